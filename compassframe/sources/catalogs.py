"""Catalog documents on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from compassframe.operators.catalog import DOCUMENT_TYPE, explode_documents


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT_TYPE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_configurations(spark: SparkSession, path: str) -> DataFrame:
    return explode_documents(read_documents(spark, path))
