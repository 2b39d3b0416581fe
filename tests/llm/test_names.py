"""Stages that return the columns of documents leave other columns alone, whatever their names and types."""

import random

from pyspark.sql import functions as F
from tests.llm.conftest import prose
from tests.llm.llm_helpers import rows_of

from compassframe.llm import decontamination, jaccard_join, linear_quality, mixing

NAMES = ["tie", "text_hash", "__total", "__rows", "__nth", "__times", "__row", "total", "rows", "nth", "times", "Root", "CID", "bucket", "class_id", "__doc_id"]


def table(spark, docs):
    plain = spark.createDataFrame([(d, t, s) for d, t, s in docs], "doc_id bigint, text string, source string")
    extra = [F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in NAMES]
    return plain.select("*", *extra, F.create_map(F.lit("k"), F.col("doc_id")).alias("A map"), F.parse_json(F.lit('{"a": 1}')).alias("v.ariant"),
                        F.encode(F.col("text"), "UTF-8").alias("raw"), F.array(F.struct(F.lit(1).alias("tie"))).alias("nested"))


def values(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text or "", *[r[n] for n in NAMES], r["A map"] and r["A map"]["k"]) for r in rows_of(df))


def test_columns_of_any_name_and_type_keep_their_values(spark):
    rng = random.Random(1)
    docs = [(k, prose(k % 30, 30 + k % 9), "ab"[k % 2]) for k in range(80)] + [(None, prose(1, 40), "a"), (200, None, None), (201, "", "b")]
    docs += docs[:7]
    rng.shuffle(docs)
    given = table(spark, docs)
    have = values(given)
    items = spark.createDataFrame([(1, prose(3, 20))], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    for stage in (lambda d: decontamination.drop_contaminated(d, items), jaccard_join.keep_one_each, mixing.take, lambda d: linear_quality.keep_good(d, labels)):
        out = stage(given)
        assert out.columns == given.columns and out.dtypes == given.dtypes
        got = values(out)
        assert got and set(map(str, got)) <= set(map(str, have))


def test_take_shares_out_copies_of_equal_rows(spark):
    docs = [(1, "a b c", "x")] * 5 + [(2, "d e f", "y")]
    once, again = values(mixing.take(table(spark, docs))), values(mixing.take(table(spark, docs).repartition(3)))
    assert once == again and len(once) > 0
