"""Keeps costly row expressions from being repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, names: list[str]) -> DataFrame:
    """Evaluates the named columns once, here.

    A filter on a derived column is pushed below the steps that derive it, and each push copies their
    expressions; a chain of steps that use each other several times grows exponentially. Passing the
    columns through a one-element explode stops that. It costs one struct per row and no shuffle, and
    filters on all other columns still reach the scan.
    """
    keep = [c for c in df.columns if c not in names]
    one = F.explode(F.array(F.struct(*names))).alias("_settled")
    return df.select(*keep, one).select(*keep, "_settled.*")
