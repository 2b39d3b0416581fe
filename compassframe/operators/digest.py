"""Content digests of tables, independent of row order and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANES = 8


def table_digest(df: DataFrame, columns: list[str], groups: list[str] | None = None) -> DataFrame:
    """One digest per group: SHA-256 over the row count and the exact lane sums of the rows' SHA-256.

    Each row's digest is cut into eight 32-bit lanes and each lane is summed without wrap-around, an
    additive multiset hash. Sums combine map-side, so every task sends one row per group and no rows are
    gathered or sorted. Changing, adding, dropping or repeating a row changes the digest.
    """
    groups = groups or []
    row = F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in columns], F.lit("")), 256)
    lanes = [
        F.sum(F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"_l{i}") for i in range(LANES)
    ]
    sums = df.select(*groups, row.alias("_h")).groupBy(*groups).agg(F.count("*").alias("rows"), *lanes)
    whole = F.concat_ws(
        "|", F.col("rows").cast("string"), *[F.coalesce(F.col(f"_l{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(LANES)]
    )
    return sums.select(*groups, "rows", F.sha2(whole, 256).alias("digest"))
