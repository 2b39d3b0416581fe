"""Uniform shuffle into shards of exact size, planned by a hypergeometric communication matrix.

Rows belong to logical partitions (buckets of a hash, so that a task that runs again sees the same ones). The
driver draws how many rows each partition sends to each shard: row sums are the partitions' counts, column sums
the shards' sizes, and the draw is multivariate hypergeometric, as for a uniform permutation of all rows. Each
partition permutes its rows and deals them out by its row of the matrix; each shard permutes what it got.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compassframe.llm.common import Scratch, documents

N_SHARDS = 40
#: Rows of a partition, or of a piece of a shard: what one sort has to hold.
ROWS_PER_PIECE = 20_000
#: Cells of the matrix; bounds the driver's memory and the broadcast (8 bytes a cell).
MAX_CELLS = 1 << 22
#: Columns that tell rows apart while they are placed.
ROW_KEYS = ("doc_id", "size", "text_crc32")


def draw(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """A hypergeometric number: how many of `taken` rows are good ones."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, taken)) if taken and good else 0
    low, high = max(0, taken - bad), min(taken, good)
    at = min(high, max(low, (taken + 1) * (good + 1) // (good + bad + 2)))
    ln = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(ln(good, at) + ln(bad, taken - at) - ln(good + bad, taken))
    u, left, right, below, above = rng.random() - p, at, at, p, p
    while u > 0 and (left > low or right < high):  # outwards from the mode, where nearly all the mass is
        if right < high:
            above *= (good - right) * (taken - right) / ((right + 1) * (bad - taken + right + 1))
            right += 1
            u -= above
            if u <= 0:
                return right
        if left > low:
            below *= left * (bad - taken + left) / ((good - left + 1) * (taken - left + 1))
            left -= 1
            u -= below
            if u <= 0:
                return left
    return at


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """counts[p] rows of partition p dealt to n_shards shards whose sizes differ by one at most."""
    rng, total = np.random.default_rng(seed), sum(counts)
    left = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = np.zeros((len(counts), n_shards), dtype=np.int64)
    for p, n in enumerate(counts):
        rest = sum(left)
        for s in range(n_shards):
            rest -= left[s]
            got = draw(rng, left[s], rest, n)
            matrix[p, s], left[s], n = got, left[s] - got, n - got
    return matrix


def place(rows: DataFrame, n_shards: int = N_SHARDS, seed: int = 20240611) -> DataFrame:
    """Adds shard and slot to rows that have the columns doc_id, size and text_crc32.

    shard is 0 to n_shards - 1; shard sizes differ by one at most; slot counts from 0 in each shard without gaps.
    Other columns travel along; columns named shard or slot are replaced. Rows that agree in all three key
    columns are alike and share the places they get. An empty table gives an empty table.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "shards")
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    keys = [F.col(c) for c in ROW_KEYS]
    total = rows.count()
    n_parts = max(1, min(math.ceil(total / ROWS_PER_PIECE), MAX_CELLS // n_shards))
    n_pieces = max(1, math.ceil(total / n_shards / ROWS_PER_PIECE))
    first = F.xxhash64(F.lit(seed), *keys)
    sent = rows.select(*kept, F.pmod(F.xxhash64(F.lit(seed + 1), *keys), F.lit(n_parts)).cast("int").alias("__part"))
    counts = dict(sent.groupBy("__part").count().collect())  # n_parts rows at most
    matrix = communication_matrix([counts.get(p, 0) for p in range(n_parts)], n_shards, seed)
    plan = spark.createDataFrame(
        [(p, [int(x) for x in row]) for p, row in enumerate(matrix.cumsum(axis=1))], "__part int, __upto array<bigint>"
    )
    order = Window.partitionBy("__part").orderBy(first, *keys)
    second = F.xxhash64(F.lit(seed + 2), *keys)
    dealt = (
        sent.withColumn("__rank", F.row_number().over(order))
        .join(F.broadcast(plan), "__part")
        .withColumn("shard", F.expr("size(filter(__upto, x -> x < __rank))"))
        .withColumn("__piece", F.floor(F.shiftrightunsigned(second, 33) * F.lit(n_pieces) / F.lit(1 << 31)).cast("int"))
        .drop("__part", "__rank", "__upto")
    )
    dealt = scratch.put(dealt, "dealt")
    before = Window.partitionBy("shard").orderBy("__piece")
    pieces = dealt.groupBy("shard", "__piece").agg(F.count("*").alias("__n")).select(
        "shard", "__piece", (F.sum("__n").over(before) - F.col("__n")).alias("__before")
    )
    if n_shards * n_pieces <= MAX_CELLS:
        pieces = F.broadcast(pieces)
    within = Window.partitionBy("shard", "__piece").orderBy(second, *keys)
    return (
        dealt.withColumn("__at", F.row_number().over(within))
        .join(pieces, ["shard", "__piece"])
        .select(*kept, "shard", (F.col("__before") + F.col("__at") - 1).cast("long").alias("slot"))
    )


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, none if null, plus 16) and text_crc32."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """One row per row of docs: where it goes under the law that shards' counts are one apart at most.

    Reads doc_id and text only; both may be null. grown_shard is null: under this law more shards move rows.
    """
    rows = Scratch(docs.sparkSession, "sized").put(sized(docs), "rows")
    return place(rows, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
