"""Token-bucket decisions for a log of writes.

A bucket that has had time to fill up does not remember anything, so a key's log falls apart at every
pause of ``60 s`` or more (a full refill). The pieces are independent: they are what is distributed, not
the keys. Within a piece rows stream through the task in order with the bucket level carried from batch
to batch; no piece is held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FULL_REFILL_SECONDS = 60


def with_piece(writes: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Adds ``_piece``, the start of the run of writes a row belongs to.

    Rows first find their predecessor inside a calendar hour; only one row per key and hour, its newest,
    crosses into the next.
    """
    rows = writes.withColumn("_hour", F.date_trunc("hour", F.col(at)))
    inside = Window.partitionBy(key, "_hour").orderBy(at, tie)
    across = Window.partitionBy(key).orderBy("_hour")
    gap = F.expr(f"INTERVAL {FULL_REFILL_SECONDS} SECONDS")
    hours = rows.groupBy(key, "_hour").agg(F.max(at).alias("_newest")).withColumn(
        "_carried", F.lag("_newest").over(across)
    ).drop("_newest")
    started = (
        rows.join(hours, [key, "_hour"])
        .withColumn("_before", F.coalesce(F.lag(at).over(inside), F.col("_carried")))
        .withColumn("_start", F.when(F.col("_before").isNull() | (F.col(at) - F.col("_before") >= gap), F.col(at)))
    )
    tops = started.groupBy(key, "_hour").agg(F.max("_start").alias("_top"))
    earlier = tops.withColumn(
        "_open", F.max("_top").over(across.rowsBetween(Window.unboundedPreceding, -1))
    ).drop("_top")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        started.join(earlier, [key, "_hour"])
        .withColumn("_piece", F.coalesce(F.max("_start").over(upto), F.col("_open")))
        .drop("_hour", "_carried", "_before", "_start", "_open")
    )


def bucket_step(tokens: float, elapsed: float, capacity: float) -> tuple[float, bool, int]:
    """One write: refill, then allow if a whole token is there, else say how long to wait."""
    refill = capacity / 60.0
    tokens = min(capacity, tokens + max(0.0, elapsed) * refill)
    if tokens >= 1:
        return tokens - 1, True, 0
    return tokens, False, max(1, round((1 - tokens) / refill))


def token_bucket(writes: DataFrame, key: str, at: str, tie: str, per_minute: int) -> DataFrame:
    """(key, tie, at, allowed, retry_after) for every write, each key starting with a full bucket."""
    pieces = with_piece(writes.select(key, tie, at), key, at, tie)
    ordered = (
        pieces.withColumn("_us", F.unix_micros(F.col(at)))
        .repartition(F.col(key), F.col("_piece"))
        .sortWithinPartitions(key, "_piece", at, tie)
    )
    capacity = float(per_minute)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, last = None, capacity, 0
        for pdf in batches:
            allowed, wait = [], []
            for k, piece, us in zip(pdf[key], pdf["_piece"], pdf["_us"]):
                if (k, piece) != current:
                    current, tokens, last = (k, piece), capacity, us
                tokens, ok, retry = bucket_step(tokens, (us - last) / 1e6, capacity)
                last = us
                allowed.append(ok)
                wait.append(retry)
            yield pdf[[key, tie, at]].assign(allowed=allowed, retry_after=wait)

    kinds = dict(writes.dtypes)
    schema = f"{key} {kinds[key]}, {tie} {kinds[tie]}, {at} {kinds[at]}, allowed boolean, retry_after int"
    return ordered.mapInPandas(decide, schema)
