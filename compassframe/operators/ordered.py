"""Order-dependent operators that do not put one key's rows into one task.

A window partitioned by a key sends all rows of that key to one task. The operators here first cut
each key's rows into buckets of its order column, reduce every bucket with a plain aggregate, combine
the few bucket rows, and only then look inside single buckets. Buckets are a function of the row alone,
never of how it happens to be partitioned, so a retried task sees the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOT_KEYS = 256


def running_max(
    rows: DataFrame, keys: list[str], order: str, value: Column, out: str, bucket_width: int
) -> DataFrame:
    """Maximum of ``value`` over strictly earlier rows of the same key; ``order`` is unique per key."""
    marked = rows.withColumn("_value", value).withColumn("_bucket", F.floor(F.col(order) / bucket_width))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        marked.groupBy(*keys, "_bucket")
        .agg(F.max("_value").alias("_top"))
        .withColumn("_before", F.max("_top").over(across))
        .drop("_top")
    )
    return (
        marked.join(buckets, [*keys, "_bucket"])
        .withColumn(out, F.greatest(F.max("_value").over(inside), F.col("_before")))
        .drop("_value", "_bucket", "_before")
    )


def hash_rank(
    rows: DataFrame, hash60: str, out: str, groups: list[str] | None = None, bits: int = 16, tie: str | None = None
) -> DataFrame:
    """1-based rank of each row by a uniform 60-bit hash, per optional group; ``tie`` orders equal hashes.

    The top ``bits`` of the hash make the buckets: at most 2**bits per group, each holding an even
    share of the rows. Only bucket counts meet in one place.
    """
    groups = groups or []
    marked = rows.withColumn("_bucket", F.shiftright(F.col(hash60), 60 - bits))
    across = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*[c for c in (hash60, tie) if c])
    sizes = marked.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        *groups, "_bucket", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset")
    )
    return (
        marked.join(offsets, [*groups, "_bucket"])
        .withColumn(out, F.row_number().over(inside) + F.col("_offset"))
        .drop("_bucket", "_offset")
    )


def newest_n(
    rows: DataFrame, keys: list[str], at: str, tie: str, take: Column, out: str, bucket: str = "hour"
) -> DataFrame:
    """Flags the newest ``take`` rows of each key; ``take`` may use ``_total``, the key's row count.

    Rows are counted per key and calendar bucket; the bucket where the count from the newest end
    crosses ``take`` is the only one whose rows have to be ordered.
    """
    marked = rows.withColumn("_bucket", F.date_trunc(bucket, F.col(at)))
    later = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    buckets = (
        marked.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_take", take)
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.col(at).desc(), F.col(tie).desc())
    return (
        marked.join(buckets, [*keys, "_bucket"])
        .withColumn(out, F.row_number().over(inside) + F.col("_later") <= F.col("_take"))
        .drop("_bucket", "_later", "_take")
    )


def first_of_group(rows: DataFrame, key: str, order: str, carry: str, out: str, row_id: str) -> DataFrame:
    """Adds, to every row, the ``carry`` value of its group's first row by ``order``.

    The first row is found by a partial aggregate. The lookup back is a join on ``key``; rows of the
    largest groups take it from a broadcast of at most HOT_KEYS rows and are spread over all tasks in
    the shuffled join, so a key with a third of all rows is no single task's work.
    """
    firsts = rows.groupBy(key).agg(F.min_by(carry, order).alias("_first"), F.count("*").alias("_n"))
    return lookup(rows, firsts, key, "_first", out, weight="_n", row_id=row_id)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The HOT_KEYS most frequent values of ``key``; any other holds less than a 1/HOT_KEYS share."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return counts.orderBy(F.col("_n").desc(), F.col(key)).limit(HOT_KEYS).select(key)


def lookup_skewed(
    rows: DataFrame, dim: DataFrame, key: str, values: list[str], row_id: str, frequent: DataFrame | None = None
) -> DataFrame:
    """Left join of a unique-key ``dim`` to rows whose keys may be badly skewed.

    The frequent keys are counted first (map-side combined); their few ``dim`` rows are broadcast, and
    the rows that use them are spread over all tasks of the shuffled join for the others. Pass
    ``frequent`` (from ``hot_keys``) when ``rows`` is costly and its keys come from a plainer table.
    """
    packed = dim.select(key, F.struct(*values).alias("_v"))
    hot = (hot_keys(rows, key) if frequent is None else frequent).withColumn("_hot_key", F.lit(1))
    weighted = packed.join(F.broadcast(hot), key, "left").withColumn("_w", F.coalesce("_hot_key", F.lit(0)))
    joined = lookup(rows, weighted, key, "_v", "_found", weight="_w", row_id=row_id)
    return joined.select(*rows.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


def lookup(
    rows: DataFrame, dim: DataFrame, key: str, value: str, out: str, weight: str, row_id: str
) -> DataFrame:
    """Left join of a unique-key ``dim``; ``weight`` says how many rows each key has.

    Hot rows are spread by ``row_id``, not at random: a retried task must place them as before.
    """
    hot = dim.orderBy(F.col(weight).desc(), F.col(key)).limit(HOT_KEYS).select(
        key, F.col(value).alias("_hot"), F.lit(True).alias("_is_hot")
    )
    cold = dim.select(F.col(key).alias("_cold_key"), F.col(value).alias("_cold"))
    first = rows.join(F.broadcast(hot), key, "left")
    # rows without a key match nothing; they are spread like hot ones, or all would meet in one task
    spread = F.when(
        F.coalesce("_is_hot", F.lit(False)) | F.col(key).isNull(), F.concat(F.lit("\x00hot"), F.col(row_id).cast("string"))
    ).otherwise(F.col(key).cast("string"))
    return (
        first.withColumn("_join_key", spread)
        .join(cold.withColumn("_cold_key", F.col("_cold_key").cast("string")),
              F.col("_join_key") == F.col("_cold_key"), "left")
        .withColumn(out, F.when(F.col("_is_hot"), F.col("_hot")).otherwise(F.col("_cold")))
        .drop("_hot", "_is_hot", "_join_key", "_cold_key", "_cold")
    )
