"""Lines of large files in file order, block by block, as a base for whole-file work that needs no whole file in a task.

A block is what Spark reads as one split through the Hadoop file system. Its lines arrive in order in one task, so a
task can carry a state through a block; what a block does to the state is summed up in one row, and the rows of a
file's blocks, combined from the front, give every block the state it begins with.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compassframe.session import written

#: Blocks whose states travel to all tasks at most; some 60 TB in blocks of 128 MB. More files go in several calls.
MOST_BLOCKS = 500_000


def lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """file, block (its first byte), size (of the file) and line (bytes without the separator), in file order."""
    read = spark.read.option("lineSep", separator).text(path)
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))


@contextmanager
def held(spark: SparkSession) -> Iterator[None]:
    """Every scan in here cuts its files into the same blocks; else their size changes with the cores Spark has just then."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(name)


def begun(read: DataFrame, part: Column, name: str) -> DataFrame:
    """The lines with `begin`: the sum of part over all lines in earlier blocks of their file.

    Call it, and run what it returns, inside `held`: the lines are read once for the sums and once for the result.
    """
    sums = read.groupBy("file", "block").agg(F.sum(part).alias("_sum"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sums.select("file", "block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("begin")), name)
    blocks = starts.count()
    if blocks > MOST_BLOCKS:
        raise ValueError(f"{blocks} blocks at once; give fewer files")
    starts = F.broadcast(starts.withColumnsRenamed({"file": "_file", "block": "_block"}))  # keeps the lines' order
    placed = read.join(starts, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")), "left")
    known = F.coalesce("begin", F.raise_error(F.concat(F.lit("block without a state: "), "file", F.lit(" "), "block")).cast("bigint"))
    return placed.drop("_file", "_block").withColumn("begin", known)


def files(spark: SparkSession, path: str) -> DataFrame:
    """file and size of all files that have bytes (Spark does not list empty ones); contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
