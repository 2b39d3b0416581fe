"""Digests of files of any size: a hash tree over byte ranges, read in blocks by many tasks in constant memory.

A line belongs to the range of RANGE bytes that its first byte is in, and a range's digest is the SHA-256 of its lines.
A block's first and last range usually reach into its neighbours: their bytes, less than two ranges a block, meet by
shuffle; all others leave the task as digests. Ranges are hashed FAN by FAN up to a root with the file's size, which
does not depend on how a file was split.

A file's bytes are its lines, each with its line end but perhaps the last, and its size; the root fixes all of them. A
line has to fit into a task. Names that end in a codec's suffix are read unpacked, as everywhere in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compassframe.session import written
from compassframe.sources import blocks

RANGE, FAN = 1 << 20, 1024


def range_digests(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """file, size, range and digest for every byte range in which a line begins."""
    names = ["file", "size", "range", "at", "digest", "bytes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, held = None, [], []

        def piece() -> None:
            file, size, k, first, at, end = now
            whole = b"".join(held)
            held.clear()
            inner = first <= k * range_bytes and end >= (k + 1) * range_bytes
            out.append((file, size, k, at, sha256(whole).hexdigest() if inner else None, None if inner else whole))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("file", "size", "block", "begin", "line")]
            for file, size, block, begin, line in zip(*columns, strict=True):
                if now is None or (file, block) != place:
                    if held:
                        piece()
                    place, offset = (file, block), begin
                    now = None
                if now is None or offset // range_bytes != now[2]:
                    if held:
                        piece()
                    now = (file, size, offset // range_bytes, begin, offset, offset)
                held.append(line + b"\n")
                offset += len(line) + 1
                now = (*now[:5], offset)
            if out:
                yield batch_of()
                out.clear()
        if held:
            piece()
            yield batch_of()

    with blocks.held(spark):
        placed = blocks.begun(blocks.lines(spark, path), F.octet_length("line") + 1, "file-offsets")
        pieces = written(placed.mapInArrow(cut, "file string, size bigint, range bigint, at bigint, digest string, bytes binary"), "file-pieces")
    ordered = F.array_sort(F.collect_list(F.struct("at", "bytes")))  # a block's end and its neighbours' starts
    joined = F.aggregate(ordered, F.lit(b""), lambda s, x: F.concat(s, x.bytes))
    met = pieces.where("digest IS NULL").groupBy("file", "size", "range").agg(F.sha2(joined, 256).alias("digest"))
    return pieces.where("digest IS NOT NULL").select("file", "size", "range", "digest").unionByName(met)


def roots(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """file, size, ranges and root for all files that have bytes."""
    def up(nodes: DataFrame) -> DataFrame:
        members = F.transform(F.array_sort(F.collect_list(F.struct("range", "digest"))), lambda x: x.digest)
        return nodes.groupBy("file", F.expr(f"range div {FAN}").alias("range")).agg(
            F.sum("n").alias("n"), F.sha2(F.array_join(members, ""), 256).alias("digest"))

    top = up(up(ranges.withColumn("n", F.lit(1).cast("bigint")))).groupBy("file").agg(
        F.sum("n").alias("ranges"), F.array_sort(F.collect_list(F.struct("range", "digest"))).alias("m"))
    joined = files.join(top, "file", "left")
    body = F.coalesce(F.array_join(F.transform("m", lambda x: x.digest), ""), F.lit(""))
    return joined.select("file", "size", F.coalesce("ranges", F.lit(0)).cast("bigint").alias("ranges"),
                         F.sha2(F.concat(F.col("size").cast("string"), F.lit("|"), body), 256).alias("root"))


def file_roots(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """file, size, ranges, root: one row for each file under a path or pattern."""
    return roots(range_digests(spark, path, range_bytes), blocks.files(spark, path))


def name_in(column: str = "file") -> F.Column:
    """The last part of a path, by which manifests name files."""
    return F.element_at(F.split(column, "/"), -1)


def verify(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """file, expected, actual and problem (missing, unexpected or changed) of the files that are not as the manifest says;
    both sides are file and root."""
    joined = manifest.select("file", F.col("root").alias("expected")).join(
        actual.select("file", F.col("root").alias("actual")), "file", "full_outer")
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").otherwise("changed")
    return joined.where(~F.col("expected").eqNullSafe(F.col("actual"))).withColumn("problem", problem)


def changed_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """file and range of the byte ranges whose digests differ or that one side lacks."""
    one = before.select("file", "range", F.col("digest").alias("x")).join(
        after.select("file", "range", F.col("digest").alias("y")), ["file", "range"], "full_outer")
    return one.where(~F.col("x").eqNullSafe(F.col("y"))).select("file", "range")
