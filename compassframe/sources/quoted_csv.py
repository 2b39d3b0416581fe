"""Splittable reading of quoted CSV whose fields hold line ends.

Whether a line begins inside a quoted field follows from the parity of all quotes before it in its file. Blocks count
their quotes, the counts are summed up from the front of each file, and each task then cuts its block into records;
a doubled quote changes the parity twice, so it needs no care. What belongs to a record that began in an earlier block
leaves the task as a fragment; the fragments of a record meet by shuffle. Records are parsed by Spark's own CSV parser,
which takes a NUL for the end of its input in some places: records that hold one are parsed with the NUL spelt differently.

Files have to follow RFC 4180: quotes only around whole fields, doubled inside. A record has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compassframe.session import written
from compassframe.sources import blocks

WHOLE, TAIL, HEAD = 0, 1, 2  # a record; the start of one that goes on; the rest of one that began before


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, first (whether it is its file's first record) and record (with its inner line ends, without its last)."""
    quotes = F.octet_length("line") - F.octet_length(F.replace(F.col("line").cast("string"), F.lit('"'), F.lit("")).cast("binary"))
    names = ["file", "block", "kind", "first", "record"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, kind, quoted, count, out = None, [], WHOLE, False, 0, []

        def close(open_: bool) -> None:
            """The held lines leave: as a whole record or the rest of one, or, still open, as what has to be joined."""
            nonlocal count
            if held:
                out.append((*place, kind if kind == HEAD else TAIL if open_ else WHOLE, place[1] == 0 and count == 0 and kind != HEAD,
                            b"\n".join(held) + (b"\n" if open_ else b"")))
                count += 1
                held.clear()

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("file", "block", "inside", "line")]
            for file, block, inside, line in zip(*columns, strict=True):
                if (file, block) != place:
                    close(quoted)
                    place, quoted, count, kind = (file, block), inside, 0, HEAD if inside else WHOLE
                held.append(line)
                if line.count(b'"') % 2:
                    quoted = not quoted
                if not quoted:
                    close(False)
                    kind = WHOLE
            if out:
                yield batch_of()
                out.clear()
        close(quoted)
        if out:
            yield batch_of()

    with blocks.held(spark):
        placed = blocks.begun(blocks.lines(spark, path), quotes, "csv-quotes")
        placed = placed.select("file", "block", (F.col("begin") % 2 == 1).alias("inside"), "line")
        found = written(placed.mapInArrow(cut, "file string, block bigint, kind int, first boolean, record binary"), "csv-records")
    nth = F.sum((F.col("kind") == TAIL).cast("bigint")).over(Window.partitionBy("file").orderBy("block", F.desc("kind")))
    pieces = found.where(F.col("kind") != WHOLE).withColumn("nth", nth)  # two rows a block at most
    ordered = F.array_sort(F.collect_list(F.struct("block", (-F.col("kind")).alias("k"), "record")))
    met = pieces.groupBy("file", "nth").agg(
        F.max("first").alias("first"), F.aggregate(ordered, F.lit(b""), lambda s, x: F.concat(s, x.record)).alias("record"))
    whole = found.where(F.col("kind") == WHOLE).select("file", "first", "record").unionByName(met.select("file", "first", "record"))
    text = F.regexp_replace(F.col("record").cast("string"), r"\r?\n?\z", "")
    return whole.select("file", "first", text.alias("record")).where("first OR record <> ''")


def _respelt(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def read_csv(spark: SparkSession, path: str, columns: list[str], null: str = "") -> DataFrame:
    """The named columns, as strings, of CSV files with a header; blank lines are skipped.

    All files must have the same header. Columns that are not asked for are parsed over but not kept. A value of ``null``
    is NULL, as one that is missing is; unless that is the empty string, quoted empty strings are empty strings.
    """
    found = written(records(spark, path), "csv")
    headers = [r.record for r in found.where("first").select("record").distinct().limit(2).collect()]
    if not headers:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    if len(headers) > 1:
        raise ValueError("files have different headers")
    have = spark.range(1).select(F.split(F.regexp_replace(F.lit(headers[0]), '"', ""), ",").alias("h")).first().h
    missing = sorted(set(columns) - set(have))
    if missing:
        raise ValueError(f"source is missing required columns: {missing}")
    schema = ", ".join(f"`{c}` string" for c in have)
    parsed = F.from_csv("record", schema, {"escape": '"', "mode": "FAILFAST", "multiLine": "true", "maxCharsPerColumn": "-1", "nullValue": null})
    nul = F.contains("record", F.lit("\0"))
    spelt = F.when(nul, _respelt(F.col("record"), (("\x01", "\x011"), ("\0", "\x010")))).otherwise(F.col("record"))
    rows = found.where(~F.col("first")).select(nul.alias("nul"), spelt.alias("record")).select("nul", parsed.alias("r"))
    back = lambda c: F.when(F.col("nul"), _respelt(c, (("\x010", "\0"), ("\x011", "\x01")))).otherwise(c)
    return rows.select(*[back(F.col("r").getField(c)).alias(c) for c in columns])
