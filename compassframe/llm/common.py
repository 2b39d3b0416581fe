"""Small helpers shared by the corpus operators: written intermediates, checked broadcasts, ids and words."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from compassframe.session import ensure_checkpoint_dir

#: Rows a side may have to be broadcast. Sides are a few dozen bytes wide, so this is some 32 MB at most.
BROADCAST_ROWS = 500_000
#: A word: a maximal run of characters other than ASCII white space. bytes.split() cuts at the same characters.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Tables written under spark.checkpoint.dir, which driver and executors share.

    A written table cuts lineage: a lost executor costs the tasks it ran, not the stages before them.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Removes a table that no later step reads."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Python workers get at most so many rows at a time from what is run inside; long texts fill memory soon."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; lower() does just that to ASCII texts, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def attach(big: DataFrame, small: DataFrame, on: Iterable[str], how: str = "left", few: bool | None = None,
           most: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a written table on columns that may be null; broadcast only if its counted rows are few.

    Beyond `most` rows it is a shuffled join, whose hot keys adaptive execution splits. A caller whose rows are
    wide says itself whether they are few.
    """
    on = list(on)
    side = small.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in small.columns if c not in on])
    if few if few is not None else small.limit(most + 1).count() <= most:
        side = F.broadcast(side)
    condition = None
    for c in on:
        equal = big[c].eqNullSafe(side[f"__{c}"])
        condition = equal if condition is None else condition & equal
    return big.join(side, condition, how).drop(*[f"__{c}" for c in on])


def held(docs: DataFrame, **keys: Column) -> DataFrame:
    """A table of whole rows, as __row, and the keys: no column of docs can clash with a key, whatever its name."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), *[k.alias(name) for name, k in keys.items()])


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def lowered_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
