"""Continuous forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from compassframe.functions.profile import profile
from compassframe.operators import feedback as fb
from compassframe.operators.rank import recommend
from compassframe.operators.ratelimit import FULL_REFILL_SECONDS, bucket_step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DROPPED = "numRowsDroppedByWatermark"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which operators with several kinds of state need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def recommend_stream(requests: DataFrame, catalog: DataFrame, write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Profiles and ranks every micro-batch with the batch functions.

    Each decision is a function of its own row, so there is no state. The catalog is read per batch,
    hence a newly accepted version takes effect without a restart.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        write(recommend(profile(batch), catalog), batch_id)

    return requests.writeStream.foreachBatch(each)


def distinct_feedback(feedback: DataFrame, receipts: DataFrame | None = None, lateness: str = "1 hour") -> DataFrame:
    """First feedback per recommendation within the watermark; later copies are dropped.

    With receipts, feedback that the batch rules refuse is left out before copies are looked for, as in
    batch: a refused first row does not stand in the way of a good second one.
    """
    at = feedback.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    if receipts is not None:
        at = fb.checked_alone(at, receipts).where(F.col("_problem").isNull()).select(*feedback.columns)
    return at.withWatermark("recorded_at", lateness).dropDuplicatesWithinWatermark(["recommendation_id"])


def late_rows(query: StreamingQuery) -> int:
    """How many rows the watermark has kept out of a query's state, over the batches it still reports.

    The progress of the last ``spark.sql.streaming.numRecentProgressUpdates`` batches is kept; a listener may add
    up ``late_rows_of`` for a query that runs longer.
    """
    return sum(late_rows_of(progress) for progress in query.recentProgress)


def late_rows_of(progress) -> int:
    """The same of one batch's progress."""
    return sum(operator[DROPPED] for operator in progress["stateOperators"])


def running_cells(events: DataFrame) -> DataFrame:
    """Outcome counts per (profile, task, configuration), for update or complete mode."""
    return events.groupBy("feedback_profile_id", "task_family", "configuration_id").agg(
        F.count("*").alias("support"), F.sum(F.col("success").cast("int")).alias("successes")
    )


def signals_from_cells(cells: DataFrame, minimum_support: int = fb.MINIMUM_SUPPORT) -> DataFrame:
    """Signals of the current counts (complete mode, inside foreachBatch)."""
    ones = cells.select("feedback_profile_id", "task_family", "configuration_id", "support", "successes")
    profiles = ones.groupBy("feedback_profile_id").agg(
        fb._rate(F.sum("successes"), F.sum("support")).alias("global_rate")
    )
    return fb.score_cells(ones, profiles, minimum_support)


class BucketProcessor(StatefulProcessor):
    """Token bucket per key; the state is two numbers."""

    def __init__(self, per_minute: int):
        self.capacity = float(per_minute)

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("updated_us", T.LongType())])
        self.bucket = handle.getValueState("bucket", kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        tokens, last = self.bucket.get() if self.bucket.exists() else (self.capacity, None)
        pdf = pd.concat(list(rows)).sort_values(["us", "write_id"])
        out = []
        for write_id, us in zip(pdf["write_id"], pdf["us"]):
            us = int(us)
            tokens, ok, retry = bucket_step(tokens, 0.0 if last is None else (us - last) / 1e6, self.capacity)
            last = us if last is None else max(last, us)
            out.append((key[0], int(write_id), us, bool(ok), int(retry)))
        if last is not None:
            self.bucket.update((float(tokens), int(last)))
        yield pd.DataFrame(out, columns=["client", "write_id", "us", "allowed", "retry_after"])

    def close(self) -> None:
        pass


def token_bucket_stream(writes: DataFrame, per_minute: int) -> DataFrame:
    """Decisions for a stream of (client, write_id, ts); needs the RocksDB state store."""
    keyed = writes.select("client", "write_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    schema = "client bigint, write_id bigint, us bigint, allowed boolean, retry_after int"
    return keyed.groupBy("client").transformWithStateInPandas(
        statefulProcessor=BucketProcessor(per_minute), outputStructType=schema, outputMode="Append", timeMode="None"
    )


_cell = Row("feedback_profile_id", "task_family", "configuration_id", "support", "successes")
_decision = Row("client", "write_id", "us", "allowed", "retry_after")


class CellProcessor(StatefulProcessor):
    """Outcome counts of a profile's cells; a batch's changed cells and the profile's totals go out.

    A profile's cells, task families times configurations at most, are one state value: each call for state is an
    exchange of messages with the JVM, so a batch makes two for a profile, not some for each of its cells.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        names = "task_family array<string>, configuration_id array<string>"
        self.cells = handle.getValueState("cells", f"{names}, support array<bigint>, successes array<bigint>")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        before = self.cells.get()
        cells = {(t, c): (n, k) for t, c, n, k in zip(*before, strict=True)} if before else {}
        changed = set()
        for row in rows:
            cell = row.task_family, row.configuration_id
            support, successes = cells.get(cell, (0, 0))
            cells[cell] = support + 1, successes + int(row.success or 0)
            changed.add(cell)
        columns = [list(c) for c in zip(*((*cell, *n) for cell, n in cells.items()), strict=True)]
        self.cells.update(tuple(columns))
        for cell in changed:
            yield _cell(key[0], *cell, *cells[cell])
        yield _cell(key[0], None, None, sum(columns[2]), sum(columns[3]))

    def close(self) -> None:
        pass


def changed_cells(events: DataFrame) -> DataFrame:
    """Counts that a batch changed, in update mode: rows out are bounded by the batch, whatever the state holds.

    (feedback_profile_id, task_family, configuration_id, support, successes); a profile's totals have neither task nor
    configuration. Events without a task or configuration are left out, as they are nobody's signal. Counts only grow,
    so the row of largest support is a cell's newest: a sink may keep repeats of a replayed batch.
    """
    known = events.select("feedback_profile_id", "task_family", "configuration_id", "success").where(
        F.col("task_family").isNotNull() & F.col("configuration_id").isNotNull())
    schema = "feedback_profile_id string, task_family string, configuration_id string, support bigint, successes bigint"
    return known.groupBy("feedback_profile_id").transformWithState(
        statefulProcessor=CellProcessor(), outputStructType=schema, outputMode="Update", timeMode="None")


def signals_from_changes(changes: DataFrame, minimum_support: int = fb.MINIMUM_SUPPORT) -> DataFrame:
    """Signals of the newest counts among all changes written so far."""
    key = ["feedback_profile_id", "task_family", "configuration_id"]
    newest = changes.groupBy(*key).agg(F.max(F.struct("support", "successes")).alias("n")).select(*key, "n.*")
    profiles = newest.where(F.col("task_family").isNull()).select(
        "feedback_profile_id", fb._rate(F.col("successes"), F.col("support")).alias("global_rate"))
    return fb.score_cells(newest.where(F.col("task_family").isNotNull()), profiles, minimum_support)


class OrderedBucketProcessor(StatefulProcessor):
    """Token bucket per key in the order of event time, whatever the order of arrival.

    Writes wait in a list until the watermark has passed them. A timer stands at the oldest one that waits; when none
    does, at the moment the bucket is full again, which is the state of a key never seen: then all is forgotten.
    """

    def __init__(self, per_minute: int):
        self.capacity = float(per_minute)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one element a batch: each element costs its own serialisation on both sides
        self.waiting = handle.getListState("waiting", "us array<bigint>, write_id array<bigint>")
        self.bucket = handle.getValueState("bucket", "tokens double, updated_us bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        us, ids = zip(*((row.us, row.write_id) for row in rows), strict=True)
        self.waiting.appendValue((list(us), list(ids)))
        self.wake(min(us))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(r for us, ids in self.waiting.get() for r in zip(us, ids, strict=True))
        due = [r for r in rows if r[0] <= passed]
        rest = rows[len(due):]
        tokens, last = self.bucket.get() or (self.capacity, None)
        for us, write_id in due:
            tokens, ok, retry = bucket_step(tokens, 0.0 if last is None else (us - last) / 1e6, self.capacity)
            last = us
            yield _decision(key[0], write_id, us, bool(ok), int(retry))
        if rest and due:
            self.waiting.put([tuple(list(c) for c in zip(*rest, strict=True))])
        elif due:
            self.waiting.clear()
        full_at = None if last is None else last + FULL_REFILL_SECONDS * 1_000_000
        if full_at is not None and full_at <= passed:
            self.bucket.clear()
            full_at = None
        elif last is not None:
            self.bucket.update((float(tokens), int(last)))
        wake = rest[0][0] if rest else full_at
        if wake is not None:
            self.wake(wake)

    def wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000) + 1)

    def close(self) -> None:
        pass


def ordered_token_bucket_stream(writes: DataFrame, per_minute: int, lateness: str = "10 minutes") -> DataFrame:
    """Decisions for a stream of (client, write_id, ts) as the batch operator makes them, once the watermark passed.

    Writes may come in any order within the lateness; later ones are dropped and counted (``late_rows``). State holds
    the undecided writes and the buckets that are not full: a key without writes for a minute leaves it. Needs RocksDB.
    """
    timed = writes.select("client", "write_id", F.col("ts").cast("timestamp").alias("ts")).where(F.col("ts").isNotNull())
    keyed = timed.withColumn("us", F.unix_micros("ts")).withWatermark("ts", lateness)
    schema = "client bigint, write_id bigint, us bigint, allowed boolean, retry_after int"
    return keyed.groupBy("client").transformWithState(
        statefulProcessor=OrderedBucketProcessor(per_minute), outputStructType=schema, outputMode="Append", timeMode="EventTime")
