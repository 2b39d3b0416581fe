"""Continuous forms run over given tables: rows land in files, a stream reads all that is there, and its sinks are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from compassframe.plans import governing as G
from compassframe.plans.inputs import table
from compassframe.session import ensure_checkpoint_dir
from compassframe.sources import tables as TB
from compassframe.streaming import streams as S

FILES = 8


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/flow-{uuid.uuid4().hex}"


def _arriving(parts: list[DataFrame], key: str, folder: str) -> DataFrame:
    """The stream of what lands, part after part: a micro-batch takes as many files as a part has, oldest first."""
    for k, part in enumerate(parts):
        part.repartition(FILES, key).write.parquet(f"{folder}/landed/part={k}")
    spark, schema = parts[0].sparkSession, parts[0].schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).option("recursiveFileLookup", True)
    return files.parquet(f"{folder}/landed")


def _drain(writer: DataStreamWriter, folder: str) -> None:
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stream_token_bucket(spark, sf):
    """Decisions on all events as writes of their users, which arrive up to ten minutes out of order, 2 a minute.

    The log ends with a mark two days after its newest write, which takes the watermark past all of them.
    """
    folder = _folder(spark)
    writes = table(spark, sf, "events").select(
        F.col("user_id").cast("bigint").alias("client"), F.col("event_id").cast("bigint").alias("write_id"),
        F.col("ts").cast("timestamp").alias("ts"))
    first, last = writes.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return spark.createDataFrame([], "event_id bigint, allowed boolean, retry_after int")
    arrived = F.col("ts") + F.make_dt_interval(secs=F.pmod(F.xxhash64("write_id"), F.lit(600)))
    third = [first + (last - first) * k / 3 for k in (1, 2)]
    parts = [arrived < third[0], (arrived >= third[0]) & (arrived < third[1]), arrived >= third[1]]
    mark = writes.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("bigint").alias("client"), F.lit(-1).cast("bigint").alias("write_id"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    stream = _arriving([*[writes.where(p) for p in parts], mark], "write_id", folder)
    out = f"{folder}/decisions"
    with S.rocksdb(spark):
        _drain(S.ordered_token_bucket_stream(stream, 2).writeStream.format("parquet").option("path", out), folder)
    return spark.read.parquet(out).where(F.col("client") >= 0).select(F.col("write_id").alias("event_id"), "allowed", "retry_after")


def stream_signals(spark, sf):
    """Signals read from the changed cells that micro-batches of feedback wrote."""
    folder = _folder(spark)
    events = G._usable(spark, sf).select("feedback_id", "feedback_profile_id", "task_family", "configuration_id", "success")
    halves = [events.where(F.pmod(F.xxhash64("feedback_id"), F.lit(2)) == k) for k in (0, 1)]
    out = f"{folder}/changes"

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with S.rocksdb(spark):
        stream = S.changed_cells(_arriving(halves, "feedback_id", folder))
        _drain(stream.writeStream.outputMode("update").foreachBatch(each), folder)
    return G.signal_columns(S.signals_from_changes(spark.read.parquet(out)))


def stream_commits(spark, sf):
    """The latest feedback on each recommendation; every micro-batch is committed twice, as after a lost driver."""
    folder = _folder(spark)
    rows = TB.conform(G._feedback(spark, sf), "feedback")
    facts = f"{folder}/facts"

    def each(batch: DataFrame, batch_id: int) -> None:
        for _ in range(2):
            TB.append_batch(batch, facts, "feedback", batch_id)

    halves = [rows.where(F.pmod(F.xxhash64("feedback_id"), F.lit(2)) == k) for k in (0, 1)]
    _drain(_arriving(halves, "feedback_id", folder).writeStream.foreachBatch(each), folder)
    kept = TB.read(spark, facts, "feedback").groupBy("recommendation_id").agg(F.count("*").alias("states"))
    state = TB.compact(spark, facts, f"{folder}/state", "feedback", "recommendation_id")
    return state.join(kept, "recommendation_id").select("recommendation_id", "feedback_id", "states")


QUERIES = {f.__name__: f for f in (stream_token_bucket, stream_signals, stream_commits)}
ORACLES = {
    "stream_token_bucket": G.ORACLES["token_bucket"],
    "stream_signals": G.ORACLES["feedback_signals"],
    "stream_commits": f"""{G._FEEDBACK_SQL}
SELECT rid AS recommendation_id, arg_max(feedback_id, (recorded_at, feedback_id)) AS feedback_id, count(*) AS states FROM fb GROUP BY rid""",
}
