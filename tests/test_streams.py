import random
from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from compassframe.functions.profile import profile
from compassframe.operators import catalog as C
from compassframe.operators import feedback as FB
from compassframe.operators import rank as R
from compassframe.operators import ratelimit as RL
from compassframe.plans import governing as G
from compassframe.plans import inputs as I
from compassframe.sources import tables as TB
from compassframe.streaming import streams as S


def landed(spark, df, path, files=3):
    df.repartitionByRange(files, df.columns[0]).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(writer, tmp_path):
    q = writer.option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_recommend_stream_equals_batch(spark, sf, tmp_path):
    req = I.requests(spark, sf).select("request_id", "prompt", "objective", "privacy")
    stream = landed(spark, req, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    keep = ["request_id", "status", "shortlist"]
    drain(S.recommend_stream(stream, C.neutral_catalog(spark), lambda df, i: df.select(*keep).write.mode("append").parquet(out)), tmp_path)
    batch = R.recommend(profile(req), C.neutral_catalog(spark)).select(*keep)
    rows = lambda df: sorted((r.request_id, r.status, str(r.shortlist)) for r in df.collect())
    assert rows(spark.read.parquet(out)) == rows(batch)


def test_feedback_stream_drops_repeats(spark, sf, tmp_path):
    fb = G._feedback(spark, sf)
    twice = fb.unionByName(fb).withColumnRenamed("feedback_id", "feedback_id")
    S_in = landed(spark, twice.select("recorded_at", "feedback_id", "recommendation_id", "payload"), str(tmp_path / "in"))
    out = str(tmp_path / "out")
    drain(S.distinct_feedback(S_in, lateness="40 days").writeStream.format("parquet").option("path", out), tmp_path)
    got = spark.read.parquet(out)
    assert got.count() == got.select("recommendation_id").distinct().count() == fb.select("recommendation_id").distinct().count()


def test_a_refused_first_row_does_not_hide_a_good_one(spark, sf, tmp_path):
    fb = G._feedback(spark, sf).select("recorded_at", "feedback_id", "recommendation_id", "payload")
    bad = fb.withColumn("recorded_at", F.col("recorded_at") - F.expr("INTERVAL 1 SECOND")).withColumn(
        "feedback_id", F.concat(F.lit("bad-"), "feedback_id")).withColumn("payload", F.col("payload").withField("outcome", F.lit(None).cast("string")))
    both = bad.unionByName(fb).orderBy("recorded_at")
    receipts = G._receipts(spark, sf)
    stream, out = landed(spark, both, str(tmp_path / "in"), files=1), str(tmp_path / "out")
    drain(S.distinct_feedback(stream, receipts, "40 days").writeStream.format("parquet").option("path", out), tmp_path)
    batch = FB.validate(both, receipts).where("rejected IS NULL")
    ids = lambda df: sorted(r.recommendation_id for r in df.collect())
    assert ids(spark.read.parquet(out)) == ids(batch) and batch.count() > 0
    assert not any(r.feedback_id.startswith("bad-") for r in spark.read.parquet(out).collect())


def test_running_signals_equal_batch(spark, sf, tmp_path):
    ev = G._usable(spark, sf).select("feedback_profile_id", "task_family", "configuration_id", "success")
    stream = landed(spark, ev, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    each = lambda df, i: S.signals_from_cells(df).write.mode("overwrite").parquet(out)
    drain(S.running_cells(stream).writeStream.outputMode("complete").foreachBatch(each), tmp_path)
    rows = lambda df: sorted(
        (r.feedback_profile_id, r.task_family, r.configuration_id, r.support, round(r.score_adjustment, 10)) for r in df.collect()
    )
    assert rows(spark.read.parquet(out)) == rows(FB.signals(ev))


def test_token_bucket_stream_equals_batch(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    ev = I.table(spark, sf, "events").select("ts", F.col("user_id").alias("client"), F.col("event_id").alias("write_id"))
    stream = landed(spark, ev, str(tmp_path / "in"), files=1)
    out = str(tmp_path / "out")
    drain(S.token_bucket_stream(stream, 2).writeStream.format("parquet").option("path", out), tmp_path)
    rows = lambda df: sorted((r.write_id, r.allowed, r.retry_after) for r in df.collect())
    assert rows(spark.read.parquet(out)) == rows(RL.token_bucket(ev, "client", "ts", "write_id", 2))


def in_files(spark, files, schema, path):
    """One micro-batch a file, in the order given."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


START = datetime(2024, 1, 1)


def test_writes_out_of_order_are_decided_as_in_batch_and_idle_keys_are_forgotten(spark, tmp_path):
    """Neighbours in time land in other batches; in the end only the mark that closes the log is in the state."""
    rng = random.Random(4)
    rows = [(rng.randrange(3), i, START + timedelta(seconds=i * 7)) for i in range(200)]
    late = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(400)))
    files = [late[:70], late[70:140], late[140:], [(99, -1, START + timedelta(days=2))], [(99, -2, START + timedelta(days=4))]]
    schema, out = "client bigint, write_id bigint, ts timestamp", str(tmp_path / "out")
    with S.rocksdb(spark):
        stream = S.ordered_token_bucket_stream(in_files(spark, files, schema, str(tmp_path / "in")), 2, "10 minutes")
        q = drain(stream.writeStream.format("parquet").option("path", out), tmp_path)
    got = spark.read.parquet(out).where("client <> 99")
    batch = RL.token_bucket(spark.createDataFrame(rows, schema), "client", "ts", "write_id", 2)
    keep = lambda df: sorted((r.client, r.write_id, r.allowed, r.retry_after) for r in df.collect())
    assert keep(got) == keep(batch) and S.late_rows(q) == 0
    last = [p for p in q.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]
    assert last["numRowsTotal"] <= 4  # of client 99 alone: its waiting mark and its timer


def test_rows_before_the_watermark_are_counted(spark, tmp_path):
    day = lambda d: START + timedelta(days=d)
    schema = "recorded_at timestamp, feedback_id string, recommendation_id string"
    files = [[(day(10), "a", "ra"), (day(9), "b", "rb")], [(day(12), "c", "rc")],
             [(day(1), "d", "rd"), (day(2), "e", "re"), (day(12), "f", "rf"), (day(1), "g", "rd")]]
    out = str(tmp_path / "out")
    stream = S.distinct_feedback(in_files(spark, files, schema, str(tmp_path / "in")), lateness="1 hour")
    q = drain(stream.writeStream.format("parquet").option("path", out), tmp_path)
    assert sorted(r.feedback_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "f"]
    assert S.late_rows(q) == 3


def test_changed_cells_give_the_batch_signals(spark, sf, tmp_path):
    ev = G._usable(spark, sf).select("feedback_profile_id", "task_family", "configuration_id", "success").limit(400)
    rows = ev.collect()
    stream, out, sizes = in_files(spark, [rows[:150], rows[150:390], rows[390:]], ev.schema, str(tmp_path / "in")), str(tmp_path / "out"), {}

    def each(df, i):
        df.write.mode("append").parquet(out)
        df.write.mode("append").parquet(out)  # a replayed batch changes nothing
        sizes[i] = df.count()

    with S.rocksdb(spark):
        drain(S.changed_cells(stream).writeStream.outputMode("update").foreachBatch(each), tmp_path)
    keep = lambda df: sorted(
        (r.feedback_profile_id, r.task_family, r.configuration_id, r.support, round(r.score_adjustment, 10)) for r in df.collect())
    assert keep(S.signals_from_changes(spark.read.parquet(out))) == keep(FB.signals(spark.createDataFrame(rows, ev.schema)))
    assert 0 < sizes[max(k for k in sizes if sizes[k])] <= 20  # ten events: ten cells and ten profiles at most


def test_a_replayed_batch_adds_no_row(spark, tmp_path):
    schema = "recorded_at timestamp, feedback_id string, recommendation_id string"
    make = lambda *rows: spark.createDataFrame([(START + timedelta(hours=h), f, r) for h, f, r in rows], schema)
    path, target = str(tmp_path / "facts"), str(tmp_path / "state")
    first = make((1, "a", "r1"), (30, "b", "r2"), (31, "n", None))
    for batch, rows in [(0, first), (1, make((2, "c", "r1"), (2, "d", "r1"))), (0, first), (2, make())]:
        TB.append_batch(rows, path, "feedback", batch)
    ids = lambda df: sorted(r.feedback_id for r in df.collect())
    assert ids(TB.read(spark, path, "feedback")) == ["a", "b", "c", "d", "n"]
    assert ids(TB.compact(spark, path, target, "feedback", "recommendation_id")) == ["b", "d"]
    assert ids(TB.compact(spark, target, target + "2", "feedback", "recommendation_id")) == ["b", "d"]


class _Counted:
    """A state that counts the messages it would exchange."""

    def __init__(self):
        self.calls, self.value = 0, None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def appendValue(self, value):
        self.calls, self.value = self.calls + 1, [*(self.value or []), value]


class _Handle:
    def __init__(self):
        self.made, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.made.setdefault(name, _Counted())

    getListState = getValueState

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_a_batch_asks_for_state_twice_however_many_cells_it_changes():
    handle, processor = _Handle(), S.CellProcessor()
    processor.init(handle)
    event = Row("task_family", "configuration_id", "success")
    for batch in range(2):
        rows = [event(f"t{i % 7}", f"c{i % 5}", None if i == 3 else i % 2 == 0) for i in range(70)]
        out = list(processor.handleInputRows(("p",), iter(rows), None))
    assert sum(s.calls for s in handle.made.values()) == 4
    cells = {(r.task_family, r.configuration_id): (r.support, r.successes) for r in out}
    assert cells[None, None] == (140, 70) and len(cells) == 36
    assert cells["t0", "c0"] == (4, 2) and cells["t3", "c3"] == (4, 2)


def test_waiting_writes_of_a_batch_are_one_element():
    handle, processor = _Handle(), S.OrderedBucketProcessor(2)
    processor.init(handle)
    write = Row("us", "write_id")
    assert list(processor.handleInputRows((1,), iter([write(5_000_000 - i, i) for i in range(50)]), None)) == []
    assert handle.made["waiting"].calls == 1 and len(handle.made["waiting"].value) == 1
    assert handle.timers == [5_001]
