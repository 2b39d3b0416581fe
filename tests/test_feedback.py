import pytest
from pyspark.sql import functions as F

from compassframe.operators import feedback as FB
from compassframe.operators import retention as RT
from compassframe.operators import vectors as VE
from compassframe.sources import tables as T

EVENTS = "feedback_id string, recommendation_id string, recorded_at timestamp, feedback_profile_id string, task_family string, configuration_id string, success boolean"


def events(spark, rows):
    data = [(f"f{i:03d}", f"r{i}", i, p, t, c, s) for i, (p, t, c, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "feedback_id string, recommendation_id string, n int, feedback_profile_id string, task_family string, configuration_id string, success boolean")
    return df.withColumn("recorded_at", F.timestamp_seconds(F.col("n") * 10)).drop("n")


def test_signals_support_bounds_and_isolation(spark):
    ev = events(spark, [("a", "writing", "c", True)] * 4 + [("b", "writing", "c", True)] * 10 + [("z", "writing", "c", False)] * 20)
    s = {r.feedback_profile_id: r for r in FB.signals(ev).collect()}
    assert s["a"].support == 4 and not s["a"].applied and s["a"].score_adjustment == 0
    assert s["b"].applied and 0 < s["b"].score_adjustment <= 0.04
    assert s["z"].score_adjustment == pytest.approx(-0.04)


def test_replay_decisions(spark):
    ev = events(
        spark,
        [("ten", "writing", "c", True)] * 10
        + [("few", "writing", "c", True)] * 9
        + [("bad", "code", "c", True)] * 5 + [("bad", "writing", "c", False)] * 5 + [("bad", "writing", "c", True)] * 2,
    )
    r = {x.feedback_profile_id: x for x in FB.replay(ev).collect()}
    assert r["few"].decision == "insufficient_data" and r["few"].training_count == 0
    assert (r["ten"].training_count, r["ten"].holdout_count, r["ten"].decision) == (8, 2, "promoted")
    assert r["ten"].baseline_brier == pytest.approx(0.01235, abs=1e-5)
    assert r["ten"].candidate_brier == pytest.approx(0.00381, abs=1e-5)
    assert r["bad"].decision == "rejected" and not r["bad"].bias_guard_passed
    m = r["bad"].slice_metrics["writing"]
    assert m.candidate_brier > m.baseline_brier


def test_undecidable_constraints_refuse(spark):
    from compassframe.operators import catalog as C
    from compassframe.operators import rank as R

    cat = C.neutral_catalog(spark).withColumn("privacy", F.when(F.col("configuration_id") != "birch-lite", F.col("privacy")))
    req = spark.createDataFrame([("q", "code", 0.2, 100, ["text"], [], None, None)],
                                "request_id string, task_family string, uncertainty double, estimated_input_tokens int, "
                                "required_capabilities array<string>, privacy_flags array<string>, privacy string, objective string")
    now = F.lit("2024-02-20").cast("timestamp")
    dated = cat.withColumn("observed_at", F.lit("2024-01-01").cast("timestamp")).withColumn("expires_at", F.lit("2024-03-01").cast("timestamp"))
    row = R.recommend(req, dated.withColumn("disclaimer", F.lit("estimates")), now).first()
    refused = {c.configuration_id: c.rejected_by for c in row.assessed}
    assert "privacy" in refused["birch-lite"] and "privacy" in refused["cedar-coder"]  # NULL privacy means no_training
    assert row.shortlist[0].warning_codes[:2] == ["catalog_disclaimer", "catalog_aging"]
    assert row.shortlist[0].evidence[0].url.startswith("https://") and row.shortlist[0].model_id
    assert "catalog_disclaimer" not in R.recommend(req, cat).first().shortlist[0].warning_codes


def test_validation_reasons(spark):
    receipts = spark.createDataFrame([("r1", ["a", "b"]), ("r2", ["a", "b"])], "recommendation_id string, selected_configuration_ids array<string>")
    rows = [
        ("f1", "r1", 2, (True, "a", "worked", None, None, None, "b")),
        ("f2", "r1", 1, (True, "b", "worked", None, None, None, None)),
        ("f3", "r2", 1, (True, "c", "worked", None, None, None, None)),
        ("f4", "r2", 2, (True, None, "worked", None, None, None, "a")),
        ("f5", "r2", 3, (False, "a", "unknown", None, None, None, None)),
        ("f6", "r9", 4, (True, "a", "worked", None, None, None, None)),
        ("f7", "r2", 5, (True, "a", "worked", 9, None, None, None)),
        ("f8", "r2", 6, (False, None, "unknown", None, None, None, None)),
        ("f9", "r2", 7, (True, "a", "worked", 5, 0.1, 3, "a")),
        ("g1", "r2", 8, (True, "a", "did_not_work", 5, 0.1, 3, "b")),
        ("g2", "r2", 0, (None, "a", "worked", 5, 0.1, 3, None)),
        ("g3", "r2", 0, (True, "a", None, 5, 0.1, 3, None)),
    ]
    fb = spark.createDataFrame(rows, "feedback_id string, recommendation_id string, n int, " + T.FEEDBACK.split("recorded_at timestamp, ")[1])
    fb = fb.withColumn("recorded_at", F.timestamp_seconds("n")).drop("n")
    got = {r.feedback_id: r.rejected for r in FB.validate(fb, receipts).collect()}
    assert got == {
        "f1": "duplicate_feedback", "f2": None, "f3": "used_not_in_shortlist", "f4": "used_without_configuration",
        "f5": "configuration_without_use", "f6": "unknown_recommendation", "f7": "quality_rating_range",
        "f8": "pairwise_same_configuration", "f9": "pairwise_same_configuration", "g1": None,
        "g2": "missing_used_recommendation", "g3": "missing_outcome",
    }
    assert {r.rejected for r in FB.validate(fb, receipts, enabled=False).collect()} == {"feedback_disabled"}


def test_retention_keeps_old_receipts_with_recent_feedback(spark):
    days = lambda n: F.lit("2024-06-01").cast("timestamp") - F.make_interval(days=F.lit(n))
    r = spark.createDataFrame([("old", 100), ("kept", 100), ("new", 2)], "recommendation_id string, d int").withColumn("created_at", F.lit("2024-06-01").cast("timestamp") - F.make_interval(days="d"))
    f = spark.createDataFrame([("kept", 1), ("old", 90)], "recommendation_id string, d int").withColumn("recorded_at", F.lit("2024-06-01").cast("timestamp") - F.make_interval(days="d"))
    runs = r.select("created_at")
    out = {x.table: x.deleted for x in RT.purge_counts(r, f, runs, runs, RT.cutoff(F.lit("2024-06-01").cast("timestamp"), 30)).collect()}
    assert out == {"feedback": 1, "receipts": 1, "benchmarks": 2, "promotions": 2}
    kept = RT.purge(r, f, runs, runs, days(30))
    assert {x.recommendation_id for x in kept["receipts"].collect()} == {"kept", "new"}
    left = RT.delete_feedback(f.withColumn("feedback_id", F.col("recommendation_id")), f.select(F.lit("kept").alias("feedback_id")))
    flags = {x.recommendation_id: x.feedback_received for x in RT.with_feedback_received(r, left).collect()}
    assert flags == {"old": True, "kept": False, "new": False}
    empty, count = RT.reset_feedback(f)
    assert empty.count() == 0 and count.first().deleted == 2
    with pytest.raises(ValueError):
        RT.cutoff(F.lit(None), 0)


def test_assessment_merge_and_fallback(spark):
    good = '{"task_family":"code","difficulty":"high","required_capabilities":["text","code"],"privacy_flags":["email"],"confidence":0.91,"reason_codes":["semantic"]}'
    cases = [
        ("ok", "always", f"noise {good} noise"), ("bad", "always", "not-json"), ("off", "off", good), ("calm", "auto", good),
        ("extra", "always", good[:-1] + ',"surprise":1}'), ("short", "always", '{"task_family":"code","difficulty":"low","confidence":0.5}'),
        ("none", "always", None),
    ]
    df = spark.createDataFrame(cases, "id string, assessor_mode string, assessment string").select(
        "*", F.lit("general").alias("task_family"), F.lit("medium").alias("difficulty"), F.array(F.lit("text")).alias("required_capabilities"),
        F.array().cast("array<string>").alias("privacy_flags"), F.lit(0.5).alias("uncertainty"), F.array(F.lit("base")).alias("reason_codes"),
    )
    out = {r.id: r for r in VE.merge(df).collect()}
    assert (out["ok"].task_family, out["ok"].difficulty, out["ok"].privacy_flags) == ("code", "high", ["email"])
    assert out["ok"].uncertainty == pytest.approx(0.09) and out["ok"].reason_codes == ["base", "semantic"]
    for name, status in (("bad", "invalid_output"), ("off", "disabled"), ("calm", "not_needed"), ("extra", "invalid_output"), ("none", "unavailable")):
        assert out[name].assessor_status == status and out[name].task_family == "general" and out[name].uncertainty == 0.5
    assert out["short"].assessor_status == "completed" and out["short"].task_family == "general"


def test_bad_vectors_are_not_classified(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 2.0], 1), (2, [0.0, 0.0], None), (3, [float("nan"), 1.0], None), (4, [1.0], None), (5, [0.9, 0.1], None)]
    df = spark.createDataFrame(rows, "id int, v array<double>, label int")
    book = VE.prototype_book(VE.prototypes(df.where("label is not null"), "v", "label", 2), "label")
    got = {r.id: r.predicted for r in VE.nearest_prototype(df, "v", book, 2).collect()}
    several = [book, book]
    assert got == {r.id: r.predicted for r in VE.nearest_prototype(df, "v", several[:1], 2).collect()}
    assert got == {0: 0, 1: 1, 2: None, 3: None, 4: None, 5: 0}


def test_signals_reach_the_score_of_a_hot_profile(spark):
    from compassframe.functions.profile import profile
    from compassframe.operators import catalog as C
    from compassframe.operators import rank as R

    ev = events(spark, [("hot", "writing", "cedar-writer", True)] * 20 + [("hot", "writing", "alder-core", False)] * 20)
    req = profile(
        spark.range(30).select(
            F.concat(F.lit("r"), "id").alias("request_id"), F.lit("Draft a warm welcome note for the new members.").alias("prompt"),
            F.when(F.col("id") < 20, "hot").when(F.col("id") < 25, "cold").alias("feedback_profile_id"),
        )
    )
    out = R.recommend(FB.attach_signals(req, FB.signals(ev)), C.neutral_catalog(spark)).collect()
    assert len(out) == 30
    for r in out:
        parts = {c.configuration_id: c.feedback_part for c in r.ranked}
        if r.feedback_profile_id == "hot":
            assert parts["cedar-writer"] > 0 > parts["alder-core"] and parts["birch-pro"] is None
        else:
            assert set(parts.values()) == {None}


def test_many_prototypes_are_scored_in_blocks(spark, monkeypatch):
    import random

    from compassframe.operators import vectors as VE

    rng = random.Random(1)
    point = lambda: [rng.uniform(-1, 1) for _ in range(3)]
    rows = spark.createDataFrame([(i, f"l{i % 40}", point()) for i in range(200)], "id int, label string, v array<double>")
    protos = VE.prototypes(rows, "v", "label", 3)
    one = {r.id: (r.predicted, r.margin) for r in VE.nearest_prototype(rows, "v", VE.prototype_book(protos, "label"), 3).collect()}
    monkeypatch.setattr(VE, "MAX_PROTOTYPES", 20)
    books = VE.prototype_books(protos, "label")
    assert len(books) == 4
    assert one == {r.id: (r.predicted, r.margin) for r in VE.nearest_prototype(rows, "v", books, 3).collect()}
