import pytest
from pyspark.sql import functions as F

from compassframe.operators import bootstrap as B
from compassframe.operators import evaluation as E
from compassframe.operators import policy as PO
from compassframe.operators.digest import table_digest
from compassframe.plans import evaluating as V

POOL = {"m-small": 1.0, "m-mid": 5.0, "m-big": 50.0}
WIDE = ("key string, split string, task_family string, length_band string, observations "
        "array<struct<model: string, params: double, correctness: double, tokens: bigint>>")


def rows(n, score):
    return [
        (f"k{i}", "train" if i % 3 else "validation", "code" if i % 2 else "writing", "lt_128" if i % 5 else "gte_2048",
         [(m, p, score(i, m), 10 + i % 7) for m, p in POOL.items()])
        for i in range(n)
    ]


def evidence(spark, n=180, score=None):
    score = score or (lambda i, m: {"m-small": 0.3, "m-mid": 0.5 + 0.3 * (i % 2), "m-big": 0.7}[m])
    ev = spark.createDataFrame(rows(n, score), WIDE)
    return PO.with_compute(ev, PO.maximum_compute(ev))


def test_policies_learn_from_training_rows_only(spark):
    ev = evidence(spark)
    train = ev.where("split = 'train'")
    policy = {(r.strategy, r.segment): r.choice for r in PO.fit(train, (0.2,)).collect()}
    assert policy[("always_cheapest", None)] == "m-small"
    assert policy[("always_best_quality", None)] == "m-big"
    assert policy[("task_segment", "code")] == "m-mid"
    out = PO.choices_for(ev.where("split = 'validation'"), PO.fit(train, (0.0, 0.2)), POOL)
    means = {(r["lambda"], r.strategy): r for r in E.summarize(out).collect()}
    for lam in (0.0, 0.2):
        best = means[(lam, "oracle")].mean_utility
        assert all(best >= means[(lam, s)].mean_utility - 1e-12 for s in PO.STRATEGIES)
        assert sum(means[(lam, "seeded_random")].recommendation_share.values()) == pytest.approx(1)
    unseen = ev.where("split = 'validation'").withColumn("task_family", F.lit("never-seen"))
    fallback = PO.choices_for(unseen, PO.fit(train, (0.2,)), POOL).where("strategy = 'task_segment'")
    assert {r.model for r in fallback.select("model").distinct().collect()} == {policy[("global_utility", None)]}


def test_ties_go_to_fewer_parameters_then_the_greater_name(spark):
    ev = evidence(spark, 30, lambda i, m: 0.5)
    got = {r.strategy: r.choice for r in PO.fit(ev, (0.0,)).where("segment is null").collect()}
    assert got["always_best_quality"] == got["global_utility"] == "m-small"


def test_content_blind_control_has_the_candidates_shares(spark):
    ev = evidence(spark, 120)
    cand = ev.select("key", F.when(F.pmod(F.hash("key"), F.lit(3)) == 0, "m-big").otherwise("m-mid").alias("model"))
    counts = lambda df: {r.model: r["count"] for r in df.groupBy("model").count().collect()}
    assert counts(PO.content_blind(ev, cand, "s|")) == counts(cand)


@pytest.mark.parametrize("method", ["poisson", "multinomial"])
def test_bootstrap_of_a_constant_difference_is_exact(spark, method):
    df = spark.range(8).select(F.col("id").cast("string").alias("key"), F.lit(0.1).alias("d"), F.col("id").cast("double").alias("x"))
    reps = B.resample_means(df, ["d", "x"], 100, "t", method=method)
    assert reps.count() == 100
    got = {r.metric: (r.low, r.high) for r in B.intervals(reps, ["d", "x"]).collect()}
    assert got["d"] == pytest.approx((0.1, 0.1))
    assert got["x"][0] < 3.5 < got["x"][1]


def test_percentile_rules(spark):
    df = spark.createDataFrame([([float(i) for i in range(1, 6)],)], "v array<double>")
    pick = lambda q, rule: df.select(B.percentile(F.col("v"), q, rule)).first()[0]
    assert (pick(0.3, "floor"), pick(0.3, "ceil"), pick(0.125, "round"), pick(0.375, "round")) == (2.0, 3.0, 1.0, 3.0)
    assert pick(0.95, "share") == 5.0


def test_gate_refuses_a_regressing_slice(spark):
    base = [(f"k{i}", "validation", "code", "lt_128", 0.2, s, "m", u, 0.0, u) for i in range(40) for s, u in (("hybrid_segment", 0.4), ("global_utility", 0.5))]
    out = spark.createDataFrame(base, "key string, split string, task_family string, length_band string, lambda double, strategy string, model string, correctness double, compute double, utility double")
    gate = E.segment_gate(E.summarize(out), E.slice_regressions(E.slices(out), "hybrid_segment", "global_utility")).first()
    assert gate.eligible is False and gate.regressions == 2


def test_calibration_edges(spark):
    below = 0.9 - 2**-53
    df = spark.createDataFrame([(0.9, 1.0), (below, 1.0), (1.0, 1.0), (0.0, 0.0)], "probability double, label double")
    assert {r.bin: r.n for r in E.calibration_bins(df).collect()} == {0: 1, 8: 1, 9: 2}


def test_digest_sees_changes_but_not_order(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    d = lambda x: table_digest(x, ["a", "b"]).first().digest
    assert d(df) == d(df.orderBy(F.desc("a")).repartition(7))
    assert d(df) != d(df.where("a <> '7'")) != d(df.unionByName(df.limit(1)))
    assert d(df) != d(df.withColumn("b", F.when(F.col("a") == "7", "y").otherwise("x")))


def test_policies_beyond_the_bound_are_joined(spark, sf, monkeypatch):
    rows = lambda: sorted(map(tuple, V.strategy_choices(spark, sf).collect()))
    travelling = rows()
    monkeypatch.setattr(PO, "MAX_SEGMENTS", 3)
    assert rows() == travelling and len(travelling) > 0


def test_a_group_of_one_row_can_be_resampled(spark):
    df = spark.createDataFrame([("a", "one", 1.0)] + [(str(i), "many", float(i)) for i in range(200)], "key string, g string, v double")
    reps = B.resample_means(df, ["v"], 200, "t", ["g"]).groupBy("g").count().collect()
    counts = {r.g: r["count"] for r in reps}
    assert counts["many"] == 200 and 90 < counts["one"] < 160  # no row of a resample: no mean


@pytest.mark.parametrize("weak", [0.5, 0.95, 0.99])
def test_the_gate_draws_resamples_until_its_slices_are_decided(spark, monkeypatch, tmp_path, weak):
    """Far below its floor a slice has failed after one round; on it or above, all resamples count."""
    side = spark.range(480).select(
        F.col("id").cast("string").alias("key"), F.when(F.col("id") % 2 == 0, "lt_128").otherwise("gte_2048").alias("length_band"),
        F.when(F.col("id") % 3 == 0, "code").when(F.col("id") < 2, "rare").otherwise("writing").alias("task_family"),
        *[F.lit(x).alias(c) for c, x in {"cc": 0.1, "cu": 0.9, "fc": 0.5, "fu": 0.5, "bu": 0.4, "ou": 0.95, "fq": 0.5}.items()])
    cq = F.when(F.col("task_family") == "code", 0.5 * weak).when(F.col("task_family") == "rare", 0.0).otherwise(0.5)
    side = side.withColumn("cq", cq + F.when(F.col("key") % 12 == 0, 0.01).otherwise(0.0)).localCheckpoint()
    drawn, plain = [], B.resample_means

    def spied(rows, values, reps, salt, *args, first=0, **kwargs):
        drawn.append((salt, first, reps))
        return plain(rows, values, reps, salt, *args, first=first, **kwargs)

    monkeypatch.setattr(B, "resample_means", spied)
    monkeypatch.setattr(V, "_comparison", lambda *_: side)
    got = V.confirmatory_gate(spark, str(tmp_path)).first()
    rounds = [(first, reps) for salt, first, reps in drawn if salt == "slice"]
    lows = {r.slice: r.low for r in V._slice_intervals(side).collect()}
    assert "task:code" in lows and "task:rare" not in lows
    assert got.major_slices_ok == all(low >= E.MAJOR_SLICE_FLOOR for low in lows.values()) == (weak > 0.9)
    assert rounds == ([(0, V.ROUNDS[0])] if weak < 0.9 else list(zip((0, *V.ROUNDS), V.ROUNDS)))
    assert [(first, reps) for salt, first, reps in drawn if salt == "ratio"] == [(0, V.GATE_REPS)]
