"""Resampling next to plain loops over rows and resamples."""

import math
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compassframe.operators import bootstrap as B

REPS = 37


def weight(salt, rep, key):
    digits = sha256(f"{salt}|{rep // B.LANES}|{key}".encode()).hexdigest()[8 * (rep % B.LANES):][:8]
    return sum(digits >= cut for cut in B.POISSON_CUTS)


def means(rows, reps, salt):
    """rows of (key, groups, value); value None adds nothing."""
    n, total = defaultdict(int), {}
    for key, groups, value in rows:
        for rep in range(reps):
            w = weight(salt, rep, key)
            for g in groups if w else []:
                n[g, rep] += w
                if value is not None:
                    total[g, rep] = total.get((g, rep), 0.0) + w * value
    return {at: total[at] / n[at] if at in total else None for at in n}


@pytest.mark.parametrize("held", [None, 1])
def test_poisson_means_of_opened_groups_equal_a_loop(spark, monkeypatch, held):
    if held:  # every group leaves the task as soon as another one comes
        monkeypatch.setattr(B, "HELD_SUMS", held)
        monkeypatch.setattr(B, "HELD_WEIGHTS", held)
    rows = [(f"k{i}", [g for g in "abc" if (i + ord(g)) % 3] + (["few"] if i == 7 else []),
             None if i % 5 == 0 else float(i)) for i in range(60)]
    rows += [("none", [], 1.0), ("odd", ["only-null"], None), ("k1", ["a", "a"], 2.0)]
    df = spark.createDataFrame(rows, "key string, g array<string>, v double")
    got = {(r.g, r.rep): r.v for r in B.resample_means(df, ["v"], REPS, "s", ["g"], drawn_by="g").collect()}
    want = means(rows, REPS, "s")
    assert got.keys() == want.keys()
    for at, value in want.items():
        assert got[at] == (value if value is None else pytest.approx(value)), at


def test_infinite_values_stay_out_of_resamples_that_do_not_draw_them(spark):
    df = spark.createDataFrame([("a", math.inf), ("b", 1.0), ("c", 2.0)], "key string, v double")
    got = {r.rep: r.v for r in B.resample_means(df, ["v"], REPS, "s").collect()}
    for rep, value in got.items():
        assert math.isinf(value) == (weight("s", rep, "a") > 0)


def test_tables_without_rows_have_no_resamples(spark):
    df = spark.createDataFrame([], "key string, v double")
    for method in ("poisson", "multinomial"):
        assert B.resample_means(df, ["v"], 3, "s", method=method).count() == 0


def test_bucket_draws_add_up_to_the_rows():
    sizes = np.array([5, 0, 17, 1, 0, 40, 2])
    draws = np.stack([B.bucket_draws(sizes, b, 4000, "s") for b in range(len(sizes))])
    assert (draws.sum(axis=0) == sizes.sum()).all()
    assert (draws[sizes == 0] == 0).all()
    assert np.abs(draws.mean(axis=1) - sizes).max() < 0.4
    share = sizes / sizes.sum()
    assert draws.var(axis=1) == pytest.approx(sizes.sum() * share * (1 - share), rel=0.1, abs=0.05)


def test_multinomial_resamples_draw_exactly_n_rows_and_repeat(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") == 3, 200.0).otherwise(0.0).alias("v"),
                                 F.lit(1.0).alias("one"))
    runs = [{r.rep: (r.v, r.one) for r in B.resample_means(x, ["v", "one"], 2000, "s", method="multinomial").collect()}
            for x in (df, df.orderBy(F.desc("v")).repartition(3))]
    assert runs[0] == runs[1] and len(runs[0]) == 2000
    times = np.array([v for v, _ in runs[0].values()])  # the mean times n over 200: how often row 3 was drawn
    assert (times == times.round()).all() and {one for _, one in runs[0].values()} == {1.0}
    assert times.mean() == pytest.approx(1.0, abs=0.1) and times.var() == pytest.approx(1.0, abs=0.15)


def test_multinomial_sends_no_draws_through_exchanges(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("key"), F.lit(1.0).alias("v"))
    plan = B.resample_means(df, ["v"], 50, "s", method="multinomial")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_digests_come_from_spark_and_follow_the_order_of_the_blocks(spark):
    reps = 8 * 23 + 3  # three rows of ten blocks each, the last one not full
    rows = [(f"k{i}", [], float(i)) for i in range(30)]
    df = spark.createDataFrame([(k, v) for k, _, v in rows], "key string, v double")
    out = B.resample_means(df, ["v"], reps, "s")
    assert "sha2(" in out._jdf.queryExecution().optimizedPlan().toString()
    want = means([(k, ["all"], v) for k, _, v in rows], reps, "s")
    assert {("all", r.rep): pytest.approx(r.v) for r in out.collect()} == want


def test_rows_without_a_key_draw_from_salt_and_block_alone(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 2.0)], "key string, v double")
    got = {r.rep: r.v for r in B.resample_means(df, ["v"], 24, "s").collect()}
    for rep in range(24):
        digits = sha256(f"s|{rep // B.LANES}".encode()).hexdigest()[8 * (rep % B.LANES):][:8]
        w = [sum(digits >= cut for cut in B.POISSON_CUTS), weight("s", rep, "a")]
        assert got.get(rep) == (pytest.approx((w[0] + 2 * w[1]) / sum(w)) if sum(w) else None)


def test_weights_next_to_every_threshold():
    cuts = [int(c, 16) for c in B.POISSON_CUTS]
    near = [0, 1, 2**32 - 1, *[min(c + d, 2**32 - 1) for c in cuts for d in range(-3, 4)]]
    near += [0] * (-len(near) % (B.LANES * B.TENS))
    digits = [f"{x:08x}" for x in near]
    rows = ["".join(digits[k:k + B.LANES * B.TENS]) for k in range(0, len(near), B.LANES * B.TENS)]
    batch = pa.record_batch({"v": pa.array([0.0] * 2 * len(rows)), "_digests": pa.array(2 * rows)})
    (_, got), = B.poisson_weights(len(near))(iter([batch]))
    assert got.tolist() == 2 * [[float(sum(d >= cut for cut in B.POISSON_CUTS)) for d in digits]]


def test_resamples_in_rounds_are_the_same_resamples(spark):
    df = spark.createDataFrame([(f"k{i}", float(i), ["a", "b"][i % 2:]) for i in range(20)], "key string, v double, g array<string>")
    draw = lambda reps, first: {(r.g, r.rep): r.v for r in B.resample_means(
        df, ["v"], reps, "s", ["g"], drawn_by="g", first=first).collect()}
    whole, parts = draw(250, 0), [draw(80, 0), draw(160, 80), draw(250, 160)]
    assert {k for _, k in parts[1]} == set(range(80, 160)) and {k for _, k in parts[2]} == set(range(160, 250))
    assert {at: pytest.approx(v) for p in parts for at, v in p.items()} == whole
    with pytest.raises(ValueError, match="rounds"):
        B.resample_means(df, ["v"], 250, "s", first=100)


def test_lows_of_some_resamples_are_never_below_those_of_all(spark):
    rng = np.random.default_rng(5)
    for rule in ("floor", "round", "ceil", "share"):
        values = rng.integers(0, 40, 400) / 40.0
        df = spark.createDataFrame([("g", k, float(v)) for k, v in enumerate(values)], "g string, rep int, v double")
        low = B.intervals(df, ["v"], ["g"], (rule, rule)).first().low
        tops = {n: B.lows_at_most(df.where(F.col("rep") < n), ["v"], ["g"], 400, rule).first().low for n in (5, 50, 200, 400)}
        assert tops[5] is None and tops[50] >= tops[200] >= tops[400] == low
        less = df.where(F.col("rep") % 3 != 0)  # some resamples drew no row of the group
        assert B.lows_at_most(less.where(F.col("rep") < 200), ["v"], ["g"], 400, rule).first().low >= B.intervals(less, ["v"], ["g"], (rule, rule)).first().low
