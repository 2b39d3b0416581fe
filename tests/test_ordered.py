import random

from pyspark.sql import functions as F

from compassframe.functions.text import hash60
from compassframe.operators import catalog as C
from compassframe.operators import ordered as O
from compassframe.operators import pareto as PA
from compassframe.operators import ratelimit as RL


def test_running_max_and_hash_rank_match_plain_loops(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.randint(0, 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, n int, v int")
    got = {(r.k, r.n): r.m for r in O.running_max(df, ["k"], "n", F.col("v"), "m", 7).collect()}
    seen = {}
    for k, n, v in rows:
        assert got[(k, n)] == seen.get(k), (k, n)
        seen[k] = max(v, seen.get(k, v))
    ranked = O.hash_rank(df.withColumn("h", hash60(F.col("n").cast("string"))), "h", "r", bits=4).collect()
    assert [r.r for r in sorted(ranked, key=lambda r: r.h)] == list(range(1, 301))


def test_newest_n_flags_the_newest_rows_of_a_hot_key(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"), F.col("id"),
        F.timestamp_seconds(F.col("id") * 400 % 86400).alias("at"),
    )
    out = O.newest_n(df, ["k"], "at", "id", F.floor(F.col("_total") / 5), "new").collect()
    for k in ("hot", "cold"):
        mine = sorted((r for r in out if r.k == k), key=lambda r: (r.at, r.id))
        cut = len(mine) - len(mine) // 5
        assert [r.new for r in mine] == [False] * cut + [True] * (len(mine) - cut)


def test_first_of_group_on_a_group_with_a_third_of_all_rows(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 400)).alias("g"))
    got = {r.id: r["first"] for r in O.first_of_group(df, "g", "id", "id", "first", row_id="id").collect()}
    first = {}
    for i in range(900):
        first.setdefault("hot" if i % 3 == 0 else f"c{i % 400}", i)
    assert got == {i: first["hot" if i % 3 == 0 else f"c{i % 400}"] for i in range(900)}


def test_skyline_keeps_equal_rows_and_drops_dominated(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("xy"), rng.randint(0, 8), float(rng.randint(0, 8))) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, g string, up int, down double")
    got = {r.id for r in PA.skyline(df, ["g"], "up", "down", tiles=3).collect()}
    want = {
        i for i, g, u, d in rows
        if not any(h == g and u2 >= u and d2 <= d and (u2 > u or d2 < d) for _, h, u2, d2 in rows)
    }
    assert got == want


def test_active_version_follows_the_swap_rule(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for c in range(60):
        active = prev = None
        for a in range(rng.randint(1, 12)):
            action = rng.choice(["import", "rollback"])
            rows.append((c, a, action, f"v{a}"))
            if action == "import":
                active, prev = f"v{a}", active
            elif active is not None:
                active, prev = (prev, active) if prev is not None else (None, None)
        want[c] = active or "builtin"
    df = spark.createDataFrame(rows, "catalog_id int, arrival int, action string, catalog_version string")
    assert {r.catalog_id: r.active_version for r in C.active_versions(df, bucket_width=3).collect()} == want


def test_token_bucket_example_and_random_log(spark):
    rows = [(1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 4, 30), (2, 5, 0)]
    rng, t = random.Random(9), 0
    for i in range(400):
        t += rng.choice([0, 1, 5, 20, 59, 60, 61, 4000])
        rows.append((3, 100 + i, t))
    df = spark.createDataFrame(rows, "client int, w int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.w: (r.allowed, r.retry_after) for r in RL.token_bucket(df, "client", "ts", "w", 2).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5)] == [(True, 0), (True, 0), (False, 30), (True, 0), (True, 0)]
    tokens, last = 2.0, None
    for _, w, s in rows[5:]:
        tokens, ok, retry = RL.bucket_step(tokens, 0 if last is None else s - last, 2.0)
        last = s
        assert got[w] == (ok, retry), w
