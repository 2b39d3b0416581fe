import random

import numpy as np
from pyspark.sql import functions as F
from tests.llm.llm_helpers import rows_of

from compassframe.llm import neighbour_graph as ng


def brute(table, every):
    ok = [(i, np.array(v, float)) for i, v in table if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    sizes = [len(v) for _, v in ok]
    d = max(set(sizes), key=lambda x: (sizes.count(x), x)) if ok else 0
    ok = [(i, v) for i, v in ok if len(v) == d]
    out = {}
    for q, x in ok:
        if q % every == 0:
            scored = sorted((-float((x * v).sum()), i) for i, v in ok if i != q)[:20]
            out[q] = [(i, -s) for s, i in scored]
    return out


def got_of(spark, table, every=20):
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS node", "'x' AS v", "2 AS rank", "map('k', 1) AS score")
    out = {}
    for r in sorted(rows_of(ng.nearest(df, F.col("vec_id") % every == 0)), key=lambda r: (r.query_id, r.rank)):
        got = out.setdefault(r.query_id, [])
        assert r.rank == len(got) + 1
        got.append((r.vec_id, r.score))
    return out


def vectors(n, d, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    x = centres[rng.integers(0, 8, n)] * spread + rng.normal(size=(n, d))
    return x * rng.uniform(0.3, 3, (n, 1))  # lengths differ


def recall(got, want):
    assert got.keys() == want.keys()
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def test_recall_order_and_scores(spark):
    x = vectors(1500, 24, 1).astype(np.float32)
    table = [(int(k), [float(f) for f in v]) for k, v in enumerate(x)]
    got, want = got_of(spark, table), brute(table, 20)
    assert recall(got, want) >= 0.9
    of = dict(table)
    for q, rows in got.items():
        assert len(rows) == 20
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert all(abs(s - float((np.array(of[q]) * np.array(of[i])).sum())) < 1e-9 for i, s in rows)


def test_copies_and_odd_rows(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    table = [(k, base[k]) for k in range(40)] + [(100 + k, base[3]) for k in range(300)]
    table += [(900, None), (901, [0.0] * 6), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6),
              (905, [1.0, 2.0]), (906, []), (None, base[5]), (920, [-0.0, *base[0][1:]]), (940, [0.0, *base[0][1:]])]
    table = [(i, None if v is None else [None if f is None else float(np.float32(f)) for f in v]) for i, v in table]
    got = got_of(spark, table)
    want = brute(table, 20)
    assert got.keys() == want.keys()
    for q in want:  # 41 distinct vectors: all are found, so ties at copies show
        assert [(i, round(s, 5)) for i, s in got[q]] == [(i, round(s, 5)) for i, s in want[q]]


def test_few_rows_and_empty_tables(spark):
    assert got_of(spark, []) == {}
    assert got_of(spark, [(0, None), (20, [0.0, 0.0])]) == {}
    assert got_of(spark, [(0, [1.0, 0.0])]) == {}
    assert got_of(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]) == {0: [(1, 0.5), (2, -1.0)]}


def test_codes_keep_inner_products():
    x = vectors(50, 16, 2)
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = ng.unpack(ng.pack(x))
    assert np.abs(y @ y.T - x @ x.T).max() < 0.03


def test_best_rows_of_each_target():
    to, of = np.array([1, 2, 1, 1, 2, 1]), np.array([5, 6, 7, 5, 8, 9])
    sim = np.array([0.1, 0.5, 0.9, 0.1, 0.4, 0.2])
    best = ng._best_rows(to, of, sim, 2)
    assert sorted((int(to[k]), int(of[k])) for k in best) == [(1, 7), (1, 9), (2, 6), (2, 8)]
