import random
import re
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from compassframe.operators import learner as L
from compassframe.session import written

SCHEMA = "id bigint, text string, label int"


def buckets_of(text):
    tokens = re.findall(r"[^\W_]+(?:['’-][^\W_]+)?", (text or "").lower())
    h = lambda s: int(md5(s.encode()).hexdigest()[:15], 16) % L.BUCKETS
    return [h("1|" + t) for t in tokens] + [h(f"2|{a} {b}") for a, b in zip(tokens, tokens[1:], strict=False)]


def dense(texts):
    x = np.zeros((len(texts), L.BUCKETS + 1))
    for i, t in enumerate(texts):
        for j in buckets_of(t):
            x[i, j] += 1
        norm = np.sqrt((x[i] ** 2).sum())
        x[i] /= norm or 1
        x[i, -1] = 1
    return x


def plain(texts, labels, loss, rounds):
    x, y = dense(texts), np.array(labels, float)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, s = np.zeros(L.BUCKETS + 1), np.zeros(L.BUCKETS + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w)) if loss == "logistic" else x @ w
        g = x.T @ (share * (p - y)) + L.L2 * np.r_[w[:-1], 0]
        s += g * g
        w = w - L.RATE * g / (np.sqrt(s) + L.EPS)
    return w


@pytest.fixture(scope="module")
def battles():
    rng, out = random.Random(1), []
    for k in range(400):
        hard = rng.random() < 0.3
        words = [rng.choice(["prove", "derive", "optimise"] if hard and rng.random() < 0.5 else ["say", "list", "copy", "name", "tell"]) for _ in range(rng.randrange(1, 14))]
        out.append((k, " ".join(words), int(hard)))
    return out


def table(spark, rows):
    return written(spark.createDataFrame(rows, SCHEMA).repartition(5).select(
        "id", "label", "text", L.hashed_features(F.col("text")).alias("features")), "learner-test")


def test_features_equal_plain_hashing(spark, battles):
    odd = battles[:20] + [(900, None, 1), (901, "", 0), (902, " ... ", 0), (903, "One", 1), (904, "it's x-y Ünï 数据", 1)]
    for r in table(spark, odd).collect():
        assert sorted(r.features) == sorted(buckets_of(r.text)), r.text


@pytest.mark.parametrize("loss", L.LOSSES)
def test_equals_a_plain_run(spark, battles, loss):
    model = L.fit(table(spark, battles), loss, rounds=8)
    want = plain([t for _, t, _ in battles], [y for _, _, y in battles], loss, 8)
    assert np.abs(model.weights - want).max() < 1e-9


def test_learns_what_can_be_learnt(spark, battles):
    train, rest = battles[:300], battles[300:]
    model = L.fit(table(spark, train), rounds=30)
    got = {r.id: (r.label, r.probability) for r in L.predict(table(spark, rest), model, ["id", "label"]).collect()}
    assert len(got) == len(rest)
    assert np.mean([(p >= 0.5) == y for y, p in got.values()]) > 0.85


def test_one_class_no_rows_and_unlabelled(spark, battles):
    assert not L.fit(table(spark, [(1, "a b", 1), (2, "c", 1)])).weights.any()
    assert not L.fit(table(spark, battles).limit(0)).weights.any()
    with_gaps = battles + [(1000, "prove it", None), (1001, "prove it", 7)]
    assert np.allclose(L.fit(table(spark, with_gaps), rounds=3).weights, L.fit(table(spark, battles), rounds=3).weights)
    flat = L.Model(np.zeros(L.BUCKETS + 1), "logistic")
    assert {r.probability for r in L.predict(table(spark, [(1, None, None), (2, "", 0)]), flat, ["id"]).collect()} == {0.5}
    with pytest.raises(ValueError):
        L.fit(table(spark, battles), "hinge")


def test_settled_tokens_and_given_ids_change_nothing(spark):
    from compassframe.operators import alignment as A

    texts = spark.createDataFrame([(0, "One TWO, two’s"), (1, "ℌello one"), (2, ""), (3, None)], "k int, text string")
    rows = texts.withColumn("t", L.tokens_of(F.col("text"))).select(L.hashed_features(F.col("text")).alias("a"), L.token_features(F.col("t")).alias("b"))
    assert all(r.a == r.b for r in rows.collect())
    battles = spark.createDataFrame(
        [(i // 2 if i < 4 else i, "s", "e", "p", i % 2, 1 - i % 2, 0) for i in range(9)],
        "id bigint, model_a string, model_b string, prompt string, winner_model_a int, winner_model_b int, winner_tie int")
    got = [sorted(A.battle_labels(battles, ("s", "e"), ids=ids).collect(), key=str) for ids in (None, battles.select("id"))]
    assert got[0] == got[1] and sum(r.problem == "duplicate_id" for r in got[0]) == 4
