import math
import random
import re
from collections import Counter

import pytest
from tests.llm.conftest import prose
from tests.llm.llm_helpers import rows_of

from compassframe.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    full = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, n_terms = len(full), sum(n for _, _, n in full)
    df = Counter(t for _, c, _ in full for t in c)
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, q in asked.items():
        scored = []
        for d, c, n in full:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, k in q.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:20])]
    return sorted(out, key=str)


def got_of(small, spark, docs, items):
    asked = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS score", "'x' AS doc_id")
    return sorted((tuple(r) for r in rows_of(lexical_search.search(small(docs), asked))), key=str)


@pytest.fixture(scope="module")
def corpus(odd):
    rng = random.Random(3)
    docs = odd + [(100 + k, prose(700 + k, rng.choice([3, 20, 80, 300]), rng.choice([50, 400, 3000]))) for k in range(300)]
    docs += [(5000 - k, docs[40][1]) for k in range(60)]  # more equal documents than ranks
    items = [(k, prose(700 + 3 * k, 12, 300) + " é 数据") for k in range(12)]
    items += [(50, docs[40][1]), (50, docs[40][1]), (51, ""), (52, None), (53, "never-seen!"), (54, "W1 w1 W2"), (54, "w3, w4"), (None, "w5 w9"), (55, "x")]
    return docs, items


def test_equals_brute_force(spark, small, corpus):
    docs, items = corpus
    assert got_of(small, spark, docs, items) == brute(docs, items)


def test_small_buckets_and_blocks_give_the_same(spark, small, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical_search, "BUCKET", 7)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 60)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = lexical_search.search(small(docs).repartition(5), asked)
    assert sorted((tuple(r) for r in rows_of(got)), key=str) == brute(docs, items)


def test_bounds_prune(spark, small):
    """Of short vectors far below the best none is scored."""
    import numpy as np

    weights = np.array([1000, 10], dtype=np.int64)
    item = lexical_search.Item(np.array([0, 1]), np.array([1, 1]), weights, 1)
    item.take(np.full(20, 10**6), list(range(20)))
    short = lexical_search.Bucket(np.array([30.0, 20.0]), np.array([0, 1]), np.array([0, 1]), np.array([900, 60]), weights)
    assert short.visit(item) is None
    long = lexical_search.Bucket(np.array([2e6, 1e5]), np.array([0, 1]), np.array([0, 0]), np.array([2 * 10**6, 10**5]), weights)
    rows, scores = long.visit(item)
    assert rows.tolist() == [0] and scores.tolist() == [2 * 10**6]


def test_empty_tables(spark, small, odd):
    assert got_of(small, spark, [], [(1, "w1")]) == []
    assert got_of(small, spark, odd, []) == []
    assert got_of(small, spark, [(1, None), (2, "")], [(1, "w1")]) == []
