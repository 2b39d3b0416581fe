from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest
from tests.llm.conftest import prose
from tests.llm.llm_helpers import rows_of, words

from compassframe.llm import class_lm
from compassframe.llm.common import Scratch


def held_out(doc):
    return crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def base_rows(docs):
    c, n_train = Counter(), 0
    for d, t in docs:
        if not held_out(d):
            c.update(words(t))
            n_train += 1
    total, types = sum(c.values()) + n_train, len(c) + (n_train > 0)
    out = []
    for d, t in docs:
        counts = [c[w] for w in words(t)] + [n_train]
        out.append((d, held_out(d), len(counts), sum(x > 0 for x in counts), total, sum(log10((x + 1) / (total + types + 1)) for x in counts)))
    return out


@pytest.fixture(scope="module")
def docs(odd):
    return [(i, prose(i, 20 + i % 90) if i % 2 else prose(i, 40).replace("w", "v")) for i in range(400)] + odd


@pytest.mark.parametrize("lookup", [1e-6, 1e-3])
def test_counts_and_base_score(spark, small, docs, lookup, monkeypatch):
    """Also when most words are joined, not looked up."""
    monkeypatch.setattr(class_lm, "LOOKUP_SHARE", lookup)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in
                  rows_of(class_lm.score_texts(small(docs)))), key=str)
    assert got == sorted(((*r[:5], round(r[5], 6)) for r in base_rows(docs)), key=str)


def test_scores_do_not_depend_on_what_is_looked_up(spark, small, docs, monkeypatch):
    monkeypatch.setattr(class_lm, "CORE_SHARE", 2e-3)
    a = sorted(round(r.score, 6) for r in rows_of(class_lm.score_texts(small(docs))))
    monkeypatch.setattr(class_lm, "LOOKUP_SHARE", 1e-3)
    b = sorted(round(r.score, 6) for r in rows_of(class_lm.score_texts(small(docs).repartition(3))))
    assert a == b


def test_classes_beat_the_base_on_held_out_text(spark, small, docs):
    got = [r for r in rows_of(class_lm.score_texts(small(docs))) if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)


def test_probabilities_add_up(spark, small, docs):
    learnt = class_lm.learn(small(docs).select("text"), Scratch(spark, "t"))
    rng = np.random.default_rng(1)
    m = class_lm.smoothed(rng.integers(0, 3, (learnt.size, learnt.size)).astype(float), learnt.mass)
    assert np.allclose(m.sum(axis=1), 1)
    share = np.zeros(learnt.size)
    share[learnt.k] = 1.0
    share[learnt.k + 1:] = 1 / learnt.mass[learnt.k + 1:]  # one place in each form for words never seen
    for r in rows_of(learnt.words):
        share[r.c] += (r.n if r.c < learnt.k else r.n + 1) / learnt.mass[r.c]
    assert np.allclose(share[m[0] > 0], 1)


@pytest.mark.parametrize("core", [5e-5, 3e-2])
def test_words_found_twice_are_clustered_whatever_their_share(spark, small, docs, core, monkeypatch):
    monkeypatch.setattr(class_lm, "CORE_SHARE", core)
    texts = [(i, " ".join(f"w{i % 7} the{j} w{j} rare{i // 2}" for j in range(5))) for i in range(200)]
    learnt = class_lm.learn(small(texts).select("text"), Scratch(spark, "t"))
    assert learnt.k > 1
    assert all(r.c < learnt.k for r in rows_of(learnt.words) if r.n >= 2)


def test_rare_words_join_the_class_of_largest_gain(spark, small, monkeypatch):
    """Against contexts and gains counted text by text, in slices so small that words go over their ends."""
    monkeypatch.setattr(class_lm, "SLICE", 3)
    rng = np.random.default_rng(5)
    k, core = 3, {b"a": 0, b"b": 1, b"c": 2, class_lm.END: 3}
    texts = [(i, " ".join(rng.choice(["a", "b", "c", "x", "y", "z", "q"], rng.integers(0, 12)))) for i in range(60)]
    m = rng.integers(1, 50, (k + 1, k + 1)).astype(float)
    gains = class_lm.context_gains(m)
    sums = {}
    for _, t in texts:
        seq = [class_lm.END, *words(t), class_lm.END]
        for before, w, after in zip(seq, seq[1:], seq[2:], strict=False):
            if w not in core:
                x = sums.setdefault(w, np.zeros(2 * (k + 1)))
                if before in core:
                    x[core[before]] += 1
                if after in core:
                    x[k + 1 + core[after]] += 1
    found = class_lm.assign(class_lm.count_contexts(small(texts).repartition(7), core, k), gains)
    assert {bytes(r.word): r.c for r in rows_of(found)} == {w: int(np.argmax(x @ gains)) for w, x in sums.items() if x.any()}


def test_scores_equal_a_model_worked_out_text_by_text(spark, small, docs, monkeypatch):
    """From the classes learnt: transitions, masses and scores by brute force, most words joined."""
    monkeypatch.setattr(class_lm, "LOOKUP_SHARE", 1e-2)
    monkeypatch.setattr(class_lm, "CORE_SHARE", 1e-2)
    kept = {}
    learn = class_lm.learn
    monkeypatch.setattr(class_lm, "learn", lambda d, s: kept.setdefault("learnt", learn(d, s)))
    got = rows_of(class_lm.score_texts(small(docs)))
    learnt = kept["learnt"]
    table = {bytes(r.word): (r.n, r.c) for r in rows_of(learnt.words)}
    k = learnt.k

    def classes(t):
        return [k, *[table[w][1] if w in table else k + 1 + class_lm.form(w) for w in words(t)], k]

    m = np.zeros((learnt.size, learnt.size))
    for d, t in docs:
        if not held_out(d):
            c = classes(t)
            np.add.at(m, (c[:-1], c[1:]), 1)
    p = class_lm.smoothed(m, learnt.mass)
    expected = []
    for d, t in docs:
        c, total = classes(t), 0.0
        for x, y in zip(c, c[1:], strict=False):
            total += log10(p[x, y] / learnt.mass[y])
        for w in words(t):
            n, own = table.get(w, (0, k + 1))
            total += log10(n if own < k else n + 1)
        expected.append((str(d), round(total, 6)))
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted(expected)


def test_moving_a_word_raises_the_likelihood():
    rng = np.random.default_rng(3)
    for _ in range(20):
        pairs = rng.integers(0, 5, (12, 12)).astype(float)
        classes, k = rng.integers(0, 4, 12), 4

        def matrix(c):
            m = np.zeros((k, k))
            np.add.at(m, (c[:, None].repeat(12, 1), c[None, :].repeat(12, 0)), pairs)
            return m

        def value(c):
            m = matrix(c)
            return class_lm.xlogx(m).sum() - class_lm.xlogx(m.sum(0)).sum() - class_lm.xlogx(m.sum(1)).sum()

        w, others = 5, np.arange(12) != 5
        m = matrix(classes)
        left = np.bincount(classes[others], pairs[others, w], k)
        right = np.bincount(classes[others], pairs[w, others], k)
        best = class_lm.best_class(m, left, right, pairs[w, w], int(classes[w]), k)
        values = []
        for c in range(k):
            tried = classes.copy()
            tried[w] = c
            values.append(value(tried))
        assert values[best] == pytest.approx(max(values))
        classes[w] = best
        assert np.allclose(m, matrix(classes))


def test_tables_without_training_rows(spark, small):
    only = next(i for i in range(100) if held_out(i))
    got = rows_of(class_lm.score_texts(small([(only, "a b"), (only, None)])))
    assert len(got) == 2 and all(np.isfinite(r.score) and r.train_tokens == 0 for r in got)
    assert rows_of(class_lm.score_texts(small([(1, "a")]).limit(0))) == []
