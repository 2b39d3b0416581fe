import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from tests.llm.conftest import prose
from tests.llm.llm_helpers import rows_of

from compassframe.llm import linear_quality, tree_quality


@pytest.fixture(scope="module")
def labelled(spark, small):
    """Prose is good; shouted, padded and repeating texts are not. Odd labels are thrown in."""
    docs, labels = [], []
    for i in range(600):
        text = prose(i, 30 + i % 200)
        kind = i % 6
        if kind == 1:
            text = " ".join(w + "%%%" for w in text.split())
        elif kind == 3:
            text = " ".join(f"{w} {w} {w}" for w in text.split())
        docs.append((i, text))
        labels.append((i, 0 if kind in (1, 3) else 1))
    labels += [(None, 1), (3, None), (5, 7), (99_999, 1), (0, 1)]
    return docs, spark.createDataFrame([(*x, 1.0) for x in labels], "doc_id bigint, quality int, score double")


def test_held_out_rows_are_classified_and_not_learnt_from(spark, small, labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in rows_of(linear_quality.classify(small(docs), labels))}
    assert all(r.held_out == (crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    wrong = [i for i, r in got.items() if r.held_out and r.predicted != (0 if i % 6 in (1, 3) else 1)]
    assert len(wrong) <= 2
    flipped = labels.selectExpr("doc_id", "IF(crc32(string(doc_id)) % 5 = 0, 1 - quality, quality) AS quality")
    again = {r.doc_id: r.score for r in rows_of(linear_quality.classify(small(docs), flipped))}
    assert all(again[i] == r.score for i, r in got.items())


def test_odd_texts_get_scores_and_repeats_the_same(spark, small, labelled, odd):
    _, labels = labelled
    got = rows_of(linear_quality.classify(small(odd), labels))
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert len({r.score for r in got if r.doc_id == 5}) == 1


def test_no_labels_and_empty_tables(spark, small, odd, labelled):
    _, labels = labelled
    assert {r.score for r in rows_of(linear_quality.classify(small(odd), labels.limit(0)))} == {0.5}
    assert rows_of(linear_quality.classify(small(odd).limit(0), labels)) == []
    kept = linear_quality.keep_good(small(odd), labels.limit(0))
    assert kept.columns == small(odd).columns and kept.count() == len(odd)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {i + k for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)]


def test_statistics_equal_brute_force(odd):
    texts = [t for _, t in odd] + [prose(7, 20) + "\n" + prose(7, 20) + "\n\n \n" + prose(7, 20), "a # b\n*|<>\n*|<>", "x\x0by\x0cz\rw v"]
    for t in texts:
        assert tree_quality.statistics(t)[0] == brute_counts(t)


def test_rules_keep_prose_and_drop_junk(spark, small, labelled, odd):
    docs, labels = labelled
    got = {r.doc_id: r for r in rows_of(tree_quality.judge(small(docs), labels))}
    for i, text in docs:
        n = brute_counts(text)
        r = got[i]
        assert [r[c] for c in tree_quality.COUNTS] == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)
    wrong = [i for i, r in got.items() if not r.base_failed and r.kept != (i % 6 not in (1, 3))]
    assert len(wrong) <= 6
    strange = rows_of(tree_quality.judge(small(odd), labels))
    assert len(strange) == len(odd) and not any(r.kept for r in strange if r.doc_id in (1, 2, 3, 9))
    assert rows_of(tree_quality.judge(small(odd).limit(0), labels)) == []
    assert {r.score for r in rows_of(tree_quality.judge(small(odd), labels.limit(0)))} == {0.5}


def test_trees_are_monotone_and_flat_scoring_equals_walking():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] + 0.3 * np.sin(12 * x[:, 0]) < 0.6) ^ (rng.random(800) < 0.05)).astype(float)
    trees = tree_quality.fit_trees(x, y, [-1, 0, 0])
    grid = np.repeat(x[:20], 50, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 50), 20)
    assert (np.diff(trees.score(grid).reshape(20, 50), axis=1) <= 1e-12).all()

    def walk(row):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x[:50]), [walk(r) for r in x[:50]])
    free = tree_quality.fit_trees(x, y, [0, 0, 0])
    assert ((free.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
