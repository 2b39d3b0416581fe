from collections import Counter, defaultdict

import pytest
from tests.llm.conftest import prose
from tests.llm.llm_helpers import rows_of, words

from compassframe.llm import mixing


def targets(sizes):
    """Water filling, one source at a time: shares by weight, caps, the excess shared out again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, total, out = set(names), sum(sizes.values()), {}
    while left:
        unit = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * unit >= 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * unit for s in left}
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= over
    return out


@pytest.fixture(scope="module")
def mixed(small, odd):
    docs = [(i, prose(i, 5 + i * 7 % 300), ("a", "b", "B", None, "é", "empty")[i % 5] if i % 97 else "tiny") for i in range(1500)]
    docs += [(i, t, "odd") for i, t in odd] + [(9001, "", "empty"), (9002, None, "empty")]
    return docs, rows_of(mixing.mix(small(docs)))


def test_targets_follow_the_weights_and_caps(mixed):
    docs, got = mixed
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(words(text))
    expected = targets(sizes)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    for r in got:
        source = names[r.source_id]
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(expected[source], rel=1e-9, abs=1e-9)
    assert sum(expected.values()) == pytest.approx(sum(sizes.values()))


def test_taken_words_are_near_their_targets(mixed):
    docs, got = mixed
    assert len(got) == len(docs)
    taken, target, largest = Counter(), {}, defaultdict(int)
    for r in got:
        assert r.taken in {k * r.size for k in range(4)} and r.taken == r.copies * r.size
        taken[r.source_id] += r.taken
        target[r.source_id] = r.target
        largest[r.source_id] = max(largest[r.source_id], r.size)
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.06 * t + 1.5 * largest[s]


def test_copies_add_up_and_reruns_agree(spark, small):
    docs = small([(i, "a b c", "s" if i % 3 else "t") for i in range(900)])
    first = rows_of(mixing.mix(docs))
    again = rows_of(mixing.mix(docs.repartition(5)))
    assert sorted(first) == sorted(again)
    for s in {r.source_id for r in first}:
        mine = [r for r in first if r.source_id == s]
        assert abs(sum(r.copies for r in mine) - mine[0].target / 3) <= 1


def test_expectations_are_kept(spark, small):
    """Each document of one source is taken about as often as the others, over many sources alike."""
    docs = small([(s * 10 + i, " ".join(["w"] * (i + 1)), f"s{s:03d}") for s in range(300) for i in range(10)])
    got = rows_of(mixing.mix(docs))
    share = defaultdict(list)
    for r in got:
        if r.source_id % 3 == 1:  # weight 2 of (5, 2, 1): 3/4 of the source
            share[r.size].append(r.copies)
    for size, copies in share.items():
        assert abs(sum(copies) / len(copies) - 0.75) < 0.16, size


def test_taking_repeats_rows(spark, small, odd):
    docs = small([(*r, "s") for r in odd] + [(100 + i, prose(i, 40), "tuv"[i % 3]) for i in range(200)])
    copies = Counter()
    for r in rows_of(mixing.mix(docs)):
        copies[r.doc_id] += r.copies
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    assert Counter(r.doc_id for r in rows_of(taken)) == +copies


def test_empty_tables(spark, small, odd):
    assert rows_of(mixing.mix(small(odd).limit(0))) == []
    assert {r.taken for r in rows_of(mixing.mix(small([(1, None), (2, "")])))} == {0}
