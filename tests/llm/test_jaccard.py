import random

import numpy as np
import pytest
from tests.llm.conftest import prose
from tests.llm.llm_helpers import rows_of, words

from compassframe.llm import jaccard_join
from compassframe.llm.common import Scratch
from compassframe.llm.components import components


def sets(docs):
    out = []
    for _, text in docs:
        w = words(text)
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(docs):
    s, root = sets(docs), list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if s[i] and doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(s[i]), least.get(find(i)) if s[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def got_of(docs_table):
    found = jaccard_join.near_duplicates(docs_table).select("doc_id", "n_shingles", "component_id")
    return sorted((tuple(r) for r in rows_of(found)), key=str)


@pytest.fixture(scope="module")
def family():
    """Copies with edits of all sizes, chains, a passage shared by all, and unlike texts."""
    rng, docs = random.Random(4), []
    shared = prose(99, 40)
    for f in range(6):
        base = prose(f, 60 + 40 * f, 3000).split()
        for k in range(14):
            w = base[:]
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
            docs.append((1000 - len(docs), " ".join(w)))
    docs += [(2000 + i, shared + " " + prose(300 + i, rng.choice([5, 10, 30, 120]), 9000)) for i in range(40)]
    docs += [(3000 + i, prose(500 + i, 30, 9000)) for i in range(20)]
    return docs


def test_components_equal_brute_force(spark, small, family, odd):
    docs = family + odd
    assert got_of(small(docs)) == brute(docs)


def test_small_tiles_and_hubs_give_the_same(spark, small, family, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 5)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 4000)
    assert got_of(small(family).repartition(5)) == brute(family)


def test_signature_bounds_never_cut_a_link(family):
    s = [jaccard_join.shingle_set(words(t)) for _, t in family]
    s.append(jaccard_join.shingle_set(words(prose(7, 4000, 10_000))))
    for make in (jaccard_join.signature, jaccard_join.wide_signature):
        bits = [make(x) for x in s]
        for i in range(0, len(s), 3):
            for j in range(i):
                length = min(len(bits[i]), len(bits[j]))
                x, y = (jaccard_join.folded(bits[k], length) for k in (i, j))
                differ = sum(int(v).bit_count() for v in x ^ y)
                assert (len(s[i]) + len(s[j]) - differ) // 2 >= len(set(s[i].tolist()) & set(s[j].tolist()))


def test_one_of_each_group_stays(spark, small, family, odd):
    docs = family + [x for x in odd if x[0] != 12]  # an id of two texts has two components
    kept = jaccard_join.keep_one_each(small(docs))
    assert kept.columns == small(docs).columns
    have = rows_of(kept)
    expected = brute(docs)
    groups = {c for d, n, c in expected if n and c is not None}
    assert {r.doc_id for r in have if words(r.text)} == groups
    assert len([r for r in have if words(r.text)]) == len(groups)
    assert len([r for r in have if not words(r.text)]) == sum(not words(t) for _, t in docs)


def test_rows_without_ids(spark, small):
    t = prose(1, 50)
    assert got_of(small([(None, t), (None, t), (None, prose(2, 50))])) == sorted([(None, len(sets([(0, t)])[0]), None)] * 2 + [
        (None, len(sets([(0, prose(2, 50))])[0]), None)], key=str)
    assert len(rows_of(jaccard_join.keep_one_each(small([(None, t), (None, t), (None, prose(2, 50))])))) == 2


def test_empty_table(spark, small, odd):
    assert got_of(small(odd).limit(0)) == []


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((30, 25), (200, 260), (300, 150)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(0, k) for k in range(n // 4)]
        root = list(range(n))
        for _ in range(n):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        got = components(spark.createDataFrame([*edges, (None, 1)], "a bigint, b bigint"), Scratch(spark, "t"), "g")
        assert {r.node: r.root for r in rows_of(got)} == {x: root[x] for e in edges for x in e if e[0] != e[1]} | {
            x: root[x] for a, b in edges if a != b for x in (a, b)}


def test_large_family_of_near_copies(spark, small, monkeypatch):
    """2,000 near copies, most of which miss the hub, take pairs in proportion to sets and end as brute force says."""
    import numpy as np

    rng, base = random.Random(8), prose(1, 120, 4000).split()
    docs = []
    for k in range(2000):
        w = base[:]
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(99_999)}"
        docs.append((k, " ".join(w)))
    counts, plain = [], jaccard_join.open_pairs

    def counting(tiles, choose):
        found = plain(tiles, choose)
        counts.append(found.count())
        return found

    monkeypatch.setattr(jaccard_join, "open_pairs", counting)
    got = got_of(small(docs))
    s = sets(docs)
    index = {g: i for i, g in enumerate(sorted({g for x in s for g in x}))}
    m = np.zeros((len(s), len(index)), np.float32)
    for i, x in enumerate(s):
        m[i, [index[g] for g in x]] = 1
    n = m.sum(1)
    both = m @ m.T
    link = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
    least = np.arange(len(s))
    while True:
        new = np.array([least[row].min() for row in link])
        if (new == least).all():
            break
        least = new
    assert got == sorted(((i, len(s[i]), int(least[i])) for i in range(len(s))), key=str)
    assert len(set(least.tolist())) < 1000 and sum(counts) < 60 * len(docs)


def test_spanning_pairs_join_all_that_every_pair_joins():
    import numpy as np

    rng = np.random.default_rng(3)
    for sided in (False, True):
        x = [np.unique(rng.integers(0, 60, rng.integers(20, 60)).astype(np.uint64) << np.uint64(7)) for _ in range(40)]
        n = np.array([len(a) for a in x])
        bits = np.stack([jaccard_join.signature(a) for a in x])
        side, root = np.arange(40) % 2 * int(sided), rng.integers(0, 30, 40)

        def groups(pairs, root=root):
            now = root.copy()
            for i, j in zip(*pairs, strict=True):
                now[now == now[i]] = now[j]
            return [set(np.flatnonzero(now == c).tolist()) for c in np.unique(now)]

        some, every = (f(side, n, root, bits) for f in (jaccard_join.spanning_pairs, jaccard_join.every_pair))
        assert sorted(map(sorted, groups(some))) == sorted(map(sorted, groups(every)))
        assert len(some[0]) < len(set(root.tolist()))


def test_small_tiles_are_looked_at_together():
    """The pairs are those of each tile by itself, and tiles without a choice take no call of their own."""
    import numpy as np

    rng = np.random.default_rng(3)
    sizes = np.r_[rng.integers(1, 7, 300), [jaccard_join.SMALL_TILE + 3, jaccard_join.SMALL_TILE]]
    ends = np.cumsum(sizes)
    heads, total = ends - sizes, int(ends[-1])
    sets = [np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64)) for _ in range(40)]
    sets += [np.r_[s[:55], s[55:] + np.uint64(k)] for s in sets for k in (1, 2)]
    which = np.where(rng.random(total) < 0.6, rng.integers(0, 40, total) % 3, rng.integers(0, len(sets), total))
    n = np.array([len(sets[w]) for w in which])
    bits = np.array([jaccard_join.signature(sets[w]) for w in which])
    root, side = which % 40, np.zeros(total, np.int32)
    for h, e in list(zip(heads, ends, strict=True))[::3]:
        side[(h + e) // 2 : e] = 1
    for choose in (jaccard_join.spanning_pairs, jaccard_join.every_pair):
        calls, expected, got = [], set(), set()
        for h, e in zip(heads, ends, strict=True):
            i, j = choose(side[h:e], n[h:e], root[h:e], bits[h:e])
            expected |= {frozenset((int(h + a), int(h + b))) for a, b in zip(i, j, strict=True)}

        def counted(*x, choose=choose, calls=calls):
            calls.append(1)
            return choose(*x)

        for _, i, j in jaccard_join.chosen_pairs(heads, ends, side, n, root, bits, counted):
            got |= {frozenset((int(a), int(b))) for a, b in zip(i, j, strict=True)}
        assert got == expected and expected and len(calls) < len(heads) / 2


def test_signatures_are_not_broadcast(spark):
    """Up to 64 MB of them were collected and hashed in the driver, twice for each round of pairs."""
    sets = {c: np.unique(np.random.default_rng(c // 2).integers(0, 1 << 63, 300, dtype=np.uint64)) for c in range(6)}
    rows = [(c, 300, None, bytearray(jaccard_join.wide_signature(x).tobytes())) for c, x in sets.items()]
    signatures = spark.createDataFrame(rows, "cid bigint, n int, bits binary, wide binary")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a bigint, b bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = jaccard_join.passing(pairs, signatures)
        assert sorted(map(tuple, found.collect())) == [(0, 1), (2, 3), (4, 5)]
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
