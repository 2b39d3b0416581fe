import hashlib
import random

import pytest
from tests.llm.conftest import prose
from tests.llm.llm_helpers import rows_of

from compassframe.llm import suffix_dedup


def brute(docs):
    """Expected rows for documents in order; equal (id, text) rows are one document."""
    seen, done, out = set(), {}, []
    for doc, text in docs:
        raw = (text or "").encode()
        if (doc, text) not in done:
            mark = bytearray(len(raw))
            for p in range(len(raw) - 99):
                if raw[p : p + 100] in seen:
                    mark[p : p + 100] = b"\1" * 100
                seen.add(raw[p : p + 100])
            rest = bytes(c for c, m in zip(raw, mark, strict=True) if not m)
            done[doc, text] = (doc, len(raw), sum(mark), sum(1 for s in bytes(mark).split(b"\0") if s), hashlib.sha256(rest).hexdigest())
        out.append(done[doc, text])
    return sorted(out, key=str)


def check(table, docs, **options):
    got = rows_of(suffix_dedup.remove_repeats(table, **options))
    assert sorted((tuple(r[:5]) for r in got), key=str) == brute(docs)
    for r in got:
        assert len(r.kept) == r.n_bytes - r.n_removed and hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


@pytest.fixture(scope="module")
def corpus():
    rng, docs = random.Random(7), []
    passages = [prose(900 + i, n) for i, n in enumerate((26, 30, 45, 80, 300))]
    for i in range(120):
        parts = [prose(i, rng.randrange(1, 60), 3000)]
        for p in rng.sample(passages, rng.randrange(3)):
            a = rng.randrange(20)
            parts += [p[a : len(p) - rng.randrange(20)], prose(1000 + i, rng.randrange(30), 3000)]
        docs.append((i * 3 - 50, " ".join(parts)))
    docs += [(400, docs[5][1]), (401, docs[5][1][:-7]), (402, "ab" * 400), (403, "ab" * 300), (404, "a" * 150), (405, "a" * 99),
             (406, "a" * 100), (407, "é" * 120), (408, "x" + "é" * 120), (409, prose(3, 30) * 3)]
    return docs


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_equals_brute_force_for_any_number_of_batches(spark, small, corpus, batches):
    check(small(corpus).repartition(6), corpus, n_batches=batches)


def test_odd_rows(spark, small, odd):
    plain = [(d, t) for d, t in odd if d is not None and d != 12]
    check(small(plain), sorted(plain, key=lambda x: x[0]))
    got = rows_of(suffix_dedup.remove_repeats(small(odd)))
    assert len(got) == len(odd)
    base = next(t for d, t in odd if d is None)
    first = [r for r in got if r.doc_id is None and r.n_bytes == len(base)][0]
    assert first.n_removed == 0  # a null id comes first
    assert [r.n_removed for r in got if r.doc_id == 4] == [len(base)]
    assert len([r for r in got if r.doc_id == 12]) == 2
    assert rows_of(suffix_dedup.remove_repeats(small(odd).limit(0))) == []


def test_long_texts_are_cut_and_joined(spark, small, monkeypatch):
    text = prose(1, 40_000, 100_000)
    docs = [(1, text), (2, "pad " + text[50_000:150_000]), (3, text[-90:] + text[:130])]
    check(small(docs), docs)


def test_repeats_at_the_cuts_of_long_texts(spark, small):
    """Single passages, so that no neighbouring repeat covers a run that is cut in two."""
    cut, docs = suffix_dedup.CHUNK // 2 - 99, []
    for i in range(10):
        text = prose(20 + i, 24_000, 100_000)
        assert len(text) > cut + 300
        n = 101 + 8 * i
        a = cut - (n - 99) // 2
        docs += [(100 + i, text), (i if i % 2 else 200 + i, f"<{text[a : a + n]}>")]
    docs.sort()
    check(small(docs).repartition(4), docs)


def test_levels_merge_geometrically(spark, small):
    from compassframe.llm.common import Scratch
    docs = suffix_dedup.identified(small([(i, prose(i, 50)) for i in range(24)]), Scratch(spark, "t"))
    family = suffix_dedup.IndexFamily(Scratch(spark, "t"), 8)
    sizes = []
    for b in range(6):
        family.add(docs.where(f"id >= {4 * b} AND id < {4 * b + 4}"))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]


def test_anchors_are_dealt_evenly_over_parts(spark):
    """Anchors are least hashes: cut by their size, nearly all would be in the first part."""
    rows = [(i, 0, prose(i, 400, 3000)) for i in range(40)]
    docs = spark.createDataFrame(rows, "id bigint, dup int, text string")
    sizes = dict.fromkeys(range(16), 0)
    for r in suffix_dedup.batch_entries(docs, 16).where(f"kind = {suffix_dedup.LEVEL}").collect():
        sizes[r.part] += len(r.a) // 8
    assert sum(sizes.values()) > 1000 and max(sizes.values()) < 3 * sum(sizes.values()) / 16


def test_texts_are_shuffled_once_and_never_meet_a_broadcast(spark, small, corpus):
    """Beyond a million rows to broadcast, each of both joins with the texts used to shuffle all of them again."""
    from compassframe.llm.common import Scratch
    docs = suffix_dedup.identified(small(corpus).repartition(3), Scratch(spark, "t"))
    spots = spark.createDataFrame([(7, 0, d, 0) for d, _ in corpus[:9]], "k bigint, y bigint, id bigint, pos bigint")
    whole = spark.createDataFrame([(d, 0, 100) for d, _ in corpus[:9]], "id bigint, start bigint, end bigint")
    found = suffix_dedup.without(docs, whole.unionByName(suffix_dedup.open_spans(docs, spots)), False)
    assert len(rows_of(found)) == len(corpus)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Broadcast" not in plan
    texts = [x for x in plan.splitlines() if "Exchange hashpartitioning(id#" in x and "dup#" in x]
    moved = [x for x in texts if "ReusedExchange" not in x]
    assert plan.count("SortMergeJoin") == 2 and "ReusedExchange [doc_id#" in plan and len(moved) <= 3  # texts, spots, spans
