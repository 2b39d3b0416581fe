import hashlib
import re

import pytest
from tests.llm.conftest import prose
from tests.llm.llm_helpers import rows_of

from compassframe.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(item)
    lengths = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])] - {None}
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def cases(odd):
    long = prose(50, 60)
    items = [(1, prose(2, 30)), (2, prose(2, 30).upper()), (10, long), (3, "one two"), (4, "Solo"), (5, None), (6, "..."),
             (None, prose(3, 25, 5000)), (7, "é É ß 数据 \U0001f600 " * 3), (8, "a b c"), (8, "a b c"), (9, "x " * 30)]
    docs = odd + [(20, "say " + ", ".join(long.split()[5:40]) + "; end"), (21, long[:40]), (22, "solo SOLO Solo."), (23, "a a b c a b"),
                  (24, " ".join(long.split()[:9])), (25, "É é"), (26, f"{long} {long}")]
    return docs, items


def test_equals_brute_force(spark, small, cases):
    docs, items = cases
    bench = spark.createDataFrame([(*i, "q") for i in items], "item_id bigint, text string, window string")
    got = rows_of(decontamination.contamination(small(docs), bench))
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)


def test_dropping_keeps_clean_documents(spark, small, cases):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontamination.drop_contaminated(small(docs), bench)
    assert kept.columns == small(docs).columns
    clean = [(r[0], r[1]) for r in brute(docs, items) if not r[-1]]
    assert sorted(((r.doc_id, len(split(r.text))) for r in rows_of(kept)), key=str) == sorted(clean, key=str)


def test_blocks_of_the_benchmark_do_not_matter(spark, small, cases, monkeypatch):
    docs, items = cases
    monkeypatch.setattr(decontamination, "SHINGLE_BLOCK", 40)
    monkeypatch.setattr(decontamination, "ANCHOR_BLOCK", 30)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = rows_of(decontamination.contamination(small(docs[-8:]), bench))
    assert sorted((tuple(r) for r in got), key=str) == brute(docs[-8:], items)


def test_empty_sides(spark, small, odd):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in rows_of(decontamination.contamination(small(odd), none)))
    assert rows_of(decontamination.contamination(small(odd).limit(0), none)) == []
