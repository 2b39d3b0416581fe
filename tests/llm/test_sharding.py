from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
from tests.llm.llm_helpers import rows_of

from compassframe.llm import sharding


def test_every_row_gets_a_place_and_shards_are_even(spark, small, odd):
    got = rows_of(sharding.shard_documents(small(odd * 20)))
    assert len(got) == len(odd) * 20
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    expected = Counter((i, len((t or "").encode()) + 16, crc32((t or "").encode())) for i, t in odd * 20)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_places_do_not_depend_on_partitions_and_empty_tables_work(spark, small):
    docs = small([(i, f"text {i}") for i in range(3000)])
    a = sorted(rows_of(sharding.shard_documents(docs.repartition(7))))
    b = sorted(rows_of(sharding.shard_documents(docs.repartition(2, "text"))))
    assert a == b
    assert rows_of(sharding.shard_documents(docs.limit(0))) == []


def test_the_matrix_is_exact_and_fair():
    counts = [1000, 1, 0, 499, 2500]
    m = sharding.communication_matrix(counts, 7, 3)
    assert m.sum(axis=1).tolist() == counts
    assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
    cell = np.array([sharding.communication_matrix([30, 70], 2, s)[0, 0] for s in range(400)])
    assert abs(cell.mean() - 15) < 0.5 and 4.0 < cell.var() < 6.6  # hypergeometric: 15 and 5.3


def test_large_draws_agree_with_the_moments():
    rng = np.random.default_rng(1)
    x = [sharding.draw(rng, 10**9, 3 * 10**9, 4000) for _ in range(300)]
    assert abs(np.mean(x) - 1000) < 6 and 550 < np.var(x) < 1000


def test_shards_look_shuffled(spark, small):
    got = rows_of(sharding.shard_documents(small([(i, "same text") for i in range(4000)])))
    where = {r.doc_id: r.shard for r in got}
    neighbours = sum(where[i] == where[i + 1] for i in range(3999))
    assert 50 < neighbours < 160  # 100 expected
