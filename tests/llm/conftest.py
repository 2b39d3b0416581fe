import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, n int, shard string, key string, copy int"


@pytest.fixture(scope="session")
def small(spark):
    """A maker of documents tables from (doc_id, text) or (doc_id, text, source), with extra columns that clash."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or ""), -1, -2, "x", "y", 9) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd():
    """Documents with every odd case: nulls, blanks, repeats, ties, a very long text, an id of two texts."""
    base = prose(1, 200)
    return [
        (None, base), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, base), (5, base.upper()), (5, base.upper()),
        (6, prose(2, 200)), (7, prose(2, 190) + " end"), (8, prose(3, 30_000, 5000)), (9, "one two"), (10, "One  two"),
        (11, "é É ß 数据 \U0001f600 " * 40), (12, prose(4, 60)), (12, prose(5, 60)), (13, "x " * 500), (14, "!!! ... ***"),
        (-3, base + "\n" + prose(6, 50)),
    ]
