import random
from hashlib import sha256

import pytest

from compassframe.operators import merkle as M

SCHEMA = "k bigint, v string, g string"


def plain(rows):
    """The root by plain sorting, for one group."""
    counts = {}
    for k, v, _ in rows:
        part = lambda x: "\x01" if x is None else f"\x02{x}"
        leaf = sha256(f"{part(k)}\x00{part(v)}\x00".encode()).hexdigest()
        counts[(k is not None, k or 0, leaf)] = counts.get((k is not None, k or 0, leaf), 0) + 1
    nodes = [(at, sha256(f"{at[2]}|{n}".encode()).hexdigest(), n) for at, n in sorted(counts.items())]
    level = 0
    while len(nodes) > 1:
        level += 1
        runs = []
        for at, digest, n in nodes:
            if not runs or at[2].startswith("0" * M.DIGITS * level):
                runs.append([])
            runs[-1].append((at, digest, n))
        nodes = [(r[0][0], sha256(("".join(d for _, d, _ in r) + f"|{sum(n for _, _, n in r)}").encode()).hexdigest(), sum(n for _, _, n in r)) for r in runs]
    return (nodes[0][2], nodes[0][1]) if nodes else None


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(k, f"v{rng.randrange(50)}", "abc"[k % 3]) for k in range(1500)]
    return out + [(7, f"hot {k}", "a") for k in range(400)] + [(None, "x", "a"), (None, None, "b"), (3, None, None), (5, "v", "a"), (5, "v", "a")]


def root_of(spark, rows, parts=7, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return {r["g"] if "groups" in how else None: (r.rows, r.digest) for r in M.ordered_digest(df, "k", ["v"], how.get("groups")).collect()}


def test_root_equals_plain_tree(spark, rows):
    assert root_of(spark, rows)[None] == plain(rows)
    got = root_of(spark, rows, 3, groups=["g"])
    assert got == {g: plain([r for r in rows if r[2] == g]) for g in ("a", "b", "c", None)}
    assert root_of(spark, []) == {}


def test_any_change_shows(spark, rows):
    base = plain(rows)
    swapped = [((101 if k == 100 else 100 if k == 101 else k), v, g) for k, v, g in rows]
    assert root_of(spark, swapped)[None] != base
    assert root_of(spark, rows + [(5, "v", "a")])[None] != base
    assert root_of(spark, rows[1:])[None] != base
    assert root_of(spark, list(reversed(rows)), 2)[None] == base


def test_differing_ranges_hold_the_change(spark, rows):
    changed = [(k, "other" if k == 777 else v, g) for k, v, g in rows]
    a, b = (M.tree(spark.createDataFrame(x, SCHEMA), "k", ["v"]) for x in (rows, changed))
    found = M.differing_ranges(a, b).collect()
    assert 1 <= len(found) <= 2 and any(r["first"] <= 777 <= r["last"] for r in found)
    assert sum(r.left_rows for r in found) < 1500
    assert M.differing_ranges(a, a).isEmpty()
    assert M.first_difference(a, b).first().ranges == len(found)


def test_proofs(spark, rows):
    t = M.tree(spark.createDataFrame(rows, SCHEMA), "k", ["v"])
    root = t.root.first().digest
    leaf = {r.k: r.leaf for r in t.levels[0].where("at.key IN (5, 900)").selectExpr("at.key AS k", "at.leaf AS leaf", "rows").where("rows = 1").collect()}
    path = M.prove(t, (900, leaf[900]))
    assert path and M.proves(path, leaf[900], 1, root)
    assert not M.proves(path, leaf[900], 2, root) and not M.proves(path, leaf[5], 1, root) and not M.proves(path[1:], leaf[900], 1, root)
    assert M.prove(t, (900, "0" * 64)) == []


def test_leaves_are_written_in_half_the_bytes(spark, rows, monkeypatch):
    """Of the lowest level only the key, the leaf's 32 bytes and the count are shuffled and written."""
    kept, written = {}, M.written

    def noted(df, label):
        kept.setdefault(label, dict(df.dtypes))
        return written(df, label)

    monkeypatch.setattr(M, "written", noted)
    got = M.tree(spark.createDataFrame(rows, SCHEMA), "k", ["v"])
    for label in ("merkle1", "merkle-level"):
        assert "digest" not in kept[label] and kept[label]["at"] == "struct<key:bigint,leaf:binary>", kept[label]
    assert dict(got.levels[0].dtypes)["at"] == "struct<key:bigint,leaf:string>" and "digest" in got.levels[0].columns
