"""Ordered digests: a Merkle tree over ranges of a sorted key, with differing ranges and proofs of single rows.

A row's leaf is the SHA-256 of its key and payload; equal rows are one leaf with a count. Leaves in the order of key and
leaf are cut into runs wherever a leaf begins with DIGITS zeros; runs are nodes, and nodes whose first leaf begins with
twice as many zeros start runs of runs, until each group has one node. Cuts depend on the rows beside them alone: neither
partitions nor rows far away move them, so two tables that differ in one row share all other ranges. A hot key is cut
like any range, since its leaves differ. Every level is a shuffle of a 256th of the level below. Leaves are shuffled and
written as 32 bytes, and the digests that follow from them are not: they are computed where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from compassframe.session import written

DIGITS = 2  # hexadecimal; 256 nodes a run on average
SEPARATOR = "\x00"


def leaf_digest(key: Column, payload: list[Column]) -> Column:
    """SHA-256 of key and payload, each ended by a zero byte; NULL is told apart from every text."""
    parts = [F.when(c.isNull(), "\x01").otherwise(F.concat(F.lit("\x02"), c.cast("string"))) for c in (key, *payload)]
    return F.sha2(F.concat_ws(SEPARATOR, *parts, F.lit("")), 256)


def node_digest(digests: Column, rows: Column) -> Column:
    return F.sha2(F.concat(F.array_join(digests, ""), F.lit("|"), rows.cast("string")), 256)


def leaf_count_digest(leaf: Column, rows: Column) -> Column:
    """The lowest level's digest of a leaf and how often it occurs."""
    return F.sha2(F.concat_ws("|", leaf, rows.cast("string")), 256)


def _packed(at: Column) -> Column:
    """The same order in half the bytes."""
    return F.when(at.isNotNull(), F.struct(at.key.alias("key"), F.unhex(at.leaf).alias("leaf")))


def _text(leaf: Column) -> Column:
    return F.lower(F.hex(leaf))


def _member_digest(member: Column) -> Column:
    """The same of a packed leaf in a list."""
    return leaf_count_digest(_text(member["at"]["leaf"]), member["rows"])


def _opened(packed: DataFrame, groups: list[str], level: int) -> DataFrame:
    """Nodes of a written level with leaves as text and every digest."""
    whole = lambda c: F.when(c.isNotNull(), F.struct(c.key.alias("key"), _text(c.leaf).alias("leaf")))
    digest = leaf_count_digest(_text(F.col("at.leaf")), F.col("rows")) if level == 1 else F.col("digest")
    return packed.select(*groups, whole(F.col("at")).alias("at"), digest.alias("digest"), "rows", whole(F.col("run")).alias("run"))


def _runs(nodes: DataFrame, groups: list[str], level: int) -> DataFrame:
    """nodes, packed, with `run`: the first node of the run each is in; NULL for a group's first run.

    Nodes are range-partitioned and sorted; a run that began in an earlier partition is carried over by a row a
    partition and group.
    """
    begins = F.substring(_text(F.col("at.leaf")), 1, DIGITS * level) == "0" * (DIGITS * level)
    kept = ["rows"] if level == 1 else ["digest", "rows"]
    slim = nodes.select(*groups, _packed(F.col("at")).alias("at"), *kept)
    placed = written(slim.repartitionByRange(*groups, "at").withColumn("_part", F.spark_partition_id()), f"merkle{level}")
    begin = F.when(begins, F.col("at"))
    local = F.last(begin, True).over(Window.partitionBy(*groups, "_part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    ends = placed.groupBy(*groups, "_part").agg(F.max(begin).alias("_last"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(ends.withColumn("_carried", F.last("_last", True).over(before)).drop("_last"))  # partitions x groups that meet
    filled = placed.withColumn("run", local)
    on = [filled[g].eqNullSafe(carried[g]) for g in groups] + [filled["_part"] == carried["_part"]]
    joined = filled.join(carried, on)
    return joined.select(*[filled[g] for g in groups], "at", *kept, F.coalesce("run", "_carried").alias("run"))


def leaves(df: DataFrame, key: str, payload: list[str], groups: list[str] | None = None) -> DataFrame:
    """groups, at (key, leaf), digest and rows: level 0 of the tree. The key may be NULL, repeated or of any sortable type."""
    groups = groups or []
    leaf = leaf_digest(F.col(key), [F.col(c) for c in payload])
    counted = df.select(*groups, F.struct(F.col(key).alias("key"), F.unhex(leaf).alias("leaf")).alias("at")).groupBy(*groups, "at").agg(
        F.count("*").alias("rows"))
    at = F.struct(F.col("at.key").alias("key"), _text(F.col("at.leaf")).alias("leaf"))
    return counted.select(*groups, at.alias("at"), leaf_count_digest(_text(F.col("at.leaf")), F.col("rows")).alias("digest"), "rows")


@dataclass(frozen=True)
class Tree:
    """levels: written tables, leaves first, of groups, at, digest, rows and run (the parent's range); root: groups,
    rows, digest."""

    levels: list[DataFrame]
    root: DataFrame


def tree(df: DataFrame, key: str, payload: list[str], groups: list[str] | None = None) -> Tree:
    """All levels, one job or two each, until every group has one node. Empty tables have no root."""
    groups, levels, roots = groups or [], [], None
    nodes = leaves(df, key, payload, groups)
    while True:
        level = len(levels) + 1
        placed = _opened(written(_runs(nodes, groups, level), "merkle-level"), groups, level)
        levels.append(placed)
        counts = written(placed.groupBy(*groups).agg(F.count("*").alias("_n")), "merkle-groups")
        same = F.lit(True)
        for g in groups:
            same = same & placed[g].eqNullSafe(counts[g])
        done = placed.join(counts.where("_n = 1"), same, "left_semi").select(*groups, "rows", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if counts.where("_n > 1").isEmpty():
            return Tree(levels, roots)
        members = F.array_sort(F.collect_list(F.struct(_packed(F.col("at")).alias("at"), *(["rows"] if level == 1 else ["digest", "rows"]))))
        first = F.get("m", F.lit(0)).at
        digests = F.transform("m", _member_digest if level == 1 else lambda x: x["digest"])
        left = placed.join(counts.where("_n > 1"), same, "left_semi")
        rows = F.aggregate("m", F.lit(0).cast("bigint"), lambda s, x: s + x.rows)
        nodes = left.groupBy(*groups, "run").agg(members.alias("m")).select(
            *groups, F.struct(first.key.alias("key"), _text(first.leaf).alias("leaf")).alias("at"),
            node_digest(digests, rows).alias("digest"), rows.alias("rows"))


def ordered_digest(df: DataFrame, key: str, payload: list[str], groups: list[str] | None = None) -> DataFrame:
    """groups, rows, digest of the roots."""
    return tree(df, key, payload, groups).root


def differing_ranges(left: Tree, right: Tree, groups: list[str] | None = None) -> DataFrame:
    """groups, first and last (keys seen on either side), left_rows, right_rows of the runs of leaves that differ.

    Trees are compared at the first level above the leaves: a row for each range that only one side has, or that has
    other rows. A changed row changes its own range; one that begins or ends a range changes its neighbour's too.
    """
    groups = groups or []

    def side(tree: Tree, name: str) -> DataFrame:
        members = F.array_sort(F.collect_list(F.struct(_packed(F.col("at")).alias("at"), "rows")))
        whole = F.sha2(F.array_join(F.transform(members, _member_digest), ""), 256)
        return tree.levels[0].groupBy(*groups, "run").agg(
            whole.alias("digest"), F.min("at.key").alias("low"), F.max("at.key").alias("high"), F.sum("rows").alias("rows")
        ).select(*[F.col(c).alias(f"{name}_{c}") for c in (*groups, "run", "digest", "low", "high", "rows")])

    a, b = side(left, "a"), side(right, "b")
    same = F.lit(True)
    for c in (*groups, "run"):
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    keyed = [F.xxhash64(*[F.col(f"{n}_{c}") for c in (*groups, "run")]).alias("_k") for n in "ab"]
    both = a.select("*", keyed[0]).withColumnRenamed("_k", "_ka").join(
        b.select("*", keyed[1]).withColumnRenamed("_k", "_kb"), (F.col("_ka") == F.col("_kb")) & same, "full_outer")
    return both.where(~F.col("a_digest").eqNullSafe(F.col("b_digest"))).select(
        *[F.coalesce(f"a_{g}", f"b_{g}").alias(g) for g in groups],
        F.least("a_low", "b_low").alias("first"), F.greatest("a_high", "b_high").alias("last"),
        F.coalesce("a_rows", F.lit(0)).alias("left_rows"), F.coalesce("b_rows", F.lit(0)).alias("right_rows"))


def first_difference(left: Tree, right: Tree, groups: list[str] | None = None) -> DataFrame:
    """The first differing range of each group, and how many there are."""
    groups = groups or []
    ranges = differing_ranges(left, right, groups)
    first = F.min(F.struct("first", "last", "left_rows", "right_rows")).alias("r")
    return ranges.groupBy(*groups).agg(F.count("*").alias("ranges"), first).select(*groups, "ranges", "r.*")


def prove(tree: Tree, at: tuple, groups: dict[str, object] | None = None) -> list[tuple[int, list[str], int]]:
    """The path from the leaf at (key, leaf) to the root: for each level the node's place among its run's digests, the
    digests and the rows under them. Runs are short, so this is a few thousand digests at most. Empty if there is no such leaf.
    """
    path, key, leaf = [], *at
    here = lambda df: df.where(" AND ".join(f"{g} <=> {v!r}" for g, v in groups.items())) if groups else df
    for nodes in tree.levels:
        nodes = here(nodes)
        own = nodes.where(F.col("at.key").eqNullSafe(F.lit(key)) & (F.col("at.leaf") == leaf)).select("run", "digest").first()
        if own is None:
            return []
        if nodes.limit(2).count() == 1:
            break
        run = nodes.where(F.col("run").isNull() if own.run is None else
                          F.col("run.key").eqNullSafe(F.lit(own.run.key)) & (F.col("run.leaf") == own.run.leaf))
        members = sorted(run.select("at", "digest", "rows").collect(), key=lambda r: (r["at"].key is not None, r["at"].key, r["at"].leaf))
        digests = [r.digest for r in members]
        path.append((digests.index(own.digest), digests, sum(r.rows for r in members)))
        key, leaf = members[0]["at"].key, members[0]["at"].leaf
    return path


def proves(path: list[tuple[int, list[str], int]], leaf: str, count: int, root: str) -> bool:
    """Whether the path leads from a leaf that occurs count times to the root."""
    now = sha256(f"{leaf}|{count}".encode()).hexdigest()
    for place, digests, rows in path:
        if not 0 <= place < len(digests) or digests[place] != now:
            return False
        now = sha256(f"{''.join(digests)}|{rows}".encode()).hexdigest()
    return now == root
