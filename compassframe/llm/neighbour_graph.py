"""Approximate nearest neighbours by inner product: a graph built by NN-descent, searched greedily.

Vectors are scaled by the largest length and given one more coordinate that makes all of them unit vectors; then the
largest inner product with an item is the nearest vector, whatever the lengths. Equal vectors are one node.

Building: nodes first meet in small leaves of a few random hyperplane partitions. Then, round by round, every node
gathers its neighbours and those it is a neighbour of, compares those of them that have not met, and sends each the
ones that beat its farthest neighbour: neighbours of neighbours are likely neighbours. Rounds end when few
neighbour lists change. Vectors travel as one byte a coordinate.

Searching: a query keeps its best WIDTH nodes; each round the best that are not expanded yet bring in their
neighbours, until all are. What is found is then scored on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compassframe.llm.common import Scratch, attach, documents

NEIGHBOURS, REVERSE = 40, 40  # of a node; reverse ones drawn by hash, since a hub may have any number of them
LEAF, PARTITIONS, LEAF_BEST = 256, 4, 12
STOP, MOST_ROUNDS = 0.1, 12  # a share of changed list entries at which rounds end
TOP, WIDTH, EXPANDED, MOST_STEPS = 20, 160, 32, 60
#: Bytes of a side that may be broadcast; a code takes a byte a coordinate and some 60 more.
WIDE_BYTES = 32 << 20


def pack(rows: np.ndarray) -> list[bytes]:
    """Rows of floats as bytes: four for the scale, then one a coordinate."""
    scale = (np.abs(rows).max(axis=1) / 127).astype(np.float32)
    code = np.rint(rows / np.where(scale == 0, 1, scale)[:, None]).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale, code, strict=True)]


def unpack(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _best_rows(to: np.ndarray, of: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Places of each target's distinct best rows."""
    order = np.lexsort((of, -sim, to))
    to, of = to[order], of[order]
    order = order[np.r_[True, (to[1:] != to[:-1]) | (of[1:] != of[:-1])]] if len(order) else order
    head = np.flatnonzero(np.r_[True, np.diff(to[np.r_[True, (to[1:] != to[:-1]) | (of[1:] != of[:-1])]]) != 0]) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(head, np.diff(np.r_[head, len(order)]))
    return order[rank < most]


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one key, which the rows are sorted by, each run whole."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if rest and rest[-1].column(key)[-1].as_py() != k[0]:
            yield pa.concat_batches(rest)
            rest = []
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(k)], strict=True):
            rest.append(batch.slice(a, b - a))
            if b < len(k):
                yield pa.concat_batches(rest)
                rest = []
    if rest:
        yield pa.concat_batches(rest)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part: finite, not zero, and as long as most are."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    some = vectors.where(whole & F.exists("embedding", lambda x: x != 0)).select("vec_id", v.alias("v"))
    sizes = some.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return some.where(F.size("v") == sizes["d"]) if sizes else some


def nodes_of(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors as node (the least vec_id of the equal ones) and v; and the TOP + 1 least vec_ids of each node,
    as node, vec_id."""
    # zeros of either sign are equal
    key = F.sha2(F.to_json(F.struct(F.transform("v", lambda x: x + 0.0))), 256).alias("key")
    keyed = scratch.put(found.select(key, "vec_id", "v"), "keyed")
    least = keyed.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("times"))
    least = scratch.put(least, "least")
    single = least.where("times = 1").select("node", F.col("node").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    copies = keyed.select("key", "vec_id").join(least.where("times > 1").select("key", "node"), "key")
    first = copies.select("key", "vec_id", "node").withColumn("r", rank).where(F.col("r") <= TOP + 1)
    members = scratch.put(single.unionByName(first.select("node", "vec_id")), "members")
    is_first = least.select(F.col("key").alias("k"), "node")
    nodes = keyed.join(is_first, (keyed["key"] == is_first["k"]) & (keyed["vec_id"] == is_first["node"])).select("node", "v")
    return scratch.put(nodes.dropDuplicates(["node"]), "nodes"), members


def codes_of(nodes: DataFrame, longest: float) -> DataFrame:
    """node and code of the unit vectors that lengths become."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1) / longest if batch.num_rows else np.zeros((0, 1))
            last = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(pack(np.c_[x, last]), pa.binary())], ["node", "code"])

    return nodes.mapInArrow(code, "node bigint, code binary")


def leaves(codes: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """v, u, sim: the best of each node in leaves of random hyperplane partitions; a crowded cell is cut by hash."""
    bits = max(0, int(np.ceil(np.log2(max(1, count) / LEAF))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpack(batch.column("code").to_pylist())
            for r in range(PARTITIONS):
                planes = np.random.default_rng(1000 + r).normal(size=(x.shape[1], min(bits, 60))).astype(np.float32)
                cell = ((x @ planes) > 0) @ (1 << np.arange(planes.shape[1], dtype=np.int64)) if planes.shape[1] else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("code"), pa.array(cell.astype(np.int64) * PARTITIONS + r)], ["node", "code", "cell"])

    cells = scratch.put(codes.mapInArrow(place, "node bigint, code binary, cell bigint"), "cells")
    crowded = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * LEAF)
    dealt = attach(cells, scratch.put(crowded, "crowded"), ["cell"])
    part = F.pmod(F.xxhash64("node", "cell"), F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(1)) / LEAF)))
    dealt = dealt.select("node", "code", F.xxhash64("cell", part).alias("leaf")).repartition("leaf").sortWithinPartitions("leaf")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf in grouped(batches, "leaf"):
            ids, x = leaf.column("node").to_numpy(), unpack(leaf.column("code").to_pylist())
            for a in range(0, len(ids), 4 * LEAF):  # as rows come, whatever the size
                part, y = ids[a : a + 4 * LEAF], x[a : a + 4 * LEAF]
                sim = y @ y.T
                np.fill_diagonal(sim, -9)
                most = min(LEAF_BEST, len(part) - 1)
                if most > 0:
                    best = np.argpartition(-sim, most - 1, axis=1)[:, :most]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(part, most)), pa.array(part[best].ravel()), pa.array(np.take_along_axis(sim, best, 1).ravel())], ["v", "u", "sim"])

    return dealt.mapInArrow(meet, "v bigint, u bigint, sim float")


def nearest_of(rows: DataFrame) -> DataFrame:
    """The NEIGHBOURS best distinct u of every v; new unless the row was there before."""
    one = rows.repartition("v").groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    return one.withColumn("rank", rank).where(F.col("rank") <= NEIGHBOURS).drop("rank")


def around(graph: DataFrame) -> DataFrame:
    """v, u, new: every node's neighbours and REVERSE of those it is a neighbour of, new ones first."""
    drawn = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("new"), F.xxhash64("u", "v")))
    back = graph.select("v", "u", "new").withColumn("r", drawn).where(F.col("r") <= REVERSE)
    both = graph.select("v", "u", "new").union(back.select(F.col("u").alias("v"), F.col("v").alias("u"), "new"))
    return both.groupBy("v", "u").agg(F.max("new").alias("new"))


def descent_round(graph: DataFrame, codes: DataFrame) -> DataFrame:
    """v, u, sim of pairs that met at a common neighbour, one of them new to it, if u beats v's farthest neighbour."""
    farthest = graph.groupBy("v").agg(F.min("sim").alias("least"), F.count("*").alias("n"))
    known = codes.join(farthest, codes["node"] == farthest["v"], "left").select(
        F.col("node").alias("u"), "code", F.when(F.col("n") >= NEIGHBOURS, F.col("least")).otherwise(-9.0).cast("float").alias("least"))
    members = around(graph).join(known, "u").repartition("v").sortWithinPartitions("v").select("v", "u", "new", "code", "least")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            to, of, sim = (np.concatenate(c) for c in zip(*held, strict=True))
            best = _best_rows(to, of, sim, NEIGHBOURS)
            return pa.RecordBatch.from_arrays([pa.array(to[best]), pa.array(of[best]), pa.array(sim[best])], ["v", "u", "sim"])

        for group in grouped(batches, "v"):
            ids, new, least = (group.column(c).to_numpy(zero_copy_only=False) for c in ("u", "new", "least"))
            x = unpack(group.column("code").to_pylist())
            sim = x @ x.T
            better = (new[:, None] | new[None, :]) & (sim > least[:, None])
            np.fill_diagonal(better, False)
            i, j = np.nonzero(better)
            if len(i):
                held.append((ids[i], ids[j], sim[i, j]))
                size += len(i)
            if size > 500_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return members.mapInArrow(meet, "v bigint, u bigint, sim float")


def neighbour_graph(codes: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """v, u, sim: approximately the nearest NEIGHBOURS of every node, by rounds of NN-descent until lists settle."""
    start = leaves(codes, count, scratch).withColumn("new", F.lit(True))
    graph, k = scratch.put(nearest_of(start), "graph0"), 0
    while k < MOST_ROUNDS:
        found = descent_round(graph, codes).withColumn("new", F.lit(True))
        old = graph.withColumn("new", F.lit(False))
        k += 1
        graph = scratch.put(nearest_of(old.unionByName(found)), f"graph{k}")
        scratch.drop(f"graph{k - 1}")
        changed, entries = graph.agg(F.coalesce(F.sum(F.col("new").cast("long")), F.lit(0)), F.count("*")).first()
        codes.sparkSession.sparkContext._jvm.System.gc()  # the round's shuffle files go with the objects that own them
        if changed <= STOP * entries:
            break
    return graph


def adjacency(graph: DataFrame, codes: DataFrame) -> DataFrame:
    """node, around (ids) and codes (of theirs, end to end): a row for each node of the graph."""
    of = codes.withColumnRenamed("node", "u")
    members = around(graph.withColumn("new", F.lit(True))).join(of, "u").repartition("v").sortWithinPartitions("v", "u").select("v", "u", "code")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, "v"):
            yield pa.RecordBatch.from_arrays(
                [g.column("v").slice(0, 1), pa.array([g.column("u").to_pylist()], pa.list_(pa.int64())),
                 pa.array([b"".join(g.column("code").to_pylist())], pa.binary())], ["node", "around", "codes"])

    return members.mapInArrow(gather, "node bigint, around array<bigint>, codes binary")


def greedy_search(near: DataFrame, queries: DataFrame, starts: DataFrame, scratch: Scratch) -> DataFrame:
    """query, node, sim: each query's best WIDTH nodes; queries: query, code; starts: query, node, sim.

    A round expands each query's EXPANDED best nodes that are not expanded yet; a query ends when its WIDTH best all are.
    """
    beam = scratch.put(_kept(starts.select("query", "node", "sim", F.lit(False).alias("done"))), "beam0")
    size = len(queries.select("code").first()[0]) + 60
    for k in range(1, MOST_STEPS + 1):
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "node"))
        next_ = beam.where("NOT done").withColumn("r", place).where(F.col("r") <= EXPANDED).drop("r")
        bound = beam.groupBy("query").agg(F.min("sim").alias("least"), F.count("*").alias("n"))
        bound = bound.select("query", F.when(F.col("n") >= WIDTH, F.col("least")).otherwise(-9.0).cast("float").alias("least"))
        front = scratch.put(next_.join(bound, "query").join(queries, "query").select("query", "node", "least", "code"), f"front{k}")
        rows = front.count()
        if not rows:
            break
        met = attach(near, front.select("node", "query", "least", "code"), ["node"], "inner", few=rows * size <= WIDE_BYTES)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                columns = [batch.column(c).to_pylist() for c in ("query", "code", "least", "codes")]
                for query, code, least, codes, ids in zip(*columns, batch.column("around"), strict=True):
                    sims = unpack([codes[i : i + len(code)] for i in range(0, len(codes), len(code))]) @ unpack([code])[0]
                    better = np.flatnonzero(sims >= least)
                    if len(better):
                        found.append((np.full(len(better), query), ids.values.to_numpy()[better], sims[better]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query", "node", "sim"])

        found = met.select("query", "code", "least", "codes", "around").mapInArrow(score, "query bigint, node bigint, sim float")
        marks = next_.select("query", "node", "sim", F.lit(True).alias("done"))
        beam = scratch.put(_kept(beam.unionByName(marks).unionByName(found.withColumn("done", F.lit(False)))), f"beam{k}")
        scratch.drop(f"beam{k - 1}")
        scratch.drop(f"front{k}")
    return beam.select("query", "node", "sim")


def _kept(rows: DataFrame) -> DataFrame:
    one = rows.repartition("query").groupBy("query", "node").agg(F.max("sim").alias("sim"), F.max("done").alias("done"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "node"))
    return one.withColumn("r", place).where(F.col("r") <= WIDTH).drop("r")


def exact(pairs: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """query, node and score: the inner product of the original vectors in doubles."""
    both = pairs.join(nodes.select("node", F.col("v").alias("y")), "node").join(queries.select("query", F.col("v").alias("x")), "query")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array((x * y).sum(axis=1), pa.float64())], ["query", "node", "score"])

    return both.select("query", "node", "x", "y").mapInArrow(score, "query bigint, node bigint, score double")


def nearest(vectors: DataFrame, is_query) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of vectors that is_query (a Column) the 20 other rows of largest inner
    product that the search finds, nearest first, ties to the smaller vec_id.

    Reads vec_id (an integer) and embedding; other columns are left alone. Vectors that are null, zero, hold nulls or
    numbers that are not finite, or are not as long as most take no part, nor do rows without vec_id. Equal vectors are
    one node, so any number of copies costs one; a vec_id of several rows counts with each. Fewer than 21 rows: all that
    there are. Tables of nothing usable give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    found = scratch.put(valid(vectors.where("vec_id IS NOT NULL")), "valid")
    nodes, members = nodes_of(found, scratch)
    count, longest = nodes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    asked = found.where(is_query).dropDuplicates(["vec_id", "v"])
    asked = scratch.put(asked.select(F.col("vec_id").alias("query_id"), "v").withColumn("query", F.xxhash64("query_id", "v")), "asked")
    if not count or asked.isEmpty():
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    codes = scratch.put(codes_of(nodes, longest), "codes")
    graph = neighbour_graph(codes, count, scratch)
    near = scratch.put(adjacency(graph, codes), "near")
    flat = asked.select(F.col("query").alias("node"), F.expr("transform(v, x -> x / sqrt(aggregate(v, 0D, (s, y) -> s + y * y)))").alias("v"))
    codes_of_queries = scratch.put(codes_of(flat, 1.0).withColumnRenamed("node", "query"), "questions")
    # a query's own node and the graph's neighbours of it are where its search starts
    own = asked.select("query", "v").join(nodes.select("node", "v"), "v").select("query", "node")
    starts = scratch.put(own.select("query", "node", F.lit(9.0).cast("float").alias("sim")), "starts")
    beam = greedy_search(near, codes_of_queries, starts, scratch)
    scored = scratch.put(exact(beam.select("query", "node"), nodes, asked), "scored")
    ids = asked.select("query", "query_id")
    full = scored.join(members, "node").join(ids, "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return full.withColumn("rank", rank).where(F.col("rank") <= TOP).select("query_id", "rank", "vec_id", "score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
