"""Paired bootstrap intervals.

All metrics of one resample share its weights, so differences and ratios stay paired. Rows are dealt out once; a task
gets the weights of some rows for all resamples at once, multiplies them with the rows' values and sends one row of
sums per group and resample: resamples x tasks rows however large the table.

``method="poisson"`` gives every row an independent Poisson(1) weight per resample, computed from the row's key: eight
resamples come from one SHA-256, so another engine can repeat them.

``method="multinomial"`` draws exactly n rows per resample. Rows lie in buckets by key; the n draws are split between
the two halves of the buckets by a binomial count, then in each half again, down to the bucket, and inside it from row
to row. A draw's seed names its node of that tree, so every task, and every repeated task, finds the same counts
without asking another one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compassframe.functions.text import hash60

#: Resamples drawn from one digest, each from four bytes.
LANES = 8
#: Poisson(1) cumulative probabilities, from the definition, as eight hexadecimal digits.
POISSON_CUTS = [
    f"{math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))):08x}" for k in range(11)
]
#: Weights (rows x resamples) and sums (groups x resamples x values) a task holds at once.
HELD_WEIGHTS, HELD_SUMS = 1_000_000, 4_000_000
#: Groups whose sums are multiplied at once.
HELD_GROUPS = 32

#: Called once a task with its batches: gives rows with their weights, rows x resamples.
Weigher = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, np.ndarray]]]

#: Digests in a row: those of the blocks that differ in their last digit.
TENS = 10


def with_digests(rows: DataFrame, reps: int, salt: str, key: str, first: int = 0) -> DataFrame:
    """Each row once per ten blocks, in their order; ``_digests`` are the digits of the SHA-256 of salt, block and key.

    Spark's own function digests several times as fast as a call per message in Python does.
    """
    blocks = (reps - 1) // LANES + 1
    heads = [f"{salt}|{tens or ''}" for tens in range(first // LANES // TENS, (blocks - 1) // TENS + 1)]
    tailed = rows.withColumn("_tail", F.coalesce(F.concat(F.lit("|"), F.col(key)), F.lit(""))).drop(key)
    opened = tailed.select("*", F.explode(F.array(*map(F.lit, heads))).alias("_head"))
    digests = [F.sha2(F.concat("_head", F.lit(str(last)), "_tail"), 256) for last in range(TENS)]
    return opened.select(*[c for c in rows.columns if c != key], F.concat(*digests).alias("_digests"))


def _whole(batches: Iterator[pa.RecordBatch], times: int) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that what was one row before it was repeated is in one batch."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        end = batch.num_rows // times * times
        if end:
            yield batch.slice(0, end)
        rest = batch.slice(end) if end < batch.num_rows else None


def poisson_weights(reps: int) -> Weigher:
    """How many thresholds each eight digits of the digests reach. Digits compare as their characters do.

    Few draws reach the third threshold; only those are looked up among all.
    """
    cuts = np.array([int.from_bytes(c.encode(), "big") for c in POISSON_CUTS], dtype=np.int64)
    times = (reps - 1) // LANES // TENS + 1
    step = max(1, HELD_WEIGHTS // reps)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in _whole(batches, times):
            digits = batch.column("_digests")
            width = 8 * TENS * LANES
            drawn = np.frombuffer(digits.buffers()[2], ">i8", len(digits) * width // 8, digits.offset * width)
            drawn = drawn.reshape(-1, times * TENS * LANES)[:, :reps]
            once = batch.drop_columns(["_digests"]).take(pa.array(np.arange(0, batch.num_rows, times)))
            for lo in range(0, once.num_rows, step):
                w = np.empty((min(step, once.num_rows - lo), reps), dtype=np.uint8)
                for k, row in enumerate(drawn[lo:lo + len(w)]):  # a row's draws stay in the cache
                    native = row.astype(np.int64)
                    np.add((native >= cuts[0]).view(np.uint8), (native >= cuts[1]).view(np.uint8), out=w[k])
                    more = np.flatnonzero(native >= cuts[2])
                    w[k, more] = np.searchsorted(cuts, native[more], side="right")
                yield once.slice(lo, len(w)), w.astype(np.float64)

    return weigh


def _generator(salt: str, *place: object) -> np.random.Generator:
    name = "|".join([salt, *map(str, place)])
    return np.random.Generator(np.random.PCG64(int.from_bytes(sha256(name.encode()).digest(), "big")))


def bucket_draws(sizes: np.ndarray, bucket: int, reps: int, salt: str) -> np.ndarray:
    """How many of the n draws of each resample fall in the bucket; over all buckets they add up to n."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    draws = np.full(reps, before[-1], dtype=np.int64)
    lo, hi = 0, len(sizes)
    while hi - lo > 1:
        half = (lo + hi) // 2
        rows, left = before[hi] - before[lo], before[half] - before[lo]
        to_left = _generator(salt, lo, hi).binomial(draws, left / rows if rows else 0.0)
        lo, hi, draws = (lo, half, to_left) if bucket < half else (half, hi, draws - to_left)
    return draws


def multinomial_weights(sizes: np.ndarray, reps: int, salt: str) -> Weigher:
    """Exact draws of rows sorted by bucket; sizes are the rows of each bucket."""
    step = max(1, HELD_WEIGHTS // reps)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        at, row, left, generator = -1, 0, None, None
        for batch in batches:
            buckets = batch.column("_bucket").to_pylist()
            for lo in range(0, len(buckets), step):
                some = buckets[lo:lo + step]
                w = np.empty((len(some), reps))
                for k, bucket in enumerate(some):
                    if bucket != at:
                        at, row = bucket, 0
                        left, generator = bucket_draws(sizes, bucket, reps, salt), _generator(salt, "rows", bucket)
                    w[k] = drawn = generator.binomial(left, 1.0 / (sizes[bucket] - row))
                    left = left - drawn.astype(np.int64)
                    row += 1
                yield batch.slice(lo, len(some)), w

    return weigh


class _Held:
    """One group's sums: rows drawn, values, and whether a value was there at all."""

    def __init__(self, reps: int, width: int) -> None:
        self.n, self.sums, self.found = np.zeros(reps), np.zeros((reps, width)), np.zeros((reps, width), dtype=bool)

    def add(self, n: np.ndarray, sums: np.ndarray, found: np.ndarray) -> None:
        self.n += n
        self.sums += sums
        self.found |= found


def weighted_sums(
    rows: DataFrame, values: list[str], reps: int, groups: list[str], opened: str | None, weights: Weigher, first: int = 0,
) -> DataFrame:
    """groups, rep (from first), _n and the values' weighted sums. ``opened`` names the group that is an array of a row's groups."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField(g, types[g].elementType if g == opened else types[g]) for g in groups])
    schema.add("rep", T.IntegerType()).add("_n", T.LongType())
    for v in values:
        schema.add(v, T.DoubleType())

    def names(columns: list[list], k: int) -> Iterator[tuple]:
        """The groups of a row."""
        cells = [c[k] for c in columns]
        if opened is None:
            yield tuple(cells)
            return
        place = groups.index(opened)
        for one in cells[place] or []:
            yield (*cells[:place], one, *cells[place + 1:])

    def out(held: dict[tuple, _Held], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        for name, h in held.items():
            drawn = np.flatnonzero(h.n > 0)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([x] * len(drawn), t) for x, t in zip(name, kinds, strict=True)],
                 pa.array(drawn + first, pa.int32()), pa.array(h.n[drawn].astype(np.int64)),
                 *[pa.array(h.sums[drawn, j], mask=~h.found[drawn, j]) for j in range(len(values))]], schema.names)
        held.clear()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Held] = {}
        kinds: list[pa.DataType] = []
        wide = len(values)
        for batch, w in weights(b for b in batches if b.num_rows):
            kinds = [batch.schema.field(g).type.value_type if g == opened else batch.schema.field(g).type for g in groups]
            v = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in values], axis=1)
            valid = np.stack([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in values], axis=1)
            finite = np.isfinite(v)
            # what a draw of the row adds: one, its values and, where some are missing, that they are there
            cells = [np.ones((len(v), 1)), np.where(finite, v, 0.0)] + ([] if valid.all() else [valid.astype(np.float64)])
            adds = np.concatenate(cells, axis=1)
            columns = [batch.column(g).to_pylist() for g in groups]
            members: dict[tuple, list[int]] = {}
            for k in range(len(v)):
                for name in names(columns, k) if groups else [()]:
                    members.setdefault(name, []).append(k)
            some = list(members)
            for lo in range(0, len(some), HELD_GROUPS):
                part = some[lo:lo + HELD_GROUPS]
                matrix = np.zeros((len(v), len(part), adds.shape[1]))
                for j, name in enumerate(part):
                    np.add.at(matrix[:, j], members[name], adds[members[name]])
                summed = (w.T @ matrix.reshape(len(v), -1)).reshape(w.shape[1], len(part), -1)
                for j, name in enumerate(part):
                    if name not in held:
                        if (len(held) + 1) * reps * (1 + wide) > HELD_SUMS:
                            yield from out(held, kinds)
                        held[name] = _Held(reps, wide)
                    n, sums, there = summed[:, j, 0], summed[:, j, 1:wide + 1], summed[:, j, wide + 1:]
                    held[name].add(n, sums, there > 0 if there.size else (n > 0)[:, None])
                    for i, c in zip(*np.nonzero((valid & ~finite)[members[name]]), strict=True):  # a weight of 0 must not make them NaN
                        row = members[name][i]
                        held[name].sums[w[row] > 0, c] += v[row, c]
        yield from out(held, kinds)

    partial = rows.mapInArrow(add, schema)
    return partial.groupBy(*groups, "rep").agg(F.sum("_n").alias("_n"), *[F.sum(v).alias(v) for v in values])


def resample_means(
    rows: DataFrame, values: list[str], reps: int, salt: str, groups: list[str] | None = None,
    method: str = "poisson", key: str = "key", drawn_by: str | None = None, first: int = 0,
) -> DataFrame:
    """Mean of every value column per group and resample: (groups..., rep, values...).

    Poisson weights are drawn per key, so a row in several groups weighs the same in all; ``drawn_by`` may
    name an array column among the groups, which is opened after the draw. A resample that draws no row of a group is
    missing, as can happen in very small groups. NULL values add nothing, and a mean of NULL only is NULL. Group
    columns are plain values, not arrays or maps. Multinomial draws count the rows of the buckets when called. Poisson
    resamples may be made in rounds: those before ``first``, a multiple of LANES * TENS, are left to another call.
    """
    groups = groups or []
    if first % (LANES * TENS) or first and method != "poisson":
        raise ValueError("rounds are for Poisson resamples and begin at whole rows of digests")
    # fix the partition number so that a small input is not merged into one task: every row is work for `reps` draws
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = rows.select(*dict.fromkeys(groups), F.col(key).cast("string").alias("_key"), *[F.col(v).cast("double").alias(v) for v in values])
    if method == "poisson":
        digested = with_digests(slim.repartition(parts, "_key"), reps, salt, "_key", first)
        sums = weighted_sums(digested, values, reps - first, groups, drawn_by, poisson_weights(reps - first), first)
    elif method == "multinomial":
        if groups:
            raise ValueError("multinomial draws are for one group of rows")
        bucket = hash60(F.concat(F.lit(salt), F.coalesce("_key", F.lit("")))) % parts
        dealt = slim.withColumn("_bucket", bucket.cast("int"))
        sizes = np.zeros(parts, dtype=np.int64)
        for b, n in dealt.groupBy("_bucket").count().collect():  # one row a bucket
            sizes[b] = n
        ordered = dealt.repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_key", *values)
        sums = weighted_sums(ordered, values, reps, groups, None, multinomial_weights(sizes, reps, salt))
    else:
        raise ValueError(f"unknown bootstrap method {method}")
    return sums.select(*groups, "rep", *[F.try_divide(F.col(v), F.col("_n")).alias(v) for v in values])


def percentile(values: Column, q: float, rule: str, size: Column | None = None) -> Column:
    """Nearest-rank element of an array; ``rule`` says how q*(n-1) becomes an index. ``size`` stands for another n."""
    size = F.size(values) if size is None else size
    place = F.lit(q) * (size - 1)
    index = {
        "floor": F.floor(place),
        "ceil": F.ceil(place),
        "round": F.bround(place, 0),
        "share": F.greatest(F.lit(0), F.least(size - 1, F.bround(F.lit(q) * size, 0) - 1)),
    }[rule].cast("int")
    return F.get(F.array_sort(values), index)


def intervals(reps: DataFrame, metrics: list[str], groups: list[str] | None = None,
              rules: tuple[str, str] = ("floor", "ceil")) -> DataFrame:
    """95 % intervals per group and metric from at most some thousand resample rows."""
    groups = groups or []
    lists = reps.groupBy(*groups).agg(*[F.collect_list(m).alias(m) for m in metrics])
    return lists.select(
        *groups,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric"),
                        percentile(F.col(m), 0.025, rules[0]).alias("low"),
                        percentile(F.col(m), 0.975, rules[1]).alias("high"),
                    )
                    for m in metrics
                ]
            )
        ),
    )


def lows_at_most(reps: DataFrame, metrics: list[str], groups: list[str], total: int, rule: str = "floor") -> DataFrame:
    """groups, metric and low: at least the lower bound of the interval over ``total`` resamples, of which reps are some.

    More values only move the element at a place down, and fewer than ``total`` only move the place down. NULL while
    there are not enough resamples to tell.
    """
    lists = reps.groupBy(*groups).agg(*[F.collect_list(m).alias(m) for m in metrics])
    low = {m: percentile(F.col(m), 0.025, rule, F.lit(total)) for m in metrics}
    return lists.select(*groups, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("low")) for m, c in low.items()])))
