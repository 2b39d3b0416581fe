"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

A document's set is its distinct 5-word shingles. Two sets at or above the threshold share one of the first
(1 - threshold) of their shingles in any fixed order of all shingles; the order used is rarest first, by counts in
hash buckets over the whole corpus. The sets that meet at a shingle, in order of size, are cut into tiles: blocks of
the pair matrix whose sizes are near enough to link. In a tile, the bits in which two parity bitmaps differ bound the
overlap from above; what passes is intersected exactly.

Equal word sequences are one set throughout. Pairs are looked at in rounds, and only links between components
matter: each set with one hub of its shingle; then the pairs of a spanning forest over a tile's components that takes the
likeliest links first, in tiles of one block and then of two, so that near copies which miss the hub are joined by as
many pairs as there are sets, not by all pairs; then, in tiles where some pair could link, whatever pairs between
components are still possible. No link that joins components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from compassframe.llm.common import Scratch, attach, documents, held, lowered_words
from compassframe.llm.components import components

N, NUMERATOR, DENOMINATOR = 5, 3, 4  # words of a shingle; a similarity of 3/4
BUCKET_BITS, SIGNATURE_BITS, TILE = 18, 1024, 256
#: Rows of a tile whose pairs are looked at together with those of other tiles.
SMALL_TILE = 16
#: Bytes of sets in a block of a verification tile; a tile has two blocks.
BLOCK_BYTES = 8 << 20
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The sorted distinct hashes of the 5-word shingles; fewer words make one shingle, none an empty set."""
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(N, len(h))
    if not n:
        return h
    x = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        x = x * _STEP + h[i : len(h) - n + 1 + i]
    x ^= x >> np.uint64(31)
    x *= _MIX
    x = np.sort(x ^ (x >> np.uint64(29)))
    return x[np.r_[True, x[1:] != x[:-1]]]  # as np.unique, which takes twice the time on sets this small


def needed(n: np.ndarray | int):
    """The least overlap of a set of n with any set it links with."""
    return -(-NUMERATOR * n // DENOMINATOR)


def signature(x: np.ndarray, bits: int = SIGNATURE_BITS) -> np.ndarray:
    """Parity bits: sets differ in at least as many elements as their signatures of one length in bits."""
    odd = np.bincount((x >> np.uint64(7)) & np.uint64(bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def wide_signature(x: np.ndarray) -> np.ndarray:
    """A signature of at least two bits an element, as many as tell sets of that size apart."""
    return signature(x, max(SIGNATURE_BITS, 1 << (2 * len(x) - 1).bit_length()))


def folded(bits: np.ndarray, length: int) -> np.ndarray:
    """The signature with fewer bits of the same set."""
    while len(bits) > length:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def enough(overlap, size_a, size_b):
    """Whether that overlap makes a link: overlap >= 3/4 of the union."""
    return (DENOMINATOR + NUMERATOR) * overlap >= NUMERATOR * (size_a + size_b)


def content_id(words: list[bytes]) -> int:
    return xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def scan_sets(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text_hash, cid, n) and one for each bucket and task (bucket, count of shingles)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "cid", "n", "bucket", "count"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, id_arrow = np.zeros(1 << BUCKET_BITS, dtype=np.int64), None
        for batch in batches:
            cids, ns, id_arrow = [], [], batch.schema.field("doc_id").type
            for text in batch.column("text").to_pylist():
                words = lowered_words(text)
                x = shingle_set(words)
                np.add.at(counts, x >> np.uint64(64 - BUCKET_BITS), 1)
                cids.append(content_id(words) if words else None)
                ns.append(len(x))
            k = len(ns)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(cids, pa.int64()), pa.array(ns, pa.int32()),
                 pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], names)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(some), id_arrow), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()),
                 pa.nulls(len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(counts[some])], names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        scan, f"doc_id {id_type}, text_hash bigint, cid bigint, n int, bucket int, count bigint")


def ranks(counts: np.ndarray) -> np.ndarray:
    """Ranks of the buckets by count in 16 bits, which sort fast; buckets of near counts may share one."""
    order = np.argsort(counts, kind="stable")
    found = np.empty(len(counts), np.uint16)
    found[order] = np.arange(len(counts)) * (1 << 16) // len(counts)
    return found


def prefix_tokens(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """token, n, cid for the shingles of each set's prefix, rarest first."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks(counts))  # 2 ** BUCKET_BITS numbers

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ns, cids = [], [], []
            for text in batch.column("text").to_pylist():
                words = lowered_words(text)
                if words:
                    x = shingle_set(words)
                    rare = np.argsort(shared.value[x >> np.uint64(64 - BUCKET_BITS)], kind="stable")
                    tokens.append(x[rare[: len(x) - needed(len(x)) + 1]].view(np.int64))
                    ns.append(len(x))
                    cids.append(content_id(words))
            if tokens:
                each = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array(ns, np.int32), each)),
                     pa.array(np.repeat(np.array(cids, np.int64), each))], ["token", "n", "cid"])

    return docs.select("text").mapInArrow(cut, "token bigint, n int, cid bigint")


def tiles(tokens: DataFrame) -> DataFrame:
    """tile, side, n, cid, hub, hub_n: the sets that meet at a shingle, in blocks of at most TILE.

    A block with itself is a tile of side 0; two blocks of one shingle make a tile of sides 0 and 1 if the sizes of
    some of their sets are near enough. Shingles of one set only make none.
    """
    names = ["tile", "side", "n", "cid", "hub", "hub_n"]

    def rows_of(token: int, n: np.ndarray, cid: np.ndarray) -> Iterator[list[np.ndarray]]:
        hub = int(np.argmin(cid))
        starts = range(0, len(n), TILE)
        for i in starts:
            for j in starts:
                a, b = slice(i, i + TILE), slice(j, j + TILE)
                if j < i or (j > i and DENOMINATOR * n[a][-1] < NUMERATOR * n[b][0]):
                    continue
                part = np.r_[a, b] if j > i else np.r_[a]
                part = part[part < len(n)]
                side = (part >= j).astype(np.int32) if j > i else np.zeros(len(part), np.int32)
                tile = xxh3_64_intdigest(f"{token},{i},{j}") - (1 << 63)
                yield [np.full(len(part), tile, np.int64), side, n[part], cid[part],
                       np.full(len(part), cid[hub], np.int64), np.full(len(part), n[hub], np.int32)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "n", "cid")]
                rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            token, n, cid = rest
            new = np.r_[True, (token[1:] != token[:-1]) | (cid[1:] != cid[:-1]) | (n[1:] != n[:-1])]
            token, n, cid = token[new], n[new], cid[new]
            heads = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            ends = np.r_[heads[1:], len(token)]
            if batch is not None:  # the last group may go on
                rest = [x[heads[-1] :] for x in (token, n, cid)]
                heads, ends = heads[:-1], ends[:-1]
            several = np.flatnonzero(ends - heads > 1)
            out = [r for g in several for r in rows_of(int(token[heads[g]]), n[heads[g] : ends[g]], cid[heads[g] : ends[g]])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    return tokens.mapInArrow(cut, "tile bigint, side int, n int, cid bigint, hub bigint, hub_n int")


def _with_end(batches):
    yield from batches
    yield None


def sets_of(docs: DataFrame, wanted: DataFrame, full: bool) -> DataFrame:
    """cid, n and, if full, sorted shingles, else signatures (bits, wide) for the rows of wanted: cid and a doc_id of it."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, ns, bits, wide, sets = [], [], [], [], []
            for cid, text in zip(batch.column("cid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = lowered_words(text)
                if words and content_id(words) == cid:  # ids that several texts share meet several cids
                    x = shingle_set(words)
                    cids.append(cid)
                    ns.append(len(x))
                    bits_wide = None if full else wide_signature(x)
                    bits.append(None if full else folded(bits_wide, SIGNATURE_BITS // 64).tobytes())
                    wide.append(None if full else bits_wide.tobytes())
                    sets.append(x.tobytes() if full else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cids, pa.int64()), pa.array(ns, pa.int32()), *[pa.array(c, pa.binary()) for c in (bits, wide, sets)]],
                ["cid", "n", "bits", "wide", "shingles"])

    found = attach(docs.select("doc_id", "text"), wanted, ["doc_id"], "inner").select("cid", "text")
    return found.mapInArrow(build, "cid bigint, n int, bits binary, wide binary, shingles binary")


def passing(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose wide signatures leave room for a link.

    Signatures are shuffled to the pairs: as broadcasts, wide as they are, they would fill the driver.
    """
    end = lambda c: signatures.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}"))
    both = pairs
    for c in ("a", "b"):
        both = attach(both, end(c), [c], "inner", few=False)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = []
            for x, y, n, m in zip(*[batch.column(c).to_pylist() for c in ("wide_a", "wide_b", "n_a", "n_b")], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                length = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, length) ^ folded(y, length)).sum())
                stays.append(enough((n + m - differ) // 2, n, m))
            yield batch.select(["a", "b"]).filter(pa.array(stays, pa.bool_()))

    return both.select("a", "b", "n_a", "wide_a", "n_b", "wide_b").mapInArrow(bound, "a bigint, b bigint")


def verified(docs: DataFrame, pairs: DataFrame, first: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs a, b that link, by exact intersection.

    Pairs are gathered by the least set two links away, near enough to a component of the pairs' graph for a set to
    travel to few places, and these are cut into blocks of BLOCK_BYTES of sets: a set travels once for each pair of
    blocks it has pairs in, not once for each pair. Only sets in pairs are built.
    """
    pairs = scratch.put(pairs, f"{name}-pairs")
    both = pairs.union(pairs.select("b", "a"))
    one = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    two = both.join(one.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("m"))
    two = scratch.put(two, f"{name}-near")
    end = lambda c: two.select(F.col("a").alias(c), F.col("m").alias(f"m_{c}"))
    rooted = attach(attach(pairs, end("a"), ["a"], "inner"), end("b"), ["b"], "inner").select(
        F.least("m_a", "m_b").alias("root"), "a", "b")
    rooted = scratch.put(rooted, f"{name}-rooted")
    nodes = scratch.put(first.join(two.select(F.col("a").alias("cid")), "cid", "left_semi"), f"{name}-nodes")
    each = rooted.select("root", F.col("a").alias("cid")).union(rooted.select("root", "b")).distinct()
    parts = attach(each, nodes.select("cid", "n"), ["cid"], "inner").groupBy("root").agg(
        F.ceil(F.sum(F.col("n") * 8) / F.lit(BLOCK_BYTES)).cast("int").alias("parts")).where("parts > 1")
    cut = attach(rooted, scratch.put(parts, f"{name}-parts"), ["root"]).withColumn("parts", F.coalesce("parts", F.lit(1)))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int")
    cut = cut.select("root", block("a").alias("block_a"), block("b").alias("block_b"), "a", "b")
    dealt = scratch.put(cut.select("root", F.least("block_a", "block_b").alias("x"), F.greatest("block_a", "block_b").alias("y"),
                                   "a", "b"), f"{name}-dealt")
    tile = ["root", "x", "y"]
    needs = dealt.select(*tile, F.col("a").alias("cid")).union(dealt.select(*tile, "b")).distinct()
    sets = sets_of(docs, nodes.select("cid", "doc_id"), True).select("cid", "shingles")
    rows = attach(sets, scratch.put(needs, f"{name}-needs"), ["cid"], "inner").select(
        *tile, F.col("cid").alias("a"), F.lit(None).cast("bigint").alias("b"), "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, {}
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in (*tile, "a", "b", "shingles")]
            for root, x, y, a, b, shingles in zip(*columns, strict=True):
                if (root, x, y) != now:
                    now, have = (root, x, y), {}
                if b is None:
                    have[a] = np.frombuffer(shingles, np.uint64)
                    continue
                one, other = have[a], have[b]
                both = np.sort(np.concatenate([one, other]), kind="stable")
                if enough(int((both[1:] == both[:-1]).sum()), len(one), len(other)):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    together = rows.unionByName(dealt.withColumn("shingles", F.lit(None).cast("binary")))
    sorted_ = together.repartition(*tile).sortWithinPartitions(*tile, F.asc_nulls_first("b"))
    return scratch.put(sorted_.mapInArrow(compare, "a bigint, b bigint"), f"{name}-links")


@lru_cache(maxsize=32)
def all_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of n, at most 2 * TILE of them in a tile."""
    return np.triu_indices(n, 1)


def possible(i: np.ndarray | int, j: np.ndarray, side: np.ndarray, n: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of places i, j may link, and the most that their overlap can be as a share of their union."""
    a, b = n[i], n[j]
    differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
    overlap = (a + b - differ) // 2
    ok = enough(overlap, a, b) & (DENOMINATOR * np.minimum(a, b) >= NUMERATOR * np.maximum(a, b))
    if side.any():
        ok &= side[i] != side[j]
    return ok, overlap / np.maximum(1, a + b - overlap)


def every_pair(side: np.ndarray, n: np.ndarray, root: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All possible pairs of a tile between different components."""
    i, j = all_pairs(len(n))
    open_ = root[i] != root[j]
    i, j = i[open_], j[open_]
    if not len(i):
        return i, j
    ok, _ = possible(i, j, side, n, bits)
    return i[ok], j[ok]


def spanning_pairs(side: np.ndarray, n: np.ndarray, root: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a tile's components over its possible pairs, likeliest pairs first (Prim's way)."""
    best, of, done = np.full(len(n), -1.0), np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    pairs = []
    while not done.all():
        k = int(np.argmax(np.where(done, -2.0, best)))
        if best[k] >= 0:
            pairs.append((of[k], k))
        members = np.flatnonzero((root == root[k]) & ~done)
        done[members] = True
        open_ = np.flatnonzero(~done)
        if len(open_):
            for v in members:
                ok, share = possible(v, open_, side, n, bits)
                better = ok & (share > best[open_])
                best[open_[better]], of[open_[better]] = share[better], v
    i, j = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    return i, j


def chosen_pairs(heads: np.ndarray, ends: np.ndarray, side: np.ndarray, n: np.ndarray, root: np.ndarray, bits: np.ndarray,
                 choose) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs that choose takes from each tile of rows heads to ends: place of the tile in heads, and of both rows.

    Most tiles are small and have no possible pair or one, which leaves no choice: the pairs of all tiles of one size
    are looked at together, and choose decides for the rest.
    """
    sizes = ends - heads
    two = np.repeat(np.maximum.reduceat(side, heads), sizes) if len(heads) else side
    rest = [np.flatnonzero(sizes > SMALL_TILE)]
    for size in range(2, SMALL_TILE + 1):
        tiles_ = np.flatnonzero(sizes == size)
        if not len(tiles_):
            continue
        i, j = ((heads[tiles_][:, None] + x).ravel() for x in all_pairs(size))
        of = np.repeat(tiles_, size * (size - 1) // 2)
        open_ = (root[i] != root[j]) & ((two[i - heads[0]] == 0) | (side[i] != side[j]))
        i, j, of = i[open_], j[open_], of[open_]
        ok, _ = possible(i, j, np.zeros(1, np.int32), n, bits)
        i, j, of = i[ok], j[ok], of[ok]
        times = np.bincount(of, minlength=len(heads))
        rest.append(np.flatnonzero(times > 1))
        alone = times[of] == 1
        yield of[alone], i[alone], j[alone]
    for t in np.concatenate(rest):
        part = slice(heads[t], ends[t])
        i, j = choose(side[part], n[part], root[part], bits[part])
        yield np.full(len(i), t), heads[t] + i, heads[t] + j


def open_pairs(open_tiles: DataFrame, choose) -> DataFrame:
    """tile, a, b: the pairs that choose takes from each tile; rows of tile, side, n, cid, root, bits."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        for batch in _with_end(batches):
            if batch is not None:
                now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "side", "n", "cid", "root")}
                now["n"] = now["n"].astype(np.int64)
                now["bits"] = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, SIGNATURE_BITS // 64)
                rest = now if rest is None else {c: np.concatenate([rest[c], now[c]]) for c in now}
            if rest is None or not len(rest["tile"]):
                continue
            heads = np.flatnonzero(np.r_[True, rest["tile"][1:] != rest["tile"][:-1]])
            ends = np.r_[heads[1:], len(rest["tile"])]
            if batch is not None:
                heads, ends = heads[:-1], ends[:-1]
            pairs, cid = [], rest["cid"]
            for of, i, j in chosen_pairs(heads, ends, *(rest[c] for c in ("side", "n", "root", "bits")), choose):
                if len(i):
                    pairs.append(np.stack([rest["tile"][heads[of]], np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])]))
            if batch is not None and len(ends):
                rest = {c: x[ends[-1] :] for c, x in rest.items()}
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(pairs, axis=1)], ["tile", "a", "b"])

    dealt = open_tiles.repartition("tile").sortWithinPartitions("tile", "side", "n", "cid")
    return dealt.select("tile", "side", "n", "cid", "root", "bits").mapInArrow(compare, "tile bigint, a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, class_id (of its word sequence; null without words),
    text_hash and root (one value for each component; null without words).

    Reads doc_id and text. A-Z are lower-cased; white space and case make no difference. Texts that are null, empty or
    blank have no shingles and are components of their own. Rows without an id take part; a component without any
    id has none. Repeated rows and equal texts share class and component. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    scanned = scratch.put(scan_sets(docs), "scan")
    meta = scanned.where("bucket IS NULL").select("doc_id", "text_hash", "cid", "n")
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for bucket, count in scanned.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count")).toLocalIterator():
        counts[bucket] = count  # 2 ** BUCKET_BITS rows at most
    tokens = prefix_tokens(docs, counts)
    met = scratch.put(tiles(tokens.repartition("token").sortWithinPartitions("token", "n", "cid")), "tiles")

    first = meta.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    first = scratch.put(met.select("cid").distinct().join(first, "cid"), "wanted")
    signatures = scratch.put(sets_of(docs, first.drop("n"), False).drop("shingles").dropDuplicates(["cid"]), "signatures")

    near = F.least("n", "hub_n") * DENOMINATOR >= F.greatest("n", "hub_n") * NUMERATOR
    star = met.where((F.col("hub") != F.col("cid")) & near).select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    star = scratch.put(star, "star")
    links = verified(docs, passing(star, signatures), first, scratch, "stars")
    roots, tested = scratch.put(components(links, scratch, "one"), "roots1"), star
    kinds = met.groupBy("tile").agg(F.max("side").alias("two"))
    blocks = scratch.put(kinds, "kinds")
    met_in = lambda tiles: met.join(tiles.select("tile"), "tile", "left_semi")
    looked = None  # tiles in which some pair may link
    rounds = [lambda: (met_in(blocks.where("two = 0")), spanning_pairs), lambda: (met_in(blocks.where("two = 1")), spanning_pairs),
              lambda: (met_in(looked), every_pair)]
    for k, round_ in enumerate(rounds):
        places, choose = round_()
        labelled = attach(places.select("tile", "side", "n", "cid"), roots.withColumnRenamed("node", "cid"), ["cid"])
        labelled = scratch.put(labelled.withColumn("root", F.coalesce("root", "cid")), f"labelled{k}")
        several = labelled.groupBy("tile").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        still = labelled.join(several.select("tile"), "tile", "left_semi")
        still = attach(still, signatures.select("cid", "bits"), ["cid"], "inner", few=False)  # as in passing()
        found = scratch.put(open_pairs(still, choose), f"found{k}")
        scratch.drop(f"labelled{k}")
        tiles_now = found.select("tile").distinct()
        looked = tiles_now if looked is None else looked.union(tiles_now)
        more = scratch.put(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), f"open{k}")
        if more.isEmpty():
            continue
        links = links.unionByName(verified(docs, passing(more, signatures), first, scratch, f"more{k}"))
        tested = tested.unionByName(more)
        roots = scratch.put(components(links, scratch, f"two{k}"), f"roots2{k}")
    for name in ("tiles", "signatures"):
        scratch.drop(name)

    placed = scratch.put(attach(meta, roots.withColumnRenamed("node", "cid"), ["cid"]).withColumn(
        "root", F.coalesce("root", "cid")), "placed")
    smallest = scratch.put(placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return attach(placed, smallest, ["root"]).select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("cid").alias("class_id"), "text_hash", "root")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, of its smallest doc_id, and every row without words, in docs' columns.

    Rows with an id come before rows without; of repeated rows one stays. Other columns may have any type and name and
    keep their values.
    """
    scratch, key = Scratch(docs.sparkSession, "kept"), ["doc_id", "text_hash"]
    found = near_duplicates(docs).where("root IS NOT NULL").groupBy(*key, "root").agg(F.count("*").alias("times"))
    found = scratch.put(found, "classes")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *key)).alias("first"))
    chosen = attach(found, scratch.put(first, "first"), ["root"]).select(
        *key, "times", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("stays"))
    chosen = scratch.put(chosen, "chosen")
    rows = held(docs, doc_id=F.col("doc_id"), text_hash=F.xxhash64("text"))
    kept = attach(rows, chosen.where("NOT stays").select(*key), key, "left_anti")
    repeated = chosen.where("stays AND times > 1").select(*key)
    once = attach(kept, repeated, key, "left_anti").unionByName(attach(kept, repeated, key, "left_semi").dropDuplicates(key))
    return once.select("__row.*")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP8_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i + 1:i + 5], ' ')) AS g FROM p),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
        WHERE 100 * o >= 75 * (nx.n + ny.n - o)),
both_ways AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON reach.r = x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.r) AS component_id
FROM d JOIN reach ON d.doc_id = reach.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
