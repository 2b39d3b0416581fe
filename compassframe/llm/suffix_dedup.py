"""Removal of long repeated strings by a logarithmic family of sparse suffix arrays.

Documents come in batches, in order of id. A batch's suffix array holds suffixes at anchors only: the anchor of a
LENGTH-byte window is its rarest-hashed GRAM-byte substring, so equal windows have equal anchors at equal places, and
neighbouring windows share one. An entry stands for the run of windows of one anchor: the anchor's hash, a hash of
the run's bytes with its reach to both sides, document and position, in the order of the hashes, cut into parts of
like size by a hash of the anchor's hash (which is the least of many, so most of them are small numbers). A new batch is merge-scanned with the entries of all levels, part by part; levels that have grown
as large as what comes in are merged in the same pass, so there are about log2(batches) levels.

A run that occurred earlier goes as a whole. Runs that share an anchor but not all their bytes (where a repeat begins
or ends) are compared window by window on their bytes, fetched from the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compassframe.llm.common import Scratch, attach, documents, small_batches

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1  # grams of a window
BATCHES = 4
PART_BYTES = 16 << 20
#: Entries a task holds before it sends them on, and bytes that are hashed at once.
HOLD, CHUNK = 1 << 16, 1 << 18
#: Documents whose bytes are cut out at a time.
CUT_ROWS = 500
LEVEL, SPANS, OPEN = 0, 1, 2
BLOBS = ["a", "b", "c", "d"]
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_LOW, _DUP = np.uint64(CHUNK - 1), 40
_TABLE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_MUL, _INV):
            x = np.full(CHUNK + 1, base, dtype=np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def pieces(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """A text in parts of at most half a chunk that share LENGTH - 1 bytes, with where they start."""
    step = CHUNK // 2 - LENGTH + 1
    for at in range(0, max(1, len(raw) - LENGTH + 1), step):
        if len(raw) - at >= LENGTH:
            yield at, raw[at : at + CHUNK // 2]


def runs(chunk: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """The runs of (document, position of the first byte, bytes): anchor hash, content and reach, document, position."""
    b = np.frombuffer(b"".join(x for _, _, x in chunk), dtype=np.uint8)
    sizes = np.array([len(x) for _, _, x in chunk])
    first = np.cumsum(sizes) - sizes
    t = _TABLE[b]
    mul = lambda n: np.uint64(pow(_MUL, n, 1 << 64))
    h2 = t[:-1] * mul(1) + t[1:]
    h4 = h2[:-2] * mul(2) + h2[2:]
    h8 = h4[:-4] * mul(4) + h4[4:]
    h16 = h8[:-8] * mul(8) + h8[8:]
    gram = mixed(h16[:-8] * mul(8) + h8[16:])
    low = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
    for n in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-n], low[n:])
    low = np.minimum(low[: -(SPAN - 64)], low[SPAN - 64 :])  # the leftmost least gram of each window
    anchor = (low & _LOW).astype(np.int64)
    piece = np.repeat(np.arange(len(chunk)), sizes)[: len(anchor)]
    valid = np.arange(len(anchor)) + LENGTH <= (first + sizes)[piece]
    change = valid[1:] & valid[:-1] & (anchor[1:] == anchor[:-1]) & (piece[1:] == piece[:-1])
    p0 = np.flatnonzero(valid & ~np.r_[False, change])
    p1 = np.flatnonzero(valid & ~np.r_[change, False])
    up, down = powers()
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(t * down[: len(t)], dtype=np.uint64)]
    content = mixed((total[p1 + LENGTH] - total[p0]) * up[p0] + (p1 - p0).astype(np.uint64))
    at, of = anchor[p0], piece[p0]
    reach = ((at - p0) << 8 | (at - p1)).astype(np.uint64)
    docs, bases = (np.array([x[i] for x in chunk], dtype=np.int64) for i in (0, 1))
    return [gram[at], (content & ~np.uint64(0xFFFF)) | reach, docs[of], bases[of] + at - first[of]]


def spans_of(y: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Maximal spans (document, start, end) of whole runs; starts and ends keep the number of the text."""
    start, end = pos - (y >> np.uint64(8) & np.uint64(255)).astype(np.int64), pos - (y & np.uint64(255)).astype(np.int64) + LENGTH
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return [doc, start, end]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])]  # ends rise with starts in a document
    return [doc[new], start[new], np.maximum.reduceat(end, np.flatnonzero(new))]


def ordered(k: np.ndarray, y: np.ndarray, doc: np.ndarray, pos: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Entries in the order of all four, each once: repeated rows are one document."""
    order = np.lexsort((pos, doc, y, k))
    k, y, doc, pos, *more = (x[order] for x in (k, y, doc, pos, *more))
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (y[1:] != y[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    return [x[new] for x in (k, y, doc, pos, *more)]


def pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compresses."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def row(part: int, kind: int, columns: list[np.ndarray]) -> dict:
    blobs = [pack(c) for c in columns] + [b""] * (4 - len(columns))
    return {"part": part, "kind": kind, "batch": 0, **dict(zip(BLOBS, blobs, strict=True))}


def part_of(k: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of each anchor hash. Hashed once more: anchors are the least hashes of their windows, so not uniform."""
    return (mixed(k * np.uint64(_MUL)) >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)


SCHEMA = "part int, kind int, batch int, a binary, b binary, c binary, d binary"
ARROW = pa.schema([*[(c, pa.int32()) for c in ("part", "kind", "batch")], *[(c, pa.binary()) for c in BLOBS]])


def batch_entries(docs: DataFrame, n_parts: int) -> DataFrame:
    """Blobs of a batch's entries by part; of runs that a task has seen earlier, only spans to remove."""
    def send(held: list[list[np.ndarray]]) -> Iterator[dict]:
        k, y, doc, pos = ordered(*(np.concatenate(c) for c in zip(*held, strict=True)))
        again = np.r_[False, (k[1:] == k[:-1]) & (y[1:] == y[:-1])]
        if again.any():
            yield row(int(k[0] % np.uint64(n_parts)), SPANS, spans_of(y[again], doc[again], pos[again]))
        k, y, doc, pos = k[~again], y[~again], doc[~again], pos[~again]
        part = part_of(k, n_parts)
        by_part = np.argsort(part, kind="stable")
        part, k, y, doc, pos = (x[by_part] for x in (part, k, y, doc, pos))
        heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(heads, np.r_[heads[1:], len(part)], strict=True):
            yield row(int(part[a]), LEVEL, [x[a:b] for x in (k, y, doc, pos)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, chunk, size = [], 0, [], 0
        for batch in (b.slice(i, CUT_ROWS) for b in batches for i in range(0, b.num_rows, CUT_ROWS)):
            for doc, dup, text in zip(*[batch.column(c).to_pylist() for c in ("id", "dup", "text")], strict=True):
                for at, raw in pieces(text.encode("utf-8", "surrogatepass") if text else b""):
                    if size + len(raw) > CHUNK:
                        held.append(runs(chunk))
                        n += len(held[-1][0])
                        chunk, size = [], 0
                    chunk.append((doc, (dup << _DUP) + at, raw))
                    size += len(raw)
            if n > HOLD:
                yield pa.RecordBatch.from_pylist(list(send(held)), ARROW)
                held, n = [], 0
        if chunk:
            held.append(runs(chunk))
        if held:
            yield pa.RecordBatch.from_pylist(list(send(held)), ARROW)

    return docs.select("id", "dup", "text").mapInArrow(scan, SCHEMA)


def merge_scan(merge: frozenset[int], newest: int, keep: bool):
    """Scans one part: the new batch's entries (batch = newest) against those of all levels.

    Returns the entries of the new level (the batch's first of each content and those of the levels in merge), spans
    of runs that occur earlier, and the entries of anchors where contents differ and something is new.
    """
    def scan(table: pa.Table) -> pa.Table:
        part, kinds = table.column("part")[0].as_py(), np.array(table.column("kind").to_pylist())
        out = table.take(np.flatnonzero(kinds == SPANS)).to_pylist()
        entries = table.take(np.flatnonzero(kinds == LEVEL))
        if not entries.num_rows:
            return pa.Table.from_pylist(out, ARROW)
        read = lambda c, kind: [unpack(x, kind) for x in entries.column(c).to_pylist()]
        keys = read("a", np.uint64)
        level = np.repeat(np.array(entries.column("batch").to_pylist()), [len(x) for x in keys])
        k, y, doc, pos = np.concatenate(keys), *(np.concatenate(read(c, t)) for c, t in (("b", np.uint64), ("c", np.int64), ("d", np.int64)))
        k, y, doc, pos, level = ordered(k, y, doc, pos, level)
        same = (k[1:] == k[:-1]) & (y[1:] == y[:-1])
        again = np.r_[False, same]
        if again.any():
            out.append(row(part, SPANS, spans_of(y[again], doc[again], pos[again])))
        first = ~again
        k, y, doc, pos, level = (x[first] for x in (k, y, doc, pos, level))
        heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[heads, len(k)])
        fresh = np.add.reduceat((level == newest).astype(np.int64), heads) > 0
        several = np.repeat((sizes > 1) & fresh, sizes)
        if several.any():
            out.append(row(part, OPEN, [x[several] for x in (k, y, doc, pos)]))
        stays = np.isin(level, [*merge, newest])
        if keep and stays.any():
            out.append(row(part, LEVEL, [x[stays] for x in (k, y, doc, pos)]))
        return pa.Table.from_pylist(out, ARROW)

    return scan


class IndexFamily:
    """The levels: each is a table of entries by part, and the number of batches it covers."""

    def __init__(self, scratch: Scratch, n_parts: int):
        self.scratch, self.n_parts, self.added = scratch, n_parts, 0
        self.levels: list[tuple[int, int]] = []  # batches covered, number of the batch that made the level

    def _made(self, batch: int, kind: int) -> DataFrame:
        path = f"{self.scratch.folder}/batch{batch}"
        return self.scratch.spark.read.schema(SCHEMA).parquet(path).where(F.col("kind") == kind)

    def add(self, docs: DataFrame, last: bool = False) -> None:
        """Scans a batch of id, dup and text, later in order than all before; without keeping it if it is the last."""
        self.added += 1
        size, merge, scanned = 1, [], [b for _, b in self.levels]
        while self.levels and self.levels[-1][0] == size and not last:
            merge.append(self.levels.pop()[1])
            size *= 2
        rows = batch_entries(docs, self.n_parts).withColumn("batch", F.lit(self.added))
        for b in scanned:
            rows = rows.unionByName(self._made(b, LEVEL).withColumn("batch", F.lit(b)))
        # one part a task: blobs are large, and parts put together would be held together
        found = rows.repartition(self.n_parts, "part").groupBy("part").applyInArrow(merge_scan(frozenset(merge), self.added, not last), SCHEMA)
        with small_batches(self.scratch.spark):
            found.write.partitionBy("kind").parquet(f"{self.scratch.folder}/batch{self.added}")
        self.levels.append((size, self.added))
        for b in merge:
            self.scratch.drop(f"batch{b}/kind={LEVEL}")

    def found(self, kind: int, schema: str, names: list[str]) -> DataFrame:
        """Rows out of the blobs of a kind, of all batches."""
        types = [np.uint64 if n in ("k", "y") else np.int64 for n in names]

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blobs in zip(*[batch.column(c).to_pylist() for c in BLOBS[: len(names)]], strict=True):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(unpack(x, t).view(np.int64)) for x, t in zip(blobs, types, strict=True)], names)

        made = [self._made(b + 1, kind) for b in range(self.added)]
        rows = made[0]
        for x in made[1:]:
            rows = rows.unionByName(x)
        return rows.select(*BLOBS).mapInArrow(spread, schema)


def open_spans(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """Spans (id, start, end) of the windows of the entries in spots (k, y, id, pos) that occur at earlier ones."""
    spot = F.struct("k", F.col("y").bitwiseAND(0xFFFF).alias("reach"), "pos")
    by_doc = spots.groupBy("id", F.shiftright("pos", _DUP).cast("int").alias("dup")).agg(F.collect_set(spot).alias("spots"))
    joined = beside(docs, by_doc, "inner").select("doc_id", "id", "text", "spots")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, CUT_ROWS) for b in batches for i in range(0, b.num_rows, CUT_ROWS)):
            out: list[list] = [[], [], [], [], []]
            for doc, text, wanted in zip(*[batch.column(c).to_pylist() for c in ("id", "text", "spots")], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for s in wanted:
                    at = s["pos"] & ((1 << _DUP) - 1)
                    a, b = at - (s["reach"] >> 8), at - (s["reach"] & 255) + LENGTH
                    for column, value in zip(out, (s["k"], s["reach"], doc, s["pos"], raw[a:b]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.binary())], ["k", "reach", "id", "pos", "bytes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, last = None, set(), None
        for batch in (b.slice(i, 8 * CUT_ROWS) for b in batches for i in range(0, b.num_rows, 8 * CUT_ROWS)):
            ids, starts, ends = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("k", "reach", "id", "pos", "bytes")]
            for k, reach, doc, pos, raw in zip(*columns, strict=True):
                if (k, doc, pos, reach) == last:  # a repeated row; a run over a cut of pieces() has two reaches
                    continue
                last = k, doc, pos, reach
                if k != now:
                    now, seen = k, set()
                left = reach >> 8
                mine = [(left - i, raw[i : i + LENGTH]) for i in range(len(raw) - LENGTH + 1)]
                hit = [i for i, w in enumerate(mine) if w in seen]
                seen.update(mine)
                for n, i in enumerate(hit):
                    if n and i == hit[n - 1] + 1:
                        ends[-1] += 1
                    else:
                        ids.append(doc)
                        starts.append(pos - left + i)
                        ends.append(pos - left + i + LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ends)], ["id", "start", "end"])

    cuts = joined.mapInArrow(cut, "k bigint, reach bigint, id bigint, pos bigint, bytes binary")
    dealt = cuts.repartition("k").sortWithinPartitions("k", "id", "pos", "reach")
    return dealt.mapInArrow(compare, "id bigint, start bigint, end bigint")


def beside(docs: DataFrame, by_doc: DataFrame, how: str) -> DataFrame:
    """docs (doc_id, text, id, dup) with what by_doc has for their id and dup.

    Always by a merge of shuffled tables: texts are shuffled in one way and with the same columns wherever this is
    used in a query, so Spark shuffles them once for all.
    """
    return docs.join(by_doc.hint("merge"), ["id", "dup"], how)


def identified(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text, id (a null doc_id comes first) and dup, the number of the text among those of its id."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"),
                       F.xxhash64("text").alias("text_hash"))
    texts = rows.groupBy("id").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low <> high")
    texts = scratch.put(texts.select("id"), "shared-ids")
    if texts.isEmpty():
        # not a literal: that would leave the keys of joins, and each join would shuffle the texts in its own way
        return rows.select("doc_id", "text", "id", (F.col("id") * 0).cast("int").alias("dup"))
    several = rows.select("id", "text_hash").join(texts, "id").distinct().withColumn(
        "dup", F.row_number().over(Window.partitionBy("id").orderBy("text_hash")) - 1)
    return attach(rows, scratch.put(several, "dups"), ["id", "text_hash"]).select(
        "doc_id", "text", "id", F.coalesce("dup", F.lit(0)).alias("dup"))


def remove_repeats(docs: DataFrame, n_batches: int = BATCHES, with_bytes: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that remain,
    null unless asked for).

    A byte goes if a LENGTH-byte string over it also starts earlier: in a smaller doc_id, or earlier in the document.
    Reads doc_id (an integer) and text. Null texts count as empty; a null id comes first. Repeated rows are one
    document; texts that share an id are told apart by a hash, which also orders them. Texts shorter than LENGTH
    bytes stay whole.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = identified(docs, scratch)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    family = IndexFamily(scratch, int(min(1 << 20, max(8, -(-total // PART_BYTES)))))
    shares = [i / n_batches for i in range(1, n_batches)]
    edges = sorted(set(rows.agg(F.percentile_approx("id", shares)).first()[0] or [])) if shares else []
    bounds = [None, *edges, None]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        batch = rows if low is None else rows.where(F.col("id") > low)
        family.add(batch if high is None else batch.where(F.col("id") <= high), last=i == len(edges))
    spots = family.found(OPEN, "k bigint, y bigint, id bigint, pos bigint", ["k", "y", "id", "pos"])
    whole = family.found(SPANS, "id bigint, start bigint, end bigint", ["id", "start", "end"])
    with small_batches(docs.sparkSession):
        return scratch.put(without(rows, whole.unionByName(open_spans(rows, spots)), with_bytes), "rest")


def without(docs: DataFrame, spans: DataFrame, with_bytes: bool) -> DataFrame:
    """What remove_repeats returns, for docs (doc_id, text, id, dup) and the spans (id, start, end) that go."""
    by_doc = spans.groupBy("id", F.shiftright("start", _DUP).cast("int").alias("dup")).agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << _DUP) - 1
        for batch in batches:
            sizes, removed, counts, hashes, kept = [], [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                out, at, n = [], 0, 0
                for a, b in sorted((s["start"] & mask, s["end"] & mask) for s in spans or []):
                    if a > at or not n:
                        out.append(raw[at:a])
                        n += 1
                    at = max(at, b)
                rest = b"".join([*out, raw[at:]])
                sizes.append(len(raw))
                removed.append(len(raw) - len(rest))
                counts.append(n)
                hashes.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_bytes else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (sizes, removed, counts)], pa.array(hashes, pa.string()),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return beside(docs, by_doc, "left").select("doc_id", "text", "spans").mapInArrow(
        apply, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS i FROM d)),
again AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY md5(s) ORDER BY doc_id, i) > 1),
edge AS (SELECT doc_id, i, coalesce(i > 100 + max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM again),
runs AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, r),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN g.b IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (g.b - a)) END, '' ORDER BY a) AS k
  FROM gaps g JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS c, sum(b - a) AS r FROM spans GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
