"""Ranked lexical search: impact vectors in norm buckets, pruned by Cauchy-Schwarz, rescored exactly in integers.

A document is a vector over the terms that the items ask for: the impact of a term is its weight times a saturated
count. Score and bounds share one scale: a coordinate of either side carries the root of the weight, so that an
item's vector times a document's is the score. Documents are kept by falling length and cut into buckets of similar
length. For an item a bucket whose longest vector times the item's is below the item's 20th best score is skipped; in
the others the item's heaviest coordinates, as many as leave a rest that no untouched document can live on, are
summed, the rest of a document is bounded by what is left of both lengths, and what survives is scored in 64-bit
integers.

Bounds carry a margin for rounding; a document is dropped only below the threshold, never at it, so ties are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compassframe.llm.common import Scratch, documents, small_batches

TOP, BUCKET, SHRINK = 20, 4096, 0.5  # ranks; vectors of a bucket at most; shortest to longest in it at least
#: Distinct terms of items that are searched in one pass over the documents; more are cut into blocks of items.
BLOCK_TERMS = 200_000
MARGIN = 1 + 1e-9
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters beyond ASCII; A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, count: the terms of all distinct texts of an item together."""
    id_type = items.schema["item_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms, counts = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for term, n in Counter(terms_of(text)).items():
                    rows.append(k)
                    terms.append(term)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(rows, pa.int64())), pa.array(terms, pa.binary()), pa.array(counts, pa.int64())],
                ["item_id", "term", "count"])

    rows = items.select("item_id", "text").distinct().mapInArrow(count, f"item_id {id_type}, term binary, count bigint")
    return rows.groupBy("item_id", "term").agg(F.sum("count").alias("count"))


def count_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), terms and counts (of the vocabulary, ascending); and a row without n for each
    task with the document frequencies that it saw."""
    id_type, known = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["doc_id", "n", "terms", "counts"]

    def lists(values: list[np.ndarray]) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, df, id_arrow = known.value, np.zeros(len(known.value), dtype=np.int64), None
        for batch in batches:
            ns, terms, counts = [], [], []
            id_arrow = batch.schema.field("doc_id").type
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                found = Counter(map(of.get, words))
                found.pop(None, None)
                ids = np.array(sorted(found), dtype=np.int64)
                ns.append(len(words))
                terms.append(ids)
                counts.append(np.array([found[int(i)] for i in ids], dtype=np.int64))
                df[ids] += 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int64()), lists(terms), lists(counts)], names)
        some = np.flatnonzero(df)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_arrow), pa.nulls(1, pa.int64()), lists([some]), lists([df[some]])], names)

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {id_type}, n bigint, terms array<bigint>, counts array<bigint>")


def term_weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def impact_vectors(counted: DataFrame, weights: np.ndarray, n_documents: int, n_terms: int) -> DataFrame:
    """doc_id, norm, terms and impacts of documents with a term of weight, by falling norm within partitions."""
    id_type, shared = counted.schema["doc_id"].dataType.simpleString(), counted.sparkSession.sparkContext.broadcast(weights)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            terms, counts = batch.column("terms"), batch.column("counts")
            offsets = terms.offsets.to_numpy() - terms.offsets[0].as_py()
            t, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy()
            row = np.repeat(np.arange(len(batch)), np.diff(offsets))
            m = 75 + (25 * batch.column("n").to_numpy() * n_documents) // n_terms
            x = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
            norm = np.sqrt(np.bincount(row, weights=w[t] * x.astype(np.float64) ** 2, minlength=len(batch)))
            impacts = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(w[t] * x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(norm), terms, impacts], ["doc_id", "norm", "terms", "impacts"])

    vectors = counted.where("n IS NOT NULL AND size(terms) > 0").mapInArrow(
        weigh, f"doc_id {id_type}, norm double, terms array<bigint>, impacts array<bigint>")
    return vectors.where("norm > 0").sortWithinPartitions(F.desc("norm"))


class Item:
    """An item's coordinates, heaviest first, and its best documents so far."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, least: int):
        scaled = counts * np.sqrt(weights[terms].astype(np.float64))
        order = np.lexsort((terms, -weights[terms]))
        self.terms, self.counts, self.scaled = terms[order], counts[order], scaled[order]
        self.rest = np.sqrt(np.cumsum((self.scaled**2)[::-1])[::-1])  # length from each coordinate on
        self.rest = np.append(self.rest, 0.0)
        self.least, self.best = least, []

    @property
    def threshold(self) -> int:
        return -self.best[-1][0] if len(self.best) == TOP else self.least

    def take(self, scores: np.ndarray, ids: list) -> None:
        if len(scores) > TOP:
            stays = scores >= np.partition(scores, len(scores) - TOP)[len(scores) - TOP]
            scores, ids = scores[stays], [i for i, s in zip(ids, stays, strict=True) if s]
        new = [(-int(s), i is None, 0 if i is None else i) for s, i in zip(scores, ids, strict=True)]
        self.best = sorted(self.best + new)[:TOP]


class Bucket:
    """Vectors of similar length, by document and by term."""

    def __init__(self, norm: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray, weights: np.ndarray):
        self.norm, self.longest, self.impact = norm, float(norm.max()), impact
        self.width = len(weights)
        self.keys = row * self.width + term  # ascending: rows in order, terms ascending in a row
        order = np.argsort(term, kind="stable")
        self.term, self.row = term[order], row[order]
        self.scaled = impact[order] / np.sqrt(np.maximum(weights[self.term], 1).astype(np.float64))

    def visit(self, item: Item) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows and exact scores of the documents that may be among the item's best; none if the bucket is skipped."""
        least = item.threshold
        reach = item.rest * (self.longest * MARGIN)
        if reach[0] < least:
            return None
        focus = int(np.argmax(reach < least)) if reach[-1] < least else len(item.terms)
        low = np.searchsorted(self.term, item.terms[:focus], "left")
        high = np.searchsorted(self.term, item.terms[:focus], "right")
        if not (high > low).any():
            return None
        spots = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
        rows, x = self.row[spots], self.scaled[spots]
        part = np.bincount(rows, weights=x * np.repeat(item.scaled[:focus], high - low), minlength=len(self.norm))
        used = np.bincount(rows, weights=x * x, minlength=len(self.norm))
        bound = part + item.rest[focus] * np.sqrt(np.maximum(self.norm**2 * MARGIN - used, 0))
        rows = np.flatnonzero((part > 0) & (bound * MARGIN >= least))
        if not len(rows):
            return None
        wanted = rows[:, None] * self.width + item.terms[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        scores = (np.where(self.keys[at] == wanted, self.impact[at], 0) * item.counts).sum(axis=1)
        stays = scores >= least
        return rows[stays], scores[stays]


def best_of(vectors: DataFrame, ids: pa.Array, item_type: str, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray,
            least: list[int], first_only: bool = False) -> DataFrame:
    """item_id, place (of the item in its block), doc_id, score: the best documents of each partition, or of its first bucket."""
    doc_type = vectors.schema["doc_id"].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast((ids, items, weights, least))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, weights, least = shared.value
        open_items = [Item(t, c, weights, max(1, low)) for (t, c), low in zip(items, least, strict=True)]
        doc_arrow = None
        for batch in batches:
            doc_arrow = batch.schema.field("doc_id").type
            docs, norms = batch.column("doc_id").to_pylist(), batch.column("norm").to_numpy()
            offsets = batch.column("terms").offsets.to_numpy() - batch.column("terms").offsets[0].as_py()
            term, impact = batch.column("terms").flatten().to_numpy(), batch.column("impacts").flatten().to_numpy()
            start = 0
            while start < len(docs):
                short = np.flatnonzero(norms[start : start + BUCKET] < SHRINK * norms[start])
                end = start + int(short[0]) if len(short) else min(start + BUCKET, len(docs))
                flat = slice(offsets[start], offsets[end])
                row = np.repeat(np.arange(end - start), np.diff(offsets[start : end + 1]))
                bucket = Bucket(norms[start:end], row, term[flat], impact[flat], weights)
                for item in open_items:
                    if (found := bucket.visit(item)) is not None:
                        item.take(found[1], [docs[start + r] for r in found[0]])
                start = end
                if first_only:
                    break
            if first_only:
                break
        rows = [(k, d, null, -s) for k, item in enumerate(open_items) for s, null, d in item.best]
        if rows:
            place = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(place), place, pa.array([None if r[2] else r[1] for r in rows], doc_arrow), pa.array([r[3] for r in rows], pa.int64())],
                ["item_id", "place", "doc_id", "score"])

    return vectors.mapInArrow(search, f"item_id {item_type}, place bigint, doc_id {doc_type}, score bigint")


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: for every item the 20 documents of highest score above 0, best first.

    Reads doc_id and text of docs, item_id and text of items; other columns are left alone. Null and empty texts have
    no terms. Every row of docs is a document of its own: repeated rows and rows of one doc_id are ranked each; rows
    without doc_id come last among equals. Repeated items count once, and the texts of an item_id are one item. Items
    without a known term have no rows; empty tables give none. Texts are read whole, however long.

    The items' terms travel to all tasks in blocks of BLOCK_TERMS (an item is never cut); a task holds one bucket of
    vectors and 20 documents an item. Vectors are sorted by Spark within the partitions of docs; nothing but each
    task's best documents is shuffled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    asked = scratch.put(item_terms(items), "items")
    item_type = items.schema["item_id"].dataType.simpleString()
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    n_documents = n_terms = None
    found = None
    for b in range(blocks):
        rows = asked.where(block == b).orderBy("item_id", "term").toArrow()
        if not rows.num_rows:
            continue
        names = rows.column("term").to_pylist()
        vocabulary = {t: k for k, t in enumerate(sorted(set(names)))}
        terms = np.array([vocabulary[t] for t in names], dtype=np.int64)
        asked_counts, keys = rows.column("count").to_numpy(), rows.column("item_id").to_pylist()
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        ids = rows.column("item_id").combine_chunks().take(pa.array(cuts[:-1], pa.int64()))
        block_items = [(terms[i:j], asked_counts[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
        with small_batches(spark):
            counted = scratch.put(count_vectors(docs, vocabulary), f"counted{b}")
        if n_documents is None:
            n_documents, n_terms = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_documents:
            continue
        df = np.zeros(len(vocabulary), dtype=np.int64)
        each = counted.where("n IS NULL").select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
        for r in each.groupBy("x.terms").agg(F.sum("x.counts").alias("df")).toLocalIterator():  # the block's terms at most
            df[r["terms"]] = r["df"]
        weights = np.array([term_weight(n_documents, int(n)) for n in df], dtype=np.int64)
        vectors = scratch.put(impact_vectors(counted, weights, n_documents, n_terms), f"vectors{b}")
        scratch.drop(f"counted{b}")
        least = [0] * len(block_items)
        with small_batches(spark, BUCKET):
            longest = best_of(vectors, ids, item_type, block_items, weights, least, first_only=True)
            for r in _first(longest, ["place"]).where(F.col("rank") == TOP).select("place", "score").collect():  # one an item
                least[r["place"]] = r["score"]
            best = scratch.put(best_of(vectors, ids, item_type, block_items, weights, least), f"best{b}")
        scratch.drop(f"vectors{b}")
        found = best if found is None else found.unionByName(best)
    if found is None:
        doc_type = docs.schema["doc_id"].dataType.simpleString()
        found = spark.createDataFrame([], f"item_id {item_type}, place bigint, doc_id {doc_type}, score bigint")
    return _first(found, ["item_id"]).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS t FROM documents),
size AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
tf AS MATERIALIZED (SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d)
        WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term, n_docs),
x AS (SELECT k, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS x FROM tf JOIN w USING (term), size),
s AS (SELECT item_id, k, doc_id, sum(c * x)::BIGINT AS score FROM q JOIN x USING (term) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""
