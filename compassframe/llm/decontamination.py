"""Benchmark decontamination: which documents hold a window of words of a benchmark item.

A prefix-filtered set join. A window (WINDOW consecutive words, or a whole shorter item) is a set of word shingles.
It can occur only where all of them do, so one is a sufficient prefix: the rarest over all documents, which makes
the fewest candidates. Documents' shingles are joined with those anchors; a candidate must leave room for the whole
window (position and length bounds) and is then verified word for word.

The benchmark side is the stated query set: it is broadcast in blocks of bounded size, one pass over the documents
for each block, so documents are never shuffled by shingle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compassframe.llm.common import Scratch, ascii_lower, attach, documents, held

WINDOW, SHINGLE = 10, 3
#: Rows of a broadcast block: shingles are 8 bytes, anchors carry their window's words.
SHINGLE_BLOCK, ANCHOR_BLOCK = 1_000_000, 100_000
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same words before A-Z are lower-cased.
WORD_ANY_CASE = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: What tells the rows of documents apart.
KEY = ["doc_id", "text_hash"]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null gives none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingle(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(k)])


def windows(benchmark: DataFrame) -> DataFrame:
    """Each item's windows: item_id, window (words joined by a space), words, len."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("item")).where(F.size("item") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("item") - WINDOW, F.lit(0)))).alias("at")
    cut = items.select("item_id", "item", at).select("item_id", F.slice("item", F.col("at") + 1, WINDOW).alias("words"))
    return cut.select("item_id", F.array_join("words", " ").alias("window"), "words", F.size("words").alias("len"))


def spread_words(docs: DataFrame) -> DataFrame:
    """A row for each word of each document, with its position and the document's words."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    return rows.select(*KEY, "words", F.posexplode("words").alias("pos", "word"))


def blocks(table: DataFrame, by: str, rows: int) -> list[DataFrame]:
    """A written table in parts of about `rows` rows, each to be broadcast."""
    n = math.ceil(table.count() / rows)
    return [F.broadcast(table.where(F.pmod(F.xxhash64(by), F.lit(n)) == b) if n > 1 else table) for b in range(n)]


def rarest_anchors(docs: DataFrame, distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Each window's rarest shingle: window, words, len, k, key, offset. Windows with an absent shingle are left out."""
    k = F.least(F.lit(SHINGLE), F.col("len"))
    spots = distinct.select("window", "words", "len", k.alias("k")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))).alias("offset"))
    by_k = F.lit(None).cast("bigint")
    for n in range(1, SHINGLE + 1):
        by_k = F.when(F.col("k") == n, shingle(F.col("words"), F.col("offset"), n)).otherwise(by_k)
    spots = scratch.put(spots.withColumn("key", by_k), "spots")
    keys = scratch.put(spots.select("k", "key").distinct(), "keys")
    counted = None
    for n in (r.k for r in keys.select("k").distinct().collect()):  # SHINGLE values at most
        at = spread_words(docs).select(shingle(F.col("words"), F.col("pos"), n).alias("key"))
        for part in blocks(keys.where(F.col("k") == n).select("key"), "key", SHINGLE_BLOCK):
            found = at.join(part, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")).withColumn("k", F.lit(n))
            counted = found if counted is None else counted.unionByName(found)
    if counted is None:
        return spots.limit(0)
    counted = scratch.put(counted, "counts")
    ranked = attach(spots, counted, ["k", "key"]).groupBy("window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset", "k", "len", "words")).alias("best"))
    return ranked.where("best.n > 0").select("window", "best.*").drop("n")


def occurrences(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Where windows occur (doc_id, text_hash, start, len, window), and whose windows they are (item_id, window)."""
    owned = scratch.put(windows(benchmark), "windows")
    anchors = rarest_anchors(docs, owned.select("window", "words", "len").distinct(), scratch)
    anchors = scratch.put(anchors.withColumnRenamed("words", "wanted"), "anchors")
    found = None
    for n in (r.k for r in anchors.select("k").distinct().collect()):
        spread = spread_words(docs).withColumn("key", shingle(F.col("words"), F.col("pos"), n))
        for part in blocks(anchors.where(F.col("k") == n).drop("k"), "window", ANCHOR_BLOCK):
            start = F.col("pos") - F.col("offset")
            fits = (start >= 0) & (start + F.col("len") <= F.size("words"))
            same = F.slice("words", F.when(fits, start).otherwise(0) + 1, F.col("len")) == F.col("wanted")
            hits = spread.join(part, "key").where(fits & same).select(*KEY, start.alias("start"), "len", "window")
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lit(0).alias("start"),
                            F.lit(0).alias("len"), F.lit("").alias("window")).limit(0)
    return scratch.put(found.distinct(), "occurrences"), owned.select("item_id", "window").distinct()


def hits_by_document(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_hit, n_items and items_sha256 of the documents in which a window occurs."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    found, owned = occurrences(docs, benchmark, scratch)
    ordered = Window.partitionBy(*KEY).orderBy("start", "len")
    end = F.col("start") + F.col("len")
    seen = F.coalesce(F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = found.select(*KEY, "start", "len").distinct().select(
        *KEY, F.greatest(F.lit(0), end - F.greatest(F.col("start"), seen)).alias("new"))
    hit = covered.groupBy(*KEY).agg(F.sum("new").cast("long").alias("n_hit"))
    named = attach(found.select(*KEY, "window").distinct(), owned.where("item_id IS NOT NULL"), ["window"], "inner")
    items = named.select(*KEY, F.col("item_id").cast("string").alias("item")).distinct().groupBy(*KEY).agg(
        F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    same = [hit[c].eqNullSafe(items[c]) for c in KEY]
    return scratch.put(hit.join(items, same, "left").select(*[hit[c] for c in KEY], "n_hit", "n_items", "items_sha256"), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Reads doc_id and text of docs, item_id and text of benchmark; any of them may be null. Null and empty texts have
    no words. Items without words match nothing; items without an id mark words but are not counted or named.
    Repeated rows each get their row; rows that share an id but not a text are told apart by the text.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    return attach(rows, hits_by_document(docs, benchmark), KEY).select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no window occurs, in the columns of docs, other columns and their values untouched."""
    hits = hits_by_document(docs, benchmark).select(*KEY)
    rows = held(docs, doc_id=F.col("doc_id"), text_hash=F.xxhash64("text"))
    return attach(rows, hits, KEY, "left_anti").select("__row.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


OP1_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
bi AS (SELECT item_id, words, least(10, len(words)) AS n, unnest(range(0, greatest(len(words) - 9, 1))) AS i
       FROM b WHERE len(words) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(words[i + 1:i + n], ' ') AS win FROM bi),
sizes AS (SELECT DISTINCT n FROM w),
di AS (SELECT doc_id, words, n, unnest(range(0, greatest(len(words) - n + 1, 0))) AS i FROM d, sizes),
dw AS (SELECT doc_id, n, i, array_to_string(words[i + 1:i + n], ' ') AS win FROM di),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, w.item_id FROM dw JOIN w ON dw.win = w.win AND dw.n = w.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
