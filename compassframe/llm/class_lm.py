"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

Every word that occurs twice or more in the training texts is clustered, in two steps:

1. The core, words of at least CORE_SHARE of all tokens (20,000 at most, at any size of corpus): each moves, in parallel
   rounds, to the class that most raises the likelihood of the class bigrams.
2. All other words, however many: their neighbours' classes are counted and shuffled by word, and each word joins the
   class with the highest first-order gain of the same likelihood, a product of its context counts and a matrix.

Words that occur once, and words never met beside a core word or an end, have a class by their form (letters, digits,
symbols, length, last letters), as have words never seen; the end of a text has a class of its own. The number of
classes grows with the types, 2 * types ** 0.3, up to MOST_CLASSES, which bounds the matrices.

A text's probability is the product, over its tokens and its end, of the smoothed transition from the class before and
the word's share in its class; each class of forms keeps one place for words never seen, so the probabilities of all
words after any word add up to one. Transitions are counted over all training texts with the final classes.

Words of at least LOOKUP_SHARE of all tokens (a million at most) are looked up in a broadcast table; counts and classes
of all others are joined, token by token, and no such word is frequent enough to be a hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compassframe.llm.common import Scratch, documents, lowered_words, remainder

FOLDS, HELD_OUT = 7, 2
#: Shares of all training tokens from which a word is in the core (so at most 20,000), or looked up in a broadcast.
CORE_SHARE, LOOKUP_SHARE = 5e-5, 1e-6
#: Occurrences from which a word is clustered, whatever the size of the corpus.
LEAST = 2
MOST_CLASSES, ROUNDS, SMOOTHING = 512, 8, 20.0
SUFFIXES, FLUSH, SLICE = 16, 400_000, 2_000
PUNCTUATION = b".,;:!?"
#: Stands for the end of a text among its words; no word holds white space.
END = b" "
_LETTERS = bytes(x for x in range(256) if x >= 0x80 or chr(x).isalpha())
FORMS = 3 * 2 * 3 * SUFFIXES


def form(word: bytes) -> int:
    """The class of a word by its form alone, below FORMS."""
    core = word.rstrip(PUNCTUATION)
    rest = core.translate(None, _LETTERS)
    kind = 0 if not rest else 1 if rest.isdigit() else 2
    band = (len(core) > 5) + (len(core) > 10)
    return ((kind * 2 + (len(core) < len(word))) * 3 + band) * SUFFIXES + crc32(core[-3:]) % SUFFIXES


def number_of_classes(types: int) -> int:
    return int(min(MOST_CLASSES, max(1, 2 * types ** 0.3)))


def chunks(batches: Iterator[pa.RecordBatch], texts: int = 1000) -> Iterator[list[bytes]]:
    """The words of some texts in a row, with END before, between and after them."""
    for batch in batches:
        column = batch.column("text")
        for start in range(0, batch.num_rows, texts):
            flat = [END]
            for text in column.slice(start, texts).to_pylist():
                flat += lowered_words(text)
                flat.append(END)
            yield flat


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes, each once, and their counts added up."""
    code, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """word (bytes), n over all texts; tasks add up before anything moves."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in chain(batches, [None]):
            for text in batch.column("text").to_pylist() if batch is not None else []:
                found.update(lowered_words(text))
                if len(found) > FLUSH:
                    yield out(found)
                    found.clear()
        yield out(found)

    def out(found: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def count_pairs(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """a, b, n: how often id b follows a. END is in ids; words that are not share the id after the last."""
    shared, size = docs.sparkSession.sparkContext.broadcast(ids), len(ids) + 1

    def out(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array((code // size).astype(np.int32)), pa.array((code % size).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, other = shared.value.get, size - 1
        parts, held = [], 0
        for flat in chunks(batches):
            x = np.fromiter((get(w, other) for w in flat), np.int64, len(flat))
            parts.append(np.unique(x[:-1] * size + x[1:], return_counts=True))
            held += len(parts[-1][0])
            if held > 8 * FLUSH:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > 4 * FLUSH:
                    yield out(*parts.pop())
                    held = 0
        if parts:
            yield out(*merged(parts))

    pairs = docs.select("text").mapInArrow(count, "a int, b int, n bigint")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def contexts(pairs: DataFrame) -> DataFrame:
    """A row for each token id w: its neighbours before and after with counts. Lists hold each id once at most."""
    sides = pairs.select(F.col("b").alias("w"), F.lit(0).alias("side"), F.col("a").alias("v"), "n").union(
        pairs.select(F.col("a").alias("w"), F.lit(1).alias("side"), F.col("b").alias("v"), "n"))
    one = sides.groupBy("w", "side").agg(F.collect_list(F.struct("v", "n")).alias("x"))
    pick = lambda side, what: F.max(F.when(F.col("side") == side, F.col(f"x.{what}"))).alias(f"{what}{side}")
    return one.groupBy("w").agg(pick(0, "v"), pick(0, "n"), pick(1, "v"), pick(1, "n"))


def _context_columns(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    columns = [batch.column(c) for c in ("v0", "n0", "v1", "n1")]
    for k, w in enumerate(batch.column("w").to_pylist()):
        yield w, [np.array(c[k].as_py() or [], dtype=np.int64) for c in columns]


def class_matrix(rows: DataFrame, class_of: np.ndarray, n_classes: int) -> np.ndarray:
    """How often each class follows each; every task sends its sums once."""
    shared = rows.sparkSession.sparkContext.broadcast(class_of)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((n_classes, n_classes))
        for batch in batches:
            for w, (_, _, v1, n1) in _context_columns(batch):
                m[shared.value[w]] += np.bincount(shared.value[v1], n1, n_classes)
        a, b = np.nonzero(m)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(m[a, b].astype(np.int64))], ["a", "b", "n"])

    m = np.zeros((n_classes, n_classes), dtype=np.int64)
    sums = rows.mapInArrow(add, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    for a, b, n in sums.collect():  # classes squared at most
        m[a, b] = n
    return m


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(m: np.ndarray, left: np.ndarray, right: np.ndarray, own: float, now: int, n_free: int) -> int:
    """Takes a word's pairs out of m and finds the class in which they make the bigrams likeliest; m is changed.

    left[c] and right[c] count the classes before and after the word, own its pairs with itself (in neither).
    """
    m[:, now] -= left
    m[now] -= right
    m[now, now] -= own
    rows, columns = m.sum(axis=1) + left, m.sum(axis=0) + right  # these pairs are there wherever the word goes
    free = np.arange(n_free)
    lefts, rights = np.flatnonzero(left), np.flatnonzero(right)
    gain = (xlogx(m[lefts][:, free] + left[lefts, None]) - xlogx(m[lefts][:, free])).sum(axis=0)
    gain += (xlogx(m[free][:, rights] + right[rights]) - xlogx(m[free][:, rights])).sum(axis=1)
    at = m[free, free]  # the diagonal takes both: mend what was counted apart
    gain += xlogx(at + left[free] + right[free] + own) - xlogx(at + left[free]) - xlogx(at + right[free]) + xlogx(at)
    gain -= xlogx(rows[free] + right.sum() + own) - xlogx(rows[free])
    gain -= xlogx(columns[free] + left.sum() + own) - xlogx(columns[free])
    best = int(np.argmax(gain))
    best = best if gain[best] > gain[now] + 1e-9 else now
    m[:, best] += left
    m[best] += right
    m[best, best] += own
    return best


def exchange(rows: DataFrame, class_of: np.ndarray, m: np.ndarray, n_words: int, n_free: int, turn: int) -> dict[int, int]:
    """New classes for half of the core; a task sees its own moves, others' only in the next round."""
    shared = rows.sparkSession.sparkContext.broadcast((class_of, m))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = shared.value[0].copy(), shared.value[1].astype(np.float64)
        for batch in batches:
            moved = []
            for w, (v0, n0, v1, n1) in _context_columns(batch):
                if w >= n_words or (w * 2654435761 >> 7) % 2 != turn % 2:
                    continue
                own = float(n1[v1 == w].sum())
                left = np.bincount(classes[v0[v0 != w]], n0[v0 != w], len(seen))
                right = np.bincount(classes[v1[v1 != w]], n1[v1 != w], len(seen))
                new = best_class(seen, left, right, own, int(classes[w]), n_free)
                if new != classes[w]:
                    classes[w] = new
                    moved.append((w, new))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in moved], pa.int32()), pa.array([c for _, c in moved], pa.int32())], ["w", "c"])

    return dict(rows.where(F.col("w") < n_words).mapInArrow(move, "w int, c int").collect())


def count_contexts(docs: DataFrame, core: dict[bytes, int], k: int) -> DataFrame:
    """word, codes, ns: which classes stand before (c) and after (k + 1 + c) words outside the core, and how often.

    core maps words and END to classes up to k. A task sends a word once, or once each time its memory is full.
    """
    shared, width = docs.sparkSession.sparkContext.broadcast(core), 2 * (k + 1)

    def out(ids: dict[bytes, int], parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        code, n = merged(parts)
        found, starts = np.unique(code // width, return_index=True)
        offsets = pa.array(np.append(starts, len(code)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(ids), pa.binary()).take(pa.array(found)),
             pa.ListArray.from_arrays(offsets, pa.array(code % width, pa.int32())),
             pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()))], ["word", "codes", "ns"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        ids: dict[bytes, int] = {}
        parts, held = [], 0
        for flat in chunks(batches):
            classes = np.fromiter((get(w, -1) for w in flat), np.int64, len(flat))
            at = np.flatnonzero(classes < 0)
            own = np.fromiter((ids.setdefault(flat[i], len(ids)) for i in at.tolist()), np.int64, len(at)) * width
            before, after = classes[at - 1], classes[at + 1]
            code = np.concatenate([(own + before)[before >= 0], (own + k + 1 + after)[after >= 0]])
            parts.append(np.unique(code, return_counts=True))
            held += len(parts[-1][0])
            if held > 4 * FLUSH:
                parts = [merged(parts)]
                held = len(parts[0][0])
            if len(ids) > FLUSH or held > 3 * FLUSH:
                yield out(ids, parts)
                ids, parts, held = {}, [], 0
        if held:
            yield out(ids, parts)

    return docs.select("text").mapInArrow(count, "word binary, codes array<int>, ns array<bigint>")


def context_gains(m: np.ndarray) -> np.ndarray:
    """What one neighbour adds to the likelihood if its word is in a class: rows are codes of contexts, columns classes.

    m counts transitions of the core's classes and the end, the last. The gain of moving x counts into a cell of n is
    x * (log n + 1) to first order, less the same for the sums of its row and column; cells are smoothed.
    """
    k = len(m) - 1
    share = lambda n: (n + 1) / (n + 1).sum()
    before = (m + SMOOTHING * share(m.sum(axis=1))[:, None]) / (m.sum(axis=0) + SMOOTHING)
    after = (m.T + SMOOTHING * share(m.sum(axis=0))[:, None]) / (m.sum(axis=1) + SMOOTHING)
    return np.log(np.vstack([before, after])[:, :k])


def assign(contexts: DataFrame, gains: np.ndarray) -> DataFrame:
    """word, c: the class of the largest gain, ties to the lower. Words stream through sorted partitions.

    Only one word's sums cross from one slice of rows to the next, so memory does not depend on how many rows it has.
    """
    shared, width = contexts.sparkSession.sparkContext.broadcast(gains), len(gains)

    def out(words: list[bytes], sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array(np.argmax(sums @ shared.value, axis=1), pa.int32())], ["word", "c"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_word, open_sums = None, np.zeros(width)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                coded = batch.column("word").dictionary_encode()
                words = coded.dictionary.to_pylist()
                codes, ns = batch.column("codes"), batch.column("ns")
                lengths = np.diff(codes.offsets.to_numpy())
                own = np.repeat(coded.indices.to_numpy(), lengths).astype(np.int64)
                at = own * width + codes.flatten().to_numpy()
                sums = np.bincount(at, ns.flatten().to_numpy(), len(words) * width).reshape(len(words), width)
                if words[0] == open_word:
                    sums[0] += open_sums
                elif open_word is not None:
                    yield out([open_word], open_sums[None])
                open_word, open_sums = words[-1], sums[-1].copy()
                if len(words) > 1:
                    yield out(words[:-1], sums[:-1])
        if open_word is not None:
            yield out([open_word], open_sums[None])

    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "word binary, c int")


class Learnt(NamedTuple):
    """k classes of words, one of the end (k), then those of forms. words: word, n, c of all training words."""

    words: DataFrame
    k: int
    mass: np.ndarray  # of each class: what a word's count (clustered) or count + 1 (by form) is divided by
    n_train: int
    n_types: int
    n_texts: int

    @property
    def size(self) -> int:
        return self.k + 1 + FORMS


def learn(docs: DataFrame, scratch: Scratch) -> Learnt:
    """Counts and classes of the words of all texts of docs."""
    counts = scratch.put(count_words(docs), "counts")
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts = docs.count()
    total, types = total + texts, types + (texts > 0)
    often = counts.where(F.col("n") >= max(float(LEAST), CORE_SHARE * total)).collect()
    core = [w for _, w in sorted((-n, bytes(w)) for w, n in often)]
    n_core, k = len(core), min(number_of_classes(types), max(1, len(core)))
    ids = {w: i for i, w in enumerate([*core, END])}
    class_of = np.concatenate([np.arange(n_core) % k, [k, k + 1]]).astype(np.int64)
    rows = scratch.put(contexts(scratch.put(count_pairs(docs, ids), "pairs")), "contexts")
    scratch.drop("pairs")
    m = class_matrix(rows, class_of, k + 2)
    for turn in range(ROUNDS if n_core > k else 0):
        moved = exchange(rows, class_of, m, n_core, k, turn)
        class_of[list(moved)] = list(moved.values())
        m = class_matrix(rows, class_of, k + 2)
    scratch.drop("contexts")
    classes = {w: int(class_of[i]) for w, i in ids.items()}
    found = assign(count_contexts(docs, classes, k), context_gains(m[: k + 1, : k + 1].astype(np.float64)))
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes of the core are known, those of rare words are their forms."""
        get = shared.value.get
        for batch in batches:
            given = zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), batch.column("c").to_pylist(), strict=True)
            c = [own if (own := get(w)) is not None else k + 1 + form(w) if n < LEAST or near is None else near for w, n, near in given]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(c, pa.int32())], ["word", "n", "c"])

    words = scratch.put(counts.join(found, "word", "left").mapInArrow(finish, "word binary, n bigint, c int"), "words")
    scratch.drop("counts")
    mass = np.zeros(k + 1 + FORMS)
    mass[k:] = 1.0  # the end, and one place in each form for words never seen
    for c, n, v in words.groupBy("c").agg(F.sum("n"), F.count("*")).collect():  # one row a class
        mass[c] += n if c < k else n + v
    return Learnt(words, k, mass, int(total), int(types), texts)


class Lookup(NamedTuple):
    ids: dict[bytes, int]
    n: np.ndarray
    c: np.ndarray


def encode(docs: DataFrame, learnt: Learnt, scratch: Scratch) -> DataFrame:
    """A row for each of docs: doc_id, held_out, known, plain, weight, seq, known2, plain2, weight2, changes.

    seq has the classes of a text's words; changes (position * 4096 + class) mends those of joined words. plain adds
    log10(n + 1), weight the logarithm of what is divided by the class's mass; those ending in 2 are of joined words.
    """
    limit, k = max(1.0, LOOKUP_SHARE * learnt.n_train), learnt.k
    often = learnt.words.where(F.col("n") >= limit).collect()  # at most 1 / LOOKUP_SHARE words
    shared = docs.sparkSession.sparkContext.broadcast(Lookup(
        {bytes(r.word): i for i, r in enumerate(often)}, np.array([r.n for r in often], dtype=np.float64),
        np.array([r.c for r in often], dtype=np.int32)))
    id_type, end_plain = docs.schema["doc_id"].dataType.simpleString(), float(np.log10(learnt.n_texts + 1))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.ids.get
        plain_of = np.append(np.log10(shared.value.n + 1), 0.0)  # the last is for words that are not looked up
        weight_of = np.append(np.where(shared.value.c < k, np.log10(np.maximum(shared.value.n, 1)), plain_of[:-1]), 0.0)
        class_of = np.append(shared.value.c, 0)
        for batch in batches:
            known, plain, weight, seq, rare, places = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = lowered_words(text)
                ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                classes, at = class_of[ids], np.flatnonzero(ids < 0)
                missed = [words[i] for i in at.tolist()]
                classes[at] = [k + 1 + form(w) for w in missed]
                known.append(len(words) - len(at) + (learnt_texts > 0))
                plain.append(float(plain_of[ids].sum()) + end_plain)
                weight.append(float(weight_of[ids].sum()))
                seq.append(classes)
                rare.append(missed)
                places.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(known, pa.int64()), pa.array(plain, pa.float64()),
                 pa.array(weight, pa.float64()), pa.array(seq, pa.list_(pa.int32())), pa.array(rare, pa.list_(pa.binary())),
                 pa.array(places, pa.list_(pa.int32()))],
                ["doc_id", "held_out", "known", "plain", "weight", "seq", "rare", "at"])

    learnt_texts = learnt.n_texts
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    schema = (f"doc_id {id_type}, held_out boolean, known bigint, plain double, weight double, seq array<int>, "
              "rare array<binary>, at array<int>")
    kept = scratch.put(rows.mapInArrow(local, schema).withColumn("row", F.monotonically_increasing_id()), "encoded")
    missed = kept.select("row", F.explode(F.arrays_zip("at", "rare")).alias("x")).select("row", "x.at", F.col("x.rare").alias("word"))
    rare = learnt.words.where(F.col("n") < limit)
    plain = F.log10(F.col("n") + 1.0)
    mended = missed.join(rare, "word").groupBy("row").agg(
        F.count("*").alias("known2"), F.sum(plain).alias("plain2"),
        F.sum(F.when(F.col("c") < k, F.log10(F.col("n").cast("double"))).otherwise(plain)).alias("weight2"),
        F.collect_list(F.col("at").cast("long") * 4096 + F.col("c")).alias("changes"))
    classes = scratch.put(kept.drop("rare", "at").join(mended, "row", "left").drop("row"), "classes")
    scratch.drop("encoded")
    return classes


def transitions(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens of a batch's texts, of those before them, and where each text starts among them."""
    seq, changes = batch.column("seq"), batch.column("changes")
    offsets = seq.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    values = seq.flatten().to_numpy().astype(np.int64)
    code = changes.flatten().to_numpy()
    of = np.repeat(offsets[:-1], changes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    values[of + code // 4096] = code % 4096
    flat = np.append(np.insert(values, offsets[:-1], end), end)
    return flat[1:], flat[:-1], offsets[:-1] + np.arange(batch.num_rows)


def transition_counts(rows: DataFrame, k: int) -> np.ndarray:
    """How often each class follows each; every task sends its sums once."""
    size = k + 1 + FORMS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                after, before, _ = transitions(batch, k)
                m += np.bincount(before * size + after, minlength=size * size)
        cells = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(m[cells], pa.int64())], ["cell", "n"])

    m = np.zeros(size * size)
    sums = rows.select("seq", "changes").mapInArrow(add, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    for cell, n in sums.collect():  # classes squared at most
        m[cell] = n
    return m.reshape(size, size)


def smoothed(m: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Probabilities of classes after classes; one without words is never reached."""
    any_class = (m.sum(axis=0) + 1.0) * (mass > 0)
    any_class /= any_class.sum()
    return (m + SMOOTHING * any_class) / (m.sum(axis=1, keepdims=True) + SMOOTHING)


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the documents outside the held-out fold, scores all. Reads doc_id and text, whatever other columns there
    are; null and empty texts have the end as their only token; a null id counts as the empty text when folds are dealt.
    Repeated rows are learnt from and scored each time. Texts of any length are taken whole, each in one task. Without
    training documents all probabilities come from the smoothing alone.
    """
    scratch = Scratch(docs.sparkSession, "class-lm")
    learnt = learn(docs.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).select("text"), scratch)
    rows = encode(docs, learnt, scratch)
    k, id_type = learnt.k, docs.schema["doc_id"].dataType.simpleString()
    m = transition_counts(rows.where(~F.col("held_out")), k)
    with np.errstate(divide="ignore"):
        shared = docs.sparkSession.sparkContext.broadcast(
            (np.log10(smoothed(m, learnt.mass)), np.log10(np.maximum(learnt.mass, 1e-300))))
    floor = float(np.log10(learnt.n_train + learnt.n_types + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, mass = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            after, before, starts = transitions(batch, k)
            tokens = np.diff(np.append(starts, len(after)))
            column = lambda name: batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)
            full = np.add.reduceat(transition[before, after] - mass[after], starts) + column("weight") + column("weight2")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(tokens, pa.int64()),
                 pa.array(column("known") + column("known2"), pa.int64()),
                 pa.array(column("plain") + column("plain2") - floor * tokens, pa.float64()), pa.array(full, pa.float64())],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = rows.mapInArrow(
        score, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(learnt.n_train).cast("long").alias("train_tokens"), "base_score",
        "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
