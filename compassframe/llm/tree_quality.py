"""Quality rules: boosted regression trees over statistics of a text, scored from flat node arrays.

Statistics of every whole text are computed once, in Arrow batches. The trees are fitted on the statistics of a
bounded sample of labelled rows, by logistic loss over quantile bins, and may be held monotone in chosen statistics:
a split whose sides would go the wrong way is not made, and the sides' subtrees keep to their side of its middle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from compassframe.llm.common import documents, remainder

#: Labelled rows to learn from at most: those first in the order of a hash of their ids.
TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT, RIDGE = 60, 3, 0.2, 32, 2.0, 1.0
THRESHOLD = 0.3
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the trees see, with the direction in which quality may go as they grow (0: either).
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "repeat_share": -1, "dup_line_share": -1,
            "upper_share": -1, "same_as_before": -1, "short_share": 0, "distinct_share": 0, "digit_share": 0}
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(h: np.ndarray) -> int:
    """Words in WINDOW-word windows that are found twice or more."""
    n = len(h) - WINDOW + 1
    if n < 2:
        return 0
    x = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        x = x * _STEP + h[i : i + n]
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    steps = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of a whole text; null counts as empty."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return [0] * len(COUNTS), [0.0] * len(FEATURES)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    size = len(raw)
    chars = len(text) - (size - len(raw.translate(None, _SPACES)))
    symbols = size - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(h)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    upper, digits = (size - len(raw.translate(None, x)) for x in (_UPPER, _DIGITS))
    seen = len(np.unique(h))
    return [n, chars, symbols, dup_lines, repeats], [
        float(np.log1p(n)), chars / n, symbols / chars, repeats / n, dup_lines / len(lines), upper / chars,
        float((h[1:] == h[:-1]).sum()) / n, float((lengths == 1).sum()) / n, seen / n, digits / chars]


class Trees(NamedTuple):
    """All trees in one set of arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1.0 / (1.0 + np.exp(-np.clip(self.base + self.value[at].sum(axis=1), -35, 35)))


def fit_trees(x: np.ndarray, y: np.ndarray, directions: list[int]) -> Trees:
    """Boosted trees for labels 0 and 1; without rows of both labels, the constant of their share."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    nodes: list[list[float]] = []
    roots: list[int] = []
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])] if len(y) else []
    binned = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]
    score = np.full(len(y), base)

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        value = lambda a, b: min(high, max(low, a / (b + RIDGE)))
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0, 0.0, 0.0)
        if depth:
            for f, bins in enumerate(binned):
                k = len(edges[f]) + 1
                cg = np.cumsum(np.bincount(bins[rows], g[rows], k))[:-1]
                ch = np.cumsum(np.bincount(bins[rows], h[rows], k))[:-1]
                for at in np.flatnonzero((ch >= LEAST_WEIGHT) & (hs - ch >= LEAST_WEIGHT)):
                    a, b = value(cg[at], ch[at]), value(gs - cg[at], hs - ch[at])
                    if directions[f] * (b - a) < 0:
                        continue
                    gain = cg[at] ** 2 / (ch[at] + RIDGE) + (gs - cg[at]) ** 2 / (hs - ch[at] + RIDGE) - gs**2 / (hs + RIDGE)
                    if gain > best[0]:
                        best = (gain, f, at, a, b)
        _, f, at, a, b = best
        if f < 0:
            v = RATE * value(gs, hs)
            score[rows] += v
            return leaf(v)
        me, mid = leaf(0.0), (a + b) / 2
        go_left = binned[f][rows] <= at
        bounds = {0: ((low, high), (low, high)), -1: ((mid, high), (low, mid)), 1: ((low, mid), (mid, high))}[directions[f]]
        left = grow(rows[go_left], g, h, depth - 1, *bounds[0])
        right = grow(rows[~go_left], g, h, depth - 1, *bounds[1])
        nodes[me] = [f, edges[f][at], left, right, 0.0]
        return me

    if 0 < y.sum() < len(y):
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            roots.append(grow(np.arange(len(y)), y - p, p * (1 - p), DEPTH, -np.inf, np.inf))
    if not roots:
        roots.append(leaf(0.0))
    a = np.array(nodes, dtype=np.float64)
    return Trees(np.array(roots), a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], base)


def with_statistics(rows: DataFrame, trees: Trees | None = None) -> DataFrame:
    """Replaces the text of rows by COUNTS, the features as an array and, given trees, their score."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    shared = rows.sparkSession.sparkContext.broadcast(trees)  # TREES * 2 ** DEPTH nodes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column("text").to_pylist()]
            counts = np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(COUNTS))
            x = np.array([f for _, f in found], dtype=np.float64).reshape(-1, len(FEATURES))
            arrays = [batch.column(f.name) for f in others] + [pa.array(counts[:, i]) for i in range(len(COUNTS))]
            arrays.append(pa.array(list(x), pa.list_(pa.float64())))
            arrays.append(pa.array(shared.value.score(x)) if shared.value else pa.nulls(len(x), pa.float64()))
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in others] + [*COUNTS, "features", "score"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [f"{c} bigint" for c in COUNTS]
    return rows.mapInArrow(count, ", ".join([*schema, "features array<double>", "score double"]))


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Trees:
    """Trees for labels.quality, from at most `limit` labelled rows outside the held-out fold."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = usable.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).orderBy(
        F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `limit` rows at most
    rows = with_statistics(found).select("doc_id", "quality", "features").toPandas()
    rows = rows.assign(key=rows["features"].map(tuple)).sort_values(["doc_id", "quality", "key"])
    x = np.array(rows["features"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_trees(x, rows["quality"].to_numpy(dtype=np.float64), list(FEATURES.values()))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, COUNTS, base_failed, kept, score.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept: not that, and a score of
    THRESHOLD or more. Reads doc_id and text; null, empty and blank texts have no words and fail. Labels other than
    0 and 1 or without an id are not learnt from; without both labels the score is their constant share (none: 0.5).
    """
    rows = with_statistics(docs.select("doc_id", "text"), fit(docs, labels)).drop("features")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select("doc_id", *COUNTS, failed.alias("base_failed"),
                       (~failed & (F.col("score") >= THRESHOLD)).alias("kept"), "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
