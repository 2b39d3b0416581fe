"""Quality classifier: logistic regression over hashed word n-grams, trained by follow the regularised leader.

A text's tokens are its runs of letters and digits and its runs of other characters. Features are the hashed tokens
and pairs of neighbours, and one for a token that repeats the one before; a feature's value is its share of the
text's features. A score is the sparse dot product of shares and weights, so length does not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compassframe.llm.common import Scratch, documents, remainder

BITS = 18
#: Labelled rows to learn from at most: those first in the order of a hash of their ids.
TRAIN_ROWS = 6_000
#: Examples to learn from in all; small samples are gone through several times.
UPDATES, MAX_EPOCHS = 18_000, 40
ALPHA, BETA, L1, L2 = 1.5, 1.0, 1e-5, 1e-4
#: Makes shares of a text large enough for few updates to move the score.
SCALE = 16.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
PAIR, REPEAT = np.uint32(2654435761), np.uint32(7)


def features(text: str | None) -> np.ndarray:
    """The hashed features of a whole text, with repeats; none for a text that is null or blank."""
    tokens = TOKEN.findall(text.encode("utf-8", "surrogatepass")) if text else []
    h = np.fromiter(map(crc32, tokens), dtype=np.uint32, count=len(tokens))
    a, b = h[:-1], h[1:]
    pairs = np.where(a == b, REPEAT, (a * PAIR) ^ (b >> np.uint32(3)))
    return np.concatenate([h, pairs]) & np.uint32((1 << BITS) - 1)


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0))))


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and how often each occurs."""
    i, c = np.unique(x, return_counts=True)
    return i.astype(np.uint32), c.astype(np.uint32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and intercept by FTRL-proximal, one example (features, counts, label) at a time; without rows all is zero."""
    size = 1 << BITS
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(min(MAX_EPOCHS, -(-UPDATES // max(1, len(rows))))):
        for i, c, y in rows:
            i, v = np.append(i, np.uint32(size)), np.append(SCALE * c / max(1, int(c.sum())), 1.0)
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (sigmoid(float(wi @ v)) - y) * v
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i] += g - step * wi
            n[i] += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return (SCALE * w[:size]).astype(np.float32), float(w[size])


def training_sample(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features, counts and labels of at most `limit` labelled rows outside the held-out fold."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = usable.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).orderBy(
        F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `limit` rows at most

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [b"".join(a.tobytes() for a in counted(features(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "x"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, x binary"
    rows = found.mapInArrow(hashed, schema).distinct().collect()  # repeated rows teach once
    rows.sort(key=lambda r: (crc32(str(r.doc_id).encode()), r.doc_id, r.quality, bytes(r.x)))
    return [(x[: len(x) // 2], x[len(x) // 2 :], r.quality) for r in rows for x in [np.frombuffer(r.x, dtype=np.uint32)]]


def scorer(spark: SparkSession, model: tuple[np.ndarray, float]):
    """A column function: text to the probability that its quality label is 1."""
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS weights

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weights, intercept = shared.value
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            x = features(text)
            dot = float(weights[x].sum(dtype=np.float64)) / len(x) if len(x) else 0.0
            out[k] = sigmoid(dot + intercept)
        return pd.Series(out)

    return score


def fit(docs: DataFrame, labels: DataFrame):
    return scorer(docs.sparkSession, train(training_sample(docs, labels)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs; reads doc_id and text.

    Null, empty and blank texts have no features: their score is the intercept's. Labels other than 0 and 1, or
    without an id, are not learnt from; without any labels every score is 0.5. Repeated rows score alike.
    """
    score = fit(docs, labels)
    return docs.select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose predicted quality is 1, in the columns of docs."""
    score = fit(docs, labels)
    return docs.where(score("text") >= THRESHOLD)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
