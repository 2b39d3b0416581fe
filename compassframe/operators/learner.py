"""A linear learner over hashed one- and two-token features, fitted by rounds of sparse AdaGrad.

Each round is one job over the written examples: a task adds up its examples' gradient by bucket, the sums of a bucket
meet by shuffle, and at most BUCKETS + 1 of them come to the driver, whatever the number of examples. The weights, as
many, are what travels back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compassframe.functions.text import canonical, hash60, word_tokens

BUCKETS = 4096
ROUNDS, RATE, L2, EPS = 12, 0.5, 1e-4, 1e-6
LOSSES = ("logistic", "squared")


def hashed_features(text: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of a text's tokens and pairs of neighbouring tokens, with repeats; empty for NULL or no tokens."""
    return token_features(tokens_of(text), buckets)


def tokens_of(text: Column) -> Column:
    return F.coalesce(word_tokens(canonical(text)), F.array().cast("array<string>"))


def token_features(tokens: Column, buckets: int = BUCKETS) -> Column:
    """The same of tokens, which are used five times: best a settled column, or a text is normalised as often."""
    later = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    first = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    ones = F.transform(tokens, lambda t: hash60(F.concat(F.lit("1|"), t)) % buckets)
    twos = F.zip_with(first, later, lambda a, b: hash60(F.concat(F.lit("2|"), a, F.lit(" "), b)) % buckets)
    return F.concat(ones, twos)


@dataclass(frozen=True)
class Model:
    """Weights by bucket, the intercept last; what they were fitted with."""

    weights: np.ndarray
    loss: str

    def probability(self, dots: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-dots)) if self.loss == "logistic" else np.clip(dots, 0.0, 1.0)


def _sparse(column: pa.ListArray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, bucket and value of a batch: counts over their root of squares, and 1 for the intercept."""
    lengths = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(column)), lengths)
    keys, counts = np.unique(row * buckets + column.flatten().to_numpy(), return_counts=True)
    row, bucket = keys // buckets, keys % buckets
    norm = np.sqrt(np.bincount(row, weights=counts.astype(float) ** 2, minlength=len(column)))
    n = np.arange(len(column))
    return np.r_[row, n], np.r_[bucket, np.full(len(n), buckets)], np.r_[counts / norm[row], np.ones(len(n))]


def _gradient(examples: DataFrame, model: Model, shares: dict[int, float], buckets: int) -> np.ndarray:
    """The summed gradient of all examples at the model's weights."""
    shared = examples.sparkSession.sparkContext.broadcast(model)  # BUCKETS + 1 numbers

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(buckets + 1), np.zeros(buckets + 1, dtype=bool)
        now = shared.value
        for batch in batches:
            row, bucket, x = _sparse(batch.column("features"), buckets)
            y = batch.column("label").to_numpy().astype(float)
            dots = np.bincount(row, weights=x * now.weights[bucket], minlength=len(y))
            off = now.probability(dots) - y if now.loss == "logistic" else dots - y
            off *= np.where(y == 1, shares[1], shares[0])
            total += np.bincount(bucket, weights=x * off[row], minlength=buckets + 1)
            seen[bucket] = True
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "g"])

    parts = examples.select("features", "label").mapInArrow(add, "bucket bigint, g double")
    out = np.zeros(buckets + 1)
    for r in parts.groupBy("bucket").agg(F.sum("g").alias("g")).collect():  # BUCKETS + 1 rows at most
        out[r.bucket] = r.g
    return out


def fit(examples: DataFrame, loss: str = "logistic", rounds: int = ROUNDS, rate: float = RATE, l2: float = L2,
        buckets: int = BUCKETS) -> Model:
    """Fits examples (features, label 0 or 1), a written table: every round reads it.

    Both classes weigh alike, however rare one is. Rows without a label are not learnt from; with no examples, or of one
    class only, the weights stay zero.
    """
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    usable = examples.where(F.col("label").isin(0, 1) & F.col("features").isNotNull()).select("features", F.col("label").cast("int").alias("label"))
    n = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    model = Model(np.zeros(buckets + 1), loss)
    if len(n) < 2:
        return model
    shares = {y: 0.5 / n[y] for y in (0, 1)}
    squares = np.zeros(buckets + 1)
    for _ in range(rounds):
        g = _gradient(usable, model, shares, buckets)
        g[:-1] += l2 * model.weights[:-1]
        squares += g * g
        model = Model(model.weights - rate * g / (np.sqrt(squares) + EPS), loss)
    return model


def predict(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep and probability for rows with features (NULL counts as none)."""
    buckets = len(model.weights) - 1
    shared = rows.sparkSession.sparkContext.broadcast(model)
    fields = rows.select(*keep).schema.add("probability", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket, x = _sparse(batch.column("_features"), buckets)
            p = shared.value.probability(np.bincount(row, weights=x * shared.value.weights[bucket], minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p)], [*keep, "probability"])

    whole = F.coalesce("features", F.array().cast("array<bigint>")).alias("_features")
    return rows.select(*keep, whole).mapInArrow(score, fields)
