"""Age-based retention and deletion; every function returns what stays, or counts of what goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cutoff(now: Column, days: int) -> Column:
    if days < 1:
        raise ValueError("retention days must be positive")
    return now - F.make_interval(days=F.lit(days))


def _recent_ids(feedback: DataFrame, limit: Column) -> DataFrame:
    return feedback.where(F.col("recorded_at") >= limit).select("recommendation_id").distinct()


def purge(receipts: DataFrame, feedback: DataFrame, benchmarks: DataFrame, promotions: DataFrame,
          limit: Column) -> dict[str, DataFrame]:
    """What each table keeps. A receipt stays if it is recent or has recent feedback."""
    recent = receipts.where(F.col("created_at") >= limit)
    old = receipts.where(F.col("created_at") < limit)
    return {
        "receipts": recent.unionByName(old.join(_recent_ids(feedback, limit), "recommendation_id", "left_semi")),
        "feedback": feedback.where(F.col("recorded_at") >= limit),
        "benchmarks": benchmarks.where(F.col("created_at") >= limit),
        "promotions": promotions.where(F.col("created_at") >= limit),
    }


def purge_counts(receipts: DataFrame, feedback: DataFrame, benchmarks: DataFrame, promotions: DataFrame,
                 limit: Column) -> DataFrame:
    """(table, deleted) for the same rule."""
    gone = {
        "feedback": feedback.where(F.col("recorded_at") < limit),
        "receipts": receipts.where(F.col("created_at") < limit).join(
            _recent_ids(feedback, limit), "recommendation_id", "left_anti"
        ),
        "benchmarks": benchmarks.where(F.col("created_at") < limit),
        "promotions": promotions.where(F.col("created_at") < limit),
    }
    counts = [df.agg(F.count("*").alias("deleted")).select(F.lit(t).alias("table"), "deleted") for t, df in gone.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def delete_feedback(feedback: DataFrame, doomed: DataFrame) -> DataFrame:
    """Feedback without the given feedback_ids."""
    return feedback.join(doomed.select("feedback_id").distinct(), "feedback_id", "left_anti")


def with_feedback_received(receipts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Receipts with the derived flag; the flag is never stored."""
    have = feedback.select("recommendation_id").distinct().withColumn("_have", F.lit(True))
    return receipts.join(have, "recommendation_id", "left").withColumn(
        "feedback_received", F.coalesce("_have", F.lit(False))
    ).drop("_have")


def reset_feedback(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The empty table, and the number of rows removed."""
    return feedback.limit(0), feedback.agg(F.count("*").alias("deleted"))
