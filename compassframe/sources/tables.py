"""Fact tables of recommendations and feedback: append-only, typed, and free of prompt text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECEIPTS = (
    "recommendation_id string, created_at timestamp, catalog_version string, objective string, privacy string, "
    "task_family string, difficulty string, assessor struct<mode: string, status: string, invoked: boolean>, "
    "selected_configuration_ids array<string>, feedback_profile_id string, advisor_version string"
)
FEEDBACK = (
    "feedback_id string, recommendation_id string, recorded_at timestamp, payload struct<"
    "used_recommendation: boolean, used_configuration_id: string, outcome: string, quality_rating: int, "
    "observed_cost_usd: double, observed_latency_ms: int, preferred_over_configuration_id: string>"
)
PROMOTIONS = (
    "promotion_id string, created_at timestamp, feedback_profile_id string, policy_version string, "
    "policy_digest string, decision string, metrics struct<event_count: bigint, training_count: bigint, "
    "holdout_count: bigint, baseline_brier: double, candidate_brier: double, bias_guard_passed: boolean, "
    "slice_metrics: map<string, struct<count: bigint, baseline_brier: double, candidate_brier: double>>>"
)
BENCHMARKS = "run_id string, created_at timestamp, status string, metrics map<string, double>"
SCHEMAS = {"receipts": RECEIPTS, "feedback": FEEDBACK, "promotions": PROMOTIONS, "benchmarks": BENCHMARKS}
ADVISOR_VERSION = "compassframe-1"
FORBIDDEN = {"prompt", "original_prompt", "text", "messages", "content"}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the table's columns and types; columns that could hold a prompt are refused."""
    fields = _schema(df.sparkSession, table)
    leaking = FORBIDDEN & {f.name for f in fields}
    if leaking:
        raise ValueError(f"{table} must not carry {sorted(leaking)}")
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def _schema(spark: SparkSession, table: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMAS[table])


def append(df: DataFrame, path: str, table: str) -> None:
    """Adds rows, partitioned by day so that retention and lookups read few files."""
    at = "recorded_at" if table == "feedback" else "created_at"
    conform(df, table).withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def append_batch(df: DataFrame, path: str, table: str, batch_id: int) -> None:
    """Adds the rows of a micro-batch, for ``foreachBatch``: a batch that is replayed replaces what it wrote before.

    A batch owns the folder of its id, so a retried job adds no row and removes none of another batch. A table is filled
    either by this or by ``append``.
    """
    at = "recorded_at" if table == "feedback" else "created_at"
    rows = conform(df, table).withColumn("day", F.to_date(at))
    rows.write.mode("overwrite").partitionBy("day").parquet(f"{path.rstrip('/')}/batch={int(batch_id)}")


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row for each key, its newest; ties in time go to the row whose JSON is largest. Rows without a key stay out.

    Tasks keep one row a key before anything is shuffled, so a key with many states is not one task's work.
    """
    state = F.struct(*[rows[f"`{c}`"] for c in rows.columns])
    newest = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by(state, F.struct(F.col(at), F.to_json(state))).alias("_state"))
    return newest.select("_state.*")


def compact(spark: SparkSession, path: str, target: str, table: str, key: str) -> DataFrame:
    """Writes the latest state of every key of a table to a new folder, one batch of few files, and returns it.

    The table itself is left as it is: readers move to the new folder once it is complete.
    """
    at = "recorded_at" if table == "feedback" else "created_at"
    state = latest(read(spark, path, table), key, at).withColumn("day", F.to_date(at))
    folder = f"{target.rstrip('/')}/batch=-1"
    state.repartitionByRange("day", key).write.mode("errorifexists").partitionBy("day").parquet(folder)
    return read(spark, target, table)


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of a table; columns added after a file was written read as NULL."""
    return conform(spark.read.schema(f"{SCHEMAS[table]}, day date").parquet(path), table)


def receipts_from(recommended: DataFrame, created_at: str, catalog_version: str) -> DataFrame:
    """Receipts of shortlists: what was chosen and why, never the prompt.

    ``assessor`` (mode, status, invoked) is kept if the rows have it; without an assessor it says so.
    """
    off = F.struct(F.lit("off").alias("mode"), F.lit("disabled").alias("status"), F.lit(False).alias("invoked"))
    assessor = F.coalesce(F.col("assessor"), off) if "assessor" in recommended.columns else off
    rows = recommended.where(F.col("status") == "matched").select(
        F.col("request_id").alias("recommendation_id"), F.col(created_at).alias("created_at"),
        F.lit(catalog_version).alias("catalog_version"), "objective", "privacy", "task_family", "difficulty",
        assessor.alias("assessor"),
        F.transform("shortlist", lambda s: s.configuration_id).alias("selected_configuration_ids"),
        (F.col("feedback_profile_id") if "feedback_profile_id" in recommended.columns else F.lit(None)).alias("feedback_profile_id"),
        F.lit(ADVISOR_VERSION).alias("advisor_version"),
    )
    return conform(rows, "receipts")


def canary_rows(df: DataFrame, canary: str) -> DataFrame:
    """Rows in which a planted text shows up in any column; empty for a prompt-free table."""
    return df.where(F.contains(F.to_json(F.struct(*df.columns)), F.lit(canary)))
