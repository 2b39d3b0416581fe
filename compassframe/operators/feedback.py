"""Learning from outcome feedback: validation, signals, chronological replay and promotion state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compassframe.operators.ordered import lookup_skewed, newest_n
from compassframe.session import written

# Fixed values of the learning rule.
PRIOR_ALPHA, PRIOR_BETA = 8.0, 2.0
PRIOR_STRENGTH = PRIOR_ALPHA + PRIOR_BETA
MAX_ADJUSTMENT = 0.04
ADJUSTMENT_SCALE, FULL_SUPPORT = 0.35, 20
MINIMUM_SUPPORT = 5
MINIMUM_EVENTS = 10
TOLERANCE, IMPROVEMENT = 0.005, 1e-12


def checked_alone(feedback: DataFrame, receipts: DataFrame, enabled: bool = True) -> DataFrame:
    """Adds ``_problem`` (NULL if acceptable on its own) and the receipt's context; also for streams.

    Required fields may not be NULL. The two configuration ids must differ even when both are missing, so
    feedback that names no configuration at all is refused.
    """
    p = lambda f: F.col(f"payload.{f}")
    carried = [c for c in ("feedback_profile_id", "task_family") if c in receipts.columns]
    context = receipts.select("recommendation_id", F.lit(True).alias("_known"), "selected_configuration_ids", *carried)
    selected = F.col("selected_configuration_ids")
    used, other = p("used_configuration_id"), p("preferred_over_configuration_id")
    problem = (
        F.when(F.lit(not enabled), "feedback_disabled")
        .when(F.col("feedback_id").isNull() | F.col("recorded_at").isNull(), "missing_identity")
        .when(p("used_recommendation").isNull(), "missing_used_recommendation")
        .when(p("outcome").isNull(), "missing_outcome")
        .when(p("used_recommendation") & used.isNull(), "used_without_configuration")
        .when(~p("used_recommendation") & used.isNotNull(), "configuration_without_use")
        .when(other.isNotNull() & used.isNull(), "pairwise_without_used")
        .when(other.eqNullSafe(used), "pairwise_same_configuration")
        .when(~p("outcome").isin("worked", "did_not_work", "unknown"), "outcome_value")
        .when(~p("quality_rating").between(1, 5), "quality_rating_range")
        .when((p("observed_cost_usd") < 0) | (p("observed_latency_ms") < 0), "negative_observation")
        .when(F.col("_known").isNull(), "unknown_recommendation")
        .when(used.isNotNull() & ~F.coalesce(F.array_contains(selected, used), F.lit(False)), "used_not_in_shortlist")
        .when(other.isNotNull() & ~F.coalesce(F.array_contains(selected, other), F.lit(False)), "preferred_not_in_shortlist")
    )
    joined = feedback.join(context, "recommendation_id", "left").withColumn("_problem", problem)
    return joined.select(*feedback.columns, *carried, "_problem")


def validate(feedback: DataFrame, receipts: DataFrame, enabled: bool = True) -> DataFrame:
    """Adds ``rejected`` (NULL when accepted) and the receipt's context to every feedback row.

    Of several acceptable rows for one recommendation the earliest stands and the others are duplicates.
    Receipts are unique per recommendation, and so is the row that stands.

    Feedback meets its receipt once, in a shuffled join whose hot keys adaptive execution splits; what
    follows reads the joined table, and whoever uses the result needs no receipts again.
    """
    checked = written(checked_alone(feedback, receipts, enabled), "feedback")
    standing = (
        checked.where(F.col("_problem").isNull())
        .groupBy("recommendation_id")
        .agg(F.min(F.struct("recorded_at", "feedback_id")).alias("_first"))
        .select("recommendation_id", F.col("_first.feedback_id").alias("_standing"))
    )
    return (
        checked.join(standing, "recommendation_id", "left")
        .withColumn(
            "rejected",
            F.coalesce("_problem", F.when(F.col("_standing") != F.col("feedback_id"), "duplicate_feedback")),
        )
        .drop("_problem", "_standing")
    )


def usable_events(accepted: DataFrame) -> DataFrame:
    """Accepted feedback with outcomes that can be learned from: (profile, task, configuration, success, time)."""
    p = lambda f: F.col(f"payload.{f}")
    return accepted.where(
        p("used_recommendation") & p("used_configuration_id").isNotNull() & p("outcome").isin("worked", "did_not_work")
    ).select(
        "feedback_id", "recommendation_id", "recorded_at", "feedback_profile_id", "task_family",
        p("used_configuration_id").alias("configuration_id"), (p("outcome") == "worked").alias("success"),
    )


def _rate(successes: Column, n: Column) -> Column:
    return (F.lit(PRIOR_ALPHA) + successes) / (F.lit(PRIOR_STRENGTH) + n)


def _posterior(rate: Column, successes: Column, n: Column) -> Column:
    return (F.lit(PRIOR_STRENGTH) * rate + successes) / (F.lit(PRIOR_STRENGTH) + n)


def signals(events: DataFrame, minimum_support: int = MINIMUM_SUPPORT) -> DataFrame:
    """Bounded score adjustment per (profile, task, configuration).

    Two small partial aggregates: cells, then profiles from the cells.
    """
    ok = F.sum(F.col("success").cast("int"))
    cells = events.groupBy("feedback_profile_id", "task_family", "configuration_id").agg(
        F.count("*").alias("support"), ok.alias("successes")
    )
    profiles = cells.groupBy("feedback_profile_id").agg(
        _rate(F.sum("successes"), F.sum("support")).alias("global_rate")
    )
    return score_cells(cells, profiles, minimum_support)


def score_cells(cells: DataFrame, profiles: DataFrame, minimum_support: int) -> DataFrame:
    """Posterior and bounded adjustment of counted cells, given each profile's overall rate."""
    applied = F.col("support") >= minimum_support
    weight = F.least(F.lit(1.0), F.col("support") / F.lit(FULL_SUPPORT))
    raw = (F.col("posterior_success") - F.col("global_rate")) * F.lit(ADJUSTMENT_SCALE) * weight
    bounded = F.greatest(F.lit(-MAX_ADJUSTMENT), F.least(F.lit(MAX_ADJUSTMENT), raw))
    return (
        cells.join(profiles, "feedback_profile_id")
        .withColumn("posterior_success", _posterior(F.col("global_rate"), F.col("successes"), F.col("support")))
        .withColumn("applied", applied)
        .withColumn("score_adjustment", F.when(applied, bounded).otherwise(0.0))
    )


def attach_signals(requests: DataFrame, signal_rows: DataFrame) -> DataFrame:
    """Adds ``feedback`` (map configuration_id -> signal) to requests by (profile, task).

    A catalog has at most 500 configurations, so the maps are small. Requests without a profile get
    none. One profile may send a large share of all requests.
    """
    maps = signal_rows.groupBy("feedback_profile_id", "task_family").agg(
        F.map_from_entries(
            F.collect_list(F.struct("configuration_id", F.struct("support", "score_adjustment", "applied")))
        ).alias("feedback")
    )
    pair = F.when(
        F.col("feedback_profile_id").isNotNull(), F.to_json(F.array("feedback_profile_id", "task_family"))
    )
    keyed = lookup_skewed(
        requests.withColumn("_pair", pair), maps.withColumn("_pair", pair), "_pair", ["feedback"], row_id="request_id"
    )
    return keyed.drop("_pair")


def replay(events: DataFrame, minimum_support: int = MINIMUM_SUPPORT) -> DataFrame:
    """Chronological replay per profile: train on the older part, compare Brier scores on the newest fifth.

    Returns one row per profile with counts, both scores, the per-task scores and the decision.
    """
    profile = ["feedback_profile_id"]
    total = F.col("_total")
    take = F.when(total < MINIMUM_EVENTS, 0).otherwise(F.greatest(F.lit(2), F.floor(total / 5)))
    split = newest_n(written(events, "events"), profile, "recorded_at", "feedback_id", take, "holdout")
    ok, older = F.col("success").cast("int"), ~F.col("holdout")
    part = lambda which, value: F.coalesce(F.sum(F.when(which, value)), F.lit(0))
    # one row per (profile, task, configuration): all that follows is sums over these
    cells = written(split.groupBy(*profile, "task_family", "configuration_id").agg(
        part(older, F.lit(1)).alias("tn"), part(older, ok).alias("ts"),
        part(F.col("holdout"), F.lit(1)).alias("n"), part(F.col("holdout"), ok).alias("s"),
    ), "cells")
    base = cells.groupBy(*profile).agg(
        F.sum("tn").alias("training_count"), F.when(F.sum("tn") > 0, _rate(F.sum("ts"), F.sum("tn"))).alias("baseline"),
        (F.sum("tn") + F.sum("n")).alias("event_count"),
    )
    # all holdout rows of a cell have the same two predictions, so cell counts give the exact sums
    held = (
        cells.where("n > 0")
        .join(base.where("training_count > 0"), profile)
        .withColumn(
            "candidate",
            F.when(F.col("tn") >= minimum_support, _posterior(F.col("baseline"), F.col("ts"), F.col("tn")))
            .otherwise(F.col("baseline")),
        )
    )
    error = lambda p: (
        F.col("s") * (F.col(p) - 1.0) * (F.col(p) - 1.0) + (F.col("n") - F.col("s")) * F.col(p) * F.col(p)
    )
    by_task = held.groupBy(*profile, "task_family").agg(
        F.sum("n").alias("count"), F.sum(error("baseline")).alias("be"), F.sum(error("candidate")).alias("ce")
    ).withColumn("guard", F.col("ce") / F.col("count") <= F.col("be") / F.col("count") + TOLERANCE)
    entry = F.struct(
        F.col("task_family").alias("k"),
        F.struct("count", (F.col("be") / F.col("count")).alias("baseline_brier"),
                 (F.col("ce") / F.col("count")).alias("candidate_brier")).alias("v"),
    )
    scored = by_task.groupBy(*profile).agg(
        F.sum("count").alias("holdout_count"),
        (F.sum("be") / F.sum("count")).alias("baseline_brier"),
        (F.sum("ce") / F.sum("count")).alias("candidate_brier"),
        F.bool_and("guard").alias("bias_guard_passed"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("slice_metrics"),
    )
    enough = F.col("event_count") >= MINIMUM_EVENTS
    passes = (F.col("candidate_brier") <= F.col("baseline_brier") + TOLERANCE) & F.col("bias_guard_passed")
    improved = F.col("candidate_brier") < F.col("baseline_brier") - IMPROVEMENT
    decision = (
        F.when(~enough, "insufficient_data")
        .when(passes & improved, "promoted")
        .when(passes, "unchanged")
        .otherwise("rejected")
    )
    return base.join(scored, profile, "left").select(
        *profile, "event_count",
        F.when(enough, F.col("training_count")).otherwise(0).alias("training_count"),
        F.coalesce("holdout_count", F.lit(0)).alias("holdout_count"),
        "baseline_brier", "candidate_brier",
        F.coalesce("bias_guard_passed", F.lit(False)).alias("bias_guard_passed"),
        "slice_metrics", decision.alias("decision"),
        F.coalesce(enough & passes, F.lit(False)).alias("personalization_enabled"),
    )


def export_feedback(feedback: DataFrame, receipts: DataFrame) -> DataFrame:
    """Feedback with its receipt's context, oldest first; prompts are in neither table."""
    context = receipts.select(
        "recommendation_id", F.col("created_at").alias("recommendation_created_at"), "catalog_version",
        "task_family", "difficulty", "feedback_profile_id", "selected_configuration_ids",
    )
    return feedback.drop("task_family", "feedback_profile_id").join(context, "recommendation_id").orderBy("recorded_at", "feedback_id")


def newest(rows: DataFrame, at: str, tie: str, n: int = 100) -> DataFrame:
    """The newest ``n`` rows of a history table."""
    return rows.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(n)


def personalization_state(log: DataFrame) -> DataFrame:
    """Current state per profile from the promotion log.

    'promoted' and 'unchanged' switch personalisation on, 'rolled_back' off; other decisions change
    nothing.
    """
    changes = F.col("decision").isin("promoted", "unchanged", "rolled_back")
    when = F.when(changes, F.struct("created_at", "promotion_id"))
    state = log.groupBy("feedback_profile_id").agg(
        F.count("*").alias("audit_entries"),
        F.max_by("decision", when).alias("_last"),
        F.max_by("policy_version", when).alias("_version"),
    )
    on = F.coalesce(F.col("_last").isin("promoted", "unchanged"), F.lit(False))
    return state.select(
        "feedback_profile_id", "audit_entries", on.alias("personalization_enabled"),
        F.when(on, F.col("_version")).alias("policy_version"),
    )
