"""Reports on outcomes(key, split, task_family, length_band, lambda, strategy, model, correctness, compute, utility)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FLOORS = (0.4, 0.6, 0.8)  # fixed values
SLICE_SUPPORT, SLICE_TOLERANCE = 30, -0.02  # fixed values
MAJOR_SLICE_ROWS, MAJOR_SLICE_FLOOR = 100, 0.95  # fixed values


def _means() -> list[Column]:
    return [
        F.count("*").alias("sample_size"),
        F.avg("correctness").alias("mean_correctness"),
        F.avg("compute").alias("mean_compute"),
        F.avg("utility").alias("mean_utility"),
    ]


def summarize(outcomes: DataFrame) -> DataFrame:
    """Per (lambda, split, strategy): means, oracle regret, floor violations and model shares."""
    group = ["lambda", "split", "strategy"]
    below = [
        F.sum(F.when(F.col("correctness") < f, 1).otherwise(0)).alias(f"_below_{i}") for i, f in enumerate(FLOORS)
    ]
    parts = outcomes.groupBy(*group, "model").agg(
        F.count("*").alias("n"), F.sum("correctness").alias("q"), F.sum("compute").alias("c"),
        F.sum("utility").alias("u"), *below,
    )
    rows = parts.groupBy(*group).agg(
        F.sum("n").alias("sample_size"),
        (F.sum("q") / F.sum("n")).alias("mean_correctness"),
        (F.sum("c") / F.sum("n")).alias("mean_compute"),
        (F.sum("u") / F.sum("n")).alias("mean_utility"),
        *[(F.sum(f"_below_{i}") / F.sum("n")).alias(f"below_{int(f * 100)}") for i, f in enumerate(FLOORS)],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n")))).alias("_counts"),
    )
    oracle = F.max(F.when(F.col("strategy") == "oracle", F.col("mean_utility"))).over(
        Window.partitionBy("lambda", "split")
    )
    share = F.transform_values("_counts", lambda _, n: n / F.col("sample_size"))
    return rows.withColumn("oracle_regret", oracle - F.col("mean_utility")).withColumn(
        "recommendation_share", share
    ).drop("_counts")


def slices(outcomes: DataFrame, attributes: tuple[str, ...] = ("task_family", "length_band")) -> DataFrame:
    """Means per slice of each attribute, all attributes in one pass."""
    kinds = F.inline(
        F.array(*[F.struct(F.lit(a).alias("slice_type"), F.col(a).alias("slice")) for a in attributes])
    )
    group = ["lambda", "split", "strategy"]
    return (
        outcomes.select(*group, "correctness", "compute", "utility", kinds)
        .groupBy(*group, "slice_type", "slice")
        .agg(*_means())
    )


def slice_regressions(sliced: DataFrame, candidate: str, baseline: str) -> DataFrame:
    of = lambda s, x: F.max(F.when(F.col("strategy") == s, F.col(x)))
    return (
        sliced.groupBy("lambda", "split", "slice_type", "slice")
        .agg(
            of(candidate, "sample_size").alias("sample_size"),
            (of(candidate, "mean_utility") - of(baseline, "mean_utility")).alias("utility_difference"),
        )
        .where((F.col("sample_size") >= SLICE_SUPPORT) & (F.col("utility_difference") < SLICE_TOLERANCE))
    )


def strategy_front(summary: DataFrame, strategies: tuple[str, ...]) -> DataFrame:
    """Strategies on the (correctness up, compute down) front per (lambda, split)."""
    from compassframe.operators.pareto import skyline

    return skyline(
        summary.where(F.col("strategy").isin(*strategies)), ["lambda", "split"], "mean_correctness", "mean_compute"
    )


def paired_difference(outcomes: DataFrame, baseline: str = "global_utility") -> DataFrame:
    """Per (lambda, split, strategy): mean utility minus the baseline's on the same keys.

    Every strategy is evaluated on every key, so the mean of the paired differences needs no join.
    """
    rows = outcomes.groupBy("lambda", "split", "strategy").agg(
        F.count("*").alias("pairs"), F.avg("utility").alias("mean_utility")
    )
    base = F.max(F.when(F.col("strategy") == baseline, F.col("mean_utility"))).over(
        Window.partitionBy("lambda", "split")
    )
    return rows.withColumn("paired_difference", F.col("mean_utility") - base)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def comparison_points(cq: Column, cc: Column, cu: Column, fq: Column, fc: Column, fu: Column, bu: Column, ou: Column) -> dict[str, Column]:
    """The five comparative metrics from mean quality, compute and utility of the four policies."""
    return {
        "quality_retention": ratio(cq, fq),
        "compute_reduction": F.when(fc == 0, 0.0).otherwise(1 - ratio(cc, fc)),
        "utility_vs_fixed": cu - fu,
        "utility_vs_content_blind": cu - bu,
        "regret_reduction": F.when(ou - fu == 0, 0.0).otherwise(1 - ratio(ou - cu, ou - fu)),
    }


def segment_gate(summary: DataFrame, regressions: DataFrame, candidate: str = "hybrid_segment",
                 baseline: str = "global_utility") -> DataFrame:
    """Promotion of a segment policy: utility not below the baseline, no slice regression."""
    of = lambda s: F.max(F.when(F.col("strategy") == s, F.col("mean_utility")))
    difference = summary.groupBy("lambda", "split").agg((of(candidate) - of(baseline)).alias("utility_difference"))
    counted = regressions.groupBy("lambda", "split").agg(F.count("*").alias("regressions"))
    return (
        difference.join(F.broadcast(counted), ["lambda", "split"], "left")
        .withColumn("regressions", F.coalesce("regressions", F.lit(0)))
        .withColumn("utility_not_below", F.col("utility_difference") >= 0)
        .withColumn("no_slice_regression", F.col("regressions") == 0)
        .withColumn("eligible", F.col("utility_not_below") & F.col("no_slice_regression"))
    )


def confirmatory_gate(intervals: DataFrame, points: DataFrame, slice_intervals: DataFrame) -> DataFrame:
    """The conjunctive checks on interval lower bounds, the regret point and the major slices.

    ``intervals``: (metric, low, high); ``points``: one row of comparison points; ``slice_intervals``:
    (slice, rows, low).
    """
    low = lambda m: F.max(F.when(F.col("metric") == m, F.col("low")))
    lows = intervals.agg(
        (low("quality_retention") >= 0.99).alias("quality_retention_ok"),
        (low("compute_reduction") >= 0.40).alias("compute_reduction_ok"),
        (low("utility_vs_fixed") > 0).alias("utility_vs_fixed_ok"),
        (low("utility_vs_content_blind") > 0).alias("utility_vs_content_blind_ok"),
    )
    regret = points.select((F.col("regret_reduction") >= 0.20).alias("regret_reduction_ok"))
    major = slice_intervals.agg(
        F.coalesce(
            F.bool_and(F.when(F.col("rows") >= MAJOR_SLICE_ROWS, F.col("low") >= MAJOR_SLICE_FLOOR)), F.lit(True)
        ).alias("major_slices_ok")
    )
    checks = lows.withColumn("regret_reduction_ok", regret.scalar()).withColumn("major_slices_ok", major.scalar())
    every = F.lit(True)
    for name in checks.columns:
        every = every & F.col(name)
    return checks.withColumn("promoted", every)


def threshold_sweep(rows: DataFrame, thresholds: list[float], probability: str, strong: str, economical: str) -> DataFrame:
    """Strong model at or above each threshold, economical one below: quality, compute, strong share.

    ``strong`` and ``economical`` are struct columns with correctness and compute.
    """
    pick = F.when(F.col(probability) >= F.col("threshold"), F.col(strong)).otherwise(F.col(economical))
    return (
        rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
        .withColumn("_pick", pick)
        .groupBy("threshold")
        .agg(
            F.count("*").alias("n"),
            F.avg((F.col(probability) >= F.col("threshold")).cast("double")).alias("strong_share"),
            F.avg("_pick.correctness").alias("mean_correctness"),
            F.avg("_pick.compute").alias("mean_compute"),
        )
    )


def best_single(wide: DataFrame, lam: float) -> DataFrame:
    """The best model to use for everything, by quality and by utility."""
    from compassframe.operators.policy import model_means

    means = model_means(wide)
    utility = F.col("mean_correctness") - F.lit(lam) * F.col("mean_compute")
    order = lambda s: F.struct(s, -F.col("params"), F.col("model"))
    return means.agg(
        F.max_by("model", order(F.col("mean_correctness"))).alias("best_quality_model"),
        F.max_by("model", order(utility)).alias("best_utility_model"),
    )


def calibration_bins(rows: DataFrame, probability: str = "probability", label: str = "label") -> DataFrame:
    """Ten equal-width bins, the last one closed; edges compared exactly, not by multiplying."""
    p = F.col(probability)
    index = sum((F.when(p >= F.lit(k) / F.lit(10.0), 1).otherwise(0) for k in range(1, 10)), F.lit(0))
    inside = rows.where((p >= 0) & (p <= 1))
    return inside.groupBy(index.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(probability).alias("mean_probability"), F.avg(label).alias("observed_rate")
    )


def calibration(rows: DataFrame, probability: str = "probability", label: str = "label") -> DataFrame:
    """Brier score and expected calibration error in one pass over the rows."""
    p, y = F.col(probability), F.col(label)
    index = sum((F.when(p >= F.lit(k) / F.lit(10.0), 1).otherwise(0) for k in range(1, 10)), F.lit(0))
    inside = (p >= 0) & (p <= 1)
    bins = rows.groupBy(F.when(inside, index).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum((p - y) * (p - y)).alias("se")
    )
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("sp") - F.col("sy")))
    return bins.agg(
        F.sum("n").alias("rows"),
        (F.sum("se") / F.sum("n")).alias("brier"),
        (F.sum(gap) / F.sum("n")).alias("ece"),
    )


def classifier_report(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Per label: support, precision, recall, F1; from one confusion aggregate."""
    confusion = rows.groupBy(expected, predicted).agg(F.count("*").alias("n"))
    sides = confusion.select(
        F.inline(
            F.array(
                F.struct(F.col(expected).alias("label"), F.lit(1).alias("is_expected"), F.col("n"),
                         (F.col(expected) == F.col(predicted)).alias("hit")),
                F.struct(F.col(predicted).alias("label"), F.lit(0).alias("is_expected"), F.col("n"),
                         (F.col(expected) == F.col(predicted)).alias("hit")),
            )
        )
    )
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    counts = sides.groupBy("label").agg(
        n(F.col("is_expected") == 1).alias("support"),
        n(F.col("is_expected") == 0).alias("predicted"),
        n((F.col("is_expected") == 1) & F.col("hit")).alias("true_positive"),
    )
    precision = ratio(F.col("true_positive").cast("double"), F.col("predicted").cast("double"))
    recall = ratio(F.col("true_positive").cast("double"), F.col("support").cast("double"))
    return (
        counts.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
