"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion into a sink that discards rows. A first, untimed pass over the smallest
data set loads classes and starts the Python workers.
"""

from __future__ import annotations

import json
import os
import time

from compassframe.plans import registry
from compassframe.plans.inputs import prompts, table
from compassframe.session import ensure_checkpoint_dir, local_session

HEADLINE = [
    "token_range", "difficulty_uncertainty", "privacy_flags", "eligible_pairs", "shortlist", "pareto_parts",
    "segment_policy", "outcome_summary", "lambda_sweep", "bootstrap_ci", "ratio_bootstrap_ci", "slice_ci", "confirmatory_gate",
    "content_blind_control", "grouped_folds",
    "calibration_summary", "source_alignment", "canonical_dedup", "fuzzy_overlap", "battle_labels", "table_digests",
    "feedback_signals", "feedback_replay", "version_acceptance", "retention_purge", "nearest_prototype", "token_bucket",
]
WARM_UP = "/root/testdata/sf0.001"


def run(spark, name: str, sf_dir: str) -> tuple[float, float]:
    """Seconds in all, and of them until the result was planned (with the tables that building it writes)."""
    start = time.perf_counter()
    df = registry.QUERIES[name](spark, sf_dir)
    df._jdf.queryExecution().executedPlan()
    planned = time.perf_counter() - start
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, planned


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    spark = local_session(cpus, cpus)
    ensure_checkpoint_dir(spark)
    if os.path.isdir(WARM_UP):
        for name in names:
            run(spark, name, WARM_UP)
    both = {name: run(spark, name, sf_dir) for name in names}
    times = {name: round(t, 3) for name, (t, _) in both.items()}
    built = {name: round(t, 3) for name, (_, t) in both.items()}
    rates = {}
    if "difficulty_uncertainty" in times:
        rates["prompts_profiled_per_sec"] = round(prompts(spark, sf_dir).count() / times["difficulty_uncertainty"], 1)
    if "token_range" in times:
        rates["documents_token_ranged_per_sec"] = round(table(spark, sf_dir, "documents").count() / times["token_range"], 1)
    if "eligible_pairs" in times:
        rates["request_configuration_pairs_per_sec"] = round(prompts(spark, sf_dir).count() * 10 / times["eligible_pairs"], 1)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "built_and_planned": built, "rates": rates, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
