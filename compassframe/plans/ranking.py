"""Queries over ranking and Pareto fronts, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from compassframe.functions import profile as P
from compassframe.functions.text import round8
from compassframe.operators import catalog as C
from compassframe.operators import pareto as PA
from compassframe.operators import rank as R
from compassframe.plans.inputs import PROMPTS_SQL, REQUESTS_SQL, requests, table
from compassframe.plans.profiling import PROFILE_SQL


def _catalog_sql() -> str:
    lists = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    rows = []
    for cid, provider, dep, ctx, caps, priv, p_in, p_out, lat, src, prior, q in C.NEUTRAL_CATALOG:
        qs = ", ".join(f"{x}::DOUBLE" for x in q)
        rows.append(
            f"('{cid}', '{provider}', '{dep}', {ctx}, {lists(caps)}, {lists(priv)}, {p_in}::DOUBLE, {p_out}::DOUBLE, "
            f"{lat}::DOUBLE, '{src}', {prior}::DOUBLE, {qs})"
        )
    cols = "configuration_id, provider, deployment, context_window, caps, priv, p_in, p_out, latency, source_type, prior"
    return f"cat({cols}, {', '.join('q_' + f for f in C.QUALITY_FAMILIES)}) AS (VALUES {', '.join(rows)})"


_BY_FAMILY = " ".join(f"WHEN '{f}' THEN q_{f}" for f in C.QUALITY_FAMILIES)
_WEIGHTS = [
    "CASE objective " + " ".join(f"WHEN '{o}' THEN {w[i]}::DOUBLE" for o, w in R.OBJECTIVE_WEIGHTS.items()) + " END"
    for i in range(3)
]

ASSESSED_SQL = f"""WITH {PROMPTS_SQL}, {REQUESTS_SQL}, {PROFILE_SQL}, {_catalog_sql()},
req AS (
  SELECT r.request_id, r.objective, r.max_cost_usd, r.latency_slo_ms, r.min_quality, r.expected_output_tokens,
         p.task_family, p.uncertainty, p.high AS tokens_in, r.expected_family,
         list_concat(p.required_capabilities, r.requested_capabilities) AS needed,
         CASE WHEN len(p.privacy_flags) > 0 AND r.privacy = 'standard' THEN 'no_training' ELSE r.privacy END AS eff
  FROM requests r JOIN profiles p USING (request_id)),
base AS (
  SELECT req.*, cat.*, CASE task_family {_BY_FAMILY} ELSE q_general END AS quality,
         (tokens_in * p_in + expected_output_tokens * p_out) / 1000000::DOUBLE AS cost
  FROM req, cat),
assessed AS (
  SELECT *, list_filter([
     CASE WHEN eff = 'local_only' AND deployment <> 'local' THEN 'local_only' END,
     CASE WHEN NOT list_contains(priv, eff) THEN 'privacy' END,
     CASE WHEN NOT list_has_all(caps, needed) THEN 'capabilities' END,
     CASE WHEN tokens_in + expected_output_tokens > context_window THEN 'context' END,
     CASE WHEN quality < min_quality THEN 'quality' END,
     CASE WHEN cost > max_cost_usd THEN 'cost' END,
     CASE WHEN latency > latency_slo_ms THEN 'latency' END], lambda x: x IS NOT NULL) AS rejected_by
  FROM base),
eligible AS (SELECT * FROM assessed WHERE len(rejected_by) = 0)"""

SCORED_SQL = f"""{ASSESSED_SQL},
normal AS (
  SELECT *, coalesce(nullif(max(cost) OVER (PARTITION BY request_id), 0), 1) AS mc,
         coalesce(nullif(max(latency) OVER (PARTITION BY request_id), 0), 1) AS ml FROM eligible),
parts AS (
  SELECT *, {_WEIGHTS[0]} * quality AS quality_part, {_WEIGHTS[1]} * (1 - cost / mc) AS cost_part,
         {_WEIGHTS[2]} * (1 - latency / ml) AS latency_part,
         CASE WHEN source_type = 'provider_documentation' THEN 0.04::DOUBLE ELSE 0.10::DOUBLE END AS risk,
         prior * (0.04::DOUBLE + 0.04::DOUBLE * uncertainty) AS penalty,
         NOT EXISTS (SELECT 1 FROM eligible o WHERE o.request_id = normal.request_id
            AND o.quality >= normal.quality AND o.cost <= normal.cost AND o.latency <= normal.latency
            AND (o.quality > normal.quality OR o.cost < normal.cost OR o.latency < normal.latency)) AS pareto
  FROM normal),
scored_rows AS (SELECT *, quality_part + cost_part + latency_part - risk - penalty AS score FROM parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, cost, configuration_id) AS pos FROM scored_rows)"""

SHORTLIST_SQL = f"""{SCORED_SQL},
first_ AS (SELECT * FROM ranked WHERE pareto QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY pos) = 1),
rest1 AS (SELECT r.* FROM ranked r ANTI JOIN first_ f ON r.request_id = f.request_id AND r.configuration_id = f.configuration_id),
second_ AS (SELECT * FROM rest1 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY cost, quality DESC, configuration_id) = 1),
rest2 AS (SELECT r.* FROM rest1 r ANTI JOIN second_ s ON r.request_id = s.request_id AND r.configuration_id = s.configuration_id),
leader AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY quality DESC, score DESC, configuration_id) = 1),
guard AS (SELECT l.* FROM leader l ANTI JOIN first_ f ON l.request_id = f.request_id AND l.configuration_id = f.configuration_id
          ANTI JOIN second_ s ON l.request_id = s.request_id AND l.configuration_id = s.configuration_id
          WHERE l.request_id IN (SELECT request_id FROM rest2)),
alternative AS (SELECT * FROM rest2 WHERE request_id NOT IN (SELECT request_id FROM guard)
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY (deployment = 'local') DESC, latency, quality DESC, configuration_id) = 1),
picks AS (
  SELECT 1 AS rank, 'recommended' AS label, 'objective_best,pareto_front' AS selection_flags, * FROM first_
  UNION ALL SELECT 2, 'economical_alternative', 'lowest_cost' || CASE WHEN pareto THEN ',pareto_front' ELSE '' END, * FROM second_
  UNION ALL SELECT 3, 'specialist_alternative', 'specialist_recall_guard' || CASE WHEN pareto THEN ',pareto_front' ELSE '' END, * FROM guard
  UNION ALL SELECT 3, 'privacy_latency_alternative', 'local_or_fast' || CASE WHEN pareto THEN ',pareto_front' ELSE '' END, * FROM alternative),
rendered AS (
  SELECT *, greatest(0.30::DOUBLE, least(0.92::DOUBLE, 0.84::DOUBLE - 0.25::DOUBLE * prior - 0.20::DOUBLE * uncertainty)) AS confidence,
         CASE WHEN source_type = 'provider_documentation' THEN 0.04::DOUBLE ELSE 0.08::DOUBLE END AS spread FROM picks)"""


def _profiled(spark, sf):
    return P.profile(requests(spark, sf))


def _assessed(spark, sf):
    return R.assess(_profiled(spark, sf), C.neutral_catalog(spark))


def _ranked(spark, sf):
    return R.score(_assessed(spark, sf))


def _listed(spark, sf):
    return R.recommend(_profiled(spark, sf), C.neutral_catalog(spark))


def eligible_pairs(spark, sf):
    pairs = _assessed(spark, sf).select("request_id", F.explode_outer("assessed").alias("c"))
    return pairs.where(F.size("c.rejected_by") == 0).select(
        "request_id", "c.configuration_id", round8(F.col("c.quality")).alias("quality"),
        round8(F.col("c.cost")).alias("cost"), round8(F.col("c.latency")).alias("latency"),
    )


def rejection_reasons(spark, sf):
    """Per rule, how many request x configuration pairs it refuses, and requests nothing fits."""
    rows = _assessed(spark, sf).select(
        F.inline(
            F.flatten(
                F.array(
                    F.flatten(F.transform("assessed", lambda c: F.transform(c.rejected_by, lambda r: F.struct(r.alias("rule"))))),
                    F.when(
                        F.forall("assessed", lambda c: F.size(c.rejected_by) > 0), F.array(F.struct(F.lit("no_match").alias("rule")))
                    ).otherwise(F.array().cast("array<struct<rule:string>>")),
                )
            )
        )
    )
    return rows.groupBy("rule").agg(F.count("*").alias("pairs"))


def scored_candidates(spark, sf):
    parts = ["score", "quality_part", "cost_part", "latency_part", "risk_part", "uncertainty_part"]
    return _ranked(spark, sf).select(
        "request_id", F.posexplode_outer("ranked").alias("pos", "c")
    ).where(F.col("c").isNotNull()).select(
        "request_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "c.configuration_id",
        *[round8(F.col(f"c.{p}")).alias(p) for p in parts],
    )


def pareto_candidates(spark, sf):
    return _ranked(spark, sf).select("request_id", F.explode_outer("ranked").alias("c")).where(
        "c.pareto_efficient"
    ).select("request_id", "c.configuration_id")


def shortlist(spark, sf):
    rows = _listed(spark, sf).select("request_id", "status", F.explode_outer("shortlist").alias("s"))
    return rows.select(
        "request_id", "status", F.col("s.rank").alias("rank"), "s.label", "s.configuration_id",
        round8(F.col("s.score")).alias("score"), F.array_join("s.selection_flags", ",").alias("selection_flags"),
        round8(F.col("s.confidence")).alias("confidence"),
        round8(F.col("s.quality.low")).alias("quality_low"), round8(F.col("s.quality.high")).alias("quality_high"),
        round8(F.col("s.cost.high")).alias("cost_high"), round8(F.col("s.latency.low")).alias("latency_low"),
        F.array_join("s.reason_codes", ",").alias("reason_codes"),
    )


def software_benchmark(spark, sf):
    """Metrics of the recommender on labelled prompts: accuracy, Pareto and specialist coverage, reconciliation."""
    rows = _listed(spark, sf).where(F.col("status") == "matched")
    best = F.array_max(F.transform("shortlist", lambda s: s.quality.expected))
    first = F.get("shortlist", F.lit(0))
    guarded = F.exists("shortlist", lambda s: F.array_contains(s.selection_flags, "specialist_recall_guard"))
    error = F.array_max(
        F.transform("shortlist", lambda s: F.abs(s.score - F.aggregate(s.contributions, F.lit(0.0), lambda a, c: a + c.value)))
    )
    confidence = F.transform("shortlist", lambda s: s.confidence)
    return rows.agg(
        F.count("*").alias("requests"),
        round8(F.avg((F.col("task_family") == F.col("expected_family")).cast("double"))).alias("task_family_accuracy"),
        round8(F.avg(first.pareto_efficient.cast("double"))).alias("primary_pareto_rate"),
        round8(F.avg((guarded | (first.quality.expected == best)).cast("double"))).alias("specialist_coverage"),
        round8(F.max(error)).alias("reconciliation_max_error"),
        round8(F.min(F.array_min(confidence))).alias("confidence_min"),
        round8(F.max(F.array_max(confidence))).alias("confidence_max"),
    )


def pareto_parts(spark, sf):
    """Per brand, the parts no other part beats on size (larger) and price (lower)."""
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return PA.skyline(parts, ["p_brand"], "p_size", "p_retailprice")


QUERIES = {
    "eligible_pairs": eligible_pairs,
    "rejection_reasons": rejection_reasons,
    "scored_candidates": scored_candidates,
    "pareto_candidates": pareto_candidates,
    "shortlist": shortlist,
    "software_benchmark": software_benchmark,
    "pareto_parts": pareto_parts,
}

ORACLES = {
    "eligible_pairs": f"""{ASSESSED_SQL}
SELECT request_id, configuration_id, round(quality, 8) AS quality, round(cost, 8) AS cost, round(latency, 8) AS latency FROM eligible""",
    "rejection_reasons": f"""{ASSESSED_SQL},
reasons AS (SELECT unnest(rejected_by) AS rule FROM assessed
  UNION ALL SELECT 'no_match' FROM assessed GROUP BY request_id HAVING min(len(rejected_by)) > 0)
SELECT rule, count(*) AS pairs FROM reasons GROUP BY rule""",
    "scored_candidates": f"""{SCORED_SQL}
SELECT request_id, pos, configuration_id, round(score, 8) AS score, round(quality_part, 8) AS quality_part,
  round(cost_part, 8) AS cost_part, round(latency_part, 8) AS latency_part, round(-risk, 8) AS risk_part,
  round(-penalty, 8) AS uncertainty_part FROM ranked""",
    "pareto_candidates": f"""{SCORED_SQL} SELECT request_id, configuration_id FROM ranked WHERE pareto""",
    "shortlist": f"""{SHORTLIST_SQL}
SELECT q.request_id, CASE WHEN r.rank IS NULL THEN 'no_match' ELSE 'matched' END AS status, r.rank, r.label, r.configuration_id,
  round(score, 8) AS score, selection_flags, round(confidence, 8) AS confidence,
  CASE WHEN r.rank IS NOT NULL THEN round(greatest(0, quality - spread), 8) END AS quality_low,
  CASE WHEN r.rank IS NOT NULL THEN round(least(1, quality + spread), 8) END AS quality_high,
  round(cost * 1.5::DOUBLE, 8) AS cost_high, round(latency * 0.65::DOUBLE, 8) AS latency_low,
  'task_prior_' || r.task_family || ',objective_' || r.objective || ',' ||
    CASE WHEN deployment = 'local' THEN 'runs_locally' ELSE 'meets_' || r.eff END AS reason_codes
FROM req q LEFT JOIN rendered r ON q.request_id = r.request_id""",
    "software_benchmark": f"""{SHORTLIST_SQL},
per AS (SELECT request_id, max((task_family = expected_family)::INT) AS hit, max(CASE WHEN rank = 1 THEN pareto::INT END) AS p1,
   max(CASE WHEN label = 'specialist_alternative' OR (rank = 1 AND quality = best) THEN 1 ELSE 0 END) AS cover,
   max(abs(score - (quality_part + cost_part + latency_part - risk - penalty))) AS err, min(confidence) AS c0, max(confidence) AS c1
  FROM (SELECT *, max(quality) OVER (PARTITION BY request_id) AS best FROM rendered) GROUP BY request_id)
SELECT count(*) AS requests, round(avg(hit), 8) AS task_family_accuracy, round(avg(p1), 8) AS primary_pareto_rate,
  round(avg(cover), 8) AS specialist_coverage, round(max(err), 8) AS reconciliation_max_error,
  round(min(c0), 8) AS confidence_min, round(max(c1), 8) AS confidence_max FROM per""",
    "pareto_parts": """SELECT p_partkey, p_brand, p_size, p_retailprice FROM part a WHERE NOT EXISTS (
  SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice
    AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))""",
}
