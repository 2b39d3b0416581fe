"""Constrained multi-objective ranking of configurations for each request.

A catalog version has at most 500 configurations, so it rides along with every request as one array
literal (a scalar subquery) and the whole decision is taken inside the request's row: filter, score,
Pareto front, order and shortlist are array expressions. There is no cross join, no window and no
shuffle, and the same function serves streaming requests.

Request columns: request_id, task_family, uncertainty, estimated_input_tokens, required_capabilities,
privacy_flags, and optionally privacy, objective, max_cost_usd, latency_slo_ms, min_quality,
expected_output_tokens, requested_capabilities, feedback (map configuration_id -> struct).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compassframe.functions.barrier import settle
from compassframe.operators.catalog import MAX_CONFIGURATIONS
from compassframe.operators.pareto import mark_pareto

# Objective -> weights of quality, cost utility and latency utility.
OBJECTIVE_WEIGHTS = {
    "balanced": (0.58, 0.25, 0.17),
    "best_quality": (0.86, 0.08, 0.06),
    "lowest_cost": (0.30, 0.62, 0.08),
    "fastest": (0.30, 0.10, 0.60),
}
REQUEST_DEFAULTS = {
    "privacy": ("string", "no_training"),
    "objective": ("string", "balanced"),
    "max_cost_usd": ("double", None),
    "latency_slo_ms": ("int", None),
    "min_quality": ("double", None),
    "expected_output_tokens": ("int", 512),
    "requested_capabilities": ("array<string>", None),
    "feedback": ("map<string,struct<support:bigint,score_adjustment:double,applied:boolean>>", None),
}
RULES = ["local_only", "privacy", "capabilities", "context", "quality", "cost", "latency"]


# Catalog columns that a table of bare configurations may lack.
CATALOG_OPTIONS = {
    "model_id": "string", "display_name": "string", "settings": "map<string,string>", "prior_uncertainty": "double",
    "observed_at": "timestamp", "expires_at": "timestamp", "disclaimer": "string",
}


def catalog_array(catalog: DataFrame) -> Column:
    """The catalog as one array value; refuses to build one above the size a catalog may have.

    At most one row above that size is gathered before it is refused.
    """
    fields = [
        "configuration_id", "provider", "deployment", "context_window", "capabilities", "privacy",
        "input_usd_per_million", "output_usd_per_million", "latency_ms", "quality", "evidence", *CATALOG_OPTIONS,
    ]
    absent = {c: F.lit(None).cast(t) for c, t in CATALOG_OPTIONS.items() if c not in catalog.columns}
    full = catalog.withColumns(absent) if absent else catalog
    counted = full.limit(MAX_CONFIGURATIONS + 1).select(F.struct(*fields).alias("c")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("c.configuration_id").alias("id"), F.struct(
            *[F.map_entries(f"c.{f}").alias(f) if f in ("quality", "settings") else F.col(f"c.{f}") for f in fields]
        ).alias("c")))).alias("cs")
    )
    checked = F.when(
        F.size("cs") <= MAX_CONFIGURATIONS, F.transform("cs", lambda x: x.c)
    ).otherwise(F.raise_error(F.lit(f"a catalog holds at most {MAX_CONFIGURATIONS} configurations")))
    return counted.select(checked.alias("catalog")).scalar()


def with_defaults(requests: DataFrame) -> DataFrame:
    """Request fields that are absent or NULL take their defaults."""
    filled = {}
    for name, (kind, value) in REQUEST_DEFAULTS.items():
        default = F.lit(value).cast(kind)
        if name not in requests.columns:
            filled[name] = default
        elif value is not None:
            filled[name] = F.coalesce(F.col(name), default)
    return requests.withColumns(filled)


def effective_privacy(privacy: Column, flags: Column) -> Column:
    """Sensitive content tightens 'standard' to 'no_training'; nothing is ever loosened."""
    return F.when((F.size(flags) > 0) & (privacy == "standard"), "no_training").otherwise(privacy)


def _assessed() -> str:
    """SQL for the catalog rows with this request's quality, cost and rule outcomes."""
    return """transform(_catalog, c -> named_struct(
        'configuration_id', c.configuration_id, 'provider', c.provider, 'deployment', c.deployment,
        'evidence', c.evidence, 'prior_uncertainty', coalesce(c.prior_uncertainty, 0.2D),
        'about', named_struct('model_id', c.model_id, 'display_name', c.display_name, 'settings', c.settings,
            'observed_at', c.observed_at, 'expires_at', c.expires_at, 'disclaimer', c.disclaimer),
        'quality', coalesce(get(filter(c.quality, q -> q.key = task_family), 0).value,
                            get(filter(c.quality, q -> q.key = 'general'), 0).value),
        'cost', (estimated_input_tokens * c.input_usd_per_million
                 + expected_output_tokens * c.output_usd_per_million) / 1000000D,
        'latency', c.latency_ms,
        'ok_local_only', effective_privacy <> 'local_only' OR c.deployment = 'local',
        'ok_privacy', array_contains(c.privacy, effective_privacy),
        'ok_capabilities', size(array_except(needed_capabilities, c.capabilities)) = 0,
        'ok_context', estimated_input_tokens + expected_output_tokens <= c.context_window))"""


def assess(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``assessed``: every configuration with quality, cost, latency and the seven rule outcomes.

    A rule that cannot be decided, because a value it needs is NULL, refuses.
    """
    req = with_defaults(requests).withColumns(
        {
            "effective_privacy": effective_privacy(F.col("privacy"), F.col("privacy_flags")),
            "needed_capabilities": F.array_sort(
                F.array_union("required_capabilities", F.coalesce("requested_capabilities", F.array().cast("array<string>")))
            ),
            "_catalog": catalog_array(catalog),
        }
    )
    rows = req.withColumn("_assessed", F.expr(_assessed()))
    done = rows.withColumn(
        "assessed",
        F.expr(
            """transform(_assessed, c -> named_struct(
                'configuration_id', c.configuration_id, 'provider', c.provider, 'deployment', c.deployment,
                'evidence', c.evidence, 'prior_uncertainty', c.prior_uncertainty, 'about', c.about,
                'quality', c.quality, 'cost', c.cost, 'latency', c.latency,
                'rejected_by', array_compact(array(
                    CASE WHEN NOT coalesce(c.ok_local_only, false) THEN 'local_only' END,
                    CASE WHEN NOT coalesce(c.ok_privacy, false) THEN 'privacy' END,
                    CASE WHEN NOT coalesce(c.ok_capabilities, false) THEN 'capabilities' END,
                    CASE WHEN NOT coalesce(c.ok_context, false) THEN 'context' END,
                    CASE WHEN c.quality IS NULL OR NOT coalesce(c.quality >= min_quality, true) THEN 'quality' END,
                    CASE WHEN c.cost IS NULL OR NOT coalesce(c.cost <= max_cost_usd, true) THEN 'cost' END,
                    CASE WHEN c.latency IS NULL OR NOT coalesce(c.latency <= latency_slo_ms, true) THEN 'latency' END))))"""
        ),
    ).drop("_assessed", "_catalog")
    return settle(done, ["effective_privacy", "needed_capabilities", "assessed"])


def score(assessed: DataFrame) -> DataFrame:
    """Adds ``ranked``: eligible configurations, best first, with score parts and Pareto mark."""
    weights = F.create_map(
        *[x for k, w in OBJECTIVE_WEIGHTS.items() for x in (F.lit(k), F.array(*map(F.lit, w)))]
    )
    eligible = assessed.withColumn("_eligible", F.expr("filter(assessed, c -> size(c.rejected_by) = 0)"))
    top = lambda field: F.expr(
        f"array_max(transform(_eligible, c -> c.{field}))"
    )
    normal = eligible.withColumns(
        {
            "_weights": F.coalesce(F.try_element_at(weights, F.col("objective")), F.element_at(weights, F.lit("balanced"))),
            "_max_cost": F.when(top("cost") == 0, F.lit(1.0)).otherwise(top("cost")),
            "_max_latency": F.when(top("latency") == 0, F.lit(1.0)).otherwise(top("latency")),
            "_front": mark_pareto("_eligible"),
        }
    )
    parts = normal.withColumn(
        "_parts",
        F.expr(
            """transform(_eligible, (c, i) -> named_struct(
                'c', c, 'pareto_efficient', _front[i],
                'quality_part', _weights[0] * c.quality,
                'cost_part', _weights[1] * (1 - c.cost / _max_cost),
                'latency_part', _weights[2] * (1 - c.latency / _max_latency),
                'risk', CASE WHEN c.evidence.source_type = 'provider_documentation' THEN 0.04D ELSE 0.10D END,
                'penalty', c.prior_uncertainty * (0.04D + 0.04D * uncertainty),
                'feedback', CASE WHEN try_element_at(feedback, c.configuration_id).applied
                                 THEN try_element_at(feedback, c.configuration_id) END))"""
        ),
    )
    ranked = parts.withColumn(
        "ranked",
        F.expr(
            """transform(array_sort(transform(_parts, p -> named_struct(
                   'neg_score', -(p.quality_part + p.cost_part + p.latency_part - p.risk - p.penalty
                                  + coalesce(p.feedback.score_adjustment, 0D)),
                   'cost', p.c.cost, 'id', p.c.configuration_id, 'p', p))),
               s -> named_struct(
                   'configuration_id', s.id, 'provider', s.p.c.provider, 'deployment', s.p.c.deployment,
                   'evidence', s.p.c.evidence, 'prior_uncertainty', s.p.c.prior_uncertainty, 'about', s.p.c.about,
                   'quality', s.p.c.quality, 'cost', s.cost, 'latency', s.p.c.latency,
                   'score', -s.neg_score, 'pareto_efficient', s.p.pareto_efficient,
                   'quality_part', s.p.quality_part, 'cost_part', s.p.cost_part,
                   'latency_part', s.p.latency_part, 'risk_part', -s.p.risk, 'uncertainty_part', -s.p.penalty,
                   'feedback_part', s.p.feedback.score_adjustment, 'feedback_support', s.p.feedback.support))"""
        ),
    )
    done = ranked.drop("_eligible", "_weights", "_max_cost", "_max_latency", "_front", "_parts")
    return settle(done, ["ranked"])


def shortlist(ranked: DataFrame, now: Column | None = None) -> DataFrame:
    """Adds ``shortlist`` (at most three picks with flags) and ``status``.

    ``now`` is the time at which the catalog's age is judged; without it no age is given.

    First the best-ranked Pareto row; then the cheapest of the rest; then, if any are left, the
    quality leader of all unless already picked, else the fastest of the rest, local ones first.
    """
    flags = lambda first, pick: (
        f"CASE WHEN {pick}.pareto_efficient THEN array('{first}', 'pareto_front') ELSE array('{first}') END"
    )
    picks = (
        ranked.withColumn("_first", F.expr("get(filter(ranked, c -> c.pareto_efficient), 0)"))
        .withColumn("_rest", F.expr("filter(ranked, c -> c.configuration_id <> _first.configuration_id)"))
        .withColumn(
            "_second",
            F.expr("array_min(transform(_rest, c -> struct(c.cost, -c.quality, c.configuration_id, c))).c"),
        )
        .withColumn("_rest", F.expr("filter(_rest, c -> c.configuration_id <> _second.configuration_id)"))
        .withColumn(
            "_leader",
            F.expr("array_min(transform(ranked, c -> struct(-c.quality, -c.score, c.configuration_id, c))).c"),
        )
        .withColumn("_local", F.expr("filter(_rest, c -> c.deployment = 'local')"))
        .withColumn(
            "_alternative",
            F.expr(
                """array_min(transform(CASE WHEN size(_local) > 0 THEN _local ELSE _rest END,
                     c -> struct(c.latency, -c.quality, c.configuration_id, c))).c"""
            ),
        )
        .withColumn(
            "_guard",
            F.expr(
                """_leader.configuration_id <> _first.configuration_id
                   AND _leader.configuration_id <> _second.configuration_id"""
            ),
        )
    )
    listed = picks.withColumn(
        "_picks",
        F.expr(
            f"""array_compact(array(
                CASE WHEN _first IS NOT NULL THEN named_struct('rank', 1, 'label', 'recommended', 'c', _first,
                    'selection_flags', array('objective_best', 'pareto_front')) END,
                CASE WHEN _second IS NOT NULL THEN named_struct('rank', 2, 'label', 'economical_alternative',
                    'c', _second, 'selection_flags', {flags('lowest_cost', '_second')}) END,
                CASE WHEN size(_rest) > 0 AND _guard THEN named_struct('rank', 3, 'label', 'specialist_alternative',
                    'c', _leader, 'selection_flags', {flags('specialist_recall_guard', '_leader')})
                WHEN size(_rest) > 0 THEN named_struct('rank', 3, 'label', 'privacy_latency_alternative',
                    'c', _alternative, 'selection_flags', {flags('local_or_fast', '_alternative')}) END))"""
        ),
    )
    done = (
        listed.withColumn("_now", (F.lit(None) if now is None else now).cast("timestamp"))
        .withColumn("shortlist", F.expr(_rendered()))
        .withColumn("status", F.when(F.size("shortlist") > 0, "matched").otherwise("no_match"))
        .drop("_first", "_second", "_rest", "_leader", "_local", "_alternative", "_guard", "_picks", "_now")
    )
    return settle(done, ["shortlist", "status"])


def _rendered() -> str:
    """SQL for the shortlist rows with confidence, ranges, contributions, codes and evidence."""
    part = lambda key, value, direction: (
        f"named_struct('key', '{key}', 'value', {value}, 'direction', {direction})"
    )
    gain = lambda v: f"CASE WHEN {v} > 0 THEN 'benefit' ELSE 'neutral' END"
    base = ", ".join(
        [
            part("quality", "p.c.quality_part", "'benefit'"),
            part("cost", "p.c.cost_part", gain("p.c.cost_part")),
            part("latency", "p.c.latency_part", gain("p.c.latency_part")),
            part("evidence_risk", "p.c.risk_part", "'penalty'"),
            part("uncertainty", "p.c.uncertainty_part", "'penalty'"),
        ]
    )
    feedback = part(
        "feedback",
        "p.c.feedback_part",
        "CASE WHEN p.c.feedback_part > 0 THEN 'benefit' WHEN p.c.feedback_part < 0 THEN 'penalty' ELSE 'neutral' END",
    )
    spread = "CASE WHEN p.c.evidence.source_type = 'provider_documentation' THEN 0.04D ELSE 0.08D END"
    return f"""transform(_picks, p -> named_struct(
        'rank', p.rank, 'label', p.label, 'configuration_id', p.c.configuration_id,
        'provider', p.c.provider, 'deployment', p.c.deployment, 'model_id', p.c.about.model_id,
        'display_name', p.c.about.display_name, 'settings', map_from_entries(p.c.about.settings), 'score', p.c.score,
        'pareto_efficient', p.c.pareto_efficient, 'selection_flags', p.selection_flags,
        'confidence', greatest(0.30D, least(0.92D, 0.84D - 0.25D * p.c.prior_uncertainty - 0.20D * uncertainty)),
        'quality', named_struct('low', greatest(0D, p.c.quality - {spread}), 'expected', p.c.quality,
                                'high', least(1D, p.c.quality + {spread}), 'unit', 'score_0_1'),
        'cost', named_struct('low', p.c.cost * 0.75D, 'expected', p.c.cost, 'high', p.c.cost * 1.5D, 'unit', 'usd'),
        'latency', named_struct('low', p.c.latency * 0.65D, 'expected', p.c.latency,
                                'high', p.c.latency * 1.65D, 'unit', 'ms'),
        'contributions', concat(array({base}),
            CASE WHEN p.c.feedback_part IS NULL THEN cast(array() AS
                array<struct<key:string,value:double,direction:string>>) ELSE array({feedback}) END),
        'reason_codes', array(concat('task_prior_', task_family), concat('objective_', objective),
            CASE WHEN p.c.deployment = 'local' THEN 'runs_locally' ELSE concat('meets_', effective_privacy) END),
        'warning_codes', array_compact(array(
            CASE WHEN p.c.about.disclaimer IS NOT NULL THEN 'catalog_disclaimer' END,
            CASE WHEN _now >= p.c.about.expires_at THEN 'catalog_stale'
                 WHEN p.c.about.expires_at > p.c.about.observed_at AND
                      (unix_micros(_now) - unix_micros(p.c.about.observed_at)) * 10
                        >= 7 * (unix_micros(p.c.about.expires_at) - unix_micros(p.c.about.observed_at)) THEN 'catalog_aging' END,
            CASE WHEN p.c.evidence.source_type = 'curated_rule' THEN 'curated_estimate' END)),
        'evidence', concat(array(named_struct('id', p.c.evidence.id, 'title', p.c.evidence.title, 'url', p.c.evidence.url,
                'observed_at', p.c.about.observed_at, 'source_type', p.c.evidence.source_type)),
            CASE WHEN p.c.feedback_part IS NULL
                 THEN cast(array() AS array<struct<id:string,title:string,url:string,observed_at:timestamp,source_type:string>>)
            ELSE array(named_struct('id', concat('local-feedback-', task_family, '-', p.c.configuration_id),
                'title', concat('Local feedback, ', p.c.feedback_support, ' outcomes'), 'url', cast(NULL AS string),
                'observed_at', _now, 'source_type', 'user_feedback')) END)))"""


def recommend(profiled: DataFrame, catalog: DataFrame, now: Column | None = None) -> DataFrame:
    """Profiled requests to shortlists; requests nothing fits get status 'no_match'."""
    return shortlist(score(assess(profiled, catalog)), now)
