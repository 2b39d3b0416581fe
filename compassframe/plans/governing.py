"""Queries over feedback, retention, catalogs, vectors and rate limits, and their SQL twins.

Events play the part of feedback: the user is the profile, the event's props choose the task, its id the
configuration, its type the outcome.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from compassframe.functions.text import round8
from compassframe.operators import catalog as C
from compassframe.operators import feedback as FB
from compassframe.operators import ratelimit as RL
from compassframe.operators import retention as RT
from compassframe.operators import vectors as VE
from compassframe.plans.inputs import spread, table

TASKS = ["agent", "code", "extraction", "reasoning", "research", "summarization", "writing"]
CONFIGS = ["cfg-0", "cfg-1", "cfg-2"]
NOW = "2024-02-01 00:00:00"
DIMENSIONS = 64


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def _events(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.withColumn("m", F.col("event_id") % 3)


def _receipts(spark, sf):
    """One receipt per event id; its shortlist leaves out one configuration on some events."""
    e = _events(spark, sf)
    full = F.array(*map(F.lit, CONFIGS))
    return e.select(
        F.concat(F.lit("rec-"), "event_id").alias("recommendation_id"),
        (F.col("ts") - F.expr("INTERVAL 5 MINUTES")).alias("created_at"), F.lit("v1").alias("catalog_version"),
        _pick(TASKS, F.col("k") % 7).alias("task_family"),
        F.when(F.col("k") % 3 == 0, "low").otherwise("medium").alias("difficulty"),
        F.col("user_id").cast("string").alias("feedback_profile_id"),
        F.when(F.col("k") % 13 == 4, F.slice(full, 1, 2)).otherwise(full).alias("selected_configuration_ids"),
    )


def _feedback(spark, sf):
    """Feedback rows; ids divisible by 10 with k % 5 = 1 point at the receipt before, making duplicates.

    Some lack a required field.
    """
    e = _events(spark, sf)
    k, m = F.col("k"), F.col("m")
    target = F.when((F.col("event_id") % 10 == 0) & (k % 5 == 1) & (F.col("event_id") > 0), F.col("event_id") - 1).otherwise(
        F.when(k == 77, F.lit(-1)).otherwise(F.col("event_id"))
    )
    used = k % 17 != 6
    return e.select(
        F.concat(F.lit("fb-"), "event_id").alias("feedback_id"),
        F.concat(F.lit("rec-"), target).alias("recommendation_id"), F.col("ts").alias("recorded_at"),
        F.struct(
            F.when(k != 41, used).alias("used_recommendation"),
            F.when(used & (k % 19 != 2), _pick(CONFIGS, m)).alias("used_configuration_id"),
            F.when(k == 53, F.lit(None)).when(F.col("event_type") == "error", "did_not_work")
            .when(F.col("event_type") == "view", "unknown").otherwise("worked").alias("outcome"),
            F.when(k % 29 == 3, 6).otherwise((k % 5 + 1).cast("int")).alias("quality_rating"),
            F.col("value").alias("observed_cost_usd"), k.cast("int").alias("observed_latency_ms"),
            F.when(k % 11 == 3, _pick(CONFIGS, (m + k) % 3)).alias("preferred_over_configuration_id"),
        ).alias("payload"),
    )


def _accepted(spark, sf):
    return FB.validate(_feedback(spark, sf), _receipts(spark, sf)).where(F.col("rejected").isNull()).drop("rejected")


def _usable(spark, sf):
    return FB.usable_events(_accepted(spark, sf))


def feedback_rejects(spark, sf):
    rows = FB.validate(_feedback(spark, sf), _receipts(spark, sf))
    return rows.select("feedback_id", "recommendation_id", "rejected")


def feedback_signals(spark, sf):
    return signal_columns(FB.signals(_usable(spark, sf)))


def signal_columns(signals):
    return signals.select(
        "feedback_profile_id", "task_family", "configuration_id", "support", "successes", "applied",
        round8(F.col("posterior_success")).alias("posterior_success"),
        round8(F.col("score_adjustment")).alias("score_adjustment"),
    )


def feedback_replay(spark, sf):
    r = FB.replay(_usable(spark, sf), minimum_support=3)
    return r.select(
        "feedback_profile_id", "event_count", "training_count", "holdout_count",
        round8(F.col("baseline_brier")).alias("baseline_brier"), round8(F.col("candidate_brier")).alias("candidate_brier"),
        "bias_guard_passed", "decision",
    )


def feedback_export(spark, sf):
    x = FB.export_feedback(_accepted(spark, sf), _receipts(spark, sf))
    return x.select(
        "feedback_id", "recommendation_id", "feedback_profile_id", "task_family", "difficulty", "catalog_version",
        F.array_join("selected_configuration_ids", ",").alias("selected"), F.col("payload.outcome").alias("outcome"),
    )


def feedback_history(spark, sf):
    """The newest hundred accepted feedback rows."""
    return FB.newest(_accepted(spark, sf), "recorded_at", "feedback_id").select("feedback_id", "recommendation_id")


def feedback_delete(spark, sf):
    """Receipts and their derived feedback flag after all 'unknown' outcomes were deleted, per task."""
    kept = _accepted(spark, sf)
    doomed = kept.where(F.col("payload.outcome") == "unknown").select("feedback_id")
    left = RT.delete_feedback(kept, doomed)
    flagged = RT.with_feedback_received(_receipts(spark, sf), left)
    return flagged.groupBy("task_family", "feedback_received").agg(F.count("*").alias("n"))


def _promotion_log(spark, sf):
    """Audit entries from events: what a replay decided, or a rollback."""
    e = _events(spark, sf)
    decision = _pick(["promoted", "unchanged", "rejected", "insufficient_data", "rolled_back"], F.col("k") % 5)
    return e.select(
        F.concat(F.lit("promo-"), "event_id").alias("promotion_id"), F.col("ts").alias("created_at"),
        F.col("user_id").cast("string").alias("feedback_profile_id"), decision.alias("decision"),
        F.concat(F.lit("bayes-v"), F.col("m")).alias("policy_version"),
    )


def personalisation_state(spark, sf):
    return FB.personalization_state(_promotion_log(spark, sf))


def retention_purge(spark, sf):
    """Rows a purge of everything older than 1,200 days (counted from 2001) removes, per table."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    receipts = orders.select(F.col("o_orderkey").alias("recommendation_id"), F.col("o_orderdate").alias("created_at"))
    feedback = lines.select(F.col("l_orderkey").alias("recommendation_id"), F.col("l_shipdate").alias("recorded_at"))
    runs = orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderdate").alias("created_at"))
    promotions = lines.where(F.col("l_returnflag") == "R").select(F.col("l_shipdate").alias("created_at"))
    limit = RT.cutoff(F.lit("2001-01-01 00:00:00").cast("timestamp"), 1200)
    return RT.purge_counts(receipts, feedback, runs, promotions, limit)


def token_bucket(spark, sf):
    """Rate-limit decisions for all events as writes of their users, 2 per minute."""
    writes = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return RL.token_bucket(writes, "user_id", "ts", "event_id", 2).select("event_id", "allowed", "retry_after")


def token_bucket_shared(spark, sf):
    """The same for all writes of one event type sharing a bucket of 3 per minute: long busy runs."""
    writes = table(spark, sf, "events").select("event_type", "event_id", "ts")
    return RL.token_bucket(writes, "event_type", "ts", "event_id", 3).select("event_id", "allowed", "retry_after")


def _part_catalog(spark, sf):
    """A catalog per brand with one configuration per part, defects decided by the part's fields."""
    p = table(spark, sf, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    quality = F.when(k % 41 == 3, F.create_map(F.lit("code"), F.lit(0.5))).otherwise(
        F.create_map(F.lit("general"), F.when(k % 43 == 5, 1.2).otherwise(s / F.lit(50.0)))
    )
    caps = F.when(k % 47 == 6, F.array(F.lit("text"), F.lit("text"))).otherwise(F.array(F.lit("text"), F.lit("code")))
    return p.select(
        F.col("p_brand").alias("catalog_version"), (F.length("p_brand") * 10 + 1).cast("bigint").alias("sequence"),
        F.lit("2024-01-01").cast("timestamp").alias("observed_at"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.element_at(F.split("p_brand", "#"), 2).cast("int") * 4 + 1).cast("timestamp").alias("expires_at"),
        F.when(k % 37 == 2, F.lit("Bad Id")).otherwise(F.concat(F.lit("cfg-"), F.when(k % 53 == 7, F.lit(0)).otherwise(k))).alias("configuration_id"),
        F.element_at(F.split("p_name", " "), 1).alias("provider"), F.col("p_name").alias("model_id"), F.col("p_name").alias("display_name"),
        F.when(s % 2 == 0, "hosted").otherwise("local").alias("deployment"),
        F.when(k % 59 == 8, 0).otherwise(s * 1000).cast("bigint").alias("context_window"), caps.alias("capabilities"),
        F.array(F.lit("standard"), F.when(k % 61 == 9, "secret").otherwise("no_training")).alias("privacy"),
        F.when(k % 67 == 10, -1.0).otherwise(F.col("p_retailprice") / 1000).alias("input_usd_per_million"),
        (F.col("p_retailprice") / 500).alias("output_usd_per_million"), F.when(k % 71 == 11, 0.0).otherwise(s * 10.0).alias("latency_ms"),
        quality.alias("quality"),
        F.struct(
            F.lit("ev").alias("id"), F.lit("t").alias("title"),
            F.concat(F.when(k % 73 == 12, "http").otherwise("https"), F.lit("://catalog.invalid/")).alias("url"),
            F.lit("curated_rule").alias("source_type"),
        ).alias("evidence"),
        F.when(k % 79 == 13, 1.5).otherwise(0.2).alias("prior_uncertainty"),
    )


def catalog_violations(spark, sf):
    v = C.configuration_violations(_part_catalog(spark, sf))
    return v.groupBy("catalog_version", "rule").agg(F.count("*").alias("n"))


def catalog_summary(spark, sf):
    s = C.summarize(_part_catalog(spark, sf), F.lit(NOW).cast("timestamp"))
    return s.select("catalog_version", F.array_join("providers", ",").alias("providers"), "configuration_count", "freshness_status")


def _version_log(spark, sf):
    """Catalog imports from orders: a customer is a catalog, the order number the time of arrival."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("catalog_id"), F.col("o_orderkey").alias("arrival"),
        (F.col("o_orderkey") % 1009 + 1).alias("sequence"), F.col("o_orderdate").alias("observed_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1500 DAYS")).alias("expires_at"), "o_orderstatus",
    )


_LOG_NOW = "2000-06-01 00:00:00"


def version_acceptance(spark, sf):
    log = C.accept_versions(_version_log(spark, sf), F.lit(_LOG_NOW).cast("timestamp"), bucket_width=4000)
    return log.select("catalog_id", "arrival", "trusted_sequence", "decision")


def active_catalog(spark, sf):
    """Active version per catalog; orders of status P are rollbacks, the others accepted imports."""
    log = _version_log(spark, sf).select(
        "catalog_id", "arrival",
        F.when(F.col("o_orderstatus") == "P", "rollback").otherwise("import").alias("action"),
        F.concat(F.lit("v"), "arrival").alias("catalog_version"),
    )
    return C.active_versions(log, bucket_width=4000)


def nearest_prototype(spark, sf):
    """Prototypes are the label means over all vectors; every vector is then classified."""
    rows = spread(table(spark, sf, "embeddings"), ["vec_id"])
    book = VE.prototype_book(VE.prototypes(rows, "embedding", "label", DIMENSIONS), "label")
    near = VE.nearest_prototype(rows, "embedding", book, DIMENSIONS)
    return near.select("vec_id", "label", "predicted", F.round("confidence", 5).alias("confidence"))


def assessor_merge(spark, sf):
    """Raw assessor answers built from events and labels, some malformed, merged into plain profiles."""
    e = _events(spark, sf)
    k, m = F.col("k"), F.col("m")
    conf = F.col("value") / 100 - F.floor(F.col("value") / 100)
    answer = F.to_json(
        F.struct(
            _pick([*TASKS, "unheard_of"], k % 8).alias("task_family"),
            _pick(["low", "medium", "high", "uncertain"], k % 4).alias("difficulty"),
            F.when(k % 31 == 4, F.array(F.lit("telepathy"))).otherwise(F.array(F.lit("text"), _pick(["code", "vision", "tools"], m))).alias("required_capabilities"),
            F.array(_pick(["email", "private_key"], k % 2)).alias("privacy_flags"), conf.alias("confidence"),
            F.array(F.lit("semantic_match"), F.lit("base")).alias("reason_codes"),
        )
    )
    raw = F.when(k % 10 == 3, "not-json").when(k % 10 == 4, F.lit(None)).when(k % 10 == 5, F.concat(F.lit("Sure: "), answer, F.lit(" ok"))).otherwise(answer)
    rows = e.select(
        "event_id", raw.alias("assessment"), _pick(["always", "auto", "off"], F.col("user_id") % 3).alias("assessor_mode"),
        _pick(TASKS, F.col("user_id") % 7).alias("task_family"), _pick(["low", "medium", "high"], m).alias("difficulty"),
        F.array(F.lit("text"), F.lit("reasoning")).alias("required_capabilities"), F.array().cast("array<string>").alias("privacy_flags"),
        (k / 100.0).alias("uncertainty"), F.array(F.lit("base"), F.lit("short_prompt")).alias("reason_codes"),
    )
    return VE.merge(rows).select(
        "event_id", "assessor_status", "task_family", "difficulty",
        F.array_join(F.array_sort("required_capabilities"), ",").alias("required_capabilities"),
        F.array_join("privacy_flags", ",").alias("privacy_flags"), F.array_join("reason_codes", ",").alias("reason_codes"),
        F.round("uncertainty", 6).alias("uncertainty"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        feedback_rejects, feedback_signals, feedback_replay, feedback_export, feedback_history, feedback_delete,
        personalisation_state, retention_purge, token_bucket, token_bucket_shared, catalog_violations, catalog_summary,
        version_acceptance, active_catalog, nearest_prototype, assessor_merge,
    )
}

_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_EV = "e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 3 AS m FROM events)"
_FEEDBACK_SQL = f"""WITH {_EV},
receipts AS (SELECT 'rec-' || event_id AS rid, ts, {_list(TASKS)}[k % 7 + 1] AS task_family, CASE WHEN k % 3 = 0 THEN 'low' ELSE 'medium' END AS difficulty,
  user_id::VARCHAR AS profile, CASE WHEN k % 13 = 4 THEN {_list(CONFIGS[:2])} ELSE {_list(CONFIGS)} END AS selected FROM e),
fb AS (SELECT 'fb-' || event_id AS feedback_id, 'rec-' || CASE WHEN event_id % 10 = 0 AND k % 5 = 1 AND event_id > 0 THEN event_id - 1 WHEN k = 77 THEN -1 ELSE event_id END AS rid,
  ts AS recorded_at, CASE WHEN k <> 41 THEN k % 17 <> 6 END AS used, CASE WHEN k % 17 <> 6 AND k % 19 <> 2 THEN {_list(CONFIGS)}[m + 1] END AS cfg,
  CASE WHEN k = 53 THEN NULL ELSE CASE event_type WHEN 'error' THEN 'did_not_work' WHEN 'view' THEN 'unknown' ELSE 'worked' END END AS outcome,
  CASE WHEN k % 29 = 3 THEN 6 ELSE k % 5 + 1 END AS rating, CASE WHEN k % 11 = 3 THEN {_list(CONFIGS)}[(m + k) % 3 + 1] END AS other, value FROM e),
judged AS (SELECT fb.*, r.selected, CASE WHEN used IS NULL THEN 'missing_used_recommendation' WHEN outcome IS NULL THEN 'missing_outcome' WHEN used AND cfg IS NULL THEN 'used_without_configuration' WHEN NOT used AND cfg IS NOT NULL THEN 'configuration_without_use'
  WHEN other IS NOT NULL AND cfg IS NULL THEN 'pairwise_without_used' WHEN other IS NOT DISTINCT FROM cfg THEN 'pairwise_same_configuration'
  WHEN rating > 5 THEN 'quality_rating_range' WHEN value < 0 THEN 'negative_observation' WHEN r.rid IS NULL THEN 'unknown_recommendation'
  WHEN cfg IS NOT NULL AND NOT list_contains(selected, cfg) THEN 'used_not_in_shortlist'
  WHEN other IS NOT NULL AND NOT list_contains(selected, other) THEN 'preferred_not_in_shortlist' END AS problem FROM fb LEFT JOIN receipts r ON r.rid = fb.rid),
placed AS (SELECT *, row_number() OVER (PARTITION BY rid, problem IS NULL ORDER BY recorded_at, feedback_id) AS place FROM judged),
final AS (SELECT *, coalesce(problem, CASE WHEN place > 1 THEN 'duplicate_feedback' END) AS rejected FROM placed),
accepted AS (SELECT * FROM final WHERE rejected IS NULL),
usable AS (SELECT a.feedback_id, a.recorded_at, r.profile, r.task_family, a.cfg, a.outcome = 'worked' AS ok
  FROM accepted a JOIN receipts r ON r.rid = a.rid WHERE used AND cfg IS NOT NULL AND outcome IN ('worked', 'did_not_work'))"""


def _bucket_sql(key: str, per_minute: int) -> str:
    c = f"{per_minute}::DOUBLE"
    return f"""WITH RECURSIVE w AS (SELECT event_id, {key} AS k, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events),
b AS (
  SELECT k, n, event_id, us, {c} - 1 AS tokens, true AS allowed, 0::DOUBLE AS lack FROM w WHERE n = 1
  UNION ALL
  SELECT k, n, event_id, us, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1, CASE WHEN t >= 1 THEN 0::DOUBLE ELSE 1 - t END FROM (
    SELECT w.k, w.n, w.event_id, w.us, least({c}, b.tokens + (w.us - b.us) / 1000000::DOUBLE * ({c} / 60)) AS t FROM b JOIN w ON w.k = b.k AND w.n = b.n + 1))
SELECT event_id, allowed, CASE WHEN allowed THEN 0 ELSE greatest(1, round_even(lack / ({c} / 60), 0)) END::INT AS retry_after FROM b"""


_PART_SQL = """parts AS (SELECT p_brand AS v, p_partkey AS k, p_size AS s, p_retailprice AS price, split_part(p_name, ' ', 1) AS provider,
  CASE WHEN p_partkey % 37 = 2 THEN 'Bad Id' ELSE 'cfg-' || CASE WHEN p_partkey % 53 = 7 THEN 0 ELSE p_partkey END END AS id, split_part(p_brand, '#', 2)::INT AS b FROM part)"""

ORACLES = {
    "feedback_rejects": f"{_FEEDBACK_SQL} SELECT feedback_id, rid AS recommendation_id, rejected FROM final",
    "feedback_signals": f"""{_FEEDBACK_SQL},
g AS (SELECT profile, (8 + sum(ok::INT)) / (10 + count(*))::DOUBLE AS rate FROM usable GROUP BY profile),
c AS (SELECT profile, task_family, cfg, count(*) AS n, sum(ok::INT) AS s FROM usable GROUP BY ALL),
p AS (SELECT c.*, rate, (10 * rate + s) / (10 + n)::DOUBLE AS post FROM c JOIN g USING (profile))
SELECT profile AS feedback_profile_id, task_family, cfg AS configuration_id, n AS support, s::BIGINT AS successes, n >= 5 AS applied, round(post, 8) AS posterior_success,
  CASE WHEN n >= 5 THEN round(greatest(-0.04::DOUBLE, least(0.04::DOUBLE, (post - rate) * 0.35::DOUBLE * least(1, n / 20::DOUBLE))), 8) ELSE 0 END AS score_adjustment FROM p""",
    "feedback_replay": f"""{_FEEDBACK_SQL},
o AS (SELECT *, count(*) OVER (PARTITION BY profile) AS n, row_number() OVER (PARTITION BY profile ORDER BY recorded_at DESC, feedback_id DESC) AS back FROM usable),
x AS (SELECT *, n >= 10 AND back <= greatest(2, n // 5) AS held FROM o),
b AS (SELECT profile, (8 + sum(ok::INT)) / (10 + count(*))::DOUBLE AS base, count(*) AS tn FROM x WHERE NOT held GROUP BY profile),
t AS (SELECT profile, task_family, cfg, count(*) AS n1, sum(ok::INT) AS s1 FROM x WHERE NOT held GROUP BY ALL),
h AS (SELECT x.profile, x.task_family, ok::INT::DOUBLE AS y, base, CASE WHEN n1 >= 3 THEN (10 * base + s1) / (10 + n1)::DOUBLE ELSE base END AS cand
  FROM x JOIN b USING (profile) LEFT JOIN t USING (profile, task_family, cfg) WHERE held),
s AS (SELECT profile, task_family, avg((base - y) * (base - y)) AS be, avg((cand - y) * (cand - y)) AS ce FROM h GROUP BY ALL),
r AS (SELECT profile, count(*) AS hn, avg((base - y) * (base - y)) AS be, avg((cand - y) * (cand - y)) AS ce FROM h GROUP BY profile),
q AS (SELECT profile, bool_and(ce <= be + 0.005::DOUBLE) AS guard FROM s GROUP BY profile),
n AS (SELECT profile, count(*) AS ec FROM x GROUP BY profile)
SELECT profile AS feedback_profile_id, ec AS event_count, CASE WHEN ec >= 10 THEN tn ELSE 0 END AS training_count, coalesce(hn, 0) AS holdout_count,
  round(r.be, 8) AS baseline_brier, round(r.ce, 8) AS candidate_brier, coalesce(guard, false) AS bias_guard_passed,
  CASE WHEN ec < 10 THEN 'insufficient_data' WHEN r.ce <= r.be + 0.005::DOUBLE AND guard THEN CASE WHEN r.ce < r.be - 1e-12 THEN 'promoted' ELSE 'unchanged' END ELSE 'rejected' END AS decision
FROM n LEFT JOIN b USING (profile) LEFT JOIN r USING (profile) LEFT JOIN q USING (profile)""",
    "feedback_export": f"""{_FEEDBACK_SQL}
SELECT feedback_id, a.rid AS recommendation_id, profile AS feedback_profile_id, task_family, difficulty, 'v1' AS catalog_version,
  array_to_string(r.selected, ',') AS selected, outcome FROM accepted a JOIN receipts r ON r.rid = a.rid""",
    "feedback_history": f"{_FEEDBACK_SQL} SELECT feedback_id, rid AS recommendation_id FROM accepted ORDER BY recorded_at DESC, feedback_id DESC LIMIT 100",
    "feedback_delete": f"""{_FEEDBACK_SQL}
SELECT task_family, r.rid IN (SELECT rid FROM accepted WHERE outcome <> 'unknown') AS feedback_received, count(*) AS n FROM receipts r GROUP BY ALL""",
    "personalisation_state": f"""WITH {_EV},
l AS (SELECT user_id::VARCHAR AS p, ts, 'promo-' || event_id AS id, ['promoted', 'unchanged', 'rejected', 'insufficient_data', 'rolled_back'][k % 5 + 1] AS d, 'bayes-v' || m AS v FROM e),
c AS (SELECT p, arg_max(d, (ts, id)) AS d, arg_max(v, (ts, id)) AS v FROM l WHERE d IN ('promoted', 'unchanged', 'rolled_back') GROUP BY p)
SELECT l.p AS feedback_profile_id, count(*) AS audit_entries, coalesce(any_value(c.d) <> 'rolled_back', false) AS personalization_enabled,
  CASE WHEN any_value(c.d) <> 'rolled_back' THEN any_value(c.v) END AS policy_version FROM l LEFT JOIN c ON c.p = l.p GROUP BY l.p""",
    "retention_purge": """WITH cut AS (SELECT TIMESTAMP '2001-01-01' - INTERVAL 1200 DAY AS t)
SELECT 'feedback' AS "table", count(*) AS deleted FROM lineitem, cut WHERE l_shipdate < t
UNION ALL SELECT 'receipts', count(*) FROM orders, cut WHERE o_orderdate < t AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= t)
UNION ALL SELECT 'benchmarks', count(*) FROM orders, cut WHERE o_orderpriority = '1-URGENT' AND o_orderdate < t
UNION ALL SELECT 'promotions', count(*) FROM lineitem, cut WHERE l_returnflag = 'R' AND l_shipdate < t""",
    "token_bucket": _bucket_sql("user_id", 2),
    "token_bucket_shared": _bucket_sql("event_type", 3),
    "catalog_violations": f"""WITH {_PART_SQL},
r AS (SELECT v, id, unnest(list_filter([CASE WHEN k % 37 = 2 THEN 'configuration_id_format' END, CASE WHEN k % 59 = 8 THEN 'context_window_range' END,
  CASE WHEN k % 47 = 6 THEN 'capabilities_unique' END, CASE WHEN k % 61 = 9 THEN 'privacy_value' END, CASE WHEN k % 67 = 10 THEN 'input_price_range' END,
  CASE WHEN k % 71 = 11 THEN 'latency_range' END, CASE WHEN k % 41 = 3 THEN 'quality_general_missing' END, CASE WHEN k % 41 <> 3 AND k % 43 = 5 THEN 'quality_range' END,
  CASE WHEN k % 73 = 12 THEN 'evidence_https' END, CASE WHEN k % 79 = 13 THEN 'prior_uncertainty_range' END], lambda x: x IS NOT NULL)) AS rule FROM parts
 UNION ALL SELECT v, id, 'configuration_id_unique' FROM parts GROUP BY v, id HAVING count(*) > 1
 UNION ALL SELECT v, NULL, 'configuration_count' FROM parts GROUP BY v HAVING count(*) > 500)
SELECT v AS catalog_version, rule, count(*) AS n FROM r GROUP BY v, rule""",
    "catalog_summary": f"""WITH {_PART_SQL}, f AS (SELECT v, b, count(*) AS n, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers FROM parts GROUP BY v, b)
SELECT v AS catalog_version, providers, n AS configuration_count, CASE WHEN 31 >= b * 4 + 1 THEN 'stale' WHEN 31 / (b * 4 + 1)::DOUBLE >= 0.7::DOUBLE THEN 'aging' ELSE 'fresh' END AS freshness_status FROM f""",
    "version_acceptance": f"""WITH l AS (SELECT o_custkey AS c, o_orderkey AS a, o_orderkey % 1009 + 1 AS s, o_orderdate AS ob, o_orderdate + INTERVAL 1500 DAY AS ex FROM orders),
v AS (SELECT *, ob <= TIMESTAMP '{_LOG_NOW}' + INTERVAL 24 HOUR AS early, ex > TIMESTAMP '{_LOG_NOW}' AS live FROM l),
t AS (SELECT *, greatest(1, coalesce(max(CASE WHEN early AND live THEN s END) OVER (PARTITION BY c ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS mark FROM v)
SELECT c AS catalog_id, a AS arrival, mark AS trusted_sequence, CASE WHEN s <= mark THEN 'sequence_not_newer' WHEN NOT early THEN 'observed_in_future' WHEN NOT live THEN 'expired' ELSE 'accepted' END AS decision FROM t""",
    "active_catalog": """WITH RECURSIVE l AS (SELECT o_custkey AS c, o_orderkey AS a, o_orderstatus = 'P' AS rb, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
s AS (
  SELECT c, n, CASE WHEN NOT rb THEN 'v' || a END AS act, NULL::VARCHAR AS prev FROM l WHERE n = 1
  UNION ALL
  SELECT l.c, l.n, CASE WHEN NOT rb THEN 'v' || a WHEN s.act IS NULL THEN NULL WHEN s.prev IS NOT NULL THEN s.prev ELSE NULL END,
    CASE WHEN NOT rb THEN s.act WHEN s.act IS NULL THEN s.prev WHEN s.prev IS NOT NULL THEN s.act ELSE NULL END
  FROM s JOIN l ON l.c = s.c AND l.n = s.n + 1)
SELECT c AS catalog_id, coalesce(arg_max_null(act, n), 'builtin') AS active_version FROM s GROUP BY c""",
    "nearest_prototype": f"""WITH d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
p AS (SELECT label, i, avg(x) AS m FROM d GROUP BY ALL), pn AS (SELECT label, sqrt(sum(m * m)) AS nrm FROM p GROUP BY label),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM d GROUP BY vec_id),
s AS (SELECT d.vec_id, any_value(d.label) AS label, p.label AS proto, sum(d.x / vn.nrm * p.m / pn.nrm) AS score FROM d JOIN vn USING (vec_id) JOIN p ON p.i = d.i JOIN pn ON pn.label = p.label GROUP BY d.vec_id, p.label),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, proto DESC) AS pos FROM s)
SELECT vec_id, any_value(label) AS label, max(CASE WHEN pos = 1 THEN proto END) AS predicted,
  round(least(0.9::DOUBLE, 0.55::DOUBLE + 5 * (max(CASE WHEN pos = 1 THEN score END) - max(CASE WHEN pos = 2 THEN score END))), 5) AS confidence FROM r GROUP BY vec_id""",
    "assessor_merge": f"""WITH {_EV},
a AS (SELECT *, ['always', 'auto', 'off'][user_id % 3 + 1] AS mode, value / 100 - floor(value / 100) AS conf, k / 100.0::DOUBLE AS u, {_list([*TASKS, 'unheard_of'])}[k % 8 + 1] AS fam,
  ['low', 'medium', 'high', 'uncertain'][k % 4 + 1] AS diff, {_list(TASKS)}[user_id % 7 + 1] AS fam0, ['low', 'medium', 'high'][m + 1] AS diff0 FROM e),
s AS (SELECT *, CASE WHEN mode = 'off' THEN 'disabled' WHEN NOT (mode = 'always' OR u >= 0.55::DOUBLE) THEN 'not_needed' WHEN k % 10 = 4 THEN 'unavailable'
  WHEN k % 10 = 3 OR fam = 'unheard_of' OR k % 31 = 4 THEN 'invalid_output' ELSE 'completed' END AS status FROM a)
SELECT event_id, status AS assessor_status, CASE WHEN status = 'completed' AND conf >= 0.65::DOUBLE AND u >= 0.45::DOUBLE THEN fam ELSE fam0 END AS task_family,
  CASE WHEN status = 'completed' AND (CASE diff WHEN 'low' THEN 0 WHEN 'high' THEN 2 ELSE 1 END) > (CASE diff0 WHEN 'low' THEN 0 WHEN 'high' THEN 2 ELSE 1 END) THEN diff ELSE diff0 END AS difficulty,
  CASE WHEN status = 'completed' THEN ['code,reasoning,text', 'reasoning,text,vision', 'reasoning,text,tools'][m + 1] ELSE 'reasoning,text' END AS required_capabilities,
  CASE WHEN status = 'completed' THEN ['email', 'private_key'][k % 2 + 1] ELSE '' END AS privacy_flags,
  CASE WHEN status = 'completed' THEN 'base,short_prompt,semantic_match' ELSE 'base,short_prompt' END AS reason_codes,
  round(CASE WHEN status = 'completed' THEN least(u, 1 - conf) ELSE u END, 6) AS uncertainty FROM s""",
}
