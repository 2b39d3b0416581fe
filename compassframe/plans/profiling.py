"""Queries over the profiler, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from compassframe.functions import lexicon as L
from compassframe.functions import profile as P
from compassframe.functions import text as X
from compassframe.operators import evaluation as E
from compassframe.plans.inputs import PROMPTS_SQL, prompts, quote, spread, table

_W = r"\p{L}\p{N}_"
_S = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def _marked_pattern(term: str) -> str:
    """RE2 pattern of a term in a text whose words are wrapped in \\x01 and \\x02."""
    words = []
    for part in term.split(" "):
        words.append("-".join(rf"\x01{w}\x02" for w in part.split("-")))
    return "(?i)" + rf"[{_S}]+".join(words)


def _term_rows() -> str:
    rows = []
    for label, terms in L.TASK_TERMS.items():
        rows += [("task", label, i, w, t) for i, (t, w) in enumerate(terms)]
    for label, terms in L.CAPABILITY_TERMS.items():
        rows += [("capability", label, i, 0.0, t) for i, t in enumerate(terms)]
    rows += [("verb", t, i, 0.0, t) for i, t in enumerate(L.OPERATION_VERBS)]
    return ", ".join(
        f"('{k}', '{lab}', {i}, {w}::DOUBLE, {quote(_marked_pattern(t))})" for k, lab, i, w, t in rows
    )


_NEG = (
    rf"(?i)(?:no|not|never|without|avoid|skip|disable|exclude|do[{_S}]+not|don['’]t)"
    rf"(?:[^{_W}]+[{_W}]+){{0,3}}[^{_W}]*$"
)

LEXICON_SQL = f"""lexicon(kind, label, rank, weight, pattern) AS (VALUES {_term_rows()}),
marked AS (
  SELECT request_id, prompt, regexp_replace(prompt, '([{_W}]+)', chr(1) || '\\1' || chr(2), 'g') AS t2 FROM prompts),
found AS (
  SELECT request_id, kind, label, rank, weight,
         regexp_extract_all(t2, pattern) AS ms, string_split_regex(t2, pattern) AS parts
  FROM marked, lexicon WHERE regexp_matches(t2, pattern)),
placed AS (
  SELECT request_id, kind, label, rank, weight, unnest(list_transform(range(1, len(ms) + 1), lambda i:
           right(replace(replace(array_to_string(list_transform(range(1, i + 1), lambda j:
             parts[j] || CASE WHEN j < i THEN ms[j] ELSE '' END), ''), chr(1), ''), chr(2), ''), 48))) AS prefix
  FROM found),
hits AS (
  SELECT request_id, kind, label, rank, weight,
         regexp_matches(regexp_extract(prefix, '[^.,;:!?\\n]*$'), {quote(_NEG)}) AS negated
  FROM placed),
families(label, priority) AS (VALUES {', '.join(f"('{f}', {L.TASK_PRIORITY.index(f)})" for f in L.TASK_TERMS)}),
scored AS (
  SELECT p.request_id, f.label, f.priority,
         coalesce((SELECT list_reduce(list(h.weight ORDER BY h.rank), lambda a, b: a + b) FROM hits h
                   WHERE h.request_id = p.request_id AND h.kind = 'task' AND h.label = f.label AND NOT h.negated), 0.0::DOUBLE) AS score
  FROM prompts p, families f),
ordered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, priority) AS place FROM scored),
choice AS (
  SELECT request_id, max(CASE WHEN place = 1 THEN score END) AS best_score,
         max(CASE WHEN place = 2 THEN score END) AS second_score,
         max(CASE WHEN place = 1 THEN CASE WHEN score = 0 THEN 'general' ELSE label END END) AS task_family,
         count(*) FILTER (WHERE score >= 1.5) AS active_tasks,
         list('secondary_task_' || label ORDER BY place) FILTER (WHERE place IN (2, 3) AND score >= 1.5) AS secondary
  FROM ordered GROUP BY request_id),
counted AS (
  SELECT p.request_id,
         count(*) FILTER (WHERE h.kind <> 'verb' AND h.negated) AS negated_matches,
         count(DISTINCT h.label) FILTER (WHERE h.kind = 'verb') AS operation_count,
         list_sort(list_distinct(list_concat(['text'],
           coalesce(list(h.label) FILTER (WHERE h.kind = 'capability' AND NOT h.negated), [])))) AS capabilities
  FROM prompts p LEFT JOIN hits h USING (request_id) GROUP BY p.request_id)"""


def tokens_sql(source: str, keep: str, text: str) -> str:
    """CTE 'tokens' with low, expected, high."""
    edge = f"(?:^|[^{_W}])(?:def|class|function|SELECT|FROM|import)(?:[^{_W}]|$)"
    return f"""measured AS (
  SELECT {keep}, {text} AS t, length({text}) AS chars,
         len(regexp_extract_all({text}, '[^{_S}]+')) AS words,
         length({text}) - length(translate({text}, '{{}}[]();:=<>/\\', '')) AS punct,
         length(regexp_replace({text}, '[\\x00-\\x7f]+', '', 'g')) AS non_ascii,
         ({text} LIKE '%```%' OR regexp_matches({text}, '{edge}')) AS code
  FROM {source}),
estimated AS (
  SELECT {keep}, t, chars,
         CASE WHEN chars = 0 THEN 0 ELSE greatest(1,
           ceil(words * CASE WHEN code THEN 1.45::DOUBLE ELSE 1.30::DOUBLE END),
           ceil(chars / CASE WHEN non_ascii / greatest(1, chars)::DOUBLE > 0.15::DOUBLE THEN 2.6::DOUBLE
                             WHEN code THEN 3.2::DOUBLE ELSE 3.8::DOUBLE END)) + ceil(punct / 12.0::DOUBLE) END AS e
  FROM measured),
tokens AS (
  SELECT {keep}, t, chars,
         CASE WHEN e = 0 THEN 1 ELSE greatest(1, floor(e * 0.82::DOUBLE)) END::INT AS low,
         CASE WHEN e = 0 THEN 1 ELSE e END::INT AS expected,
         CASE WHEN e = 0 THEN 1 ELSE greatest(e, ceil(e * 1.30::DOUBLE + 8)) END::INT AS high
  FROM estimated)"""


def _flag_sql() -> str:
    edge_l, edge_r = f"(?:^|[^{_W}])", f"(?:[^{_W}]|$)"
    patterns = [
        ("api_key_like", rf"(?i){edge_l}(?:sk|key|token)[-_][A-Za-z0-9_-]{{11,}}[A-Za-z0-9_]{edge_r}"),
        ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
        ("email", rf"(?i)(?:^|[^{_W}]|[{_W}])[A-Z0-9._%+-]*[A-Z0-9_]?[A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{{2,}}{edge_r}"),
        ("aws_access_key", rf"{edge_l}(?:AKIA|ASIA)[A-Z0-9]{{16}}{edge_r}"),
        ("github_token", rf"{edge_l}gh[pousr]_[A-Za-z0-9]{{20,}}{edge_r}"),
        ("bearer_token", rf"(?i){edge_l}Bearer[{_S}]+[A-Za-z0-9._~+/-]{{19,}}[A-Za-z0-9_]{edge_r}"),
        ("us_ssn_like", rf"{edge_l}\p{{Nd}}{{3}}-\p{{Nd}}{{2}}-\p{{Nd}}{{4}}{edge_r}"),
    ]
    cases = ", ".join(f"CASE WHEN regexp_matches(prompt, {quote(p)}) THEN '{n}' END" for n, p in patterns)
    return f"flags AS (SELECT request_id, list_filter([{cases}], lambda x: x IS NOT NULL) AS privacy_flags FROM prompts)"


_HARD = " + ".join(f"(contains(lower(prompt), {quote(m)}))::INT" for m in L.HARD_MARKERS)
PROFILE_SQL = f"""{LEXICON_SQL},
{tokens_sql('prompts', 'request_id', 'prompt')},
{_flag_sql()},
shape AS (
  SELECT request_id, {_HARD} AS hard_markers,
         len(regexp_extract_all(prompt, '(?m)^[{_S}]*(?:[-*]|\\p{{Nd}}+[.)])[{_S}]+'))
         + (length(prompt) - length(replace(prompt, '```', ''))) // 3
         + least(3, (length(prompt) - length(replace(prompt, chr(10) || chr(10), ''))) // 2) AS structure_markers,
         length(regexp_replace(prompt, '^[{_S}]+|[{_S}]+$', '', 'g')) AS stripped
  FROM prompts),
joined AS (
  SELECT *, list_sort(CASE WHEN high > 24000 THEN list_append(capabilities, 'long_context') ELSE capabilities END) AS required_capabilities,
         (best_score - second_score) / greatest(best_score, 1.0::DOUBLE) AS margin
  FROM choice JOIN counted USING (request_id) JOIN tokens USING (request_id) JOIN flags USING (request_id) JOIN shape USING (request_id)),
profiles AS (
  SELECT *, hard_markers * 2 + least(operation_count, 4) + least(structure_markers, 4)
            + greatest(0, len(required_capabilities) - 2) + greatest(0, active_tasks - 1) AS complexity,
         least(1.0::DOUBLE, 0.10::DOUBLE
           + CASE WHEN best_score = 0 THEN 0.50::DOUBLE WHEN second_score > 0 AND margin < 0.20::DOUBLE THEN 0.30::DOUBLE
                  WHEN second_score > 0 AND margin < 0.45::DOUBLE THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
           + CASE WHEN stripped < 28 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
           + CASE WHEN negated_matches > 0 THEN least(0.15::DOUBLE, 0.04::DOUBLE * negated_matches) ELSE 0.0::DOUBLE END) AS uncertainty,
         list_filter(list_concat(['boundary_lexical_profile',
           CASE WHEN best_score = 0 THEN 'unknown_task_family' WHEN second_score > 0 AND margin < 0.20::DOUBLE THEN 'multiple_task_signals'
                WHEN second_score > 0 AND margin < 0.45::DOUBLE THEN 'secondary_task_signal' END,
           CASE WHEN stripped < 28 THEN 'short_prompt' END,
           CASE WHEN negated_matches > 0 THEN 'negated_requirement_detected' END],
           CASE WHEN active_tasks > 1 THEN secondary ELSE [] END,
           [CASE WHEN high >= greatest(64, expected * 1.2::DOUBLE) THEN 'conservative_token_estimate' END,
            CASE WHEN len(privacy_flags) > 0 THEN 'sensitive_content_detected' END]), lambda x: x IS NOT NULL) AS reason_codes
  FROM joined)"""
_DIFFICULTY = """CASE WHEN high > 3000 OR complexity >= 8 THEN 'high' WHEN high > 650 OR complexity >= 4 THEN 'medium' ELSE 'low' END"""


def _profiled(spark, sf):
    return P.profile(prompts(spark, sf))


def token_range(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])
    return P.with_token_range(docs, "text").select(
        "doc_id", "tokens.low", "tokens.expected", "tokens.high", X.length_band(F.length("text")).alias("length_band")
    )


def task_scores(spark, sf):
    rows = P.with_lexicon(prompts(spark, sf).withColumn("_n", X.nfkc(F.col("prompt"))), "_n")
    return rows.select(
        "request_id",
        *[X.round8(F.get("task_scores", F.lit(i)).score).alias(f) for i, f in enumerate(L.TASK_TERMS)],
    )


def task_choice(spark, sf):
    return _profiled(spark, sf).select(
        "request_id", "task_family", X.round8(F.col("best_score")).alias("best_score"),
        X.round8(F.col("second_score")).alias("second_score"), F.col("active_tasks").cast("bigint").alias("active_tasks"),
    )


def negation_counts(spark, sf):
    rows = P.with_lexicon(prompts(spark, sf).withColumn("_n", X.nfkc(F.col("prompt"))), "_n")
    return rows.select("request_id", F.col("negated_matches").cast("bigint").alias("negated_matches"),
                       F.col("operation_count").cast("bigint").alias("operation_count"))


def capabilities(spark, sf):
    return _profiled(spark, sf).select("request_id", F.array_join("required_capabilities", ",").alias("capabilities"))


def privacy_flags(spark, sf):
    flags = P.privacy_flags(X.nfkc(F.col("prompt")))
    return prompts(spark, sf).select("request_id", F.array_join(flags, ",").alias("privacy_flags"))


def difficulty_uncertainty(spark, sf):
    return _profiled(spark, sf).select(
        "request_id", "difficulty", F.col("complexity").cast("bigint").alias("complexity"),
        X.round8(F.col("uncertainty")).alias("uncertainty"), F.array_join("reason_codes", ",").alias("reason_codes"),
        F.col("estimated_input_tokens").alias("estimated_input_tokens"),
    )


def classifier_report(spark, sf):
    report = E.classifier_report(_profiled(spark, sf), "expected_family", "task_family")
    return report.select(
        "label", "support", "predicted", "true_positive",
        *[X.round8(F.col(c)).alias(c) for c in ("precision", "recall", "f1")],
    )


#: Tasks for each core, or each partition of the input: a prompt is profiled in several forms.
VARIANT_TASKS = 16
VARIANTS = {
    "case": lambda t: F.upper(t),
    "outer_whitespace": lambda t: F.concat(F.lit("  \n"), t, F.lit(" \t ")),
    "line_endings": lambda t: F.replace(t, F.lit("\n"), F.lit("\r\n")),
    "collapsed_whitespace": lambda t: F.regexp_replace(t, rf"[{L.SPACE}]+", " "),
    "nfkc_equivalent": lambda t: X.nfkc(t),
}


def variant_stability(spark, sf):
    """Share of prompts whose task and capabilities survive each rewriting; one pass, no join.

    A rewriting that leaves the text as it is has the profile of the prompt, so it is not profiled again.
    """
    variants = F.array(*[F.struct(F.lit(k).alias("variant"), f(F.col("prompt")).alias("v")) for k, f in VARIANTS.items()])
    base = P.choice(prompts(spark, sf, VARIANT_TASKS).select("prompt")).select(
        "prompt", F.col("task_family").alias("f0"), F.col("required_capabilities").alias("c0"))
    rows = base.withColumn("_v", F.explode(variants)).select(
        "f0", "c0", "_v.variant", F.when(F.col("_v.v") != F.col("prompt"), F.col("_v.v")).alias("rewritten"))
    same = (F.col("task_family") == F.col("f0")) & (F.col("required_capabilities") == F.col("c0"))
    stable = F.col("rewritten").isNull() | same
    return P.choice(rows, "rewritten").groupBy("variant").agg(
        F.count("*").alias("prompts"), X.round8(F.avg(stable.cast("double"))).alias("stability")
    )


QUERIES = {
    "token_range": token_range,
    "task_scores": task_scores,
    "task_choice": task_choice,
    "negation_counts": negation_counts,
    "capabilities": capabilities,
    "privacy_flags": privacy_flags,
    "difficulty_uncertainty": difficulty_uncertainty,
    "classifier_report": classifier_report,
    "variant_stability": variant_stability,
}

ORACLES = {
    "token_range": f"""WITH {tokens_sql('documents', 'doc_id', 'text')}
SELECT doc_id, low, expected, high, CASE WHEN chars < 128 THEN 'lt_128' WHEN chars < 512 THEN '128_511'
       WHEN chars < 2048 THEN '512_2047' ELSE 'gte_2048' END AS length_band FROM tokens""",
    "task_scores": f"""WITH {PROMPTS_SQL}, {LEXICON_SQL}
SELECT request_id, {', '.join(f"round(max(CASE WHEN label = '{f}' THEN score END), 8) AS {f}" for f in L.TASK_TERMS)}
FROM scored GROUP BY request_id""",
    "task_choice": f"""WITH {PROMPTS_SQL}, {LEXICON_SQL}
SELECT request_id, task_family, round(best_score, 8) AS best_score, round(second_score, 8) AS second_score, active_tasks FROM choice""",
    "negation_counts": f"""WITH {PROMPTS_SQL}, {LEXICON_SQL} SELECT request_id, negated_matches, operation_count FROM counted""",
    "capabilities": f"""WITH {PROMPTS_SQL}, {PROFILE_SQL}
SELECT request_id, array_to_string(required_capabilities, ',') AS capabilities FROM profiles""",
    "privacy_flags": f"""WITH {PROMPTS_SQL}, {_flag_sql()}
SELECT request_id, array_to_string(privacy_flags, ',') AS privacy_flags FROM flags""",
    "difficulty_uncertainty": f"""WITH {PROMPTS_SQL}, {PROFILE_SQL}
SELECT request_id, {_DIFFICULTY} AS difficulty, complexity, round(uncertainty, 8) AS uncertainty,
       array_to_string(reason_codes, ',') AS reason_codes, high AS estimated_input_tokens FROM profiles""",
    "classifier_report": f"""WITH {PROMPTS_SQL}, {LEXICON_SQL},
pairs AS (SELECT expected_family AS e, task_family AS p FROM prompts JOIN choice USING (request_id)),
labels_ AS (SELECT e AS label FROM pairs UNION SELECT p FROM pairs),
counts AS (SELECT label, (SELECT count(*) FROM pairs WHERE e = label) AS support, (SELECT count(*) FROM pairs WHERE p = label) AS predicted,
  (SELECT count(*) FROM pairs WHERE e = label AND p = label) AS true_positive FROM labels_),
rates AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE true_positive / predicted::DOUBLE END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE true_positive / support::DOUBLE END AS recall FROM counts)
SELECT label, support, predicted, true_positive, round(precision, 8) AS precision, round(recall, 8) AS recall,
  round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 8) AS f1 FROM rates""",
    "variant_stability": f"""WITH {PROMPTS_SQL.replace('prompts AS (', 'base AS (', 1)},
prompts AS (
  SELECT request_id || '#base' AS request_id, prompt FROM base
  UNION ALL SELECT request_id || '#case', upper(prompt) FROM base
  UNION ALL SELECT request_id || '#outer_whitespace', '  ' || chr(10) || prompt || ' ' || chr(9) || ' ' FROM base
  UNION ALL SELECT request_id || '#line_endings', replace(prompt, chr(10), chr(13) || chr(10)) FROM base
  UNION ALL SELECT request_id || '#collapsed_whitespace', regexp_replace(prompt, '[{_S}]+', ' ', 'g') FROM base
  UNION ALL SELECT request_id || '#nfkc_equivalent', prompt FROM base),
{PROFILE_SQL},
parts AS (SELECT split_part(request_id, '#', 1) AS id, split_part(request_id, '#', 2) AS variant, task_family, required_capabilities FROM profiles)
SELECT v.variant, count(*) AS prompts, round(avg((v.task_family = b.task_family AND v.required_capabilities = b.required_capabilities)::INT), 8) AS stability
FROM parts v JOIN parts b ON b.id = v.id AND b.variant = 'base' WHERE v.variant <> 'base' GROUP BY v.variant""",
}
