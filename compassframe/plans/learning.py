"""Queries of the strength learner over labelled battles, and their SQL twins with every round written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from compassframe.functions.barrier import settle
from compassframe.functions.text import stable_split
from compassframe.operators import evaluation as E
from compassframe.operators import learner as L
from compassframe.plans import acquiring, evaluating
from compassframe.session import written

SALT = "compassframe-strength-v1|"
SPLITS = ("train", "validation", "hidden_test")
#: The needs-strong probabilities at which a sweep sends a prompt to the strong model.
THRESHOLDS = [0.3, 0.4, 0.45, 0.5, 0.55, 0.6]


def _examples(spark, sf):
    """Usable battles: does the prompt need the strong model?"""
    usable = acquiring._labelled_battles(spark, sf).where("problem IS NULL")
    rows = settle(usable.withColumn("_tokens", L.tokens_of(F.col("prompt"))), ["_tokens"])
    return written(rows.select(
        "id", (F.col("label") == "strong").cast("int").alias("label"),
        stable_split(F.col("id").cast("string"), SALT, SPLITS).alias("split"), L.token_features(F.col("_tokens")).alias("features"),
    ), "strength")


def _predicted(spark, sf, loss: str = "logistic"):
    examples = _examples(spark, sf)
    model = L.fit(examples.where("split = 'train'"), loss)
    return L.predict(examples, model, ["id", "split", "label"])


def strength_predictions(spark, sf):
    return _predicted(spark, sf).select("id", "split", "label", F.round("probability", 6).alias("probability"))


def strength_regression(spark, sf):
    """The same with squared loss, cut to probabilities."""
    return _predicted(spark, sf, "squared").select("id", "split", "label", F.round("probability", 6).alias("probability"))


def strength_calibration(spark, sf):
    """Brier score and calibration error of each split."""
    rows = written(_predicted(spark, sf), "strength-scores")
    out = None
    for split in SPLITS:
        one = E.calibration(rows.where(F.col("split") == split)).select(
            F.lit(split).alias("split"), "rows", F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"))
        out = one if out is None else out.unionByName(one)
    return out


def strength_thresholds(spark, sf):
    """The strong model from each threshold on, the economical one below, over validation prompts with evidence."""
    of = lambda m: F.get(F.filter("observations", lambda o: o.model == m), F.lit(0))
    ev = evaluating._normalized(spark, sf).select(
        "key", of(evaluating.MODELS[-1]).alias("strong"), of(evaluating.MODELS[2]).alias("economical"))
    p = _predicted(spark, sf).where("split = 'validation'").select(
        F.col("id").cast("string").alias("key"), F.round("probability", 6).alias("p"))
    swept = E.threshold_sweep(p.join(ev, "key"), THRESHOLDS, "p", "strong", "economical")
    return evaluating._rounded(swept, ["strong_share", "mean_correctness", "mean_compute"])


QUERIES = {f.__name__: f for f in (strength_predictions, strength_regression, strength_calibration, strength_thresholds)}

_TOKEN_SQL = r"[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)?"


def _bucket(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT % {L.BUCKETS}"


def _rounds_sql(loss: str) -> str:
    """Examples, features and the weights after every round."""
    p = "1 / (1 + exp(-sum(x * w)))" if loss == "logistic" else "sum(x * w)"
    steps = ["w0 AS MATERIALIZED (SELECT DISTINCT j, 0::DOUBLE AS w, 0::DOUBLE AS s FROM tx)"]
    for k in range(1, L.ROUNDS + 1):
        steps.append(f"p{k} AS MATERIALIZED (SELECT id, {p} AS p FROM tx JOIN w{k - 1} USING (j) GROUP BY id)")
        steps.append(f"""g{k} AS (SELECT j, any_value(w) AS w, any_value(s) AS s, sum((p - y) * share * x) +
  CASE WHEN j = {L.BUCKETS} THEN 0 ELSE {L.L2}::DOUBLE * any_value(w) END AS g FROM tx JOIN p{k} USING (id) JOIN w{k - 1} USING (j) GROUP BY j)""")
        steps.append(f"w{k} AS MATERIALIZED (SELECT j, w - {L.RATE}::DOUBLE * g / (sqrt(s + g * g) + {L.EPS}::DOUBLE) AS w, s + g * g AS s FROM g{k})")
    scored = "1 / (1 + exp(-sum(x * coalesce(w, 0))))" if loss == "logistic" else "greatest(0, least(1, sum(x * coalesce(w, 0))))"
    return f"""WITH battle AS MATERIALIZED ({acquiring._BATTLE_ROWS_SQL}),
ex AS MATERIALIZED (SELECT id, (label = 'strong')::INT AS y, ('0x' || substr(sha256('{SALT}' || id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE AS z,
  regexp_extract_all(trim(regexp_replace(replace(lower(prompt), 'ß', 'ss'), '{acquiring._SP}', ' ', 'g')), '{_TOKEN_SQL}') AS t FROM battle WHERE problem IS NULL),
sp AS MATERIALIZED (SELECT id, y, CASE WHEN z < 0.6::DOUBLE THEN 'train' WHEN z < 0.8::DOUBLE THEN 'validation' ELSE 'hidden_test' END AS split FROM ex),
fe AS (SELECT id, {_bucket("'1|' || u")} AS j FROM (SELECT id, unnest(t) AS u FROM ex)
  UNION ALL SELECT id, {_bucket("'2|' || u")} FROM (SELECT id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS u FROM ex)),
co AS (SELECT id, j, count(*) AS c FROM fe GROUP BY ALL),
x AS MATERIALIZED (SELECT id, j, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS x FROM co UNION ALL SELECT id, {L.BUCKETS}, 1.0 FROM ex),
sh AS (SELECT y, 0.5::DOUBLE / count(*) AS share FROM sp WHERE split = 'train' GROUP BY y),
tx AS MATERIALIZED (SELECT id, j, x, y, share FROM x JOIN sp USING (id) JOIN sh USING (y) WHERE split = 'train'),
{', '.join(steps)},
scored AS MATERIALIZED (SELECT id, split, any_value(y) AS y, {scored} AS p FROM x JOIN sp USING (id) LEFT JOIN w{L.ROUNDS} USING (j) GROUP BY id, split)"""


_BINS_SQL = "least(9, floor(p * 10 + 1e-12))"
ORACLES = {
    "strength_predictions": f"{_rounds_sql('logistic')} SELECT id, split, y AS label, round(p, 6) AS probability FROM scored",
    "strength_regression": f"{_rounds_sql('squared')} SELECT id, split, y AS label, round(p, 6) AS probability FROM scored",
    "strength_calibration": f"""{_rounds_sql('logistic')},
b AS (SELECT split, {_BINS_SQL} AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) * (p - y)) AS se FROM scored GROUP BY ALL)
SELECT split, sum(n)::BIGINT AS rows, round(sum(se) / sum(n), 6) AS brier, round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM b GROUP BY split""",
    "strength_thresholds": f"""{_rounds_sql('logistic')}, {evaluating.EVIDENCE_SQL},
pr AS (SELECT id::VARCHAR AS key, round(p, 6) AS p FROM scored WHERE split = 'validation'),
th(threshold) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)})
SELECT threshold, count(*) AS n, round(avg((p >= threshold)::INT), 8) AS strong_share, round(avg(correctness), 8) AS mean_correctness,
  round(avg(compute), 8) AS mean_compute
FROM pr, th JOIN ev ON ev.key = pr.key AND ev.model = CASE WHEN p >= threshold THEN '{evaluating.MODELS[-1]}' ELSE '{evaluating.MODELS[2]}' END GROUP BY threshold""",
}
