"""Queries over acquisition: alignment, completeness, duplicates, overlap, digests; and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from compassframe.functions import text as X
from compassframe.functions.barrier import settle
from compassframe.functions.text import hash60, round8, stable_split
from compassframe.operators import alignment as A
from compassframe.operators import overlap as O
from compassframe.operators.digest import LANES, table_digest
from compassframe.operators.ordered import first_of_group
from compassframe.plans import evaluating as V
from compassframe.plans.inputs import PROMPTS_SQL, prompts, spread, table
from compassframe.sources import evidence as S

SOURCES = ["judge-a", "judge-b", "judge-c", "judge-d"]
SPLIT_SALT = "compassframe-groups-v1|"
SPLITS = ("development", "validation", "hidden_test")


def _documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text", "source"), ["doc_id"])


def _judge(spark, sf, i: int):
    """One judge's copy of all documents; some copies differ in spacing, a few in a visible character."""
    n = F.col("doc_id")
    changed = F.when(F.pmod(n * 5 + i, F.lit(97)) == 11, F.concat("text", F.lit("!"))).when(
        F.pmod(n + i, F.lit(7)) == 3, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")))
    ).otherwise(F.col("text"))
    return _documents(spark, sf).select(
        n.alias("ordinal"), F.concat(F.lit("k"), n).alias("key"), n.cast("string").alias("prompts_id"),
        (changed if i else F.col("text")).alias("original_prompt"),
        (F.pmod(n * 31 + i, F.lit(100)) + 1).alias("actual_token_count"),
        (F.pmod(n + i, F.lit(11)) / F.lit(10.0)).alias("correctness_score"),
    )


def _aligned(spark, sf):
    return A.align(A.tag_sources({s: _judge(spark, sf, i) for i, s in enumerate(SOURCES)}), len(SOURCES))


def source_alignment(spark, sf):
    return _aligned(spark, sf).select(
        "ordinal", "key", "verdict", F.array_join("differing_sources", ",").alias("differing_sources")
    )


def alignment_counts(spark, sf):
    return A.mismatch_counts(_aligned(spark, sf))


def _landed_again(spark, sf):
    """The first judge's copy as a later acquisition lands it, with faults of every kind at some ordinals."""
    n = F.col("ordinal")
    at = lambda m, r: F.pmod(n, F.lit(m)) == r
    later = _judge(spark, sf, 0).select(
        "ordinal",
        F.when(at(101, 9), F.lit("other")).otherwise(F.col("key")).alias("key"),
        F.when(~at(103, 1), F.col("prompts_id")).alias("prompts_id"),
        F.when(at(97, 11), F.concat("original_prompt", F.lit("!")))
        .when(at(7, 3), F.concat(F.lit(" "), "original_prompt")).otherwise(F.col("original_prompt")).alias("original_prompt"),
        (F.col("actual_token_count") + F.when(at(89, 5), 1).otherwise(0)).alias("actual_token_count"),
        F.when(~at(83, 7), F.col("correctness_score")).alias("correctness_score"),
    ).where(~at(107, 2))
    return later.withColumn("_copy", F.explode(F.when(at(109, 3), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy")


def prefix_anchor(spark, sf):
    """Where the first rows of a later acquisition differ from the snapshot of an earlier one.

    The snapshot is the first half of the first judge's ordinals; the later acquisition has all of them.
    """
    half = F.floor(table(spark, sf, "documents").agg(F.max("doc_id")).scalar() / 2)
    snap, later = (
        df.withColumn("fingerprint", X.fingerprint(F.col("original_prompt"))).drop("original_prompt")
        for df in (_judge(spark, sf, 0).where(F.col("ordinal") < half), _landed_again(spark, sf))
    )
    fields = ["key", "prompts_id", "fingerprint", "actual_token_count", "correctness_score"]
    out = A.prefix_mismatches(later, snap, fields, half)
    return out.select("ordinal", F.array_join("differing", ",").alias("differing"))


def _commitments(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("prompts_id"), F.concat(F.lit("k"), "o_custkey").alias("key")
    )


def _line_outcomes(spark, sf):
    """Outcomes from order lines: the line's flag names the model, the order's customer the key."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey"), "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("l_orderkey").alias("prompts_id"),
        F.concat(F.lit("k"), F.when(F.col("l_linenumber") == 7, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))).alias("key"),
        F.concat(F.lit("model-"), "l_returnflag").alias("model"),
    )


def outcome_completeness(spark, sf):
    """How many committed recommendations have complete outcomes, and what the others lack."""
    status = A.complete_outcomes(
        _commitments(spark, sf), _line_outcomes(spark, sf), ["model-A", "model-N", "model-R"]
    )
    return status.groupBy("status").agg(F.count("*").alias("n"))


def identity_join(spark, sf):
    """Orders and first order lines that do not pair up one to one by id and key."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"))
    right = lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("l_orderkey").alias("prompts_id"),
        F.concat(F.lit("k"), F.when(F.col("m") == 6, F.lit(-1)).otherwise(F.col("o_custkey"))).alias("key"),
    )
    return A.identity_mismatches(_commitments(spark, sf), right).groupBy("problem").agg(F.count("*").alias("n"))


def _sides(spark, sf):
    """Documents by their own stable split: development rows are references, all others candidates."""
    docs = _documents(spark, sf).withColumn(
        "split", stable_split(F.col("doc_id").cast("string"), SPLIT_SALT, SPLITS)
    )
    candidates = docs.where(F.col("split") != "development").select(
        F.concat(F.lit("k"), "doc_id").alias("key"), F.col("doc_id").cast("string").alias("prompts_id"),
        F.col("text").alias("original_prompt"),
    )
    references = docs.where(F.col("split") == "development").select(F.col("doc_id").alias("ref_index"), "text", "source")
    return candidates, references


def canonical_dedup(spark, sf):
    rows = O.features(_documents(spark, sf), "text").select("doc_id", "canonical_hash")
    kept = first_of_group(rows, "canonical_hash", "doc_id", "doc_id", "kept", row_id="doc_id")
    return kept.where(F.col("kept") != F.col("doc_id")).select("doc_id", F.col("kept").alias("kept_doc_id"))


def exact_overlap(spark, sf):
    candidates, references = _sides(spark, sf)
    first = O.first_references(O.features(references, "text").drop("text"))
    cand = O.features(candidates, "original_prompt").select("prompts_id", "canonical_hash")
    return O.exact_matches(cand, first).where(F.col("exact_source").isNotNull()).select(
        "prompts_id", F.col("exact_source").alias("reference_source")
    )


def fuzzy_overlap(spark, sf):
    """Every candidate with its exclusion reason; fuzzy ones with the measures of their first match."""
    out = O.screen(*_sides(spark, sf))
    return out.select(
        "key", "prompts_id", "reason", "kept_prompts_id", "reference_source",
        *[round8(F.col(c)).alias(c) for c in ("trigram_jaccard", "trigram_containment", "token_length_ratio")],
    )


def exclusion_counts(spark, sf):
    return O.screen(*_sides(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"))


def benchmark_overlap(spark, sf):
    """Documents screened against all benchmark items and conversation turns, a union of labelled sources."""
    candidates = _documents(spark, sf).select(
        F.concat(F.lit("k"), "doc_id").alias("key"), F.col("doc_id").cast("string").alias("prompts_id"),
        F.col("text").alias("original_prompt"),
    )
    references = table(spark, sf, "benchmark").select(
        (F.col("item_id") * 2).alias("ref_index"), "text", F.lit("benchmark").alias("source")
    ).unionByName(table(spark, sf, "conversations").select(
        ((F.col("conv_id") * 1000 + F.col("turn")) * 2 + 1).alias("ref_index"), "text", F.lit("conversations").alias("source")
    ))
    return O.screen(candidates, references).groupBy("reason", "reference_source").agg(F.count("*").alias("n"))


def shingle_features(spark, sf):
    f = O.features(_documents(spark, sf), "text")
    return f.select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.col("n_shingles").cast("bigint").alias("n_shingles"))


def _landed_battles(spark, sf):
    """Preference rows from orders as they land; prompts come as JSON lists, objects or plain text."""
    o, n = F.col("o_orderkey"), F.col("n")
    orders = spread(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])
    rows = settle(orders.withColumn("n", hash60(F.concat(F.lit("b|"), o.cast("string")))), ["n"])
    body = F.concat(F.lit("order "), o.cast("string"), F.lit(" "), F.col("o_orderpriority"))
    raw = (
        F.when(n % 4 == 0, F.to_json(F.array(body, F.lit("again"))))
        .when(n % 4 == 1, F.to_json(F.array(F.struct(body.alias("content")))))
        .when(n % 97 == 2, F.lit("  "))
        .otherwise(body)
    )
    win = n % 3
    return rows.select(
        F.when(n % 89 == 5, o - 1).otherwise(o).alias("id"),
        F.when(n % 2 == 0, "model-s").otherwise("model-e").alias("model_a"),
        F.when(n % 83 == 7, "model-x").when(n % 2 == 0, "model-e").otherwise("model-s").alias("model_b"),
        raw.alias("raw"),
        (win == 0).cast("int").alias("winner_model_a"), (win == 1).cast("int").alias("winner_model_b"),
        F.when(n % 101 == 9, 1).otherwise((win == 2).cast("int")).alias("winner_tie"),
    )


def _battles(spark, sf):
    """The same with the prompts parsed."""
    return X.with_battle_prompt(_landed_battles(spark, sf), "raw", "prompt").drop("raw")


def _labelled_battles(spark, sf):
    """Battles with problem and label; repeated ids are found in the rows as they land, before prompts are parsed."""
    return A.battle_labels(_battles(spark, sf), ("model-s", "model-e"), ids=_landed_battles(spark, sf).select("id"))


def battle_labels(spark, sf):
    rows = _labelled_battles(spark, sf)
    return rows.select("id", "problem", "label", F.sha2("prompt", 256).alias("prompt_sha256"))


def _raw_evidence(spark, sf):
    """Evidence in interchange form with planted defects, decided by the key's hash."""
    ev = V.evidence(spark, sf)
    d = hash60(F.concat(F.lit("d|"), F.col("key"))) % 211
    entry = F.transform(
        F.filter("observations", lambda o: ~((d == 3) & (o.model == V.MODELS[0]))),
        lambda o: F.struct(
            o.model.alias("k"),
            F.struct(
                F.when((d == 5) & (o.model == V.MODELS[1]), -1).otherwise(o.tokens).cast("bigint").alias("actual_token_count"),
                F.when((d == 7) & (o.model == V.MODELS[2]), 1.5).otherwise(o.correctness).alias("correctness_score"),
            ).alias("v"),
        ),
    )
    return ev.select("key", F.map_from_entries(entry).alias("models"))


def evidence_validation(spark, sf):
    bad = S.evidence_problems(_raw_evidence(spark, sf), V.MODELS, ["key"])
    return bad.select("key", F.array_join("problems", ",").alias("problems"))


def _fingerprinted(spark, sf):
    rows = _documents(spark, sf).select(
        F.concat(F.lit("k"), "doc_id").alias("key"), X.fingerprint(F.col("text")).alias("fingerprint")
    )
    return rows.withColumn("split", stable_split(F.col("fingerprint"), SPLIT_SALT, SPLITS))


def minimised_partition(spark, sf):
    """Per split: rows, digest, and whether its rows are written or only committed to."""
    return S.split_manifest(_fingerprinted(spark, sf))


def table_digests(spark, sf):
    return table_digest(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"], ["o_orderstatus"])


def row_keys(spark, sf):
    """Stable key of every prompt: dataset, revision, id and the prompt's digest."""
    rows = prompts(spark, sf).select("request_id", F.sha2("prompt", 256).alias("d"))
    return rows.select("request_id", X.row_key("conversations", "r1", F.col("request_id"), F.col("d")).alias("row_key"))


QUERIES = {
    f.__name__: f
    for f in (
        source_alignment, alignment_counts, prefix_anchor, outcome_completeness, identity_join, canonical_dedup,
        exact_overlap, fuzzy_overlap, exclusion_counts, benchmark_overlap, shingle_features, battle_labels, evidence_validation,
        minimised_partition, table_digests, row_keys,
    )
}

_SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}\p{C}]+"
def _visible_sql(text: str) -> str:
    return f"sha256(regexp_replace({text}, '{_SP}', '', 'g'))"


_CANON = f"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '{_SP}', ' ', 'g'))"


def _judge_sql(i: int) -> str:
    text = "text" if i == 0 else (
        f"CASE WHEN (doc_id * 5 + {i}) % 97 = 11 THEN text || '!' WHEN (doc_id + {i}) % 7 = 3 THEN '  ' || replace(text, ' ', '  ') ELSE text END"
    )
    return f"SELECT doc_id AS ordinal, '{SOURCES[i]}' AS source, {_visible_sql(text)} AS fp FROM documents"


_ALIGN_SQL = f"""WITH judged AS ({' UNION ALL '.join(_judge_sql(i) for i in range(4))}),
diff AS (SELECT ordinal, list(source ORDER BY source) FILTER (WHERE fp IS NULL OR base IS NULL OR fp <> base) AS sources FROM
  (SELECT *, max(CASE WHEN source = '{SOURCES[0]}' THEN fp END) OVER (PARTITION BY ordinal) AS base FROM judged) GROUP BY ordinal)"""

def _features_sql(rows: str, name: str = "feat") -> str:
    """Features of the rows doc_id, source, text of a table."""
    return f"""{name}_canon AS (SELECT doc_id, source, {_CANON} AS c FROM {rows}),
{name}_tok AS (SELECT doc_id, source, sha256(c) AS h, regexp_extract_all(c, '[\\p{{L}}\\p{{N}}]+(?:[''’-][\\p{{L}}\\p{{N}}]+)?') AS tokens FROM {name}_canon),
{name} AS (SELECT doc_id, source, h, len(tokens) AS nt, CASE WHEN len(tokens) >= 12 THEN list_distinct(list_transform(range(1, len(tokens) - 1), lambda i:
    tokens[i] || chr(1) || tokens[i + 1] || chr(1) || tokens[i + 2])) ELSE [] END AS sh FROM {name}_tok)"""
_FEATURES_SQL = _features_sql("documents")
_SIDES_SQL = f"""WITH {_FEATURES_SQL},
frac AS (SELECT *, ('0x' || substr(sha256('{SPLIT_SALT}' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE AS x FROM feat),
refs AS (SELECT * FROM frac WHERE x < 0.6::DOUBLE), cand AS (SELECT * FROM frac WHERE x >= 0.6::DOUBLE)"""
_SCREEN_TAIL = """,
kept AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS kept_id FROM cand),
exact AS (SELECT k.*, (SELECT arg_min(source, doc_id) FROM refs r WHERE r.h = k.h) AS exact_source FROM kept k WHERE kept_id = doc_id),
post AS (SELECT doc_id AS rid, unnest(sh) AS s FROM refs),
mine AS (SELECT doc_id, unnest(sh) AS s FROM exact WHERE exact_source IS NULL),
pairs AS (SELECT DISTINCT doc_id, rid FROM mine JOIN post USING (s)),
meas AS (SELECT p.doc_id, p.rid, r.source, len(list_intersect(c.sh, r.sh)) AS i, len(c.sh) AS na, len(r.sh) AS nb, c.nt AS ta, r.nt AS tb
  FROM pairs p JOIN cand c ON c.doc_id = p.doc_id JOIN refs r ON r.doc_id = p.rid),
hit AS (SELECT doc_id, rid, source, i / (na + nb - i)::DOUBLE AS j, i / least(na, nb)::DOUBLE AS k, least(ta, tb) / greatest(ta, tb)::DOUBLE AS l FROM meas),
best AS (SELECT * FROM hit WHERE j >= 0.82::DOUBLE OR (k >= 0.92::DOUBLE AND l >= 0.50::DOUBLE) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rid) = 1),
screened AS (
  SELECT 'k' || doc_id AS key, doc_id::VARCHAR AS prompts_id, 'evaluation_exact_duplicate' AS reason, kept_id::VARCHAR AS kept_prompts_id,
         NULL AS reference_source, NULL::DOUBLE AS trigram_jaccard, NULL::DOUBLE AS trigram_containment, NULL::DOUBLE AS token_length_ratio FROM kept WHERE kept_id <> doc_id
  UNION ALL SELECT 'k' || e.doc_id, e.doc_id::VARCHAR, CASE WHEN exact_source IS NOT NULL THEN 'development_exact_overlap' WHEN b.rid IS NOT NULL THEN 'development_fuzzy_overlap' ELSE 'eligible' END,
         NULL, coalesce(exact_source, b.source), round(j, 8), round(k, 8), round(l, 8) FROM exact e LEFT JOIN best b ON b.doc_id = e.doc_id)"""
_SCREEN_SQL = _SIDES_SQL + _SCREEN_TAIL
_BENCH_SQL = f"""WITH references_ AS (SELECT item_id * 2 AS doc_id, 'benchmark' AS source, text FROM benchmark
  UNION ALL SELECT (conv_id * 1000 + turn) * 2 + 1, 'conversations', text FROM conversations),
{_features_sql('documents', 'cand')}, {_features_sql('references_', 'refs')}{_SCREEN_TAIL}"""

_bh = "('0x' || substr(md5('b|' || o_orderkey), 1, 15))::BIGINT"
_BATTLE_ROWS_SQL = f"""SELECT id, prompt, problem, CASE WHEN problem IS NULL THEN CASE win WHEN 0 THEN 'strong' WHEN 1 THEN 'economical' ELSE 'tie' END END AS label FROM (
WITH h AS (SELECT *, {_bh} AS n, 'order ' || o_orderkey || ' ' || o_orderpriority AS body FROM orders),
b AS (SELECT CASE WHEN n % 89 = 5 THEN o_orderkey - 1 ELSE o_orderkey END AS id,
  CASE WHEN n % 83 = 7 THEN false ELSE true END AS pair_ok,
  CASE WHEN n % 4 = 0 THEN body || chr(10) || 'again' WHEN n % 4 = 1 THEN body WHEN n % 97 = 2 THEN '' ELSE body END AS prompt, n % 3 AS win,
  (n % 3 <> 2 AND n % 101 = 9) AS two FROM h),
p AS (SELECT *, CASE WHEN NOT pair_ok THEN 'model_pair' WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate_id' WHEN two THEN 'winner_indicators'
  WHEN prompt = '' THEN 'empty_prompt' END AS problem FROM b)
SELECT * FROM p)"""
_BATTLE_SQL = f"SELECT id, problem, label, sha256(prompt) AS prompt_sha256 FROM ({_BATTLE_ROWS_SQL})"


def _digest_sql(source: str, columns: str, group: str) -> str:
    lanes = ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR AS l{i}" for i in range(LANES))
    joined = " || '|' || ".join(["rows::VARCHAR", *[f"l{i}" for i in range(LANES)]])
    return f"""SELECT {group}, rows, sha256({joined}) AS digest FROM (
  SELECT {group}, count(*) AS rows, {lanes} FROM (SELECT {group}, sha256({columns}) AS h FROM {source}) GROUP BY {group})"""


ORACLES = {
    "source_alignment": f"""{_ALIGN_SQL}
SELECT ordinal, 'k' || ordinal AS key, CASE WHEN sources IS NULL THEN 'aligned' ELSE 'text_mismatch' END AS verdict,
  coalesce(array_to_string(sources, ','), '') AS differing_sources FROM diff""",
    "alignment_counts": f"{_ALIGN_SQL} SELECT source, count(*) AS text_mismatches FROM (SELECT unnest(sources) AS source FROM diff) GROUP BY source",
    "prefix_anchor": f"""WITH first AS (SELECT doc_id AS d, text FROM documents WHERE doc_id < (SELECT max(doc_id) // 2 FROM documents)),
later AS (SELECT d, CASE WHEN d % 97 = 11 THEN text || '!' WHEN d % 7 = 3 THEN ' ' || text ELSE text END AS again, text FROM first),
found AS (SELECT d AS ordinal, CASE WHEN d % 107 = 2 THEN 'missing_in_source' WHEN d % 109 = 3 THEN 'repeated' ELSE concat_ws(',',
  CASE WHEN d % 101 = 9 THEN 'key' END, CASE WHEN d % 103 = 1 THEN 'prompts_id' END,
  CASE WHEN {_visible_sql('again')} IS DISTINCT FROM {_visible_sql('text')} THEN 'fingerprint' END,
  CASE WHEN d % 89 = 5 THEN 'actual_token_count' END, CASE WHEN d % 83 = 7 THEN 'correctness_score' END) END AS differing FROM later)
SELECT * FROM found WHERE differing <> ''""",
    "outcome_completeness": """WITH o AS (SELECT l_orderkey AS id, 'k' || CASE WHEN l_linenumber = 7 THEN o_custkey + 1 ELSE o_custkey END AS key, l_returnflag AS m, o_custkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT id, bool_or(key <> 'k' || o_custkey) AS bad_key, count(*) AS n, count(DISTINCT m) AS models FROM o GROUP BY id)
SELECT CASE WHEN s.id IS NULL THEN 'no_outcomes' WHEN bad_key THEN 'key_mismatch' WHEN n > models THEN 'repeated_model' WHEN models < 3 THEN 'incomplete' ELSE 'complete' END AS status, count(*) AS n
FROM orders LEFT JOIN s ON s.id = o_orderkey GROUP BY 1""",
    "identity_join": """WITH r AS (SELECT l_orderkey AS id, max(l_linenumber) AS m FROM lineitem GROUP BY 1),
j AS (SELECT CASE WHEN r.id IS NULL THEN 'left_only' WHEN m = 6 THEN 'key_differs' END AS problem FROM orders LEFT JOIN r ON r.id = o_orderkey)
SELECT problem, count(*) AS n FROM j WHERE problem IS NOT NULL GROUP BY problem""",
    "canonical_dedup": f"""WITH {_FEATURES_SQL}
SELECT doc_id, kept AS kept_doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS kept FROM feat) WHERE kept <> doc_id""",
    "exact_overlap": f"""{_SIDES_SQL}
SELECT c.doc_id::VARCHAR AS prompts_id, arg_min(r.source, r.doc_id) AS reference_source FROM cand c JOIN refs r USING (h) GROUP BY c.doc_id""",
    "fuzzy_overlap": f"{_SCREEN_SQL} SELECT * FROM screened",
    "benchmark_overlap": f"{_BENCH_SQL} SELECT reason, reference_source, count(*) AS n FROM screened GROUP BY ALL",
    "exclusion_counts": f"{_SCREEN_SQL} SELECT reason, count(*) AS n FROM screened GROUP BY reason",
    "shingle_features": f"WITH {_FEATURES_SQL} SELECT doc_id, nt AS n_tokens, len(sh) AS n_shingles FROM feat",
    "battle_labels": _BATTLE_SQL,
    "evidence_validation": """WITH d AS (SELECT o_orderkey::VARCHAR AS key, ('0x' || substr(md5('d|' || o_orderkey), 1, 15))::BIGINT % 211 AS d FROM orders)
SELECT key, CASE d WHEN 3 THEN 'candidate_mismatch' WHEN 5 THEN 'negative_tokens' ELSE 'score_range' END AS problems FROM d WHERE d IN (3, 5, 7)""",
    "minimised_partition": f"""WITH f AS (SELECT 'k' || doc_id AS key, {_visible_sql('text')} AS fp FROM documents),
s AS (SELECT key, fp, ('0x' || substr(sha256('{SPLIT_SALT}' || fp), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE AS x FROM f),
t AS (SELECT key, fp, CASE WHEN x < 0.6::DOUBLE THEN 'development' WHEN x < 0.8::DOUBLE THEN 'validation' ELSE 'hidden_test' END AS split FROM s),
g AS ({_digest_sql('t', "key || chr(0) || fp || chr(0)", 'split')})
SELECT split, rows, digest, split <> 'hidden_test' AS persisted FROM g""",
    "table_digests": _digest_sql(
        "orders", "o_orderkey::VARCHAR || chr(0) || o_custkey || chr(0) || o_orderpriority || chr(0)", "o_orderstatus"
    ),
    "row_keys": f"""WITH {PROMPTS_SQL}
SELECT request_id, sha256('conversations|r1|' || request_id || '|' || sha256(prompt)) AS row_key FROM prompts""",
}
