"""Queries that verify landed data: ordered digests, files, pages and quoted files; and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from compassframe.operators import merkle as M
from compassframe.plans.inputs import spread, table
from compassframe.session import ensure_checkpoint_dir
from compassframe.sources import evidence as S
from compassframe.sources import filetree as T
from compassframe.sources import quoted_csv as Q

_PAYLOAD = ["o_custkey", "o_orderpriority"]


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", *_PAYLOAD)


def _swapped(spark, sf):
    """The orders with two neighbours' keys exchanged: those whose key ends in 700 and 701."""
    key = F.when(F.col("o_orderkey") % 1000 == 700, F.col("o_orderkey") + 1).when(
        F.col("o_orderkey") % 1000 == 701, F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey"))
    return _orders(spark, sf).withColumn("o_orderkey", key)


def merkle_digests(spark, sf):
    return M.ordered_digest(_orders(spark, sf), "o_orderkey", _PAYLOAD, ["o_orderstatus"])


def merkle_differences(spark, sf):
    """The first range in which exchanged order keys show, for each status, and the number of such ranges."""
    trees = [M.tree(f(spark, sf), "o_orderkey", _PAYLOAD, ["o_orderstatus"]) for f in (_orders, _swapped)]
    return M.first_difference(*trees, ["o_orderstatus"])


def _folder(spark, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Order keys of one written file; bytes of a range of its tree.
FILE_KEYS, FILE_RANGE = 5_000, 16_384


def file_trees(spark, sf):
    """Orders written as text files of FILE_KEYS keys, and each file's size and root."""
    path = _folder(spark, "orders-text")
    rows = _orders(spark, sf).select(
        F.expr(f"o_orderkey div {FILE_KEYS}").alias("part"), "o_orderkey", F.concat_ws("|", "o_orderkey", *_PAYLOAD).alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "value").write.partitionBy("part").text(path)
    found = T.file_roots(spark, path, FILE_RANGE)
    return found.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint").alias("part"), "size", "ranges", "root")


#: What stands for NULL in a quoted file; values that begin with its first character get another one in front.
CSV_NULL, CSV_MARK = "\\N", "\\"


def quoted_csv(spark, sf):
    """Documents written as quoted CSV and read back record by record from many blocks."""
    path = _folder(spark, "documents-csv")
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "source"), ["doc_id"])
    marked = lambda c: F.when(F.startswith(c, F.lit(CSV_MARK)), F.concat(F.lit(CSV_MARK), c)).otherwise(F.col(c))
    bare = lambda c: F.when(F.startswith(c, F.lit(CSV_MARK)), F.substr(c, F.lit(2))).otherwise(F.col(c))
    docs.withColumns({c: marked(c) for c in ("text", "source")}).write.options(
        header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue=CSV_NULL).csv(path)
    back = Q.read_csv(spark, path, ["doc_id", "text", "source"], null=CSV_NULL)
    return back.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(bare("text"), 256).alias("text_sha256"), bare("source").alias("source"))


def _pages(spark, sf):
    """Pages of 100 orders; some never landed, some landed short, some twice."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("at"))
    pages = orders.groupBy(F.expr("at div 100").alias("page")).agg(F.count("*").alias("n")).where("page % 37 <> 5")
    pages = pages.select((F.col("page") * 100).alias("offset"), F.when(F.col("page") % 43 == 3, F.col("n") - 7).when(
        F.col("page") % 53 == 9, F.col("n") + 5).otherwise(F.col("n")).alias("n"), F.col("page"))
    return pages.select("offset", "n", F.explode(F.sequence(F.lit(0), F.when(F.col("page") % 41 == 7, 1).otherwise(0)))).drop("col")


def page_coverage(spark, sf):
    end = table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]
    return S.page_coverage(_pages(spark, sf), end + 251)


def pages_to_fetch(spark, sf):
    return S.pages_to_fetch(page_coverage(spark, sf))


QUERIES = {f.__name__: f for f in (merkle_digests, merkle_differences, file_trees, quoted_csv, page_coverage, pages_to_fetch)}


def _tree_sql(source: str, name: str, levels: int = 4) -> str:
    """Nodes of all levels; a group that has one node keeps it."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN chr(1) ELSE chr(2) || {c} END || chr(0)"
    out = [f"""{name}0 AS MATERIALIZED (SELECT g, k, leaf, sha256(leaf || '|' || count(*)) AS digest, count(*)::BIGINT AS rows FROM (
  SELECT o_orderstatus AS g, o_orderkey AS k, sha256({" || ".join(part(c) for c in ("o_orderkey", *_PAYLOAD))}) AS leaf FROM {source}) GROUP BY g, k, leaf)"""]
    for n in range(1, levels + 1):
        zeros = "0" * (M.DIGITS * n)
        out.append(f"""{name}r{n} AS MATERIALIZED (SELECT *, last_value(CASE WHEN substr(leaf, 1, {len(zeros)}) = '{zeros}' THEN {{'k': k, 'leaf': leaf}} END IGNORE NULLS)
  OVER (PARTITION BY g ORDER BY k, leaf ROWS UNBOUNDED PRECEDING) AS run, count(*) OVER (PARTITION BY g) AS n FROM {name}{n - 1})""")
        out.append(f"""{name}{n} AS MATERIALIZED (SELECT g, arg_min(k, (k, leaf)) AS k, arg_min(leaf, (k, leaf)) AS leaf, CASE WHEN any_value(n) = 1 THEN any_value(digest)
  ELSE sha256(string_agg(digest, '' ORDER BY k, leaf) || '|' || sum(rows)::BIGINT) END AS digest, sum(rows)::BIGINT AS rows FROM {name}r{n} GROUP BY g, run)""")
    return ",\n".join(out)


_SWAPPED_SQL = """(SELECT * REPLACE (CASE o_orderkey % 1000 WHEN 700 THEN o_orderkey + 1 WHEN 701 THEN o_orderkey - 1 ELSE o_orderkey END AS o_orderkey) FROM orders)"""
_PAGES_SQL = """WITH p AS (SELECT o_orderkey // 100 AS page, count(*) AS n FROM orders GROUP BY 1),
landed AS (SELECT page * 100 AS first, page * 100 + CASE WHEN page % 43 = 3 THEN n - 7 WHEN page % 53 = 9 THEN n + 5 ELSE n END AS last, page % 41 = 7 AS twice
  FROM p WHERE page % 37 <> 5),
w AS (SELECT max(o_orderkey) + 251 AS e FROM orders),
c AS (SELECT *, coalesce(max(last) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered FROM landed, w),
faults AS (SELECT 'missing' AS problem, covered AS first, least(first, e) AS last FROM c WHERE first > covered
  UNION ALL SELECT 'overlap', first, least(covered, last) FROM c WHERE first < covered
  UNION ALL SELECT 'repeated', first, last FROM c WHERE twice
  UNION ALL SELECT 'beyond', greatest(first, e), last FROM c WHERE last > e
  UNION ALL SELECT 'missing', max(last), any_value(e) FROM c HAVING max(last) < any_value(e))"""
ORACLES = {
    "merkle_digests": f"WITH {_tree_sql('orders', 't')} SELECT g AS o_orderstatus, rows, digest FROM t4",
    "merkle_differences": f"""WITH {_tree_sql('orders', 'a', 1)}, {_tree_sql(_SWAPPED_SQL, 'b', 1)},
a AS (SELECT g, run, sha256(string_agg(digest, '' ORDER BY k, leaf)) AS d, min(k) AS lo, max(k) AS hi, sum(rows)::BIGINT AS rows FROM ar1 GROUP BY g, run),
b AS (SELECT g, run, sha256(string_agg(digest, '' ORDER BY k, leaf)) AS d, min(k) AS lo, max(k) AS hi, sum(rows)::BIGINT AS rows FROM br1 GROUP BY g, run),
x AS (SELECT coalesce(a.g, b.g) AS g, least(a.lo, b.lo) AS first, greatest(a.hi, b.hi) AS last, coalesce(a.rows, 0) AS left_rows, coalesce(b.rows, 0) AS right_rows
  FROM a FULL JOIN b ON a.g IS NOT DISTINCT FROM b.g AND a.run IS NOT DISTINCT FROM b.run WHERE a.d IS DISTINCT FROM b.d)
SELECT g AS o_orderstatus, count(*) AS ranges, arg_min(first, r) AS first, arg_min(last, r) AS last, arg_min(left_rows, r) AS left_rows, arg_min(right_rows, r) AS right_rows
FROM (SELECT *, (first, last, left_rows, right_rows) AS r FROM x) GROUP BY g""",
    "file_trees": f"""WITH l AS (SELECT o_orderkey // {FILE_KEYS} AS part, o_orderkey AS k, o_orderkey || '|' || o_custkey || '|' || o_orderpriority || chr(10) AS line FROM orders),
o AS (SELECT *, sum(strlen(line)) OVER (PARTITION BY part ORDER BY k) - strlen(line) AS pos FROM l),
r AS (SELECT part, pos // {FILE_RANGE} AS range, sha256(string_agg(line, '' ORDER BY k)) AS d, sum(strlen(line)) AS n FROM o GROUP BY ALL),
u AS (SELECT part, range // {T.FAN} AS range, sha256(string_agg(d, '' ORDER BY range)) AS d, sum(n) AS n, count(*) AS c FROM r GROUP BY ALL),
v AS (SELECT part, range // {T.FAN} AS range, sha256(string_agg(d, '' ORDER BY range)) AS d, sum(n) AS n, sum(c) AS c FROM u GROUP BY ALL)
SELECT part, sum(n)::BIGINT AS size, sum(c)::BIGINT AS ranges, sha256(sum(n)::BIGINT || '|' || string_agg(d, '' ORDER BY range)) AS root FROM v GROUP BY part""",
    "quoted_csv": "SELECT doc_id, sha256(text) AS text_sha256, source FROM documents",
    "page_coverage": f"{_PAGES_SQL} SELECT * FROM faults",
    "pages_to_fetch": f"""{_PAGES_SQL} SELECT DISTINCT unnest(range(first - first % 100, last, 100)) AS "offset" FROM faults WHERE problem = 'missing'""",
}
