"""Readers and writers of evidence: strict schemas, only allowed columns, no prompt text in results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compassframe.operators.digest import table_digest

EVIDENCE_JSON = (
    "key string, prompts_id string, original_prompt string, "
    "models map<string, struct<actual_token_count: bigint, correctness_score: double>>"
)
JUDGE_COLUMNS = ["ordinal", "key", "prompts_id", "original_prompt", "actual_token_count", "correctness_score"]
PAGE_JSON = (
    "offset bigint, num_rows_total bigint, rows array<struct<row_idx: bigint, row: struct<id: bigint, "
    "model_a: string, model_b: string, prompt: string, winner_model_a: int, winner_model_b: int, "
    "winner_tie: int>>>"
)
PAGE_SIZE = 100
SINK_FIELDS = ["key", "prompts_id", "original_prompt", "models"]


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with one observation per model; a malformed line fails the read."""
    return spark.read.schema(EVIDENCE_JSON).option("mode", "FAILFAST").json(path)


def evidence_problems(rows: DataFrame, pool: list[str], keep: list[str]) -> DataFrame:
    """Rows that break a rule, with the rules they break; empty for a usable snapshot."""
    observed = F.map_values("models")
    problems = F.array_compact(
        F.array(
            F.when(
                ~F.coalesce(F.array_sort(F.map_keys("models")) == F.array(*map(F.lit, sorted(pool))), F.lit(False)),
                "candidate_mismatch",
            ),
            F.when(
                F.exists(observed, lambda o: ~F.coalesce(o.correctness_score.between(0.0, 1.0), F.lit(False))),
                "score_range",
            ),
            F.when(
                F.exists(observed, lambda o: ~F.coalesce(o.actual_token_count >= 0, F.lit(False))), "negative_tokens"
            ),
        )
    )
    return rows.select(*keep, problems.alias("problems")).where(F.size("problems") > 0)


def to_wide(rows: DataFrame, pool: dict[str, float]) -> DataFrame:
    """Interchange form (map of models) to the evaluation form (array of observations)."""
    params = F.create_map(*[x for m, p in sorted(pool.items()) for x in (F.lit(m), F.lit(float(p)))])
    observations = F.transform(
        F.array_sort(F.map_entries("models")),
        lambda e: F.struct(
            e.key.alias("model"), F.element_at(params, e.key).alias("params"),
            e.value.correctness_score.alias("correctness"), e.value.actual_token_count.alias("tokens"),
        ),
    )
    return rows.withColumn("observations", observations).drop("models")


def read_judge_csv(spark: SparkSession, path: str, first: int | None = None, last: int | None = None,
                   by: str = "ordinal") -> DataFrame:
    """Judge tables with only the allowed columns; answers and rationales are never read.

    ``first``/``last`` select a range of the carried ordinal or of prompts_id. A missing column fails, and
    so does a file whose header has other columns, or another order, than the first file's.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(JUDGE_COLUMNS) - set(header))
    if missing:
        raise ValueError(f"source is missing required columns: {missing}")
    rows = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
        .schema(", ".join(f"`{c}` string" for c in header)).csv(path).select(*JUDGE_COLUMNS)
    )
    typed = rows.select(
        F.col("ordinal").cast("bigint").alias("ordinal"), F.trim("key").alias("key"),
        F.trim("prompts_id").alias("prompts_id"), "original_prompt",
        F.col("actual_token_count").cast("bigint").alias("actual_token_count"),
        F.col("correctness_score").cast("double").alias("correctness_score"),
    )
    at = F.col(by).cast("bigint")
    if first is not None:
        typed = typed.where(at >= first)
    if last is not None:
        typed = typed.where(at <= last)
    return typed


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed API pages, one JSON document per line."""
    return spark.read.schema(PAGE_JSON).option("mode", "FAILFAST").json(path)


def page_problems(pages: DataFrame, window_end: int) -> DataFrame:
    """Short pages, and pages saying that the source no longer holds the window."""
    return pages.select(
        "offset",
        F.when(F.col("num_rows_total") < window_end, "source_shrunk")
        .when(F.size("rows") != PAGE_SIZE, "short_page").alias("problem"),
    ).where(F.col("problem").isNotNull())


def page_rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.inline("rows")).select("row_idx", "row.*")


def one_physical_row(text: Column) -> Column:
    """Unicode line and paragraph separators become plain newlines, which JSON escapes."""
    return F.regexp_replace(text, r"[\x{2028}\x{2029}]", "\n")


def minimized(rows: DataFrame, *also: str) -> DataFrame:
    """Only the fixed fields of the evidence sink."""
    return rows.select(
        *also, "key", "prompts_id", one_physical_row(F.col("original_prompt")).alias("original_prompt"), "models"
    )


def write_partitions(rows: DataFrame, path: str, committed: str = "hidden_test") -> DataFrame:
    """Writes all splits but the committed one; returns counts and digests of every split.

    Rows of the committed split leave only a digest behind.
    """
    minimized(rows, "split").where(F.col("split") != committed).write.mode("overwrite").partitionBy("split").json(path)
    return split_manifest(rows, committed)


def split_manifest(rows: DataFrame, committed: str = "hidden_test") -> DataFrame:
    return table_digest(rows, ["key", "fingerprint"], ["split"]).withColumn(
        "persisted", F.col("split") != committed
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file of a snapshot."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def verify_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files whose digest differs from the manifest (file, sha256), or that only one side has."""
    actual = file_digests(spark, path).withColumnRenamed("sha256", "actual")
    return (
        manifest.select("file", F.col("sha256").alias("expected"))
        .join(actual, "file", "full_outer")
        .where(~F.col("expected").eqNullSafe(F.col("actual")))
    )


#: Pages of one bucket of offsets in the coverage check.
COVER_PAGES = 100_000


def page_coverage(pages: DataFrame, window_end: int, page_size: int = PAGE_SIZE) -> DataFrame:
    """What is wrong with landed pages of [0, window_end): problem, first and last (exclusive) row of each fault.

    missing: rows no page has; overlap: rows that an earlier page reaches into; repeated: a page landed again; beyond: rows
    after the window. Pages: offset and rows (an array) or n (its size). Pages without an offset are `unplaced`.

    Offsets are cut into buckets of COVER_PAGES pages; a bucket's reach is one row, and the reach of all before it is
    carried in, so no window holds all pages.
    """
    n = F.col("n") if "n" in pages.columns else F.coalesce(F.size("rows"), F.lit(0))
    landed = pages.select(F.col("offset").cast("bigint").alias("first"), (F.col("offset") + F.greatest(n, F.lit(0))).cast("bigint").alias("last"))
    placed = landed.where("first IS NOT NULL").groupBy("first", "last").agg(F.count("*").alias("times")).withColumn(
        "bucket", F.expr(f"first div {COVER_PAGES * page_size}"))
    earlier = Window.partitionBy("_").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    reach = placed.groupBy("bucket").agg(F.max("last").alias("reach")).withColumn("_", F.lit(0)).select(
        "bucket", F.coalesce(F.max("reach").over(earlier), F.lit(0)).alias("_before"))  # a row a bucket
    inside = Window.partitionBy("bucket").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    held = placed.join(F.broadcast(reach), "bucket").withColumn(
        "covered", F.greatest(F.col("_before"), F.coalesce(F.max("last").over(inside), F.lit(0))))
    end = F.lit(window_end).cast("bigint")
    fault = lambda kind, when, a, b: F.when(when, F.struct(F.lit(kind).alias("problem"), a.cast("bigint").alias("first"), b.cast("bigint").alias("last")))
    first, last, covered = F.col("first"), F.col("last"), F.col("covered")
    faults = F.array_compact(F.array(
        fault("missing", (first > covered) & (covered < end), covered, F.least(first, end)),
        fault("overlap", (first < covered) & (last > first), first, F.least(covered, last)),
        fault("repeated", F.col("times") > 1, first, last),
        fault("beyond", last > end, F.greatest(first, end), last),
    ))
    inner = held.select(F.inline(faults))
    tail = placed.agg(F.coalesce(F.max("last"), F.lit(0)).alias("first")).where(F.col("first") < end).select(
        F.lit("missing").alias("problem"), F.col("first").cast("bigint").alias("first"), end.alias("last"))
    lost = landed.where("first IS NULL").select(F.lit("unplaced").alias("problem"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"))
    return inner.unionByName(tail).unionByName(lost)


def pages_to_fetch(coverage: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """offset of every page that has to be fetched (again) so that the window is whole; a run that is resumed takes these."""
    start = F.expr(f"first - first % {page_size}")
    return coverage.where("problem = 'missing' AND last > first").select(
        F.explode(F.sequence(start, F.col("last") - 1, F.lit(page_size).cast("bigint"))).alias("offset")).distinct()
