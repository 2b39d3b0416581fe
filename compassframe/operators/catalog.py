"""Configuration catalogs: a neutral built-in one, rule checks, freshness and version acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from compassframe.operators.ordered import running_max

MAX_CONFIGURATIONS = 500  # fixed value: a catalog version holds 1..500 configurations

CONFIGURATION_TYPE = (
    "configuration_id string, provider string, model_id string, display_name string, "
    "deployment string, settings map<string,string>, context_window bigint, "
    "capabilities array<string>, privacy array<string>, input_usd_per_million double, "
    "output_usd_per_million double, latency_ms double, quality map<string,double>, "
    "evidence struct<id:string,title:string,url:string,source_type:string>, "
    "prior_uncertainty double"
)
DOCUMENT_TYPE = (
    "spec_version string, catalog_version string, sequence bigint, observed_at timestamp, "
    "expires_at timestamp, disclaimer string, "
    f"configurations array<struct<{CONFIGURATION_TYPE}>>"
)

_TEXT = ["text"]
_FULL = ["text", "vision", "tools", "structured_output", "long_context", "reasoning", "code"]
_DOC, _RULE = "provider_documentation", "curated_rule"

# (id, provider, deployment, context, capabilities, privacy, in $, out $, latency, evidence, prior,
#  quality general/code/reasoning/research/writing/extraction)
NEUTRAL_CATALOG = [
    ("alder-max", "alder", "hosted", 400_000, [*_FULL, "audio"], ["standard", "no_training"],
     6.0, 30.0, 2600.0, _DOC, 0.12, (0.93, 0.94, 0.95, 0.92, 0.90, 0.92)),
    ("alder-core", "alder", "hosted", 400_000, _FULL, ["standard", "no_training"],
     1.5, 9.0, 1400.0, _DOC, 0.15, (0.87, 0.88, 0.88, 0.85, 0.86, 0.88)),
    ("alder-mini", "alder", "hosted", 200_000, _FULL, ["standard", "no_training"],
     0.25, 2.0, 700.0, _DOC, 0.20, (0.76, 0.75, 0.74, 0.72, 0.77, 0.80)),
    ("birch-pro", "birch", "hosted", 1_000_000, [*_FULL, "audio"], ["standard", "no_training"],
     3.0, 15.0, 2100.0, _DOC, 0.14, (0.90, 0.89, 0.91, 0.93, 0.88, 0.90)),
    ("birch-lite", "birch", "hosted", 1_000_000, _FULL, ["standard", "no_training"],
     0.10, 0.40, 450.0, _DOC, 0.22, (0.70, 0.66, 0.65, 0.69, 0.71, 0.76)),
    ("cedar-coder", "cedar", "hosted", 256_000, [*_TEXT, "tools", "structured_output", "code", "reasoning"],
     ["standard"], 0.60, 2.40, 900.0, "public_benchmark", 0.18, (0.74, 0.91, 0.80, 0.68, 0.66, 0.82)),
    ("cedar-writer", "cedar", "hosted", 128_000, [*_TEXT, "structured_output"], ["standard", "no_training"],
     0.80, 3.20, 800.0, "public_benchmark", 0.24, (0.78, 0.55, 0.60, 0.74, 0.92, 0.75)),
    ("dogwood-open", "dogwood", "self_hosted", 131_072, [*_TEXT, "tools", "structured_output", "code", "reasoning"],
     ["standard", "no_training"], 0.20, 0.20, 1100.0, "local_benchmark", 0.25,
     (0.72, 0.73, 0.71, 0.66, 0.70, 0.74)),
    ("elm-local-large", "elm", "local", 32_768, [*_TEXT, "structured_output", "code", "reasoning", "tools"],
     ["standard", "no_training", "local_only"], 0.0, 0.0, 3200.0, _RULE, 0.35,
     (0.66, 0.67, 0.63, 0.60, 0.65, 0.68)),
    ("elm-local-small", "elm", "local", 16_384, [*_TEXT, "structured_output", "code"],
     ["standard", "no_training", "local_only"], 0.0, 0.0, 1500.0, _RULE, 0.40,
     (0.54, 0.52, 0.48, 0.47, 0.55, 0.57)),
]
QUALITY_FAMILIES = ["general", "code", "reasoning", "research", "writing", "extraction"]


def neutral_catalog(spark: SparkSession) -> DataFrame:
    """Ten invented configurations; two families are left out so the 'general' fallback is used."""
    rows = [
        (cid, provider, cid, cid, deployment, {"effort": "default"}, context, caps, privacy, p_in, p_out,
         latency, dict(zip(QUALITY_FAMILIES, quality)),
         (f"ev-{cid}", f"Notes on {cid}", f"https://catalog.invalid/{cid}", source), prior)
        for cid, provider, deployment, context, caps, privacy, p_in, p_out, latency, source, prior, quality
        in NEUTRAL_CATALOG
    ]
    return spark.createDataFrame(rows, CONFIGURATION_TYPE)


def explode_documents(documents: DataFrame) -> DataFrame:
    """Nested catalog documents to one row per configuration, document fields carried along."""
    return documents.select(
        "spec_version", "catalog_version", "sequence", "observed_at", "expires_at", "disclaimer",
        F.inline("configurations"),
    )


def _rule(bad: Column, name: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(name))


def configuration_violations(configurations: DataFrame) -> DataFrame:
    """Row rules and per-version rules; one output row per broken rule.

    A NULL where a value is required counts as broken; prior_uncertainty has a default.
    """
    c = F.col
    ratio = lambda x: (x < 0) | (x > 1)
    rules = F.array_compact(
        F.array(
            _rule(~c("configuration_id").rlike(r"^[a-z0-9][a-z0-9._-]{2,199}$"), "configuration_id_format"),
            _rule(~F.length("provider").between(1, 100), "provider_length"),
            _rule(~F.length("model_id").between(1, 200), "model_id_length"),
            _rule(~F.length("display_name").between(1, 200), "display_name_length"),
            _rule(~c("deployment").isin("hosted", "local", "self_hosted"), "deployment_value"),
            _rule(~c("context_window").between(1, 20_000_000), "context_window_range"),
            _rule(~F.size("capabilities").between(1, 50), "capabilities_size"),
            _rule(F.size(F.array_distinct("capabilities")) != F.size("capabilities"), "capabilities_unique"),
            _rule(~F.size("privacy").between(1, 3), "privacy_size"),
            _rule(F.size(F.array_distinct("privacy")) != F.size("privacy"), "privacy_unique"),
            _rule(
                F.size(F.array_except("privacy", F.array(*map(F.lit, ["standard", "no_training", "local_only"])))) > 0,
                "privacy_value",
            ),
            _rule(~c("input_usd_per_million").between(0, 1_000_000), "input_price_range"),
            _rule(~c("output_usd_per_million").between(0, 1_000_000), "output_price_range"),
            _rule(~((c("latency_ms") > 0) & (c("latency_ms") <= 86_400_000)), "latency_range"),
            _rule(~F.map_contains_key("quality", "general"), "quality_general_missing"),
            _rule(F.exists(F.map_values("quality"), ratio), "quality_range"),
            _rule(~F.length(c("evidence.id")).between(1, 200), "evidence_id_length"),
            _rule(~F.length(c("evidence.title")).between(1, 300), "evidence_title_length"),
            _rule(~c("evidence.url").startswith("https://"), "evidence_https"),
            _rule(
                ~c("evidence.source_type").isin(
                    "provider_documentation", "public_benchmark", "local_benchmark", "curated_rule"
                ),
                "evidence_source_type",
            ),
            _rule(ratio(F.coalesce("prior_uncertainty", F.lit(0.2))), "prior_uncertainty_range"),
        )
    )
    per_row = configurations.select(
        "catalog_version", "configuration_id", F.explode(rules).alias("rule")
    )
    by_id = configurations.groupBy("catalog_version", "configuration_id").agg(F.count("*").alias("n"))
    repeated = by_id.where("n > 1").select(
        "catalog_version", "configuration_id", F.lit("configuration_id_unique").alias("rule")
    )
    by_version = by_id.groupBy("catalog_version").agg(F.sum("n").alias("n"))
    oversized = by_version.where(~F.col("n").between(1, MAX_CONFIGURATIONS)).select(
        "catalog_version", F.lit(None).cast("string").alias("configuration_id"),
        F.lit("configuration_count").alias("rule"),
    )
    return per_row.unionByName(repeated).unionByName(oversized)


def document_violations(documents: DataFrame) -> DataFrame:
    c = F.col
    rules = F.array_compact(
        F.array(
            _rule(F.coalesce("spec_version", F.lit("1.0")) != "1.0", "spec_version"),
            _rule(~F.length("catalog_version").between(1, 100), "catalog_version_length"),
            _rule(c("sequence") < 1, "sequence_positive"),
            _rule(c("expires_at") <= c("observed_at"), "expires_after_observed"),
            _rule(F.length(F.coalesce("disclaimer", F.lit(""))) > 2000, "disclaimer_length"),
            _rule(~F.size("configurations").between(1, MAX_CONFIGURATIONS), "configuration_count"),
        )
    )
    return documents.select("catalog_version", F.explode(rules).alias("rule"))


def freshness(now: Column, observed_at: Column, expires_at: Column) -> Column:
    seconds = lambda t: F.unix_micros(t.cast("timestamp")) / F.lit(1e6)
    lifetime = seconds(expires_at) - seconds(observed_at)
    age = seconds(now) - seconds(observed_at)
    return (
        F.when(now >= expires_at, "stale")
        .when((lifetime > 0) & (age / lifetime >= 0.7), "aging")
        .otherwise("fresh")
    )


def summarize(configurations: DataFrame, now: Column) -> DataFrame:
    """Per catalog version: distinct providers, configuration count and freshness."""
    return (
        configurations.groupBy("catalog_version", "sequence", "observed_at", "expires_at")
        .agg(
            F.array_sort(F.collect_set("provider")).alias("providers"),
            F.count("*").alias("configuration_count"),
        )
        .withColumn("freshness_status", freshness(now, F.col("observed_at"), F.col("expires_at")))
    )


def accept_versions(log: DataFrame, now: Column, bucket_width: int = 100_000) -> DataFrame:
    """Which catalog imports are accepted: newer than the high-water mark, and valid at ``now``.

    ``log`` has (catalog_id, arrival, sequence, observed_at, expires_at). Validity does not depend
    on what was accepted before, and a valid row that is refused never exceeds the mark, so the mark
    is the running maximum of ``sequence`` over earlier valid rows.
    """
    early = F.col("observed_at") <= now + F.expr("INTERVAL 24 HOURS")
    valid = early & (F.col("expires_at") > now)
    marked = running_max(
        log, ["catalog_id"], "arrival", F.when(valid, F.col("sequence")), "trusted_sequence", bucket_width
    ).withColumn("trusted_sequence", F.greatest(F.lit(1), F.coalesce("trusted_sequence", F.lit(1))))
    return marked.withColumn(
        "decision",
        F.when(F.col("sequence") <= F.col("trusted_sequence"), "sequence_not_newer")
        .when(~early, "observed_in_future")
        .when(F.col("expires_at") <= now, "expired")
        .otherwise("accepted"),
    )


def active_versions(log: DataFrame, bucket_width: int = 100_000) -> DataFrame:
    """Active catalog per id after accepted imports and rollbacks; 'builtin' when none is active.

    ``log`` has (catalog_id, arrival, action in import|rollback, catalog_version), accepted imports
    only. A rollback swaps the active version with the one before it, or removes it when there is no
    other. With r(i) rollbacks between import i and the next, that makes:

    * something is active from the first import with r(i) = 0 on;
    * an odd r(i) leaves what was active before import i, an even one leaves import i itself.

    So the answer is the newest import with an even r(i), provided it is not older than the first
    import with r(i) = 0. Both are plain aggregates.
    """
    is_import = F.col("action") == "import"
    placed = running_max(
        log, ["catalog_id"], "arrival", F.when(is_import, F.col("arrival")), "_import", bucket_width
    ).withColumn("_import", F.when(is_import, F.col("arrival")).otherwise(F.col("_import")))
    per_import = (
        placed.where(F.col("_import").isNotNull())
        .groupBy("catalog_id", "_import")
        .agg(
            F.max(F.when(is_import, F.col("catalog_version"))).alias("version"),
            F.count_if(~is_import).alias("rollbacks"),
        )
    )
    even = F.col("rollbacks") % 2 == 0
    state = per_import.groupBy("catalog_id").agg(
        F.max(F.when(even, F.struct(F.col("_import").alias("at"), F.col("version").alias("version")))).alias("kept"),
        F.min(F.when(F.col("rollbacks") == 0, F.col("_import"))).alias("first_active"),
    )
    active = F.when(F.col("first_active") <= F.col("kept.at"), F.col("kept.version"))
    return (
        log.select("catalog_id").distinct()
        .join(state, "catalog_id", "left")
        .select("catalog_id", F.coalesce(active, F.lit("builtin")).alias("active_version"))
    )
