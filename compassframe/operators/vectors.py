"""Embedding prototypes and the conservative merge of a semantic assessment into a profile."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compassframe.functions.barrier import settle
from compassframe.session import written

MAX_PROTOTYPES = 512

# Fixed values of the merge rule and the allowed assessment values.
INVOKE_THRESHOLD = 0.55
TASK_CONFIDENCE, TASK_UNCERTAINTY = 0.65, 0.45
CONFIDENCE_CAP, CONFIDENCE_BASE, MARGIN_SCALE = 0.9, 0.55, 5.0
FAMILIES = ["code", "reasoning", "research", "writing", "summarization", "extraction", "agent", "general"]
CAPABILITIES = ["text", "vision", "audio", "tools", "structured_output", "long_context", "reasoning", "code"]
DIFFICULTIES = ["low", "medium", "high", "uncertain"]
ASSESSMENT_TYPE = (
    "task_family string, difficulty string, required_capabilities array<string>, "
    "privacy_flags array<string>, confidence double, reason_codes array<string>"
)


def normalized(vector: Column, dimensions: int) -> Column:
    """L2-normalised vector; NULL for a wrong dimension, a zero norm or non-finite values."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    usable = (F.size(vector) == dimensions) & (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
    return F.when(usable, F.transform(v, lambda x: x / norm))


def prototypes(rows: DataFrame, vector: str, label: str, dimensions: int) -> DataFrame:
    """Mean vector per label, normalised. One partial aggregate over (label, dimension)."""
    parts = rows.select(label, F.posexplode(vector).alias("d", "x")).groupBy(label, "d").agg(F.avg("x").alias("m"))
    return parts.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda e: e.m).alias("_mean")
    ).select(label, normalized(F.col("_mean"), dimensions).alias("prototype"))


def prototype_book(protos: DataFrame, label: str) -> Column:
    """All prototypes as one array value; one row above MAX_PROTOTYPES is gathered at most before it is refused."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "prototype")))
    return protos.limit(MAX_PROTOTYPES + 1).agg(entries.alias("b")).select(
        F.when(F.size("b") <= MAX_PROTOTYPES, F.col("b"))
        .otherwise(F.raise_error(F.lit(f"more than {MAX_PROTOTYPES} prototypes; use prototype_books"))).alias("b")
    ).scalar()


def prototype_books(protos: DataFrame, label: str) -> list[Column]:
    """Prototypes of any number as several array values, each about half full."""
    table = written(protos, "prototypes")
    n = math.ceil(2 * table.count() / MAX_PROTOTYPES)
    if n <= 1:
        return [prototype_book(table, label)]
    return [prototype_book(table.where(F.pmod(F.xxhash64(label), F.lit(n)) == k), label) for k in range(n)]


def nearest_prototype(rows: DataFrame, vector: str, book: Column | list[Column], dimensions: int) -> DataFrame:
    """Adds predicted label, margin over the runner-up and confidence. Ties go to the greater label.

    Of several books each gives its two nearest, so a row never holds the scores of more than one.
    """
    books = book if isinstance(book, list) else [book]
    scored = rows.withColumn("_v", normalized(F.col(vector), dimensions))
    scores = """transform(_book, p -> struct(
                    aggregate(zip_with(_v, p.prototype, (a, b) -> a * b), 0D, (acc, x) -> acc + x) AS score, p.label AS label))"""
    for k, b in enumerate(books):
        all_ = f"concat(_tops, {scores})" if k else scores
        many = "size(_tops) + size(_book)" if k else "size(_book)"
        nearest = F.expr(f"slice(array_sort({all_}), greatest({many} - 1, 1), 2)")
        scored = settle(scored.withColumn("_book", b).withColumn("_tops", nearest).drop("_book"), ["_tops"])
    scored = scored.withColumn("_best", F.try_element_at("_tops", F.lit(-1))).withColumn("_next", F.try_element_at("_tops", F.lit(-2)))
    usable = F.col("_v").isNotNull()
    margin = F.greatest(F.lit(0.0), F.col("_best.score") - F.col("_next.score"))
    done = (
        scored.withColumn("predicted", F.when(usable, F.col("_best.label")))
        .withColumn("margin", F.when(usable, margin))
        .withColumn("confidence", F.least(F.lit(CONFIDENCE_CAP), F.lit(CONFIDENCE_BASE) + F.lit(MARGIN_SCALE) * F.col("margin")))
        .drop("_v", "_tops", "_best", "_next")
    )
    return settle(done, ["predicted", "margin", "confidence"])


def parse_assessment(raw: Column) -> Column:
    """The outermost {...} of a raw answer as a typed struct; NULL unless every rule holds.

    Lists may be left out, but not be null; unknown fields are refused.
    """
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    a = F.from_json(body, ASSESSMENT_TYPE, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(body)
    only = lambda xs, allowed: F.size(F.array_except(xs, F.array(*map(F.lit, allowed)))) == 0
    fields = ["task_family", "difficulty", "required_capabilities", "privacy_flags", "confidence", "reason_codes"]
    given = lambda name: F.array_contains(keys, name)
    listed = lambda name, default: F.when(~given(name), default).otherwise(a[name])
    none = F.array().cast("array<string>")
    whole = F.struct(
        a.task_family.alias("task_family"), a.difficulty.alias("difficulty"),
        listed("required_capabilities", F.array(F.lit("text"))).alias("required_capabilities"),
        listed("privacy_flags", none).alias("privacy_flags"), a.confidence.alias("confidence"),
        listed("reason_codes", none).alias("reason_codes"),
    )
    valid = (
        only(keys, fields)
        & whole["task_family"].isin(FAMILIES)
        & whole["difficulty"].isin(DIFFICULTIES)
        & whole["confidence"].between(0.0, 1.0)
        & only(whole["required_capabilities"], CAPABILITIES)
        & (F.size(whole["privacy_flags"]) <= 8)
        & (F.size(whole["reason_codes"]) <= 5)
    )
    return F.when(F.coalesce(valid, F.lit(False)), whole)


def should_invoke(mode: Column, uncertainty: Column) -> Column:
    return (mode == "always") | ((mode == "auto") & (uncertainty >= INVOKE_THRESHOLD))


def merge(rows: DataFrame, raw: str = "assessment", mode: str = "assessor_mode") -> DataFrame:
    """Merges raw assessments into profile columns; what is invalid or not asked for changes nothing.

    Adds assessor_status: disabled, not_needed, unavailable, invalid_output or completed.
    """
    invoked = should_invoke(F.col(mode), F.col("uncertainty"))
    parsed = rows.withColumn("_a", F.when(invoked, parse_assessment(F.col(raw)))).withColumn(
        "assessor_status",
        F.when(F.col(mode) == "off", "disabled")
        .when(~invoked, "not_needed")
        .when(F.col(raw).isNull(), "unavailable")
        .when(F.col("_a").isNull(), "invalid_output")
        .otherwise("completed"),
    )
    parsed = settle(parsed, ["_a", "assessor_status"])
    use = F.col("assessor_status") == "completed"
    order = lambda d: F.when(d == "low", 0).when(d == "high", 2).otherwise(1)
    harder = order(F.col("_a.difficulty")) > order(F.col("difficulty"))
    take_task = use & (F.col("_a.confidence") >= TASK_CONFIDENCE) & (F.col("uncertainty") >= TASK_UNCERTAINTY)
    return parsed.withColumns(
        {
            "task_family": F.when(take_task, F.col("_a.task_family")).otherwise(F.col("task_family")),
            "difficulty": F.when(use & harder, F.col("_a.difficulty")).otherwise(F.col("difficulty")),
            "required_capabilities": F.when(
                use, F.array_sort(F.array_union("required_capabilities", F.col("_a.required_capabilities")))
            ).otherwise(F.col("required_capabilities")),
            "privacy_flags": F.when(
                use, F.array_sort(F.array_union("privacy_flags", F.col("_a.privacy_flags")))
            ).otherwise(F.col("privacy_flags")),
            "reason_codes": F.when(
                use, F.slice(F.array_distinct(F.concat("reason_codes", F.col("_a.reason_codes"))), 1, 6)
            ).otherwise(F.col("reason_codes")),
            "uncertainty": F.when(
                use, F.least(F.col("uncertainty"), 1 - F.col("_a.confidence"))
            ).otherwise(F.col("uncertainty")),
        }
    ).drop("_a")
