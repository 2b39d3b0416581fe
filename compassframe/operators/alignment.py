"""Bringing several sources of the same rows together, and checking that they agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from compassframe.functions.text import fingerprint
from compassframe.operators.ordered import lookup


def tag_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Union of the sources with their names; the first one is the anchor."""
    tagged = [df.withColumn("source", F.lit(name)).withColumn("source_no", F.lit(i))
              for i, (name, df) in enumerate(sources.items())]
    return reduce(DataFrame.unionByName, tagged)


def align(tagged: DataFrame, n_sources: int) -> DataFrame:
    """One row per ordinal with every source's observation and the alignment verdict.

    A row is 'aligned' only if all sources have it and all visible texts equal the anchor's. Different
    keys or ids at one ordinal, or a missing source, are errors of the whole acquisition, reported as
    'key_mismatch', 'id_mismatch', 'missing_source' or, if a source has the ordinal twice, 'repeated_source'. What is
    NULL agrees with nothing: a NULL key or id is a mismatch, and a source without a text differs. The grouping holds
    one row per source.
    """
    rows = tagged.withColumn("fp", fingerprint(F.col("original_prompt"))).drop("original_prompt")
    anchor = F.max(F.when(F.col("source_no") == 0, F.col("fp")))
    grouped = rows.groupBy("ordinal").agg(
        F.max(F.when(F.col("source_no") == 0, F.col("key"))).alias("key"),
        F.max(F.when(F.col("source_no") == 0, F.col("prompts_id"))).alias("prompts_id"),
        anchor.alias("fingerprint"),
        F.coalesce((F.min("key") == F.max("key")) & (F.count("key") == F.count("*")), F.lit(False)).alias("_same_key"),
        F.coalesce((F.min("prompts_id") == F.max("prompts_id")) & (F.count("prompts_id") == F.count("*")), F.lit(False)).alias("_same_id"),
        F.count("*").alias("_n"),
        F.array_sort(F.collect_list(F.struct("source", "fp", "actual_token_count", "correctness_score"))).alias("_obs"),
    )
    differing = F.transform(
        F.filter("_obs", lambda o: ~F.coalesce(o.fp == F.col("fingerprint"), F.lit(False))), lambda o: o.source
    )
    observations = F.transform(
        "_obs", lambda o: F.struct(o.source.alias("model"), o.actual_token_count.alias("actual_token_count"),
                                   o.correctness_score.alias("correctness_score"))
    )
    verdict = (
        F.when(F.size(F.array_distinct(F.transform("_obs", lambda o: o.source))) != F.col("_n"), "repeated_source")
        .when(F.col("_n") != n_sources, "missing_source")
        .when(~F.col("_same_key"), "key_mismatch")
        .when(~F.col("_same_id"), "id_mismatch")
        .when(F.size("differing_sources") > 0, "text_mismatch")
        .otherwise("aligned")
    )
    return (
        grouped.withColumn("differing_sources", differing)
        .withColumn("verdict", verdict)
        .withColumn("models", observations)
        .drop("_same_key", "_same_id", "_n", "_obs")
    )


def mismatch_counts(aligned: DataFrame) -> DataFrame:
    """How many rows each source's text differed on."""
    return aligned.select(F.explode("differing_sources").alias("source")).groupBy("source").agg(
        F.count("*").alias("text_mismatches")
    )


def prefix_mismatches(source: DataFrame, snapshot: DataFrame, fields: list[str], first_rows: Column | None = None) -> DataFrame:
    """Ordinals at which a source's first rows differ from the trusted snapshot, and in what: (ordinal, differing).

    Rows of ordinals from ``first_rows`` on are not compared; without it all are. ``differing`` lists fields (NULL
    equals NULL only), or 'missing_in_source', 'missing_in_snapshot', or 'repeated' for an ordinal that a side has
    twice. A row without an ordinal has no partner and counts as missing on the other side. The counts share the
    join's partitioning.
    """
    def side(df: DataFrame) -> DataFrame:
        kept = df.select("ordinal", *fields).where(F.col("ordinal").isNotNull() if first_rows is None else F.col("ordinal") < first_rows)
        counted = kept.withColumn("_n", F.count("*").over(Window.partitionBy("ordinal")))
        return counted.withColumn("_repeated", F.col("_n") > 1).drop("_n")

    def alone(df: DataFrame, fault: str) -> DataFrame:
        """Rows without an ordinal, which would all meet in one task."""
        return df.where(F.col("ordinal").isNull()).select("ordinal", F.array(F.lit(fault)).alias("differing"))

    joined = side(source).alias("a").join(side(snapshot).alias("b"), "ordinal", "full_outer")
    fault = lambda test, name: F.when(test, F.lit(name))
    differing = (
        F.when(F.col("a._repeated").isNull(), F.array(F.lit("missing_in_source")))
        .when(F.col("b._repeated").isNull(), F.array(F.lit("missing_in_snapshot")))
        .when(F.col("a._repeated") | F.col("b._repeated"), F.array(F.lit("repeated")))
        .otherwise(F.array_compact(F.array(*[fault(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields])))
    )
    found = joined.select("ordinal", differing.alias("differing")).where(F.size("differing") > 0)
    repeated = F.array_contains("differing", "repeated")
    once = found.where(~repeated).unionByName(found.where(repeated).distinct())
    return once.unionByName(alone(source, "missing_in_snapshot")).unionByName(alone(snapshot, "missing_in_source"))


def complete_outcomes(recommendations: DataFrame, outcomes: DataFrame, pool: list[str]) -> DataFrame:
    """Per committed recommendation: 'complete', or what its outcomes lack.

    Outcomes of unknown ids are ignored. Complete means the same key and every model exactly once.
    """
    known = outcomes.select("prompts_id", F.col("key").alias("o_key"), "model")
    per_id = (
        known.join(recommendations.select("prompts_id"), "prompts_id", "left_semi")
        .groupBy("prompts_id", "model").agg(F.count("*").alias("n"), F.min("o_key").alias("k1"), F.max("o_key").alias("k2"))
        .groupBy("prompts_id")
        .agg(
            F.count_if(F.col("model").isin(pool)).alias("models"),
            F.count_if(~F.col("model").isin(pool)).alias("unknown_models"),
            F.max("n").alias("most"), F.min("k1").alias("k1"), F.max("k2").alias("k2"),
        )
    )
    checked = recommendations.select("prompts_id", "key").join(per_id, "prompts_id", "left")
    return checked.select(
        "prompts_id", "key",
        F.when(F.col("models").isNull(), "no_outcomes")
        .when((F.col("k1") != F.col("key")) | (F.col("k2") != F.col("key")), "key_mismatch")
        .when(F.col("most") > 1, "repeated_model")
        .when((F.col("models") < len(pool)) | (F.col("unknown_models") > 0), "incomplete")
        .otherwise("complete").alias("status"),
    )


def identity_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids on one side only, or with different keys; empty when the two tables pair up one to one."""
    joined = left.select("prompts_id", F.col("key").alias("l_key")).join(
        right.select("prompts_id", F.col("key").alias("r_key")), "prompts_id", "full_outer"
    )
    return joined.where(~F.col("l_key").eqNullSafe(F.col("r_key"))).select(
        "prompts_id",
        F.when(F.col("r_key").isNull(), "left_only").when(F.col("l_key").isNull(), "right_only")
        .otherwise("key_differs").alias("problem"),
    )


def battle_labels(
    rows: DataFrame, pair: tuple[str, str], prompt: str = "prompt", ids: DataFrame | None = None
) -> DataFrame:
    """Validates preference rows and labels them; ``problem`` is NULL for usable rows.

    Rows: id, model_a, model_b, prompt (normalised), winner_model_a, winner_model_b, winner_tie. Pass ``ids``
    (the same rows' ids) when ``rows`` is costly and its ids come from a plainer table.
    """
    wins = [F.col(c) for c in ("winner_model_a", "winner_model_b", "winner_tie")]
    binary = F.lit(True)
    for w in wins:
        binary = binary & w.isin(0, 1)
    repeated = (rows if ids is None else ids).groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1")
    spread = rows.withColumn("_row", F.xxhash64(*rows.columns))
    marked = lookup(spread, repeated, "id", "_n", "_n", weight="_n", row_id="_row").drop("_row")
    problem = (
        F.when(F.array_sort(F.array("model_a", "model_b")) != F.array(*map(F.lit, sorted(pair))), "model_pair")
        .when(F.col("_n").isNotNull(), "duplicate_id")
        .when(~F.coalesce(binary, F.lit(False)) | (sum(wins[1:], wins[0]) != 1), "winner_indicators")
        .when(F.coalesce(F.length(prompt), F.lit(0)) == 0, "empty_prompt")
    )
    label = F.when(wins[0] == 1, "strong").when(wins[1] == 1, "economical").when(wins[2] == 1, "tie")
    return marked.withColumn("problem", problem).withColumn(
        "label", F.when(F.col("problem").isNull(), label)
    ).drop("_n")
