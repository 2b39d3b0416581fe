"""Segment policies on observed evidence: fit on the training split, choose, and score the choices.

Evidence is kept wide: one row per prompt key with an array of one observation per model of the pool
(a handful). Choosing a model's outcome is then an array lookup in the row and the oracle an array
maximum, so evaluating all strategies for all cost weights reads the evidence once and shuffles only
small partial aggregates. Fitted policies have one row per segment, a fixed small number, and travel to
the rows as one scalar value.

Wide columns: key, task_family, length_band, split,
observations array<struct<model, params, correctness, tokens, compute>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from compassframe.functions.barrier import settle
from compassframe.functions.text import hash60, seeded_index
from compassframe.operators.ordered import hash_rank
from compassframe.session import written

# Cost weights, shrinkage, strategies.
LAMBDAS = (0.0, 0.05, 0.10, 0.20, 0.40)
PRIMARY_LAMBDA = 0.20
SHRINKAGE = 20
STRATEGIES = ("always_cheapest", "always_best_quality", "global_utility", "length_segment",
              "task_segment", "hybrid_segment", "seeded_random", "oracle")
DEPLOYABLE = STRATEGIES[:-1]
SPLIT_SALT = "compassframe-split-v1|"
RANDOM_SEED = 42

# Default pool: parameter counts (billions) of the four model tiers compared.
POOL = {"tier-a": 0.6, "tier-b": 1.5, "tier-c": 7.0, "tier-d": 70.0}
#: Policy rows that may travel with the rows; more are joined.
MAX_SEGMENTS = 10_000


def segment_keys() -> dict[str, Column]:
    """What each segmented strategy looks its choice up by."""
    return {
        "length_segment": F.col("length_band"), "task_segment": F.col("task_family"),
        "hybrid_segment": F.concat_ws("|", "task_family", "length_band"),
    }


def to_long(wide: DataFrame) -> DataFrame:
    keep = [c for c in wide.columns if c != "observations"]
    return wide.select(*keep, F.inline("observations"))


def with_compute(wide: DataFrame, normalizer: Column | float) -> DataFrame:
    """Adds compute = params * tokens / normalizer to every observation."""
    divisor = F.lit(normalizer) if isinstance(normalizer, (int, float)) else normalizer
    scaled = wide.withColumn("_norm", divisor).withColumn(
        "observations",
        F.transform(
            "observations",
            lambda o: F.struct(
                o.model.alias("model"), o.params.alias("params"), o.correctness.alias("correctness"),
                o.tokens.alias("tokens"), (o.params * o.tokens / F.col("_norm")).alias("compute"),
            ),
        ),
    ).drop("_norm")
    return settle(scaled, ["observations"])


def maximum_compute(wide: DataFrame) -> Column:
    """Largest params * tokens over the given rows, as a scalar: pass all rows or only some splits."""
    top = F.array_max(F.transform("observations", lambda o: o.params * o.tokens))
    return wide.agg(F.max(top)).scalar()


def model_means(wide: DataFrame) -> DataFrame:
    return to_long(wide.select("observations")).groupBy("model").agg(
        F.first("params").alias("params"),
        F.avg("correctness").alias("mean_correctness"),
        F.avg("compute").alias("mean_compute"),
        F.count("*").alias("support"),
    )


def segment_sums(train: DataFrame) -> DataFrame:
    """Sums per (task, band, model): the only pass over training rows; all policies derive from it."""
    return to_long(train.select("task_family", "length_band", "observations")).groupBy(
        "task_family", "length_band", "model", "params"
    ).agg(
        F.sum("correctness").alias("q"), F.sum("compute").alias("c"), F.count("*").alias("n")
    )


def _argmax(score: Column) -> Column:
    """Highest score, then fewer parameters, then the greater name."""
    return F.max_by("model", F.struct(score, -F.col("params"), F.col("model")))


def fit(train: DataFrame, lambdas: tuple[float, ...] = LAMBDAS, shrinkage: int = SHRINKAGE) -> DataFrame:
    """policy(strategy, lambda, segment, choice, global_choice, support) for the fitted strategies.

    Everything after the one aggregate over the training rows happens on its result, one row per
    (task, band, model): the global means are window sums over it and the coarser segmentations are
    added up from it, so the training rows are read once.
    """
    per_model = Window.partitionBy("model")
    total = lambda c: F.sum(c).over(per_model)
    sums = segment_sums(train).withColumns({"gq": total("q") / total("n"), "gc": total("c") / total("n")})
    kinds = F.inline(
        F.array(
            *[
                F.struct(F.lit(strategy).alias("kind"), segment.alias("segment"))
                for strategy, segment in (
                    ("global", F.lit("")),
                    ("length_segment", F.col("length_band")),
                    ("task_segment", F.col("task_family")),
                    ("hybrid_segment", F.concat_ws("|", "task_family", "length_band")),
                )
            ]
        )
    )
    grouped = sums.select("model", "params", "q", "c", "n", "gq", "gc", kinds).groupBy(
        "kind", "segment", "model", "params"
    ).agg(
        F.sum("q").alias("q"), F.sum("c").alias("c"), F.sum("n").alias("n"),
        F.first("gq").alias("gq"), F.first("gc").alias("gc"),
    )
    w = F.when(F.col("kind") == "global", 0.0).otherwise(F.col("n") / (F.col("n") + F.lit(shrinkage)))
    shrunk = grouped.select(
        "kind", "segment", "model", "params", "n", "gq", "gc",
        (w * (F.col("q") / F.col("n")) + (1 - w) * F.col("gq")).alias("sq"),
        (w * (F.col("c") / F.col("n")) + (1 - w) * F.col("gc")).alias("sc"),
        F.explode(F.array(*[F.lit(float(x)) for x in lambdas])).alias("lambda"),
    )
    chosen = shrunk.groupBy("kind", "lambda", "segment").agg(
        _argmax(F.col("sq") - F.col("lambda") * F.col("sc")).alias("utility_choice"),
        _argmax(F.col("gq")).alias("quality_choice"),
        F.min_by("model", F.struct(F.col("gc"), -F.col("gq"), F.col("model"))).alias("cheapest_choice"),
        F.max("n").alias("support"),
    )
    is_global = F.col("kind") == "global"
    row = lambda strategy, choice: F.struct(strategy.alias("strategy"), F.col(choice).alias("choice"))
    rows = F.when(
        is_global,
        F.array(
            row(F.lit("always_cheapest"), "cheapest_choice"),
            row(F.lit("always_best_quality"), "quality_choice"),
            row(F.lit("global_utility"), "utility_choice"),
        ),
    ).otherwise(F.array(row(F.col("kind"), "utility_choice")))
    fallback = F.max(F.when(is_global, F.col("utility_choice"))).over(Window.partitionBy("lambda"))
    return (
        chosen.withColumn("_global", fallback)
        .select("lambda", "segment", "support", "_global", is_global.alias("_is_global"), F.inline(rows))
        .select(
            "strategy", "lambda",
            F.when(~F.col("_is_global"), F.col("segment")).alias("segment"), "choice",
            F.when(F.col("_is_global"), F.col("choice")).otherwise(F.col("_global")).alias("global_choice"),
            F.when(~F.col("_is_global"), F.col("support")).alias("support"),
        )
    )


def policy_book(policy: DataFrame) -> Column:
    """All fitted policies as one array value, one element per cost weight, for at most MAX_SEGMENTS rows."""
    name = lambda s: F.col("strategy") == s
    entry = F.struct(F.col("segment").alias("k"), F.col("choice").alias("v"))
    segment_map = lambda s: F.map_from_entries(F.collect_list(F.when(name(s), entry))).alias(s)
    one = lambda s: F.max(F.when(name(s), F.col("choice"))).alias(s)
    per_lambda = policy.groupBy("lambda").agg(
        F.count("*").alias("_rows"), *map(one, STRATEGIES[:3]), *map(segment_map, STRATEGIES[3:6])
    )
    return per_lambda.agg(F.collect_list(F.struct("lambda", *STRATEGIES[:6]))).scalar()


def with_policies(wide: DataFrame, policy: DataFrame) -> DataFrame:
    """wide once per cost weight, with the policies' choices for it: _lambda and one column _<strategy> each.

    Small policies travel with the rows as one value; beyond MAX_SEGMENTS rows the segments' choices are joined.
    """
    policy = written(policy, "policy")
    if policy.limit(MAX_SEGMENTS + 1).count() <= MAX_SEGMENTS:
        rows = wide.withColumn("_p", F.explode(policy_book(policy)))
        found = {s: F.try_element_at(F.col(f"_p.{s}"), key) for s, key in segment_keys().items()}
        rows = rows.withColumns({f"_{s}": c for s, c in found.items()})
    else:
        rows = wide.withColumn("_p", F.explode(policy_book(policy.where(F.col("strategy").isin(*STRATEGIES[:3])))))
        for s, key in segment_keys().items():
            one = policy.where(F.col("strategy") == s).select("lambda", F.col("segment"), F.col("choice").alias(f"_{s}"))
            on = (rows["_p.lambda"] == one["lambda"]) & (key == one["segment"])
            rows = rows.join(one, on, "left").drop("lambda", "segment")
    plain = {f"_{s}": F.col(f"_p.{s}") for s in STRATEGIES[:3]}
    return rows.withColumns(plain).withColumn("_lambda", F.col("_p.lambda")).drop("_p")


def choice_rows(
    wide: DataFrame, policy: DataFrame, pool: dict[str, float] | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per key and cost weight with ``choices``: per strategy the chosen model's observation.

    ``keep`` names more columns of ``wide`` to carry along.

    A segment never seen in training falls back to the global choice. All of it happens in the row.
    """
    names = sorted(pool or POOL)
    rows = with_policies(wide, policy)
    random_choice = F.element_at(
        F.array(*map(F.lit, names)), seeded_index(F.col("key"), RANDOM_SEED, len(names)) + 1
    )
    best = F.array_max(
        F.transform(
            "observations",
            lambda o: F.struct(
                (o.correctness - F.col("_lambda") * o.compute).alias("u"), (-o.params).alias("p"), o.model.alias("m")
            ),
        )
    ).m
    chosen = {
        **{s: F.col(f"_{s}") for s in STRATEGIES[:3]},
        **{s: F.coalesce(F.col(f"_{s}"), F.col("_global_utility")) for s in segment_keys()},
        "seeded_random": random_choice,
        "oracle": best,
    }
    picked = rows.withColumn("lambda", F.col("_lambda")).withColumn(
        "_models", F.array(*[chosen[s] for s in STRATEGIES])
    )
    observed = settle(picked, ["_models"]).withColumn(
        "_o",
        F.transform(
            "_models", lambda m: F.get(F.filter("observations", lambda o: o.model == m), F.lit(0))
        ),
    )
    outcome = F.zip_with(
        F.array(*map(F.lit, STRATEGIES)),
        "_o",
        lambda s, o: F.struct(
            s.alias("strategy"), o.model.alias("model"), o.correctness.alias("correctness"), o.compute.alias("compute"),
            (o.correctness - F.col("lambda") * o.compute).alias("utility"),
        ),
    )
    return settle(
        observed.withColumn("choices", outcome).select(
            "key", "split", "task_family", "length_band", "lambda", "choices", *keep
        ),
        ["choices"],
    )


def choices_for(wide: DataFrame, policy: DataFrame, pool: dict[str, float] | None = None) -> DataFrame:
    """outcomes: one row per key, cost weight and strategy."""
    rows = choice_rows(wide, policy, pool)
    return rows.select("key", "split", "task_family", "length_band", "lambda", F.inline("choices"))


def side_by_side(choices: DataFrame, values: dict[str, tuple[str, str]]) -> DataFrame:
    """Chosen outcomes of several strategies next to each other: {column: (strategy, field)}; no shuffle."""
    at = {s: i for i, s in enumerate(STRATEGIES)}
    return choices.select(
        "key", "task_family", "length_band", "lambda",
        *[F.col("choices")[at[s]][field].alias(name) for name, (s, field) in values.items()],
    )


def content_blind(wide: DataFrame, candidate: DataFrame, salt: str) -> DataFrame:
    """Control that ignores the prompt: same model shares as ``candidate`` (key, model), assigned by hash.

    Rows are ranked by a salted hash of the key; the first share goes to the first model in name order
    and so on. The rank is taken in two steps, so no task sees all rows.
    """
    counts = candidate.groupBy("model").agg(F.count("*").alias("n"))
    cuts = counts.agg(
        F.array_sort(F.collect_list(F.struct("model", "n"))).alias("shares")
    ).scalar()
    ranked = hash_rank(
        wide.withColumn("_h", hash60(F.concat(F.lit(salt), F.col("key")))), "_h", "_rank", bits=12, tie="key"
    )
    upper = F.expr(
        """transform(_cuts, (c, i) -> struct(c.model AS model,
             aggregate(slice(_cuts, 1, i + 1), 0L, (acc, x) -> acc + x.n) AS upto))"""
    )
    return (
        ranked.withColumn("_cuts", cuts)
        .withColumn("_cuts", upper)
        .withColumn("model", F.expr("get(filter(_cuts, c -> _rank <= c.upto), 0).model"))
        .drop("_h", "_rank", "_cuts")
    )
