"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is to be copied target / source size times. The whole part is certain; the fractions are
rounded in duels: two documents of similar size put their probabilities together, one of them comes out integral
(taken or not), the other goes on with the rest, and every document keeps its expectation. Groups of about FAN_IN
rows are folded at a time; what each group leaves undecided (one row at most) meets others in the next level of a
reduction tree: first the hash groups of one size band, then neighbouring bands, up to one row per source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compassframe.llm.common import WORD, Scratch, attach, documents, held

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Rows that one fold takes on average, as a power of two.
FAN_IN_BITS = 5
#: Size bands: 64 to a factor of e, merged 32 at a time.
BANDS_PER_E, BAND_MERGES = 64.0, (5, 10)
#: Sums of fractions this near to an integer count as it.
EPS = 1e-9

UNIT = "struct<size: bigint, tie: bigint, doc_id: {id}, source_id: int, p: double, copy: int>"


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_id, source_size and target for rows of source and size.

    Sources in code point order, null last, weigh `weights` in turn and share the sum of all sizes; a target stops
    at max_copies times its source's size and the excess goes to the others by weight. That is the level at which
    min(cap, weight * level) add up to the whole: sources are filled in the order in which they reach their caps.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    every = Window.partitionBy(F.lit(0))  # one row per source
    named = rows.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source", "source_size",
        (F.row_number().over(every.orderBy(F.asc_nulls_last("source"))) - 1).alias("source_id"),
    ).withColumn("weight", F.element_at(cycle, (F.col("source_id") % len(weights) + 1).cast("int")))
    ahead = every.orderBy("ratio", "source_id").rowsBetween(Window.unboundedPreceding, -1)
    behind = every.orderBy("ratio", "source_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = named.withColumn("ratio", F.col("source_size") * max_copies / F.col("weight")).select(
        "*",
        ((F.sum("source_size").over(every) - max_copies * F.coalesce(F.sum("source_size").over(ahead), F.lit(0)))
         / F.sum("weight").over(behind)).alias("level"),
    ).withColumn("capped", F.col("ratio") <= F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct("ratio", "source_id", "level"))).over(every)["level"]
    cap = (F.col("source_size") * max_copies).cast("double")
    return filled.select(
        "source", "source_id", "source_size",
        F.when(F.col("capped"), cap).otherwise(F.least(cap, F.col("weight") * level)).alias("target"),
    )


def fold_duels(groups: DataFrame, id_type: str, seed: int) -> DataFrame:
    """Folds each array `units` (in order of size) by duels; rows of struct u, whose copy is null if undecided."""
    one = UNIT.format(id=id_type)
    pick = f"""shiftrightunsigned(xxhash64({seed}L, acc.carry.tie, x.tie, acc.carry.doc_id, x.doc_id, acc.carry.size,
               x.size), 11) / {float(1 << 53)}D"""
    made = lambda who, p, copy: (
        f"named_struct('size', {who}.size, 'tie', {who}.tie, 'doc_id', {who}.doc_id, 'source_id', {who}.source_id, "
        f"'p', {p}, 'copy', {copy})"
    )
    state = lambda carry, *out: (
        f"named_struct('carry', {carry}, 'out', {'concat(acc.out, array(' + ', '.join(out) + '))' if out else 'acc.out'})"
    )
    none, s, c = f"cast(null as {one})", "(acc.carry.p + x.p)", "acc.carry"
    fold = f"""
        aggregate(units, named_struct('carry', {none}, 'out', cast(array() as array<{one}>)), (acc, x) ->
            CASE WHEN acc.carry IS NULL THEN {state('x')}
            WHEN abs({s} - 1) < {EPS}D THEN
                IF({pick} < x.p, {state(none, made(c, '0D', '0'), made('x', '1D', '1'))},
                                 {state(none, made(c, '1D', '1'), made('x', '0D', '0'))})
            WHEN {s} < 1 THEN
                IF({pick} < x.p / {s}, {state(made('x', s, 'CAST(NULL AS INT)'), made(c, '0D', '0'))},
                                       {state(made(c, s, 'CAST(NULL AS INT)'), made('x', '0D', '0'))})
            ELSE
                IF({pick} < (1 - x.p) / (2 - {s}), {state(made('x', s + ' - 1', 'CAST(NULL AS INT)'), made(c, '1D', '1'))},
                                                   {state(made(c, s + ' - 1', 'CAST(NULL AS INT)'), made('x', '1D', '1'))})
            END,
            acc -> IF(acc.carry IS NULL, acc.out, concat(acc.out, array(acc.carry))))"""
    return groups.select(F.explode(F.expr(fold)).alias("u"))


def pivotal_rounding(units: DataFrame, scratch: Scratch, seed: int = 17) -> DataFrame:
    """Rounds p, the probability of one more copy, to copy (0 or 1); units: size, tie, doc_id, source_id, p in (0, 1).

    In each source the copies add up to the sum of p, rounded up or down. The tree has log(rows) levels.
    """
    id_type = units.schema["doc_id"].dataType.simpleString()
    depth = max(1, math.ceil(math.log2(max(2, units.count())) / FAN_IN_BITS))
    bits = F.xxhash64(F.lit(seed), "u.doc_id", "u.tie")
    band = F.least(F.lit(1023), F.floor(F.log(F.col("u.size").cast("double") + 1) * BANDS_PER_E)).cast("int")
    levels = [(band, F.shiftrightunsigned(bits, 64 - FAN_IN_BITS * (depth - k - 1)) if k + 1 < depth else F.lit(0))
              for k in range(depth)]
    levels += [(F.shiftright(band, by), F.lit(0)) for by in BAND_MERGES]
    fields = [F.col(c) for c in ("size", "tie", "doc_id", "source_id", "p")]
    left = units.select(F.struct(*fields, F.lit(None).cast("int").alias("copy")).alias("u"))
    decided = []
    for k, keys in enumerate(levels):
        groups = left.groupBy(F.col("u.source_id").alias("s"), *[x.alias(f"k{i}") for i, x in enumerate(keys)]).agg(
            F.sort_array(F.collect_list("u")).alias("units")
        )
        done = scratch.put(fold_duels(groups, id_type, seed + k), f"level{k}")
        decided.append(done.where("u.copy IS NOT NULL").select("u.*"))
        left = done.where("u.copy IS NULL")
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed - 1), "doc_id", "tie", "size"), 11) / F.lit(float(1 << 53))
    final = left.select("u.*").withColumn("copy", (chance < F.col("p")).cast("int"))
    for x in decided:
        final = final.unionByName(x)
    return final


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """How often each row of docs is taken: doc_id, tie, source_id, size, source_size, target, copies, taken.

    size is the number of words (null text: 0), taken = copies * size; copies are 0 to max_copies. Reads doc_id,
    source and text. Sources of no words have target 0. tie is a hash of id and text; rows that agree in it, the
    source and the size are alike. The same rows give the same result whatever their order or partitions.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mix")
    rows = scratch.put(docs.select(
        "doc_id", "source", F.xxhash64("doc_id", "text").alias("tie"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ), "rows")
    targets = scratch.put(source_targets(rows, weights, max_copies), "targets")
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.lit(max_copies), F.floor(per + EPS)).cast("int")
    shared = targets.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), per - F.col("whole")))
    rows = attach(rows, shared, ["source"]).drop("source")
    split = (F.col("size") > 0) & (F.col("p") > EPS) & (F.col("whole") < max_copies)
    units = rows.where(split).select("size", "tie", "doc_id", "source_id", "p")
    rounded = pivotal_rounding(units, scratch).select("size", "tie", "doc_id", "source_id", "copy").unionByName(
        rows.where(~split).select("size", "tie", "doc_id", "source_id", F.lit(0).alias("copy"))
    )
    return attach(rounded, shared.drop("source"), ["source_id"]).select(
        "doc_id", "tie", "source_id", "size", "source_size", "target", (F.col("whole") + F.col("copy")).alias("copies"),
        ((F.col("whole") + F.col("copy")) * F.col("size")).cast("long").alias("taken"),
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as mix() says, in the columns of docs, other columns and their values untouched.

    Rows that agree in id and text share their copies out in the order of a hash of the whole row; columns may be of any
    type and name.
    """
    scratch, key = Scratch(docs.sparkSession, "taken"), ["doc_id", "tie"]
    decided = mix(docs, **options).groupBy(*key).agg(F.sum("copies").alias("total"), F.count("*").alias("rows"))
    decided = scratch.put(decided.where("total > 0"), "copies")
    found = attach(held(docs, doc_id=F.col("doc_id"), tie=F.xxhash64("doc_id", "text")), decided, key, "inner")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(F.to_json(F.struct("__row")))))
    share = F.expr("total div rows + int(nth <= total % rows)")
    single = found.where("rows = 1").select("__row", F.col("total").alias("times"))
    several = found.where("rows > 1").withColumn("nth", nth).select("__row", share.alias("times"))
    return single.unionByName(several).where("times > 0").select(
        "__row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("__row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
