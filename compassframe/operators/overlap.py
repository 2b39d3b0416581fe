"""Overlap screening of evaluation prompts against reference prompts: duplicates, exact, fuzzy.

The fuzzy rule takes the first reference, in reference order, that is similar enough. References are looked
up through trigram lists: as many of a row's rarest ones as a match cannot do without, given that a similar
pair shares at least 90 % of its smaller side (an exact prefix filter, on the smaller side). The narrower
rule "the prompt's N rarest lists" and a token limit are options. How it stays linear-ish on skewed data:

* Copies of a reference collapse to the first one (only the first can be the answer) and keep their
  count, which decides how rare a trigram is.
* A similar pair shares at least 90 % of the smaller side's trigrams. A side with fewer trigrams known
  to the other table than that cannot be the smaller side of any match; pairs of two such rows, which is
  what shared boilerplate produces, are never formed.
* All trigrams of both tables meet in one shuffle, in parts of a fixed size, and only those that both
  have, about a fifth, go on.
* Pairs are compared in rounds, a prompt's lowest references first; trigram sets are fetched only for
  prompts that no lower reference has settled.
* Lists of trigrams that many prompts selected are split over tasks by a salt sized from their counts.
* Long lists (more than ``long_list`` references) are read in blocks of growing size, lowest reference
  first, and only for prompts that a lower reference has not already settled. In a cluster of near
  copies nearly every prompt is settled by the first block, so the cluster's pairs are never emitted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from compassframe.functions import text as X
from compassframe.functions.barrier import settle
from compassframe.operators.ordered import first_of_group, lookup, lookup_skewed
from compassframe.session import ensure_checkpoint_dir, written

# Fixed values of the screening rule.
MIN_FUZZY_TOKENS = 12
JACCARD = 0.82
CONTAINMENT = 0.92
LENGTH_RATIO = 0.50

#: What any similar pair shares of its smaller side: a Jaccard of J of sides no smaller than n leaves 2J/(1+J) n.
SHARED = min(2 * JACCARD / (1 + JACCARD), CONTAINMENT)

ROWS_PER_SALT = 20_000
#: Trigrams of one part of the shuffle in which they meet, so that it is sorted in memory.
ROWS_PER_PART = 2_000_000
#: References of a prompt compared in the first round, and how much each later round takes more.
FIRST_ROUND, ROUND_GROWTH = 4, 8


def features(df: DataFrame, text: str, token_limit: int | None = None) -> DataFrame:
    """Adds canonical_hash, n_tokens, shingles (empty below 12 tokens) and n_shingles, of whole texts."""
    base = df.withColumn("_canonical", X.canonical(F.col(text))).withColumn(
        "_tokens", X.word_tokens(F.col("_canonical"), token_limit)
    )
    shingled = base.withColumns(
        {
            "canonical_hash": F.sha2("_canonical", 256),
            "n_tokens": F.size("_tokens"),
            "shingles": F.when(
                F.size("_tokens") >= MIN_FUZZY_TOKENS, X.trigram_hashes(F.col("_tokens"))
            ).otherwise(F.array().cast("array<bigint>")),
        }
    ).withColumn("n_shingles", F.size("shingles"))
    return settle(
        shingled.drop("_canonical", "_tokens"), ["canonical_hash", "n_tokens", "shingles", "n_shingles"]
    )


def drop_duplicates_keep_lowest(rows: DataFrame, numeric_id: str, carry: str) -> DataFrame:
    """Adds ``kept``: the id kept for this canonical text, the numerically lowest."""
    return first_of_group(rows, "canonical_hash", numeric_id, carry, "kept", row_id=carry)


def first_references(references: DataFrame) -> DataFrame:
    """One row per distinct canonical reference text: its first row, and how many copies there are."""
    firsts = references.groupBy("canonical_hash").agg(
        F.min("ref_index").alias("ref_index"), F.count("*").alias("copies")
    )
    return references.join(firsts.drop("canonical_hash"), "ref_index")


def exact_matches(candidates: DataFrame, first: DataFrame) -> DataFrame:
    """Adds ``exact_source``, the source of the first reference with the same canonical text, or NULL."""
    named = first.select("canonical_hash", F.col("source").alias("exact_source"))
    return lookup_skewed(candidates, named, "canonical_hash", ["exact_source"], row_id="prompts_id")


def _known(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """(cid, rid, shingle, stat) of the trigrams both sides have; one of cid and rid is NULL.

    stat: rarity, lowest and highest reference, prompts and distinct references having the trigram.
    """
    none = lambda kind: F.lit(None).cast(kind)
    both = references.select(
        none("string").alias("cid"), F.col("ref_index").alias("rid"), "copies", F.explode("shingles").alias("shingle")
    ).unionByName(
        candidates.select(
            F.col("prompts_id").alias("cid"), none("bigint").alias("rid"), F.lit(0).cast("bigint").alias("copies"),
            F.explode("shingles").alias("shingle"),
        )
    )
    rows = sum(df.agg(F.sum("n_shingles")).first()[0] or 0 for df in (candidates, references))
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(max(parts, math.ceil(rows / ROWS_PER_PART)), "shingle")
    same = Window.partitionBy("shingle")
    stat = F.struct(
        F.sum("copies").over(same).alias("df"), F.min("rid").over(same).alias("first_ref"),
        F.max("rid").over(same).alias("last_ref"), F.count("cid").over(same).alias("n_candidates"),
        F.count("rid").over(same).alias("n_references"),
    )
    return dealt.select("cid", "rid", "shingle", stat.alias("stat")).where("stat.n_candidates > 0 AND stat.n_references > 0")


def _shared(known: DataFrame, rows: DataFrame, row_id: str) -> DataFrame:
    """The known trigrams of each row, with the row's sizes and its number of shared trigrams."""
    mine = known.where(F.col(row_id).isNotNull()).select(row_id, "shingle", "stat")
    return mine.join(rows, row_id).withColumn("shared", F.count("*").over(Window.partitionBy(row_id)))


def _salts() -> Column:
    return (F.lit(1) + F.floor(F.col("stat.n_candidates") / ROWS_PER_SALT)).cast("int")


def _similar(inter: Column, na: Column, nb: Column, ta: Column, tb: Column) -> dict[str, Column]:
    jaccard = inter / (na + nb - inter)
    containment = inter / F.least(na, nb)
    ratio = F.least(ta, tb) / F.greatest(ta, tb)
    return {"trigram_jaccard": jaccard, "trigram_containment": containment, "token_length_ratio": ratio}


def _pairs(selected: DataFrame, postings: DataFrame) -> DataFrame:
    """Candidate pairs of selected lists, each once, after every check that needs no trigram sets."""
    left = selected.withColumn("salt", F.pmod(F.xxhash64("cid"), _salts()).cast("int"))
    right = postings.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts() - 1))).drop("stat")
    possible = (
        (F.least("na", "nb") >= F.greatest("na", "nb") * JACCARD)
        | (F.least("ta", "tb") >= F.greatest("ta", "tb") * LENGTH_RATIO)
    ) & F.when(F.col("na") <= F.col("nb"), F.col("a_ok")).otherwise(F.col("b_ok"))

    def join(l: DataFrame, r: DataFrame) -> DataFrame:
        return l.join(r, ["shingle", "salt"]).where(possible & (F.col("rid") < F.coalesce("best", F.col("rid") + 1)))

    # rows that cannot be the smaller side only meet rows that can
    met = join(left.where("a_ok"), right).unionByName(join(left.where("NOT a_ok"), right.where("b_ok")))
    return met.select("cid", "rid").distinct()


def _verify(pairs: DataFrame, candidates: DataFrame, references: DataFrame) -> DataFrame:
    """First similar reference per prompt among the given pairs, lowest references first."""
    order = Window.partitionBy("cid").orderBy("rid")
    ranked = written(pairs.withColumn("_rank", F.row_number().over(order)), "overlap-pairs")
    most = ranked.agg(F.max("_rank")).first()[0] or 0
    best, lo, hi = None, 0, FIRST_ROUND
    while True:
        some = ranked.where((F.col("_rank") > lo) & (F.col("_rank") <= hi)).drop("_rank")
        if best is None:
            best = written(_compare(some, candidates, references), "overlap-first")
        else:
            # a prompt that has a match has its first: all lower references were compared in this or an earlier round
            found = _compare(some.join(best.select("cid"), "cid", "left_anti"), candidates, references)
            best = written(best.unionByName(found), "overlap-first")
        if hi >= most:
            return best
        lo, hi = hi, hi * ROUND_GROWTH


def _compare(pairs: DataFrame, candidates: DataFrame, references: DataFrame) -> DataFrame:
    """First similar reference per prompt, by the trigram sets of all the given pairs."""
    used = pairs.groupBy("rid").agg(F.count("*").alias("_uses"))
    asked = written(pairs.select("cid").distinct(), "overlap-asked")  # few ids, so that the others' trigrams stay where they are
    sets = references.select(
        F.col("ref_index").alias("rid"),
        F.struct("shingles", F.col("n_shingles").alias("n"), F.col("n_tokens").alias("t"), "source").alias("b"),
    ).join(used, "rid")
    with_ref = lookup(pairs, sets, "rid", "b", "b", weight="_uses", row_id="cid")
    rows = with_ref.join(
        candidates.select(
            F.col("prompts_id").alias("cid"),
            F.struct("shingles", F.col("n_shingles").alias("n"), F.col("n_tokens").alias("t")).alias("a"),
        ).join(asked, "cid", "left_semi"),
        "cid",
    ).select("cid", "rid", "a", "b", F.size(F.array_intersect("a.shingles", "b.shingles")).alias("inter"))
    measures = _similar(F.col("inter"), F.col("a.n"), F.col("b.n"), F.col("a.t"), F.col("b.t"))
    hit = rows.select("cid", "rid", F.col("b.source").alias("reference_source"), *[m.alias(k) for k, m in measures.items()])
    hit = hit.where(
        (F.col("trigram_jaccard") >= JACCARD)
        | ((F.col("trigram_containment") >= CONTAINMENT) & (F.col("token_length_ratio") >= LENGTH_RATIO))
    )
    return _first_match(hit)


def _first_match(hits: DataFrame) -> DataFrame:
    fields = ["rid", "reference_source", "trigram_jaccard", "trigram_containment", "token_length_ratio"]
    return hits.groupBy("cid").agg(F.min(F.struct(*fields)).alias("m")).select("cid", "m.*")


def _in_prefix(n: str, order: Window) -> Column:
    """Whether a list is among the rarest that the smaller side of a match cannot all miss.

    A smaller side of n trigrams shares ceil(SHARED n) with its match, so of any n - ceil(SHARED n) + 1 it shares
    one; those that the other table lacks count among these and are not here.
    """
    least = F.ceil(F.col(n) * SHARED - 1e-9)
    return F.row_number().over(order) <= F.col("shared") - least + 1


def fuzzy_matches(
    candidates: DataFrame, references: DataFrame, long_list: int = 10_000, rarest_lists: int | None = None
) -> DataFrame:
    """First similar reference per prompt: (cid, rid, reference_source, three measures).

    With ``rarest_lists`` only references in a prompt's so many rarest lists are looked at.

    ``candidates`` are unique prompts with features and prompts_id; ``references`` distinct first
    references with features, ref_index, copies and source.
    """
    ensure_checkpoint_dir(candidates.sparkSession)
    cand, refs = candidates.where("n_shingles > 0"), references.where("n_shingles > 0")
    # lists, selections and pairs are each used more than once: written once, then read
    lists = written(_known(cand, refs), "overlap-known")
    known = _shared(
        lists, cand.select(F.col("prompts_id").alias("cid"), F.col("n_shingles").alias("na"), F.col("n_tokens").alias("ta")), "cid"
    )
    rarest = lambda row: Window.partitionBy(row).orderBy("stat.df", "stat.first_ref", "shingle")
    if rarest_lists is None:
        chosen, b_ok = known.withColumn("a_ok", _in_prefix("na", rarest("cid"))), _in_prefix("nb", rarest("rid"))
    else:
        chosen = known.withColumn("a_ok", F.col("shared") >= F.col("na") * JACCARD).withColumn(
            "_r", F.row_number().over(rarest("cid"))).where(F.col("_r") <= rarest_lists)
        b_ok = F.col("shared") >= F.col("nb") * JACCARD
    selected = written(
        chosen.select("cid", "shingle", "stat", "na", "ta", "a_ok", F.lit(None).cast("bigint").alias("best")), "overlap-selected"
    )
    postings = written(_shared(
        lists, refs.select(F.col("ref_index").alias("rid"), F.col("n_shingles").alias("nb"), F.col("n_tokens").alias("tb")), "rid"
    ).select("rid", "shingle", "stat", "nb", "tb", b_ok.alias("b_ok")), "overlap-postings")

    is_long = F.col("stat.n_references") > long_list
    longest = selected.where(is_long).agg(F.max("stat.n_references")).first()[0]
    if longest is None:
        return _verify(_pairs(selected, postings), cand, refs)

    best = _verify(_pairs(selected.where(~is_long), postings.where(~is_long)), cand, refs)
    steps = math.ceil(math.log2(longest / long_list))
    place = (F.col("rid") - F.col("stat.first_ref")) / (F.col("stat.last_ref") - F.col("stat.first_ref") + 1)
    for step in range(steps + 1):
        start = 0.0 if step == 0 else 2.0 ** (step - 1 - steps)
        block = postings.where(is_long & (place >= start) & (place < 2.0 ** (step - steps)))
        first_in_block = F.col("stat.first_ref") + F.lit(start) * (
            F.col("stat.last_ref") - F.col("stat.first_ref") + 1
        )
        waiting = (
            selected.where(is_long).drop("best")
            .join(best.select("cid", F.col("rid").alias("best")), "cid", "left")
            .where(F.col("best").isNull() | (F.col("best") > first_in_block))
        )
        found = _verify(_pairs(waiting, block), cand, refs)
        best = written(_first_match(best.unionByName(found)), "overlap-best")
    return best


def screen(
    candidates: DataFrame, references: DataFrame, long_list: int = 10_000, rarest_lists: int | None = None,
    token_limit: int | None = None,
) -> DataFrame:
    """Every candidate with its exclusion reason, or 'eligible'. Carries no prompt text.

    candidates(key, prompts_id string, original_prompt); references(ref_index bigint, text, source).
    Precedence: duplicate of an earlier candidate, exact overlap, fuzzy overlap.
    """
    ensure_checkpoint_dir(candidates.sparkSession)
    # texts are tokenised once; later steps read the columns they need, and only fuzzy ones the trigrams
    cand = written(features(candidates, "original_prompt", token_limit).drop("original_prompt"), "overlap-candidates")
    refs = written(features(references, "text", token_limit).drop("text"), "overlap-references")
    marked = written(drop_duplicates_keep_lowest(
        cand.select("key", "prompts_id", "canonical_hash", F.col("prompts_id").cast("bigint").alias("_num")), "_num", "prompts_id"
    ), "overlap-marked")
    duplicate = F.col("kept") != F.col("prompts_id")
    unique = marked.where(~duplicate)
    groups = refs.groupBy("canonical_hash").agg(F.min("ref_index").alias("_first"), F.count("*").alias("_n"))
    exact = written(exact_matches(unique, first_references(refs.select("ref_index", "canonical_hash", "source"))), "overlap-exact")
    # what is left out, or counts more than once, is the smaller part: those ids are looked up, trigrams stay where they are
    settled = written(marked.where(duplicate).select("prompts_id").unionByName(
        exact.where(F.col("exact_source").isNotNull()).select("prompts_id")), "overlap-settled")
    repeats = groups.where("_n > 1")
    later = written(refs.select("ref_index", "canonical_hash").join(repeats, "canonical_hash").where("ref_index <> _first").select("ref_index"), "overlap-later")
    copies = written(repeats.select(F.col("_first").alias("ref_index"), F.col("_n").alias("_copies")), "overlap-copies")
    first = refs.join(later, "ref_index", "left_anti").join(copies, "ref_index", "left").withColumn("copies", F.coalesce("_copies", F.lit(1)))
    fuzzy = fuzzy_matches(cand.join(settled, "prompts_id", "left_anti"), first.drop("_copies"), long_list, rarest_lists)
    judged = exact.select("key", "prompts_id", "exact_source").join(
        fuzzy.withColumnRenamed("cid", "prompts_id"), "prompts_id", "left"
    )
    none = lambda kind: F.lit(None).cast(kind)
    kept_rows = judged.select(
        "key", "prompts_id",
        F.when(F.col("exact_source").isNotNull(), "development_exact_overlap")
        .when(F.col("rid").isNotNull(), "development_fuzzy_overlap")
        .otherwise("eligible").alias("reason"),
        none("string").alias("kept_prompts_id"),
        F.coalesce("exact_source", "reference_source").alias("reference_source"),
        "trigram_jaccard", "trigram_containment", "token_length_ratio",
    )
    repeated = marked.where(duplicate).select(
        "key", "prompts_id", F.lit("evaluation_exact_duplicate").alias("reason"),
        F.col("kept").alias("kept_prompts_id"), none("string").alias("reference_source"),
        none("double").alias("trigram_jaccard"), none("double").alias("trigram_containment"),
        none("double").alias("token_length_ratio"),
    )
    return kept_rows.unionByName(repeated)
