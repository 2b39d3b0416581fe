"""Prompt profiling as columns: task family, capabilities, tokens, difficulty, flags, uncertainty.

All lexicon terms are found in one zero-width scan per text. The scan stops at every word start,
looks ahead for the longest term there and looks behind for the rest of the clause (at most 48
characters), so a term and the words that may negate it come out of the same pattern. Zero-width
matches never swallow text, hence terms that overlap ("source code review") are all seen. Texts
without a term pay for one scan; everything else is evaluated only for texts with hits.

Nothing here shuffles: the profile of a row depends on that row alone.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compassframe.functions import lexicon as L
from compassframe.functions import text as X
from compassframe.functions.barrier import settle

ENTRY_TYPE = "array<struct<kind:string,label:string,rank:int,weight:double>>"
CHAINED_TERM = "step by step"  # the one term that can overlap itself


def _trie_pattern(terms: list[str]) -> str:
    """Alternation factored by shared leading characters, longest alternatives first."""
    root: dict = {}
    for term in terms:
        node = root
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = {}

    def literal(ch: str) -> str:
        return rf"[{L.SPACE}]+" if ch == " " else ("\\" + ch if not ch.isalnum() else ch)

    def render(node: dict) -> str:
        branches = [literal(ch) + render(child) for ch, child in node.items() if ch != ""]
        if "" not in node:
            return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        # a term ends here: prefer the longer ones, but only end at a word edge
        return "(?:" + "|".join([*branches, L.EDGE_R]) + ")" if branches else L.EDGE_R

    return render(root)


_CLAUSE = rf"[^{L.CLAUSE_BREAKS}]"
_BEHIND = (
    rf"(?<=((?<!{_CLAUSE}){_CLAUSE}{{0,{L.NEGATION_WINDOW - 1}}}|{_CLAUSE}{{{L.NEGATION_WINDOW}}}))"
)
# group 1 is the term, group 2 the clause before it; the match itself is empty
SCAN = rf"(?iu){L.EDGE_L}(?=({_trie_pattern(L.all_terms())})){_BEHIND}"
# group 1 is the clause, group 2 the term; the match consumes the term
CHAIN_SCAN = rf"(?iu){L.EDGE_L}{_BEHIND}({_trie_pattern([CHAINED_TERM])})"


def _hit_structs(terms: Column, clauses: Column) -> Column:
    spelled = F.transform(
        terms,
        lambda t: F.regexp_replace(
            F.translate(F.lower(t), "ı̇", "i"), rf"[{L.SPACE}]+", " "
        ),
    )
    return F.zip_with(
        spelled,
        clauses,
        lambda t, c: F.struct(t.alias("term"), c.rlike(L.NEGATED_TAIL).alias("negated")),
    )


def lexicon_hits(text: Column) -> Column:
    """array<struct<term, negated>> with one item per bounded occurrence of a lexicon term."""
    terms = F.regexp_extract_all(text, F.lit(SCAN), F.lit(1))
    clauses = F.regexp_extract_all(text, F.lit(SCAN), F.lit(2))
    return _hit_structs(terms, clauses)


def _any_literal(text: Column, literals: list[str]) -> Column:
    found = F.contains(text, F.lit(literals[0]))
    for literal in literals[1:]:
        found = found | F.contains(text, F.lit(literal))
    return found


def _occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal, without a regular expression."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))
    return (removed / len(literal)).cast("int")


def token_estimate(text: Column) -> Column:
    """Expected token count without a tokenizer; 0 for the empty text."""
    words = F.regexp_count(text, F.lit(rf"[^{L.SPACE}]+"))
    chars = F.length(text)
    punct = chars - F.length(F.translate(text, L.PUNCTUATION, ""))
    non_ascii = F.when(F.octet_length(text) == chars, 0).otherwise(
        F.length(F.regexp_replace(text, r"[\x00-\x7f]+", ""))
    )
    code = F.contains(text, F.lit("```")) | (
        _any_literal(text, L.CODE_LITERALS) & text.rlike(L.CODE_LIKE)
    )
    base = F.when(code, F.lit(3.2)).otherwise(F.lit(3.8))
    dense = non_ascii / F.greatest(F.lit(1), chars) > 0.15
    divisor = F.when(dense, F.least(base, F.lit(2.6))).otherwise(base)
    per_word = F.when(code, F.lit(1.45)).otherwise(F.lit(1.30))
    expected = F.greatest(
        F.lit(1), F.ceil(words * per_word).cast("int"), F.ceil(chars / divisor).cast("int")
    ) + F.ceil(punct / F.lit(12.0)).cast("int")
    return F.when(chars > 0, expected).otherwise(F.lit(0))


def _range_of(expected: Column) -> Column:
    low = F.greatest(F.lit(1), F.floor(expected * F.lit(0.82)).cast("int"))
    high = F.greatest(expected, F.ceil(expected * F.lit(1.30) + 8).cast("int"))
    one = F.lit(1)
    empty = expected == 0
    return F.struct(
        F.when(empty, one).otherwise(low).alias("low"),
        F.when(empty, one).otherwise(expected).alias("expected"),
        F.when(empty, one).otherwise(high).alias("high"),
    )


def with_token_range(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    return df.withColumn("_expected", token_estimate(F.col(text))).withColumn(
        out, _range_of(F.col("_expected"))
    ).drop("_expected")


def privacy_flags(text: Column) -> Column:
    """Names of the sensitive-content patterns found, in fixed order."""
    lowered = F.lower(text)
    found = [
        F.when(_any_literal(lowered, L.PRIVACY_LITERALS[name]) & text.rlike(pattern), F.lit(name))
        for name, pattern in L.PRIVACY_PATTERNS
    ]
    return F.array_compact(F.array(*found))


def _scores_sql(entries: str) -> str:
    """Per family: the weights of its positive hits, added in lexicon order."""
    items = [
        f"""named_struct('label', '{family}', 'priority', {L.TASK_PRIORITY.index(family)}, 'score',
            aggregate(array_sort(transform(
                filter({entries}, e -> e.kind = 'task' AND e.label = '{family}' AND NOT e.negated),
                e -> struct(e.rank, e.weight))), 0D, (acc, e) -> acc + e.weight))"""
        for family in L.TASK_TERMS
    ]
    return f"array({', '.join(items)})"


def with_lexicon(df: DataFrame, norm: str) -> DataFrame:
    """Adds scores (map in lexicon order), capabilities, operation and negation counts."""
    lookup = F.from_json(F.lit(json.dumps(L.term_entries())), f"map<string,{ENTRY_TYPE}>")
    chain = F.regexp_extract_all(F.col(norm), F.lit(CHAIN_SCAN), F.lit(2))
    chain_clause = F.regexp_extract_all(F.col(norm), F.lit(CHAIN_SCAN), F.lit(1))
    none = F.array().cast("array<struct<term:string,negated:boolean>>")
    scan = F.regexp_extract_all(F.col(norm), F.lit(SCAN), F.lit(1))
    hits = (
        df.withColumn("_terms", scan)
        .withColumn(
            "_hits",
            F.when(
                F.size("_terms") > 0,
                _hit_structs(
                    F.col("_terms"), F.regexp_extract_all(F.col(norm), F.lit(SCAN), F.lit(2))
                ),
            ).otherwise(none),
        )
        .withColumn(
            "_hits",
            F.when(
                F.exists("_hits", lambda h: h.term == CHAINED_TERM),
                F.concat(
                    F.filter("_hits", lambda h: h.term != CHAINED_TERM),
                    _hit_structs(chain, chain_clause),
                ),
            ).otherwise(F.col("_hits")),
        )
        .withColumn(
            "_entries",
            F.flatten(
                F.transform(
                    "_hits",
                    lambda h: F.transform(
                        F.coalesce(
                            F.try_element_at(lookup, h.term), F.array().cast(ENTRY_TYPE)
                        ),
                        lambda e: F.struct(
                            e.kind.alias("kind"),
                            e.label.alias("label"),
                            e["rank"].alias("rank"),
                            e.weight.alias("weight"),
                            h.negated.alias("negated"),
                        ),
                    ),
                )
            ),
        )
    )
    on = F.transform(
        F.filter("_entries", lambda e: (e.kind == "capability") & ~e.negated), lambda e: e.label
    )
    return (
        hits.withColumn("task_scores", F.expr(_scores_sql("_entries")))
        .withColumn("capabilities", F.array_sort(F.array_distinct(F.concat(F.array(F.lit("text")), on))))
        .withColumn(
            "operation_count",
            F.size(
                F.array_distinct(
                    F.transform(F.filter("_entries", lambda e: e.kind == "verb"), lambda e: e.label)
                )
            ),
        )
        .withColumn("negated_matches", F.size(F.filter("_entries", lambda e: (e.kind != "verb") & e.negated)))
        .drop("_terms", "_hits", "_entries")
    )


def _with_choice(norm: DataFrame) -> DataFrame:
    """Adds task family and required capabilities of ``_norm``, and what they come from."""
    scored = with_token_range(with_lexicon(norm, "_norm"), "_norm", "token_range")
    best = F.get("_ranked", F.lit(0))
    second = F.get("_ranked", F.lit(1))
    ranked = (
        scored.withColumn(
            "_ranked",
            F.transform(
                F.array_sort(
                    F.transform(
                        "task_scores",
                        lambda s: F.struct((-s.score).alias("n"), s.priority.alias("p"), s.label.alias("l")),
                    )
                ),
                lambda s: F.struct(s.l.alias("label"), (-s.n).alias("score")),
            ),
        )
        .withColumn(
            "required_capabilities",
            F.when(
                F.col("token_range.high") > 24000,
                F.array_sort(F.array_union("capabilities", F.array(F.lit("long_context")))),
            ).otherwise(F.col("capabilities")),
        )
    )
    counted = ranked.withColumn("best_score", best.score).withColumn("second_score", second.score)
    return counted.withColumn(
        "task_family", F.when(F.col("best_score") == 0, "general").otherwise(best.label)
    ).withColumn("active_tasks", F.size(F.filter("task_scores", lambda s: s.score >= 1.5)))


def choice(df: DataFrame, text: str = "prompt") -> DataFrame:
    """Adds the profile's task_family and required_capabilities alone; NULL texts are not profiled."""
    chosen = _with_choice(df.withColumn("_norm", X.nfkc(F.col(text))))
    added = ["task_family", "required_capabilities"]
    return settle(chosen.select(*df.columns, *added), added)


def profile(df: DataFrame, text: str = "prompt") -> DataFrame:
    """Adds every profile column to ``df``; the text column itself is left as it was.

    Works on batch and streaming frames alike.
    """
    # Both Unicode forms first: a Python UDF further up would make the optimizer merge the steps
    # between them and repeat their expressions.
    norm = df.withColumns(
        {"_norm": X.nfkc(F.col(text)), "_folded": X.nfkc_casefold(F.col(text))}
    )
    n = F.col("_norm")
    folded = F.col("_folded")
    hard = sum((F.when(F.contains(folded, F.lit(m)), 1).otherwise(0) for m in L.HARD_MARKERS), F.lit(0))
    structure = (
        F.regexp_count(n, F.lit(rf"(?md)^[{L.SPACE}]*(?:[-*]|\p{{Nd}}+[.)])[{L.SPACE}]+"))
        + _occurrences(n, "```")
        + F.least(F.lit(3), _occurrences(n, "\n\n"))
    )
    base = (
        _with_choice(norm)
        .withColumn("privacy_flags", privacy_flags(n))
        .withColumn("hard_markers", hard)
        .withColumn("structure_markers", structure)
        .withColumn("stripped_length", F.length(X.strip(n)))
    )
    high = F.col("token_range.high")
    complexity = (
        F.col("hard_markers") * 2
        + F.least(F.col("operation_count"), F.lit(4))
        + F.least(F.col("structure_markers"), F.lit(4))
        + F.greatest(F.lit(0), F.size("required_capabilities") - 2)
        + F.greatest(F.lit(0), F.col("active_tasks") - 1)
    )
    margin = (F.col("best_score") - F.col("second_score")) / F.greatest(F.col("best_score"), F.lit(1.0))
    unknown = F.col("best_score") == 0
    contested = ~unknown & (F.col("second_score") > 0)
    short = F.col("stripped_length") < 28
    neg = F.col("negated_matches")
    added = [
        F.when(unknown, 0.50)
        .when(contested & (margin < 0.20), 0.30)
        .when(contested & (margin < 0.45), 0.15)
        .otherwise(0.0),
        F.when(short, 0.15).otherwise(0.0),
        F.when(neg > 0, F.least(F.lit(0.15), F.lit(0.04) * neg)).otherwise(0.0),
    ]
    uncertainty = F.lit(0.10)
    for part in added:
        uncertainty = uncertainty + part
    secondary = F.transform(
        F.filter(F.slice("_ranked", 2, 2), lambda s: s.score >= 1.5),
        lambda s: F.concat(F.lit("secondary_task_"), s.label),
    )
    codes = F.concat(
        F.array_compact(
            F.array(
                F.lit("boundary_lexical_profile"),
                F.when(unknown, "unknown_task_family")
                .when(contested & (margin < 0.20), "multiple_task_signals")
                .when(contested & (margin < 0.45), "secondary_task_signal"),
                F.when(short, "short_prompt"),
                F.when(neg > 0, "negated_requirement_detected"),
            )
        ),
        F.when(F.col("active_tasks") > 1, secondary).otherwise(F.array().cast("array<string>")),
        F.array_compact(
            F.array(
                F.when(
                    high >= F.greatest(F.lit(64.0), F.col("token_range.expected") * F.lit(1.2)),
                    "conservative_token_estimate",
                ),
                F.when(F.size("privacy_flags") > 0, "sensitive_content_detected"),
            )
        ),
    )
    done = (
        base.withColumn("complexity", complexity)
        .withColumn(
            "difficulty",
            F.when((high > 3000) | (F.col("complexity") >= 8), "high")
            .when((high > 650) | (F.col("complexity") >= 4), "medium")
            .otherwise("low"),
        )
        .withColumn("uncertainty", F.least(F.lit(1.0), uncertainty))
        .withColumn("reason_codes", F.array_distinct(codes))
        .withColumn("estimated_input_tokens", high)
        .drop("_norm", "_folded", "_ranked", "capabilities", "stripped_length")
    )
    return settle(done, [c for c in done.columns if c not in df.columns])


PROFILE_COLUMNS = [
    "task_family", "difficulty", "estimated_input_tokens", "required_capabilities",
    "privacy_flags", "uncertainty", "reason_codes",
]
