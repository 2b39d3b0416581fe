from pyspark.sql import functions as F

from compassframe.operators import alignment as A

SCHEMA = "ordinal bigint, key string, prompts_id string, original_prompt string, actual_token_count bigint, correctness_score double"


def test_what_is_null_agrees_with_nothing(spark):
    base = {1: ("k", "i", "same text"), 2: ("k", "i", "t"), 3: (None, "i", "t"), 4: ("k", None, "t"), 5: ("k", "i", None), 6: ("k", "i", "t"), 7: ("k", "i", "t")}
    other = base | {1: ("k", "i", "same  text"), 2: ("k", "i", None), 3: ("k", "i", "t"), 5: ("k", "i", "t")}
    del other[6]
    rows = lambda x: [(o, *v, 1, 0.5) for o, v in x.items()]
    sources = {"a": spark.createDataFrame(rows(base), SCHEMA), "b": spark.createDataFrame([*rows(other), (7, "k", "i", "t", 1, 0.5)], SCHEMA)}
    got = {r.ordinal: (r.verdict, r.differing_sources) for r in A.align(A.tag_sources(sources), 2).collect()}
    assert {o: v for o, (v, _) in got.items()} == {
        1: "aligned", 2: "text_mismatch", 3: "key_mismatch", 4: "id_mismatch", 5: "text_mismatch", 6: "missing_source", 7: "repeated_source"}
    assert got[2][1] == ["b"] and got[5][1] == ["a", "b"]


def test_prefix_reports_every_kind_of_fault_and_nothing_beyond_it(spark):
    schema = "ordinal long, key string, n int"
    snapshot = spark.createDataFrame([(0, "a", 1), (1, None, None), (2, "c", 3), (3, "d", None), (4, None, None)], schema)
    later = spark.createDataFrame(
        [(0, "a", 1), (1, None, None), (2, "c", None), (2, "c", 3), (3, "x", 4), (5, "in", 1), (9, "beyond", 1), (None, None, None)], schema)
    got = sorted(((r.ordinal, ",".join(r.differing)) for r in A.prefix_mismatches(later, snapshot, ["key", "n"], F.lit(6)).collect()), key=str)
    assert got == [(2, "repeated"), (3, "key,n"), (4, "missing_in_source"), (5, "missing_in_snapshot"), (None, "missing_in_snapshot")]
    assert (9, ["missing_in_snapshot"]) in [tuple(r) for r in A.prefix_mismatches(later, snapshot, ["key", "n"]).collect()]
