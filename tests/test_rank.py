import pytest
from pyspark.sql import functions as F

from compassframe.functions.profile import profile
from compassframe.operators import catalog as C
from compassframe.operators import rank as R
from compassframe.sources import tables as T

PROMPT = "Draft a friendly welcome note for new members of the club, please keep the tone warm."
SCHEMA = "request_id string, prompt string, objective string, privacy string, max_cost_usd double, latency_slo_ms int, min_quality double"


def listed(spark, rows, catalog=None):
    df = profile(spark.createDataFrame(rows, SCHEMA))
    return {r.request_id: r for r in R.recommend(df, catalog or C.neutral_catalog(spark)).collect()}


def test_constraints_scores_and_shortlist(spark):
    rows = [(o, PROMPT, o, "no_training", None, None, None) for o in R.OBJECTIVE_WEIGHTS]
    rows += [
        ("local", PROMPT, "balanced", "local_only", None, None, None),
        ("email", PROMPT + " Mail me at jo@example.org", "balanced", "standard", None, None, None),
        ("free", PROMPT, "balanced", "standard", 0.0, None, None),
        ("slow", PROMPT, "balanced", "standard", None, 10, None),
        ("floor", PROMPT, "balanced", "standard", None, None, 1.0),
    ]
    out = listed(spark, rows)
    for r in out.values():
        for pick in r.shortlist:
            assert pick.score == pytest.approx(sum(c.value for c in pick.contributions))
            assert 0.30 <= pick.confidence <= 0.92
    assert all(out[o].shortlist[0].pareto_efficient for o in R.OBJECTIVE_WEIGHTS)
    assert all(p.deployment == "local" for p in out["local"].shortlist)
    assert out["email"].effective_privacy == "no_training"
    assert all(p.cost.expected == 0 for p in out["free"].shortlist)
    assert out["slow"].status == out["floor"].status == "no_match"
    best = max((c for c in out["balanced"].assessed if not c.rejected_by), key=lambda c: c.quality)
    assert best.configuration_id in {p.configuration_id for p in out["balanced"].shortlist}


def test_ineligible_row_is_inert_and_ties_go_to_the_smaller_id(spark):
    cat = C.neutral_catalog(spark)
    rows = [("r", PROMPT, "balanced", "no_training", None, None, None)]
    base = listed(spark, rows, cat)["r"].shortlist
    hopeless = cat.where("configuration_id = 'alder-max'").withColumns(
        {"configuration_id": F.lit("aaa-hopeless"), "privacy": F.array(F.lit("standard")), "input_usd_per_million": F.lit(900.0)}
    )
    assert listed(spark, rows, cat.unionByName(hopeless))["r"].shortlist == base
    twin = cat.where("configuration_id = 'cedar-writer'")
    pair = twin.unionByName(twin.withColumn("configuration_id", F.lit("cedar-writer-b")))
    tied = listed(spark, rows, pair)["r"].shortlist
    assert [p.configuration_id for p in tied] == ["cedar-writer", "cedar-writer-b"]
    assert all(p.pareto_efficient for p in tied)


def test_ranking_does_not_shuffle_requests(spark):
    df = spark.createDataFrame([("r", PROMPT, "balanced", "standard", None, None, None)], SCHEMA)
    plan = R.recommend(profile(df), C.neutral_catalog(spark))._jdf.queryExecution().optimizedPlan().toString()
    main = "\n".join(line for line in plan.split("\n") if ":" not in line.split("Project")[0])
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in main.split("scalar-subquery")[0]


def test_catalog_size_is_checked(spark):
    row = C.neutral_catalog(spark).limit(1)
    big = row.drop("configuration_id").crossJoin(spark.range(501).select(F.concat(F.lit("cfg-"), "id").alias("configuration_id")))
    df = profile(spark.createDataFrame([("r", PROMPT, "balanced", "standard", None, None, None)], SCHEMA))
    with pytest.raises(Exception, match="at most 500"):
        R.recommend(df, big).collect()


def test_receipts_never_hold_the_prompt(spark, tmp_path):
    canary = "CANARY-7781 keep this out"
    df = profile(spark.createDataFrame([("r", PROMPT + canary, "balanced", "standard", None, None, None)], SCHEMA))
    rows = R.recommend(df, C.neutral_catalog(spark)).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    T.append(T.receipts_from(rows, "at", "v1"), str(tmp_path / "receipts"), "receipts")
    back = T.read(spark, str(tmp_path / "receipts"), "receipts")
    assert back.count() == 1 and T.canary_rows(back, "CANARY-7781").isEmpty()
