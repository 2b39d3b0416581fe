import json

import pytest
from pyspark.sql import functions as F

from compassframe.functions import text as X
from compassframe.operators import alignment as A
from compassframe.operators import catalog as C
from compassframe.plans import inputs as I
from compassframe.sources import catalogs, evidence as S


def test_evidence_round_trip_and_committed_split(spark, sf, tmp_path):
    docs = I.table(spark, sf, "documents").select(
        F.concat(F.lit("k"), "doc_id").alias("key"), F.col("doc_id").cast("string").alias("prompts_id"), F.col("text").alias("original_prompt"),
        F.create_map(F.lit("m"), F.struct(F.lit(5).cast("bigint").alias("actual_token_count"), F.lit(0.5).alias("correctness_score"))).alias("models"),
    )
    docs = docs.withColumn("fingerprint", X.fingerprint(F.col("original_prompt"))).withColumn(
        "split", X.stable_split(F.col("fingerprint"), "s|", ("development", "validation", "hidden_test"))
    )
    path = str(tmp_path / "ev")
    manifest = {r.split: r for r in S.write_partitions(docs, path).collect()}
    assert manifest["hidden_test"].persisted is False
    back = S.read_evidence(spark, path)
    assert back.count() == docs.where("split <> 'hidden_test'").count()
    assert S.evidence_problems(back, ["m"], ["key"]).isEmpty()
    assert not S.evidence_problems(back, ["m", "other"], ["key"]).isEmpty()
    files = S.file_digests(spark, path + "/split=validation/*.json")
    assert S.verify_files(spark, path + "/split=validation/*.json", files).isEmpty()
    wrong = files.withColumn("sha256", F.lit("0"))
    assert S.verify_files(spark, path + "/split=validation/*.json", wrong).count() == files.count()


def test_malformed_evidence_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"key": "a", "models": {}}\n{broken\n')
    with pytest.raises(Exception):
        S.read_evidence(spark, str(tmp_path / "x.json")).collect()


def test_judge_csv_reads_allowed_columns_only(spark, sf, tmp_path):
    src = I.table(spark, sf, "documents").select(
        F.col("doc_id").alias("ordinal"), F.concat(F.lit(" k"), "doc_id").alias("key"), F.col("doc_id").alias("prompts_id"),
        F.col("text").alias("original_prompt"), F.lit(7).alias("actual_token_count"), F.lit(0.25).alias("correctness_score"),
        F.lit("SECRET answer").alias("golden_answer"),
    )
    path = str(tmp_path / "csv")
    src.write.option("header", True).option("escape", '"').csv(path)
    rows = S.read_judge_csv(spark, path, 10, 19)
    assert rows.columns == S.JUDGE_COLUMNS and rows.count() == 10
    assert rows.where("ordinal = 12").first().key == "k12"
    text = {r.doc_id: r.text for r in I.table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert all(r.original_prompt.split() == text[r.ordinal].split() for r in rows.collect())
    with pytest.raises(ValueError, match="missing required columns"):
        src.drop("key").write.option("header", True).csv(path + "2")
        S.read_judge_csv(spark, path + "2")


def test_pages_and_battle_prompts(spark, tmp_path):
    row = {"id": 1, "model_a": "s", "model_b": "e", "prompt": '["one", {"content": "two"}]', "winner_model_a": 1, "winner_model_b": 0, "winner_tie": 0}
    full = {"offset": 0, "num_rows_total": 200, "rows": [{"row_idx": i, "row": {**row, "id": i}} for i in range(100)]}
    short = {"offset": 100, "num_rows_total": 200, "rows": full["rows"][:99]}
    (tmp_path / "p.json").write_text(json.dumps(full) + "\n" + json.dumps(short) + "\n")
    pages = S.read_pages(spark, str(tmp_path / "p.json"))
    assert [(r.offset, r.problem) for r in S.page_problems(pages, 200).collect()] == [(100, "short_page")]
    assert S.page_problems(pages, 500).count() == 2
    rows = X.with_battle_prompt(S.page_rows(pages.where("offset = 0")).withColumnRenamed("prompt", "raw"), "raw", "prompt")
    out = A.battle_labels(rows, ("s", "e"))
    assert out.where("label = 'strong'").count() == 100 and out.first().prompt == "one\ntwo"
    plain = spark.createDataFrame([("  just text ",), ('"quoted"',), ("a b\r\nc",)], "raw string")
    assert [r.p for r in X.with_battle_prompt(plain, "raw", "p").collect()] == ["just text", "quoted", "a\nb\nc"]


def test_catalog_documents(spark, tmp_path):
    rows = C.neutral_catalog(spark).toJSON().collect()
    doc = {"spec_version": "1.0", "catalog_version": "v1", "sequence": 1, "observed_at": "2024-01-01T00:00:00Z",
           "expires_at": "2024-03-01T00:00:00Z", "configurations": [json.loads(r) for r in rows]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    configs = catalogs.read_configurations(spark, str(tmp_path / "c.json"))
    assert configs.count() == 10 and C.configuration_violations(configs).isEmpty()
    assert C.document_violations(catalogs.read_documents(spark, str(tmp_path / "c.json"))).isEmpty()
    s = C.summarize(configs, F.lit("2024-02-20").cast("timestamp")).first()
    assert s.freshness_status == "aging" and s.providers == sorted(set(s.providers)) and s.configuration_count == 10
    broken = configs.withColumn("prior_uncertainty", F.lit(2.0)).withColumn("configuration_id", F.lit("same-id"))
    rules = {r.rule for r in C.configuration_violations(broken).collect()}
    assert rules == {"prior_uncertainty_range", "configuration_id_unique"}


def test_normalisers(spark):
    df = spark.createDataFrame([(" Straße\r\nﬁx\u0000 ",)], "t string")
    r = df.select(X.canonical(F.col("t")).alias("c"), X.normalize_nfc(F.col("t")).alias("n"),
                  (X.fingerprint(F.col("t")) == X.fingerprint(F.lit("Straßeﬁx"))).alias("same")).first()
    assert (r.c, r.same) == ("strasse fix", True)
    assert r.n.startswith("Straße\nﬁx")


def coverage(spark, pages, end):
    df = spark.createDataFrame(pages, "offset bigint, n int")
    return sorted((tuple(r) for r in S.page_coverage(df, end).collect()), key=str)


def test_page_coverage_names_every_fault(spark, monkeypatch):
    whole = [(k * 100, 100) for k in range(40)]
    for pages in (1, 100_000):
        monkeypatch.setattr(S, "COVER_PAGES", pages)
        assert coverage(spark, whole, 4000) == []
        assert coverage(spark, [p for p in whole if p[0] not in (0, 700, 800, 3900)], 4000) == sorted(
            [("missing", 0, 100), ("missing", 700, 900), ("missing", 3900, 4000)], key=str)
        assert coverage(spark, [*whole, (300, 100), (500, 250), (None, 3)], 3950) == sorted(
            [("repeated", 300, 400), ("overlap", 500, 600), ("overlap", 600, 700), ("overlap", 700, 750), ("beyond", 3950, 4000),
             ("unplaced", None, None)], key=str)
        assert coverage(spark, [], 250) == [("missing", 0, 250)]
    short = [(k * 100, 100 if k != 3 else 60) for k in range(5)]
    found = S.page_coverage(spark.createDataFrame(short, "offset bigint, n int"), 700)
    assert sorted(r.offset for r in S.pages_to_fetch(found).collect()) == [300, 500, 600]
    rows = spark.createDataFrame([(0, [1, 2])], "offset bigint, rows array<int>")
    assert [tuple(r) for r in S.page_coverage(rows, 2).collect()] == []
