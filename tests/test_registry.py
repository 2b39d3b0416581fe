import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compassframe.functions.profile import profile
from compassframe.plans import inputs as I
from compassframe.plans import profiling, registry
from tests.oracle_check import TABLES, canonical_rows

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql_twin(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    assert canonical_rows(df.columns, [tuple(r) for r in df.collect()]) == canonical_rows(
        [d[0] for d in cur.description], cur.fetchall()
    )


def test_every_query_of_the_core_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_variants_that_normalise_to_the_same_text_have_the_same_profile(spark, sf):
    rows = {r.variant: r for r in profiling.variant_stability(spark, sf).collect()}
    assert set(rows) == set(profiling.VARIANTS)
    assert rows["nfkc_equivalent"].stability == rows["outer_whitespace"].stability == 1.0
    assert all(math.isfinite(r.stability) and r.stability > 0.9 for r in rows.values())
    base = I.prompts(spark, sf).select("request_id", "prompt")
    same = profile(base).join(
        profile(base.withColumn("prompt", F.replace("prompt", F.lit("\n"), F.lit("\r\n")))).select(
            "request_id", F.col("task_family").alias("other")
        ),
        "request_id",
    )
    assert same.where("task_family = other").count() == base.count()
