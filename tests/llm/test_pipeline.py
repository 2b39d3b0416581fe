from collections import Counter

import corpus_pipeline
from tests.llm.llm_helpers import rows_of

from compassframe.llm import decontamination, jaccard_join
from compassframe.llm.common import Scratch


def test_stages_keep_the_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch, columns, counts = Scratch(spark, "t"), docs.columns, [docs.count()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(scratch.put(stage(spark, tables[-1], sf), name))
        counts.append(tables[-1].count())
        if name != names[-1]:
            assert tables[-1].columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows_of(tables[1])}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    assert all(n == 1 for n in Counter(r.component_id for r in rows_of(jaccard_join.near_duplicates(tables[2]))).values())
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert not any(r.contaminated for r in rows_of(decontamination.contamination(tables[3], bench)))
    assert max(Counter(r.doc_id for r in rows_of(tables[4])).values()) <= 3
    assert sorted(rows_of(corpus_pipeline.run(spark, sf))) == sorted(rows_of(tables[5]))
