import os

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now, counts = docs.columns, docs, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            now = corpus_pipeline.materialize(out, "test")
            counts.append(now.count())
    rows = out.collect()
    assert counts[0] < docs.count() and counts[1] < counts[0] and counts[2] <= counts[1] and len(rows) == counts[3]
    assert {"run", "tier", "shard"} <= set(out.columns)
    again = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.shard) for r in again.collect()) == sorted((r.doc_id, r.shard) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_are_registered():
    import __spark_entry__

    names = [q for q in __spark_entry__.queries() if q.startswith("op") or q == "pipeline"]
    assert len(names) == 14
