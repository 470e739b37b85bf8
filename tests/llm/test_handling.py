"""Clashing columns, keys of other types, empty tables, repeated commits, short benchmark items in the SQL."""

import collections
import os

import corpus_pipeline
import duckdb
import pytest

from tessera.llm import decontaminate, merkle, mixing, neardup, quality, queries, sharding
from tessera.llm.common import fresh

CLASH = "doc_id long, text string, lang string, source string, n_chars long, _score int, _row_of_docs int, _digest_of_text int, _shard int, _order int, _run int, _tier int, run int, tier int, shard int, id int, component_id int, h int, sid int"


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, *range(14)) for i, t in enumerate(texts)], CLASH)


def test_fresh(spark):
    df = spark.createDataFrame([(1, 2)], "a int, A_ int")
    assert fresh(df, "b") == "b" and fresh(df, "A") == "A__"


def test_stages_keep_clashing_columns(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(40))
    docs = clashing(spark, [words, words + " more", "other words here", None, "", "bench mark item of eight words in it"])
    spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "bench mark item of eight words in it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, str(tmp_path))
            rows = out.collect()
            assert out.columns[: len(df.columns)] == df.columns and len(set(out.columns)) == len(out.columns), name
            assert n < 4 and len(out.columns) == len(df.columns) or n == 4 and len(out.columns) == len(df.columns) + 3
            assert all(tuple(r)[5:19] == tuple(range(14)) for r in rows) and (df is docs or not rows)
    assert quality.scored(docs, *_model()).columns[-1] == "_score_"
    assert mixing.mixture(docs).columns[-2:] == ["_shard_", "_order_"]


def _model():
    import numpy as np

    table = np.zeros((quality.WORDS + quality.SHAPES, quality.DIM), np.float32)
    return table, quality.fit(np.zeros((0, 2 * quality.DIM + 3)), np.zeros(0), np.zeros(0, bool))


def test_keys_that_are_no_integers(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [("b", words), ("c", words + " x"), ("a", words), ("d", "lone words that nothing else has"), (None, words), ("e", ""), ("d", words + " y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == collections.Counter([("b", "a", False), ("c", "a", False), ("a", "a", True), ("d", "a", False), (None, None, True), ("e", "e", True), ("d", "a", False)])
    kept = {(r.doc_id, r.text) for r in neardup.deduplicated(docs).collect()}
    assert kept == {("a", words), ("d", "lone words that nothing else has"), ("e", "")}
    assert {(r.doc_id, r.n_edited_sections) for r in merkle.fingerprints(spark.createDataFrame([(1, "same"), (2, "sbme")], "doc_id long, text string")).collect()} == {(1, 1), (2, 1)}


def test_labels_that_disagree(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 9) for i in range(30)], "doc_id long, text string")
    both = [(i, i % 2, 0) for i in range(30)] + [(3, 0, 0), (5, 0, 0)]
    a = quality.classify(docs, spark.createDataFrame(both, "doc_id long, quality int, toxic int")).collect()
    b = quality.classify(docs, spark.createDataFrame(both[::-1], "doc_id long, quality int, toxic int")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_one_writer_wins_a_version(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    sharding.commit(spark, root, 1, {"version": 1, "base": None, "arrivals": []})
    with pytest.raises(RuntimeError):
        sharding.commit(spark, root, 1, {"version": 1, "base": "other", "arrivals": []})
    assert sharding.committed(spark, root)["base"] is None
    assert sorted(f for f in os.listdir(tmp_path / "s" / "commits") if not f.startswith(".")) == ["v00000001.json"]


def test_decontamination_sql_on_short_items(spark, tmp_path):
    docs = [(1, "one two three four five six seven eight nine"), (2, "So, FIVE six; done"), (3, "lone"), (4, None), (5, ""), (6, "a b c d e f g five six a b c"), (7, "c c c c")]
    items = [(1, "two three four five six seven eight nine"), (2, "five six"), (3, "lone"), (4, "c c c"), (5, None), (6, ""), (7, "five six a b c")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b)
    con = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", b)):
        df.write.parquet(f"{tmp_path}/{name}")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')")
    want = con.sql(queries.SQL["op10_decontaminate"])
    cols = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in cols) for r in want.fetchall())
    assert {r.doc_id: r.n_items for r in got.collect()} == {1: 2, 2: 1, 3: 1, 4: 0, 5: 0, 6: 2, 7: 1}


def test_tables_of_a_step_go_when_another_begins(spark):
    from tessera.llm.common import materialize, tables_of

    df = spark.range(5)
    with tables_of(spark, "one"):
        a = materialize(df, "a")
    with tables_of(spark, "one"):
        b = materialize(df, "b")
    outside = materialize(df, "c")
    assert a.count() == b.count() == 5
    files = [f.removeprefix("file://") for x in (a, b, outside) for f in x.inputFiles()[:1]]
    with tables_of(spark, "two"):
        pass
    assert [os.path.exists(f) for f in files] == [False, False, True]
