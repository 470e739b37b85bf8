"""The persisted inverted index against BM25 computed from the texts."""

import random

import pytest
from pyspark.sql import functions as F
from tessera.operators import search, textindex

WORDS = ["alpha", "beta", "gamma", "delta", "common", "often", "seldom"]


def rows_of(df):
    return sorted((r[0], r.matched, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = []
    for i in range(3000):
        words = ["common"] * rng.randint(1, 9) + rng.choices(WORDS, [1, 2, 3, 4, 200, 90, 1], k=rng.randint(1, 30))
        texts.append((i, " ".join(words) if i % 7 else None))
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def root(spark, docs, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('index')}"
    textindex.add(spark, root, docs)
    return root


@pytest.mark.parametrize("mode", ["or", "and", "auto"])
@pytest.mark.parametrize("terms", [["alpha", "often"], ["nowhere", "beta"], ["common"]])
def test_matches(spark, docs, root, mode, terms):
    want = rows_of(search.bm25(docs, "doc_id", "text", terms, mode))
    assert rows_of(textindex.matches(spark, root, terms, mode)) == want


@pytest.mark.parametrize("terms, k", [(["common"], 5), (["alpha", "common"], 20), (["alpha", "seldom", "often"], 7), (["nowhere"], 3), (["common", "often"], 5000)])
def test_the_best(spark, docs, root, terms, k):
    every = search.bm25(docs, "doc_id", "text", terms, "or").select("doc_id", F.round("score", 6).alias("score"))
    want = [tuple(r) for r in every.orderBy(F.desc("score"), "doc_id").limit(k).collect()]
    assert [(r.doc_id, r.score) for r in textindex.top(spark, root, terms, k).collect()] == want


def test_the_best_leave_blocks_out(spark, root):
    least = textindex.cutoffs(spark, root, ["common"], 5)["common"]
    blocks = textindex._blocks(spark, textindex.state(spark, root), ["common"])
    assert 0 < blocks.where(F.col("impact") >= least).count() < blocks.count()


def test_other_buckets_are_not_read(spark, root):
    plan = textindex.matches(spark, root, ["alpha"], "or")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert f"bucket#" in plan and "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,alpha)" in plan


def test_updates_are_as_good_as_new(spark, docs, tmp_path):
    root = f"file://{tmp_path}"
    old = docs.where("doc_id < 2000").withColumn("text", F.lit("alpha beta alpha"))
    textindex.add(spark, root, old)
    textindex.add(spark, root, docs.where("doc_id >= 1000"))
    textindex.add(spark, root, docs.where("doc_id < 1500"))
    want = rows_of(search.bm25(docs, "doc_id", "text", ["alpha", "often"], "or"))
    assert textindex.state(spark, root)["gone"] and textindex.state(spark, root)["docs"] == 3000
    assert rows_of(textindex.matches(spark, root, ["alpha", "often"], "or")) == want
    df = {r.term: r.df for r in textindex.vocabulary(spark, root).collect()}
    top = [tuple(r) for r in textindex.top(spark, root, ["alpha", "often"], 9).collect()]
    state = textindex.merge(spark, root)
    assert len(state["segments"]) == 1 and not state["gone"] and state["docs"] == 3000 and textindex.vacuum(spark, root) == 3
    assert rows_of(textindex.matches(spark, root, ["alpha", "often"], "or")) == want
    assert {r.term: r.df for r in textindex.vocabulary(spark, root).collect()} == df
    assert [(r[0], r[2]) for r in textindex.top(spark, root, ["alpha", "often"], 9).collect()] == [(r[0], r[2]) for r in top]


def test_versions(spark, docs, tmp_path):
    root = f"file://{tmp_path}"
    few = docs.where("doc_id < 5")
    textindex.add(spark, root, few)
    with pytest.raises(Exception, match="(?i)exist"):
        textindex._commit(spark, root, textindex.state(spark, root))  # that number is taken
    (tmp_path / "versions" / "00000002.json").write_text('{"version": 2, "segm')  # a writer died
    assert textindex.state(spark, root)["version"] == 1 and textindex.repair(spark, root) and not textindex.repair(spark, root)
    assert textindex.add(spark, root, few)["docs"] == 5
    with pytest.raises(ValueError):
        textindex.add(spark, f"{root}/other", few.union(few))


def test_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([("a", "One two, ONE"), ("b", None), ("c", ""), (None, "one"), ("d", "two " * 40000)], "id string, body string")
    root = f"file://{tmp_path}"
    assert textindex.add(spark, root, docs, "id", "body")["docs"] == 4
    assert {(r.id, r.matched) for r in textindex.matches(spark, root, ["one", "two", "one"], "or", "id").collect()} == {("a", 2), ("d", 1)}
    assert textindex.add(spark, f"{root}/empty", docs.limit(0), "id", "body")["docs"] == 0
    assert textindex.vocabulary(spark, root).count() == 2


def test_recall(spark, tmp_path):
    entries = spark.createDataFrame([(1, "deploy the cache", 10), (2, "cache of the deploy, cache", 20), (3, "100%_sure", 30), (4, "100 percent sure", 40)], "doc_id long, text string, at long")
    root = f"file://{tmp_path}"
    textindex.add(spark, root, entries)
    found = textindex.recall(spark, root, entries, "cache deploy", "at").collect()
    assert {r.doc_id for r in found} == {1, 2} and found[0].score >= found[1].score
    assert [r.doc_id for r in textindex.recall(spark, root, entries, "%_", "at").collect()] == [3]
    assert [r.doc_id for r in textindex.recall(spark, root, entries, "ercent s", "at").collect()] == [4]
    assert textindex.recall(spark, root, entries, "  ", "at").count() == 0


def test_chunks_group_what_is_shuffled(spark, monkeypatch):
    """a chunk of texts is one row for each of its terms, not one for each document and term; words are those of a split by text."""
    import re

    import pyarrow as pa

    texts = ["the cat the", None, "", "catthe ßthe", "the", "é", "x" * 300, "the-cat. caté", " cat"]
    batch = pa.RecordBatch.from_arrays([pa.array([i + 10 for i in range(len(texts))]), pa.array(texts)], names=["key", "text"]).slice(1)
    want = {(i + 10, w, len(ws), ws.count(w)) for i, t in enumerate(texts) if i for ws in [[x for x in re.split(textindex.PATTERN, t or "") if x]] for w in ws}
    for most in (8 << 20, 5):
        monkeypatch.setattr(textindex, "CHUNK", most)
        rows = [r for b in textindex._grouped(iter([batch])) for r in b.to_pylist()]
        assert sorted((k, r["term"], n, f) for r in rows for k, f, n in zip(r["keys"], r["tfs"], r["lens"])) == sorted(want)
        if most > 5:
            assert len(rows) == len({r["term"] for r in rows})
    assert [r for b in textindex._measured(iter([batch])) for r in b.column(1).to_pylist()] == [None, 0, 2, 1, 0, 1, 3, 1]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_merge_moves_blocks_not_postings(spark, tmp_path, kind, monkeypatch):
    """replaced documents are left out where the blocks are cut anew; no posting is a row of its own."""
    monkeypatch.setattr(textindex, "SLICE", 500)  # several slices
    docs = spark.range(400).select(F.col("id").cast(kind).alias("doc_id"), F.concat(F.lit("often of "), F.expr("repeat('seldom ', int(id % 5))"), F.when(F.col("id") % 50 == 0, "rare").otherwise("")).alias("text"))
    root = f"file://{tmp_path}"
    textindex.add(spark, root, docs.withColumn("text", F.lit("often often")))
    textindex.add(spark, root, docs.where("doc_id % 3 > 0"))
    textindex.add(spark, root, docs.where("doc_id % 3 = 0 OR doc_id > 300"))
    monkeypatch.setattr(textindex, "_hits", None)
    textindex.merge(spark, root)
    monkeypatch.undo()
    terms = ["often", "seldom", "rare"]
    assert rows_of(textindex.matches(spark, root, terms, "or")) == rows_of(search.bm25(docs, "doc_id", "text", terms, "or"))
    assert {r.term: r.df for r in textindex.vocabulary(spark, root).collect()} == {"often": 400, "of": 400, "seldom": 320, "rare": 8}
