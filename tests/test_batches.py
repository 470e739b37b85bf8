"""Results that depend on how rows are batched, or on signs and halves of doubles."""

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import ledger, search, toolfilters
from tessera.sources import files as sources
from tessera.sources import markup


def test_rounding_keeps_the_sign_of_zero(spark):
    values = [-1e-7, 1e-7, -0.0, 0.5e-6, -0.1234565, 0.1234565, 1.0, float("nan")]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", search.rounded(F.col("x"), 6).alias("r")).collect()
    for x, r in rows:
        y = abs(x) * 1e6
        want = math.copysign((math.floor(y) + (y - math.floor(y) >= 0.5)) / 1e6, x) if x == x else x
        assert repr(r) == repr(want), x


def test_small_files_share_frames(spark, monkeypatch):
    """Frames don't grow with the number of files, nor are they one for each file."""
    files = spark.range(5000).select(F.col("id").cast("string").alias("path"), F.concat(F.lit("SF:a\nDA:1,"), "id", F.lit("\nDA:2,0\nend_of_record")).cast("binary").alias("content"))
    made = []
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda self, run, schema: made.append(run) or self)
    sources.parsed_rows(files, sources.coverage_rows, sources.COVERAGE)
    monkeypatch.undo()
    frames = list(made[0](iter([pd.DataFrame({"path": [str(i) for i in range(5000)], "content": [b"SF:a\nDA:1,%d\nDA:2,0\n" % i for i in range(5000)]})])))
    assert [len(f) for f in frames] == [8192, 1808] and frames[1].iloc[-1].tolist() == ["4999", "a", "line", 2, 0]
    rows = sources.parsed_rows(files, sources.coverage_rows, sources.COVERAGE)
    assert rows.agg(F.sum("hits"), F.count("*")).first() == (sum(range(5000)), 10_000)


def test_nodes_come_in_small_batches(spark, monkeypatch):
    made = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: made.append(run) or self)
    pages = spark.range(1).selectExpr("id", "'x' AS html")
    markup.nodes(pages, "id", "html")
    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "html": ["<p a='1'>x<b>y</b>"] * 1000})
    out = list(made[0](iter([batch])))
    assert max(b.num_rows for b in out) <= 200 and sum(b.num_rows for b in out) == 2000
    X.packed(pages.selectExpr("id", "html AS text"), "text")
    out = list(made[1](iter([pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": ["ab" * 50] * 1000})])))
    assert max(b.num_rows for b in out) <= 200 and sum(b.num_rows for b in out) == 1000


def test_tool_outputs_come_in_small_batches(spark, monkeypatch):
    made = []
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda self, run, schema: made.append(run) or self)
    toolfilters.filtered(spark.range(1).selectExpr("id", "'x' AS command", "'y' AS output"), "command", "output", ["id"])
    out = list(made[0](iter([pd.DataFrame({"id": range(1000), "command": ["git status"] * 1000, "output": ["a\n\nb"] * 1000})])))
    assert max(map(len, out)) <= 200 and sum(map(len, out)) == 1000 and set(out[-1]["filter"]) == {"git"}


def test_files_are_folded_without_a_group_each(spark):
    """Neither fold makes a pandas frame for each file; many files, also a null one, in few tasks."""
    hits = spark.range(3000).select(F.when(F.col("id") > 2, F.col("id") % 500).alias("file"), (F.col("id") * 7 % 40).alias("lo"), (F.col("id") * 7 % 40 + 2).alias("hi"), (F.col("id") % 9 / 10).alias("distance"), (F.col("id") % 5 == 0).alias("structural"))
    out = search.merge_nearby(hits)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert out.select("file").distinct().count() == 501 and out.agg(F.min("lo"), F.max("hi")).first() == (0, 41)
    ch = hits.selectExpr("'text' AS channel", "file", "if(structural, concat('s', lo), NULL) AS name", "lo", "hi", "lo AS rank")
    fused = search.fuse_channels(ch)
    assert "FlatMapGroups" not in fused._jdf.queryExecution().toString() and fused.select("file").distinct().count() == 501


def test_ranges_hold_no_hash_tables(spark):
    rows = spark.createDataFrame([("a", n) for n in (5, 1, 2, 2, 3, 9, 9, None, None)] + [("b", 4), ("c", None), (None, 7), (None, 8)], "k string, n long")
    out = ledger.ranges(rows, "k", "n")
    assert "HashAggregate" not in out._jdf.queryExecution().toString()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("a", None, None), ("a", 1, 3), ("a", 5, 5), ("a", 9, 9), ("b", 4, 4), ("c", None, None), (None, 7, 8)], key=repr)
