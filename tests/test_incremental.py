"""Streams that stop and start again: skipping by state, totals that count each file once."""

import json
import time

import pytest
from pyspark.sql import functions as F
from tessera.streaming import accumulate, freshness

SCHEMA = "path string, sha string, mtime double, indexed double, parser string, gone boolean, seq long"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, ttl=None):
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    with freshness.rocks(spark):
        out = freshness.verdicts(source, ttl).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
        out.awaitTermination()
    return {(r.seq, r.key): r.verdict for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_skip_by_state(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [("a.py", "1", 100.0, 200.0, "p1", False, 1), ("b.py", "1", 100.0, 101.0, "p1", None, 1), ("c.py", "1", 0.0, 200.0, "p1", False, 1), (None, "1", 1.0, 1.0, "p1", False, 1)])
    assert run(spark, tmp_path) == {(1, "a.py"): "added", (1, "b.py"): "added", (1, "c.py"): "added"}
    # the stream starts again from its checkpoint: what it knows is in the state
    put(spark, f"{tmp_path}/in", [("a.py", "hidden", 100.0, 300.0, "p1", False, 2), ("b.py", "2", 100.0, 300.0, "p1", False, 2), ("c.py", "1", 0.0, 300.0, "p1", False, 2), ("a.py", "1", 150.0, 310.0, "p1", False, 3)])
    got = run(spark, tmp_path)
    assert [got[2, "a.py"], got[2, "b.py"], got[2, "c.py"], got[3, "a.py"]] == ["unchanged", "edited", "touched", "touched"]
    put(spark, f"{tmp_path}/in", [("a.py", "1", 150.0, 400.0, "p2", False, 4), ("B.py", "2", 100.0, 400.0, "p1", False, 4), ("c.py", None, None, None, None, True, 4), ("c.py", "1", 0.0, 400.0, "p1", False, 5), ("a.py", "0", 1.0, 1.0, "p0", False, 0), ("d.py", None, None, None, None, True, 4)])
    got = run(spark, tmp_path)
    assert [got[k] for k in [(4, "a.py"), (4, "b.py"), (4, "c.py"), (5, "c.py"), (0, "a.py"), (4, "d.py")]] == ["parser", "renamed", "removed", "added", "late", "unknown"]
    assert run(spark, tmp_path) == got  # nothing new


def test_state_that_expires(spark, tmp_path):
    """A stream with a time to live runs on until it is stopped."""
    put(spark, f"{tmp_path}/in", [("a.py", "1", 100.0, 200.0, "p1", False, 1)])
    got = {}

    def keep(batch, n):
        got.update({r.seq: r.verdict for r in batch.collect()})

    def waited(seq):
        until = time.monotonic() + 40
        while seq not in got and time.monotonic() < until:
            time.sleep(0.2)

    with freshness.rocks(spark):
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        query = freshness.verdicts(source, ttl=1000).writeStream.option("checkpointLocation", f"{tmp_path}/mark").foreachBatch(keep).start()
        try:
            waited(1)
            time.sleep(1.5)
            put(spark, f"{tmp_path}/in", [("a.py", "1", 100.0, 300.0, "p1", False, 2)])
            waited(2)
        finally:
            query.stop()
    assert got == {1: "added", 2: "added"}


@pytest.fixture
def census(spark, tmp_path):
    checks = {"not JSON": F.col("tool").isNull(), "negative": F.col("ms") < 0}
    return accumulate.Accumulator(spark, f"file://{tmp_path}/totals", ["tool"], {"calls": F.lit(1), "ms": F.col("ms")}, accumulate.first_reason(checks))


def lines(tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text("".join(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows))


def source(spark, tmp_path, per=1):
    text = spark.readStream.option("maxFilesPerTrigger", per).text(f"{tmp_path}/in")
    row = F.from_json("value", "tool string, ms long")
    return text.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), row.alias("r")).select("file", "r.*")


def totals(census):
    return {r.tool: (r.calls, r.ms) for r in census.totals("tool string, calls long, ms long").collect()}


def test_totals_count_each_file_once(spark, tmp_path, census, monkeypatch):
    lines(tmp_path, "a", [{"tool": "read", "ms": 5}, {"tool": "edit", "ms": 7}])
    lines(tmp_path, "b", [{"tool": "read", "ms": 1}, "torn {", "\n", {"tool": "read", "ms": 2}])
    census.run(source(spark, tmp_path), f"{tmp_path}/mark")
    assert totals(census) == {"read": (1, 5), "edit": (1, 7)}
    assert [tuple(r) for r in census.failed().collect()] == [("b", "not JSON")]
    # a batch dies between its sums and its commit; the rerun has the same number
    lines(tmp_path, "c", [{"tool": "read", "ms": 10}] * 3)
    commit = accumulate._commit

    def die(*a):
        raise RuntimeError("killed")

    monkeypatch.setattr(accumulate, "_commit", die)
    with pytest.raises(Exception):
        census.run(source(spark, tmp_path), f"{tmp_path}/mark")
    assert totals(census) == {"read": (1, 5), "edit": (1, 7)}
    monkeypatch.setattr(accumulate, "_commit", commit)
    census.run(source(spark, tmp_path), f"{tmp_path}/mark")
    assert totals(census) == {"read": (4, 35), "edit": (1, 7)}
    # a batch that was committed, but whose end Spark didn't note, runs again and counts once
    last = max(accumulate._commits(spark, census.root)["batch"])
    census.put(spark.createDataFrame([("c", "read", 10)] * 3, "file string, tool string, ms long"), last)
    assert totals(census) == {"read": (4, 35), "edit": (1, 7)}
    census.compact("tool string, calls long, ms long")
    assert totals(census) == {"read": (4, 35), "edit": (1, 7)} and census.failed().count() == 1
    census.put(spark.createDataFrame([("c", "read", 10)] * 3, "file string, tool string, ms long"), last)  # in the base already
    lines(tmp_path, "d", [{"tool": "edit", "ms": -1}, {"tool": "edit", "ms": 3}])
    lines(tmp_path, "e", [{"tool": "edit", "ms": 3}])
    census.run(source(spark, tmp_path), f"{tmp_path}/mark")
    assert totals(census) == {"read": (4, 35), "edit": (2, 10)}
    assert sorted(tuple(r) for r in census.failed().collect()) == [("b", "not JSON"), ("d", "negative")]


def test_no_files(spark, tmp_path, census):
    assert totals(census) == {} and census.failed().count() == 0
    census.compact("tool string, calls long, ms long")
    assert totals(census) == {}
