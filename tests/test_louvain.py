"""Rounds of Louvain on blocks: the labels of plain joins, whatever the blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import graph, louvain


def _by_joins(both, label, m, turn):
    """One round as joins of whole tables."""
    total = label.groupBy("c").agg(F.sum("k").alias("t"), F.count("*").alias("n"))
    near = both.join(label.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("w"))
    now = label.withColumnsRenamed({"c": "c0"}).join(total.toDF("c0", "t0", "n0"), "c0")
    own = F.col("c") == F.col("c0")
    gain = F.col("w") - F.col("k") * (F.col("t") - F.when(own, F.col("k")).otherwise(0.0)) / (2 * m)
    swap = (F.col("n") == 1) & (F.col("n0") == 1) & (F.col("c") > F.col("c0"))
    cand = near.join(now, "node").join(total, "c").withColumn("gain", F.when(own, gain).when(swap, None).otherwise(gain))
    top = cand.groupBy("node").agg(F.max(F.when(own, F.col("gain"))).alias("stay"), F.max_by("c", F.struct(F.col("gain"), -F.col("c"))).alias("to"), F.max("gain").alias("gain"))
    stay = F.coalesce("stay", -F.col("k") * (F.col("t0") - F.col("k")) / (2 * m))
    go = (F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2) & F.coalesce(F.col("gain") > stay + 1e-12, F.lit(False))
    return now.join(top, "node", "left").select("node", F.when(go, F.col("to")).otherwise(F.col("c0")).alias("c"), "k")


def _pairs(seed, nodes, n):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(n)})


def test_a_round_on_blocks_is_a_round_by_joins(spark):
    nodes = [*range(-20, 40), 2**60, 2**60 + 1, -(2**61)]
    e = [(a, b, float(1 + (a + b) % 3)) for a, b in _pairs(1, nodes, 200)]
    both = spark.createDataFrame([*e, *[(b, a, w) for a, b, w in e]], "a long, b long, w double")
    m = sum(w for *_, w in e)
    degree = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    want = have = degree.select("node", F.col("node").alias("c"), "k").localCheckpoint()
    for turn in range(4):
        want = _by_joins(both, want, m, turn).localCheckpoint()
        have, moved = graph._moved(both, have, m, turn, [(), (-5, 10, 11, 2**60)][turn % 2])
        have = have.localCheckpoint()
        rows = sorted(tuple(r) for r in have.collect())
        assert moved and rows == sorted(tuple(r) for r in want.collect())


def test_half_of_the_nodes_by_spark_hash(spark):
    nodes = [0, 1, -1, 2**62, -(2**63), 2**53 + 1]
    for number in (0, 7):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(nodes)], "i int, x long")
        want = [r.h for r in df.select("i", F.xxhash64("x", F.lit(number)).alias("h")).orderBy("i").collect()]
        assert louvain._hashed(np.array(nodes), number).astype("int64").tolist() == want


def test_blocks_do_not_change_communities(spark):
    pairs = [(a, b) for g in range(12) for a, b in _pairs(g, range(20 * g, 20 * g + 20), 60)] + _pairs(99, range(240), 60)
    df = spark.createDataFrame([(b, a, 2) for a, b in pairs], "a int, b int, w int")
    one = graph.communities(df)
    assert [f.dataType.simpleString() for f in one.schema] == ["int", "int"]
    rows = sorted(tuple(r) for r in one.collect())
    assert len(rows) == len({x for p in pairs for x in p}) and 8 <= len({c for _, c in rows}) <= 16
    for block in (900, 500):
        assert sorted(tuple(r) for r in graph.communities(df, rounds=24, block=block).collect()) == rows
    with pytest.raises(RuntimeError):
        graph.communities(df, levels=1, block=500)


def test_a_small_graph_is_not_a_table_for_each_round(spark, monkeypatch):
    names, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: names.append(name) or keep(df, name))
    df = spark.createDataFrame([(a, b, 1) for a, b in _pairs(5, range(200), 900)], "a long, b long, w long")
    assert graph.communities(df).count() == 200 and len(names) <= 3


def test_odd_weights_and_hubs(spark):
    edges = spark.createDataFrame([(1, 2, 1.5), (2, 1, 1.5), (3, 3, 9.0), (4, 5, None), (None, 1, 1.0), (6, 7, 0.0)], "a long, b long, w double")
    got = {r.node: r.community for r in graph.communities(edges).collect()}
    assert got == {1: 1, 2: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    star = spark.createDataFrame([(0, i, 1.0) for i in range(1, 400)], "a long, b long, w double")
    assert {r.community for r in graph.communities(star, block=100).collect()} == {r.community for r in graph.communities(star).collect()}
    with pytest.raises(TypeError):
        graph.communities(spark.createDataFrame([("x", "y", 1.0)], "a string, b string, w double"))
