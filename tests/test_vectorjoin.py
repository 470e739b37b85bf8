"""The cosine join against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import vectorjoin


def planted(n=1500, near=400, dim=48, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    at = rng.integers(0, n, near)
    step = rng.standard_normal((near, dim))
    step -= (step * base[at]).sum(1, keepdims=True) * base[at]
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    angle = np.arccos(rng.uniform(0.90, 1.0, near))[:, None]
    more = np.cos(angle) * base[at] + np.sin(angle) * step
    return np.concatenate([base, more * rng.uniform(0.1, 9, (near, 1))])


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").repartition(4)


def test_recall_and_precision(spark):
    v = planted()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    gram = u @ u.T
    want = {(i, j) for i, j in zip(*np.nonzero(gram >= 0.92)) if i != j}
    _, classes = vectorjoin.classes_of(frame(spark, v), "id", "vec", F.lit(True))
    got = {(r.asker, r.other) for r in vectorjoin.links(classes).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 500
    assert all((j, i) in got for i, j in got)


def test_the_promised_recall():
    for n in (100, 10**5, 10**9):
        bits, bands = vectorjoin.bands_of(n, 0.92, 0.98)
        assert 1 - (1 - (1 - math.acos(0.92) / math.pi) ** bits) ** bands >= 0.98


def test_slices_of_a_hot_bucket(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = np.concatenate([np.ones((1, 16)) + 0.01 * rng.standard_normal((300, 16)), rng.standard_normal((200, 16))])
    want = sorted(tuple(r) for r in vectorjoin.near_rows(frame(spark, v), "id", "vec", F.col("id") % 50 == 0).select("id", "n_links").collect())
    assert [n for i, n in want if i < 300] == [299] * 6
    monkeypatch.setattr(vectorjoin, "SLICE", 10)
    assert sorted(tuple(r) for r in vectorjoin.near_rows(frame(spark, v), "id", "vec", F.col("id") % 50 == 0).select("id", "n_links").collect()) == want


def test_equal_and_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [5.0, 0.1]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = sorted((r.id, r.n_links, r.n_equal, r.nearest, r.cosine and round(r.cosine, 4)) for r in vectorjoin.near_rows(df, "id", "vec", F.lit(True)).collect())
    one = (3, 2, 3, 0.9998)
    assert got == [(1, *one), (1, *one), (2, *one), (3, 3, 0, 1, 0.9998), (4, 0, 0, None, None)]
    assert vectorjoin.near_rows(df.limit(0), "id", "vec", F.lit(True)).count() == 0


@pytest.mark.parametrize("threshold", [0.8, 0.99])
def test_other_thresholds(spark, threshold):
    v = planted(400, 200, seed=5)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = ((u @ u.T >= threshold).sum(1) - 1).sum()
    got = vectorjoin.near_rows(frame(spark, v), "id", "vec", F.lit(True), threshold).agg(F.sum("n_links")).first()[0]
    assert 0.95 * want <= got <= want
