"""The Poisson bootstrap against resamples that are made row by row."""

import numpy as np
from pyspark.sql import functions as F
from tessera.operators import relations


def test_against_plain_sums(spark):
    rng = np.random.default_rng(3)
    values = rng.exponential(2.0, 900)
    df = spark.createDataFrame([(f"q{i}", float(v)) for i, v in enumerate(values)] + [("none", None)], "q string, v double")
    keys = np.array([r[0] for r in df.where("v IS NOT NULL").select(F.xxhash64("q")).collect()]).view(np.uint64)
    w = relations.poisson_weights(keys, 200, 7)
    means = [sum(w[i, d] * values[i] for i in range(900)) / w[:, d].sum() for d in range(200)]
    for parts in (1, 5):
        got = relations.bootstrap(df.repartition(parts), "q", "v").first()
        assert np.allclose([got.low, got.high], np.percentile(means, [2.5, 97.5]))
    assert got.low < values.mean() < got.high


def test_weights_are_poisson():
    w = relations.poisson_weights(np.arange(20000), 20, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03


def test_nothing_to_draw_from(spark):
    assert tuple(relations.bootstrap(spark.createDataFrame([], "q string, v double"), "q", "v").first()) == (None, None)
