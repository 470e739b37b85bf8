"""Connected components: the jobs and broadcasts that they cost the driver, and stars within tasks."""

import random

import pyarrow as pa
from tessera.llm import common
from tessera.llm.common import Forest, connected, spanning


def batch(pairs):
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def test_settled_edges_are_written_once(spark, monkeypatch):
    written = []
    keep = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: written.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    stars = [(i, i // 10 * 10) for i in range(100)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(stars, "a long, b long"), "t").collect()}
    assert got == {i: i // 10 * 10 for i in range(100)}
    assert len(written) == 1  # one step more to see that nothing changes is a write, two counts and a difference
    path = [(i, i + 1) for i in range(40)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(path, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(41)}
    assert len(written) > 2 and not any("Broadcast" in plan for plan in written)


def test_stars_within_a_task():
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    whole = Forest(300)
    for a, b in pairs:
        whole.join(a, b)
    for most in (20, 10_000):  # started anew again and again, and in one go
        out = [p for b in spanning((batch(pairs[at : at + 10]) for at in range(0, 250, 10)), most) for p in zip(b["a"].to_pylist(), b["b"].to_pylist())]
        stars = Forest(300)
        for a, b in out:
            assert b < a
            stars.join(a, b)
        assert [stars.find(i) for i in range(300)] == [whole.find(i) for i in range(300)]
    assert dict(out) == {i: whole.find(i) for i in range(300) if whole.find(i) != i} and len(out) == len(dict(out))
    assert sum(b.num_rows for b in spanning(iter([]))) == 0
