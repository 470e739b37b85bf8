"""Chunks by structure: packing, windows, symbols."""

import random

import pytest
from tessera.operators import structure


def test_packing():
    assert structure.packed([3, 3, 5, 20, 1, 9, 1], 10) == [(0, 1), (2, 2), (3, 3), (4, 5), (6, 6)]
    assert structure.packed([], 10) == [] and structure.packed([10, 1], 10) == [(0, 0), (1, 1)]


def test_every_character_once_but_for_overlaps():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab\n") for _ in range(rng.randint(1, 400)))
        starts = [s for s in structure.line_starts(text) if rng.random() < 0.3]
        budget = rng.randint(5, 60)
        overlap = rng.randrange(budget)
        got = structure.cut(text, starts, budget, overlap)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        for (a, b, _), (c, d, kind) in zip(got, got[1:]):
            assert c == (b - overlap if kind == "window" else b) and d > b
        assert all(b - a <= budget for a, b, _ in got)
        assert all(a == 0 or a in starts for a, _, kind in got if kind != "window")


def test_headings(spark):
    rows = [(1, "intro\n# one\nbody\n# two\n" + "x" * 30), (2, None), (3, ""), (None, "no heading"), (4, "# only")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted((r.id or 0, r.chunk, r.lo, r.hi, r.kind, r.body) for r in structure.by_headings(df, "id", "text", "# .*", 20, 4).collect())
    assert got == [(0, 0, 0, 10, "text", "no heading"), (1, 0, 0, 17, "text", "intro\n# one\nbody\n"), (1, 1, 17, 37, "section", "# two\n" + "x" * 14), (1, 2, 33, 53, "window", "x" * 20), (4, 0, 0, 6, "section", "# only")]
    with pytest.raises(ValueError):
        structure.by_headings(df, "id", "text", "#", 20, 20)


def test_symbols(spark):
    text = "import a\n\nclass K:\n  def m():\n    1\n  def n():\n    2\n\ndef f():\n  3\n"
    df = spark.createDataFrame([(1, text), (2, "plain"), (None, "x\ny")], "id long, text string")
    marks = spark.createDataFrame([(1, 2, 6), (1, 3, 4), (1, 5, 6), (1, 8, 9), (1, 99, 99), (None, 1, None), (5, 0, 0)], "id long, lo int, hi int")
    got = sorted((r.id or 0, r.body) for r in structure.by_symbols(df, marks, "id", "text", 50, 5).collect())
    assert got == sorted([(1, text[:10]), (1, text[10:54]), (1, text[54:]), (2, "plain"), (0, "x\ny")])
    assert text[10:54].startswith("class K:") and text[54:].startswith("def f():")


def test_rounds_of_communities_broadcast_nothing(spark, monkeypatch):
    from tessera.operators import graph

    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "a long, b long, w double")
    label = spark.createDataFrame([(1, 1, 1.0), (2, 2, 2.0), (3, 3, 1.0)], "node long, c long, k double")
    plans, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    graph._moved(edges, label, 2.0, 0)
    assert plans and not any("Broadcast" in p for p in plans)
