"""Pages of a table in key order, and near names against all pairs."""

import random

import pytest
from pyspark.sql import functions as F
from tessera.operators import clustered, nearnames


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "ab", "b", "ba", "c"]), i, f"v{i}") for i in range(3000)] + [(None, -1, "no key")]
    root = f"file://{tmp_path_factory.mktemp('clustered')}"
    clustered.write(spark.createDataFrame(rows, "k string, i long, v string").repartition(5), root, ["k", "i"], 100)
    return root, sorted(r for r in rows if r[0] is not None)


def test_pages_hold_every_row_once(spark, store, monkeypatch):
    root, rows = store
    got = list(clustered.pages(spark, root, ["k", "i"], 700))
    assert [len(p) for p in got] == [700] * 4 + [200]
    assert [(r.k, r.i) for p in got for r in p] == [r[:2] for r in rows]


def test_a_page_opens_few_files(spark, store):
    root, rows = store
    every = spark.read.parquet(f"{root}/index").count()
    for n in (0, 1500, 2900):
        files = clustered.files_of(spark, root, ["k", "i"], list(rows[n][:2]), 50)
        assert len(files) <= 2 < every
        got = clustered.page(spark, root, ["k", "i"], list(rows[n][:2]), 50).collect()
        assert [(r.k, r.i) for r in got] == [r[:2] for r in rows[n + 1 : n + 51]]
    assert clustered.page(spark, root, ["k", "i"], ["zz", 0], 50).count() == 0


@pytest.mark.parametrize("n", [3000, 30000])
def test_files_of_a_page_stay_flat(spark, tmp_path, n):
    root = f"file://{tmp_path}"
    clustered.write(spark.range(n), root, ["id"], 500)
    assert len(clustered.files_of(spark, root, ["id"], [n // 2], 100)) <= 2


def test_scope(spark, store):
    root, rows = store
    for prefix in ("a", "ab", "c", "nothing"):
        assert sorted((r.k, r.i) for r in clustered.scope(spark, root, "k", prefix).collect()) == [r[:2] for r in rows if r[0].startswith(prefix)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits, beginning", [(1, 24), (2, 24), (2, 6), (3, 8)])
def test_near_names(spark, edits, beginning, monkeypatch):
    rng = random.Random(edits)
    names = ["".join(rng.choices("abé", k=rng.randint(0, 5))) + rng.choice(["", "Symbol", "symbolTable"]) for _ in range(250)]
    for n in names[:120]:
        at = rng.randint(0, len(n))
        names.append(rng.choice([n[:at] + "x" + n[at:], n[:at] + n[at + 1 :], n[:at] + "y" + n[at + 1 :], "pre" + n]))
    asked = {n for i, n in enumerate(names) if i % 10 == 0}
    df = spark.createDataFrame([(n, n in asked) for n in names] + [(None, True)], "name string, asked boolean")
    want = {(a, b, d) for a in asked for b in set(names) if a != b and (d := distance(a, b)) <= edits}
    monkeypatch.setattr(nearnames, "SLICE", 7)  # hot variants are cut
    got = nearnames.near_names(df, edits, beginning).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    best = nearnames.nearest(nearnames.near_names(df, edits, beginning), 2).collect()
    for a in asked:
        near = sorted((d, b) for x, b, d in want if x == a)[:2]
        assert [(r.distance, r.near) for r in sorted(best, key=lambda r: r["rank"]) if r.name == a] == near


def test_what_meets_on_a_key_is_near():
    """names of one pattern met on common remains up to twice the edits apart, far more often than they are near."""
    import pyarrow as pa

    names = [f"Customer#{i:06d}" for i in range(0, 1500, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array([i % 10 == 0 for i in range(len(names))])], names=["name", "asked"])
    rows = [r for b in nearnames._keys(2, 24, {15: [11, 12, 13, 14]}, {15})(iter([batch])) for r in b.to_pylist()]
    others: dict[int, set] = {}
    for r in rows:
        if not r["asking"]:
            others.setdefault(r["variant"], set()).add(r["name"])
    met = {(r["name"], o) for r in rows if r["asking"] for o in others.get(r["variant"], ()) if o != r["name"]}
    near = {(a, b) for a in names[::10] for b in names if a != b and distance(a, b) <= 2}
    assert met == near and len(rows) < 40 * len(names)
