"""The audit of filter orders against filters that are run one after the other."""

import random
from itertools import permutations

from pyspark.sql import functions as F
from tessera.llm import filteraudit


def fails(rows):
    """Sets of failed filters of rows (key, text, part), by the plain rules."""
    first = {}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    out = []
    for key, text, _ in rows:
        t = text or ""
        words = t.encode().split()
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t):
            bad.add("C")
        if any(c in "#$%&*|" for c in t):
            bad.add("D")
        if key is not None and first[t] < key:
            bad.add("E")
        out.append(bad)
    return out


def brute(rows, labels):
    parts = [p or "" for _, _, p in rows]
    bad = fails(rows)
    good = {k for k, q, _ in labels if k is not None and q == 1}
    toxic = {k for k, _, t in labels if k is not None and t == 1}
    out = {}
    for part in set(parts):
        mine = [(k, b) for (k, _, _), p, b in zip(rows, parts, bad) if p == part]
        total = {}
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [(k, b) for k, b in left if f in b]
                left = [(k, b) for k, b in left if f not in b]
                total[f] = total.get(f, 0) + len(gone)
                failing = sum(f in b for _, b in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(b == {f} for _, b in mine), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(total[f])
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_every_order_and_part(spark):
    rng = random.Random(4)
    texts = [None, "", "SHORT AND LOUD", "a # b", "x " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i} $" for i in range(250))]
    rows = [(i, rng.choice(texts) if i % 3 else f"{i} " + " ".join(rng.choices("abcdefghijklmnop", k=rng.choice([5, 210]))), rng.choice(["one", "two", None, ""])) for i in range(300)]
    rows += [(7, "again, the same key", "one"), (7, "again, the same key", "one"), (None, "x " * 300, "two"), (None, None, None), (400, "x " * 300, "only copies")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, 7)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, mask string").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(filteraudit.audit(docs, known)) == brute(rows, labels)


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filteraudit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "aa", "s"), (2, "ab", "s"), (3, "b", "s"), (4, "b", "s")], "doc_id long, text string, source string")
    counts = filteraudit.mask_counts(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), {"X": F.col("text").contains("a")})
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in filteraudit.steps(filteraudit.survivors(counts, 2), "XE").collect()}
    assert rows == {("XE", 1): (2, 2, 0), ("XE", 2): (1, 1, 0), ("EX", 1): (3, 1, 0), ("EX", 2): (1, 2, 0)}
