"""Ignore rules on a listing against a walk that goes down folder by folder; functions in SQL."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tessera.functions import registered
from tessera.operators import walk


@pytest.mark.parametrize("rule, path, hit", [("*.log", "a/b/x.log", True), ("*.log", "x.logs", False), ("/x", "a/x", False), ("/x", "x", True), ("a/*.c", "a/b/x.c", False), ("a/**/x.c", "a/x.c", True), ("a/**/x.c", "a/b/c/x.c", True), ("**/tmp", "a/tmp", True), ("t?p", "tip", True), ("t?p", "t/p", False), ("[ab]c", "bc", True), ("[!ab]c", "bc", False), ("a.b", "axb", False), (r"\#x", "#x", True), ("x  ", "x", True), ("doc/**", "doc/a/b", True)])
def test_patterns(rule, path, hit):
    assert bool(re.fullmatch(walk.pattern(rule)[0], path)) == hit


def test_lines_that_are_no_rules():
    assert walk.pattern("") is None and walk.pattern("# note") is None and walk.pattern("  ") is None
    assert walk.pattern("!keep/")[1:] == (False, True)


def brute(paths, rules):
    """Paths that go: every folder from the root down, then the file, is looked at under the rules of the folders above it."""
    out = set()
    for path in paths:
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            entry, verdict = "/".join(parts[:k]), False
            for base in ["/".join(parts[:j]) for j in range(k)]:
                for _, text in sorted((n, r) for f, n, r in rules if f == base):
                    p = walk.pattern(text)
                    if p and (not p[2] or k < len(parts)) and re.fullmatch(p[0], entry[len(base) + 1 if base else 0 :]):
                        verdict = p[1]
            if verdict:
                out.add(path)
                break
    return out


def test_rules_by_walking_down(spark):
    rng = random.Random(8)
    paths = sorted({"/".join([*rng.choices(["a", "b", "tmp", "c"], k=rng.randint(0, 4)), rng.choice(["x.log", "keep.log", "f", "tmp.f"])]) for _ in range(400)})
    rules = [("", 1, "*.log"), ("", 2, "!keep.log"), ("", 3, "/tmp/"), ("a", 1, "keep.log"), ("a", 2, "b/tmp"), ("a/b", 1, "!keep.log"), ("a/b", 2, "c/"), ("b", 1, "**/a"), ("c", 1, "# none"), ("c", 2, ""), ("c", 3, "*"), ("c", 4, "!a")]
    listing = spark.createDataFrame([(p,) for p in paths] + [(None,), (paths[0],)], "path string").repartition(3)
    got = walk.ignored(listing, spark.createDataFrame(rules + [(None, 1, "*")], "folder string, n int, rule string")).collect()
    assert {r.path for r in got} == brute(paths, rules) and 20 < len({r.path for r in got}) < len(paths)


def test_walk(spark):
    paths = ["src/a.py", "src/node_modules/b.py", "src/.git/c.py", ".d.py", "Build/e.py", "build", "f.bin", "g.TS", "h.md", "dist.py", "x/.hidden.py"]
    out = walk.walk(spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string"), spark.createDataFrame([("", 1, "*.md")], "folder string, n int, rule string"))
    assert {(r.path, r.language) for r in out.collect()} == {("src/a.py", "python"), ("g.TS", "typescript"), ("dist.py", "python"), (".d.py", "python"), ("x/.hidden.py", "python")}


def test_registered_functions(spark):
    assert set(registered.register(spark)) == set(registered.FUNCTIONS)
    row = spark.sql("SELECT fold_path('A\\\\B') AS a, path_depth('x/y/z') AS b, file_ending('q.TS') AS c, ratio_of(1, 4) AS d, ratio_of(1, 0) AS e, path_depth(NULL) AS f").first()
    assert tuple(row) == ("a/b", 2, "ts", 0.25, None, None)
    plan = spark.range(5).select(F.expr("path_depth(cast(id AS string))"))._jdf.queryExecution().optimizedPlan().toString()
    assert "replace" in plan and "path_depth" not in plan.split("AS")[0]  # taken into the plan
    registered.register_batches(spark, "tick", "long", lambda x: x, deterministic=False)
    moved = spark.range(9).selectExpr("id", "tick(id) AS t").where("t > 3")._jdf.queryExecution().optimizedPlan().toString()
    assert moved.index("Filter") < moved.index("tick(")  # a function that isn't deterministic isn't moved into the filter
    registered.register_batches(spark, "double_it", "long", lambda x: x * 2)
    assert [r[0] for r in spark.sql("SELECT double_it(id) FROM range(3)").collect()] == [0, 2, 4]
    for bad in ("a b", "x;y", ""):
        with pytest.raises(ValueError):
            registered.register_sql(spark, bad, "p int", "int", "p")
