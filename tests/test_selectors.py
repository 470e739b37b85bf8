"""Descendant selectors at any depth against a walk over parents; recursive JSON steps that are cut."""

import json
import random

import pytest
from tessera.functions import jsonpath
from tessera.operators import graph
from tessera.sources import markup


def test_a_descendant_forty_elements_below(spark):
    page = "<div class='a'>" + "<i>" * 40 + "<b>deep</b>" + "</i>" * 40 + "</div><b>outside</b>"
    n = markup.nodes(spark.createDataFrame([(1, page), (2, "<b>other page</b>")], "id long, html string"), "id", "html")
    assert [r.text for r in markup.select(n, "id", ".a b").collect()] == ["deep"]
    assert markup.select(n, "id", ".a > b").count() == 0 and markup.select(n, "id", ".a i b").count() == 1


def inside(rows, node, test):
    while (node := rows[node]["parent"]) is not None:
        if test(rows[node]):
            return True
    return False


def test_descendants_by_walking_up(spark):
    rng = random.Random(6)
    html, open_ = [], []
    for _ in range(400):
        if open_ and rng.random() < 0.45:
            html.append(f"</{open_.pop()}>")
        else:
            open_.append(rng.choice(["div", "span", "em"]))
            html.append(f"<{open_[-1]} class='{rng.choice('xy')}'>")
    n = markup.nodes(spark.createDataFrame([(1, "".join(html))], "id long, html string"), "id", "html").persist()
    rows = [r.asDict() for r in n.orderBy("node").collect()]
    is_x, div = (lambda r: r["attrs"].get("class") == "x"), (lambda r: r["tag"] == "div")
    assert sorted(r.node for r in markup.select(n, "id", ".x div").collect()) == [r["node"] for r in rows if div(r) and inside(rows, r["node"], is_x)]
    assert sorted(r.node for r in markup.select(n, "id", ".x > div em").collect()) == [r["node"] for r in rows if r["tag"] == "em" and inside(rows, r["node"], lambda p: div(p) and p["parent"] is not None and is_x(rows[p["parent"]]))]


def test_what_a_cut_recursive_step_found_stays(spark, monkeypatch):
    monkeypatch.setattr(jsonpath, "MAX_NODES", 50)
    big, small = [{"id": i} for i in range(100)], [{"id": 7}]
    found, cut = jsonpath.bounded(big, "..id")
    assert cut and found == list(range(len(found))) and 0 < len(found) < 50
    assert jsonpath.bounded(small, "..id") == ([7], False)
    with pytest.raises(jsonpath.Truncated):
        jsonpath.evaluate(big, "..id")


def test_the_flag_of_a_cut_cell(spark):
    rows = [(1, json.dumps([{"id": 1}] * 30_000)), (2, '[{"id": 1}]'), (3, "no JSON")]
    out = jsonpath.select(spark.createDataFrame(rows, "k long, doc string"), "doc", "..id", "found", "cut").collect()
    by = {r.k: (len(r.found), r.cut) for r in out}
    assert by[1][1] and 1000 < by[1][0] < 30_000 and by[2] == (1, False) and by[3] == (0, False)
    assert {r.cut for r in jsonpath.select(spark.createDataFrame([(1, '{"a":1}')], "k long, doc string"), "doc", "a", "found", "cut").collect()} == {False}


def test_communities_that_did_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for g in range(4) for a in range(5 * g, 5 * g + 5) for b in range(a + 1, 5 * g + 5)] + [(4, 5, 1.0), (9, 10, 1.0)], "a long, b long, w double")
    with pytest.raises(RuntimeError):
        graph.communities(edges, levels=1)
    assert graph.communities(edges).select("community").distinct().count() <= 4
