"""Graphs as edge tables (src, dst): reachability, chains, cycles, communities, degrees.

Every hop is a join against the edges; only the frontier is carried on. Lineage is cut by writing each hop to the
shared folder, so a lost executor costs one hop.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import louvain
from tessera.session import discard, stored


def reach(edges: DataFrame, start: DataFrame, most: int = 8) -> DataFrame:
    """(node, hop): the fewest hops (0 to most) from the nodes of start(node) along the edges."""
    seen = stored(start.select("node").distinct().withColumn("hop", F.lit(0)), "reach")
    frontier = seen
    for hop in range(1, most + 1):
        nxt = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = stored(nxt.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def chains(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(path, status): every chain from start(node): ends in no further edge (leaf), a cycle, or the depth."""
    now = start.select(F.array("node").alias("path"))
    done = []
    for step in range(depth):
        last = F.element_at("path", -1)
        nxt = now.join(edges, last == edges["src"], "left")
        done.append(nxt.where("dst IS NULL").select("path", F.lit("leaf").alias("status")))
        grown = nxt.where("dst IS NOT NULL").select(F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("cycle"))
        done.append(grown.where("cycle").select("path", F.lit("cycle").alias("status")))
        now = stored(grown.where("NOT cycle").select("path"), "chains")
    done.append(now.select("path", F.lit("depth").alias("status")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def ancestors(parents: DataFrame, depth: int) -> DataFrame:
    """(node, ancestor, level): parents(node, parent) climbed up to `depth` levels; a cycle ends there as well."""
    now = parents.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("level"))
    out = now
    for level in range(2, depth + 1):
        up = parents.select(F.col("node").alias("ancestor"), F.col("parent").alias("_up"))
        now = stored(now.join(up, "ancestor").where("_up IS NOT NULL").select("node", F.col("_up").alias("ancestor"), F.lit(level).alias("level")), "ancestors")
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out)."""
    both = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def cycles(edges: DataFrame) -> DataFrame:
    """(node, scc): strongly connected components with more than one node, named by their least node.

    Forward-backward colouring: the least node spreads along the edges until it settles; nodes that reach back to their
    colour form its component; they are removed, nodes without an edge in or out are trimmed, and the rest goes on until
    no edge is left. Every round removes the node of each colour at least, so the rounds end without a limit.
    """
    edges = stored(edges.where("src <> dst").distinct(), "scc")
    found = None
    while True:
        while True:  # trim
            ins, outs = edges.select(F.col("dst").alias("n")).distinct(), edges.select(F.col("src").alias("n")).distinct()
            both = ins.join(outs, "n")
            kept = edges.join(both.withColumnRenamed("n", "src"), "src", "left_semi").join(both.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst")
            kept = stored(kept, "scc")
            same = kept.count() == edges.count()
            edges = kept
            if same:
                break
        if edges.isEmpty():
            break
        colour = stored(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("c", F.col("node")), "colour")
        while True:
            low = edges.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            new = stored(colour.join(low, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")), "colour")
            colour = new.select("node", "c")
            if new.where("moved").isEmpty():
                break
        back = edges.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").where("cs = cd").select(F.col("dst").alias("from"), F.col("src").alias("to"), F.col("cs").alias("c"))
        back = stored(back, "back")
        frontier = member = stored(colour.where("node = c"), "member")
        while True:
            nxt = frontier.join(back, (frontier["node"] == back["from"]) & (frontier["c"] == back["c"])).select(F.col("to").alias("node"), back["c"]).distinct()
            frontier = stored(nxt.join(member, ["node", "c"], "left_anti"), "frontier")
            if frontier.isEmpty():
                break
            member = member.unionByName(frontier)
        big = member.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
        part = member.join(big, "c", "left_semi").select("node", F.col("c").alias("scc"))
        found = part if found is None else found.unionByName(part)
        gone = member.select("node")
        edges = stored(edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "scc")
    return found if found is not None else edges.select(F.col("src").alias("node"), F.col("dst").alias("scc")).limit(0)


def _dealt(df: DataFrame) -> DataFrame:
    """df as one side of a join that deals both sides by key: a round's table isn't sent through the driver, hop by hop."""
    return df.hint("merge")


def communities(edges: DataFrame, rounds: int = 24, levels: int = 12, block: int = 1_000_000) -> DataFrame:
    """(node, community) by the Louvain method over weighted undirected edges (a, b, w); a community is named by a node.

    Local moving: each node goes to the neighbours' community with the greatest gain in modularity over staying, the
    least name in ties. Nodes move side by side, half of them (by hash) in a round, and of two single nodes only the
    greater goes to the lesser, so that labels never swap for ever (Lu, Halappanavar and Kalyanaraman, 2015). Where two
    rounds move nothing, or after `rounds`, communities become nodes and it starts again, as long as modularity grows; if it
    still does after `levels`, that is an error.
    Rounds run on blocks of about `block` neighbours (louvain.py), and from the level on that is one block, in one task;
    labels don't depend on the blocks. A node's neighbours are in one block, however many. Nodes are integers.
    """
    kind = edges.schema["a"].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"nodes are {kind.simpleString()}, not integers")
    e = edges.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), F.col("w").cast("double").alias("w"))
    e = stored(e.groupBy("a", "b").agg(F.sum("w").alias("w")), "weights")
    m, n, known = e.agg(F.sum("w"), F.count("*"), F.count("w")).first()
    if not m:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("community")).limit(0)
    if known < n:  # a node of such an edge may have no other
        alone = e.where("w IS NULL").select(F.explode(F.array("a", "b")).alias("a"))
        e = stored(e.where("w IS NOT NULL").unionByName(alone.select("a", F.col("a").alias("b"), F.lit(0.0).alias("w"))), "weights")
    member, best_q = None, None

    def through(found: DataFrame) -> DataFrame:
        return found if member is None else stored(member.toDF("n", "node").join(_dealt(found), "node").select(F.col("n").alias("node"), "community"), "member")

    for level in range(levels):
        size = 2 * e.count()
        if size <= block:
            rest = stored(e.coalesce(1).mapInArrow(louvain.settled(m, rounds, levels - level, best_q), "node long, community long, open boolean"), "settled")
            if not rest.where("open").isEmpty():
                raise RuntimeError(f"communities still grew after {levels} levels")
            member = through(rest.select("node", "community"))
            break
        many = -(-size // block)
        cuts = e.select("a").union(e.select("b")).approxQuantile("a", [i / many for i in range(1, many)], 0.25 / many)
        bounds = np.unique(np.array(cuts, "int64"))
        static = _blocks([(e, louvain.EDGES)], bounds, mirror=True)
        sent = static.mapInArrow(louvain.begun(bounds), louvain.ROW)
        still = 0
        for turn in range(rounds):
            before = sent
            sent, moved = _round(static, before, bounds, m, turn)
            if turn:  # the first is computed from static
                discard(before)
            still = 0 if moved else still + 1
            if still == 2:
                break
        end = stored(_ended(static, sent, bounds), "ended")
        discard(sent)
        discard(static)
        whole = stored(end.where(F.col("kind") == louvain.EDGES).groupBy("a", "b").agg(F.sum("w").alias("w")), "weights")
        share = whole.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)) / m).first()[0]
        label = end.where(F.col("kind") == louvain.NODES).select(F.col("a").alias("node"), F.col("b").alias("community"), F.col("w").alias("k"))
        spread = label.groupBy("community").agg(F.sum("k").alias("t")).agg(F.sum(F.pow(F.col("t") / (2 * m), 2))).first()[0]
        if best_q is not None and share - spread <= best_q + 1e-12:
            break
        best_q = share - spread
        member = through(label.select("node", "community"))
        e = whole
        if e.where("a <> b").isEmpty():
            break
    else:
        raise RuntimeError(f"communities still grew after {levels} levels")
    return member.select(F.col("node").cast(kind).alias("node"), F.col("community").cast(kind).alias("community"))


def _blocks(tables: list[tuple[DataFrame, int]], bounds: np.ndarray, mirror: bool = False) -> DataFrame:
    """The rows of `tables`, each with its kind in louvain.py, as one STATIC row for each block."""
    dealt = [df.mapInArrow(louvain.dealt(bounds, kind, mirror), louvain.ROW) for df, kind in tables]
    return stored(reduce(DataFrame.unionByName, dealt).repartitionById(len(bounds) + 1, "dest").mapInArrow(louvain.built(bounds), louvain.ROW), "blocks")


def _round(static: DataFrame, sent: DataFrame, bounds: np.ndarray, m: float, turn: int) -> tuple[DataFrame, bool]:
    """What blocks send after one round of moves, from what they sent before, and whether any node moved."""
    told = sent.where(F.col("kind") == louvain.SUMS).repartitionById(len(bounds) + 1, "dest").mapInArrow(louvain.totals, louvain.ROW)
    work = static.unionByName(sent.where(F.col("kind") == louvain.LABELS)).unionByName(told)
    out = stored(work.repartitionById(len(bounds) + 1, "dest").mapInArrow(louvain.moved(bounds, m, turn), louvain.ROW), "labels")
    return out, not out.where("moved > 0").isEmpty()


def _ended(static: DataFrame, sent: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(kind, a, b, w): nodes with label and degree, and edges between labels."""
    work = static.unionByName(sent.where(F.col("kind") == louvain.LABELS)).repartitionById(len(bounds) + 1, "dest")
    return work.mapInArrow(louvain.ended, "kind int, a long, b long, w double")


def _moved(both: DataFrame, label: DataFrame, m: float, turn: int, bounds: tuple[int, ...] = ()) -> tuple[DataFrame, bool]:
    """label(node, c, k) after one round of moves along edges given both ways, and whether any node moved."""
    cuts = np.array(bounds, "int64")
    static = _blocks([(both, louvain.EDGES), (label, louvain.NODES)], cuts)
    sent, moved = _round(static, static.mapInArrow(louvain.begun(cuts), louvain.ROW), cuts, m, turn)
    return _ended(static, sent, cuts).where(F.col("kind") == louvain.NODES).select(F.col("a").alias("node"), F.col("b").alias("c"), F.col("w").alias("k")), moved


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(modularity): Newman and Girvan's, of undirected edges (a, b, w) and member(node, community)."""
    e = edges.join(member.toDF("a", "ca"), "a").join(member.toDF("b", "cb"), "b")
    deg = edges.select(F.col("a").alias("node"), "w").unionByName(edges.select(F.col("b").alias("node"), "w")).join(member, "node").groupBy("community").agg(F.sum("w").alias("deg"))
    inner = e.groupBy(F.when(F.col("ca") == F.col("cb"), F.col("ca")).alias("community")).agg(F.sum("w").alias("inside"))
    total = edges.agg(F.sum("w").alias("m"))
    per = deg.join(inner.where("community IS NOT NULL"), "community", "left").na.fill(0, ["inside"]).crossJoin(F.broadcast(total))  # one row
    return per.agg(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), 2)).alias("modularity"))


def cross_edges(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(from, to, n): directed edges between different communities."""
    e = edges.join(member.toDF("src", "from"), "src").join(member.toDF("dst", "to"), "dst")
    return e.where(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.count("*").alias("n"))
