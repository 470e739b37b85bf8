"""Mixing sources to target weights.

Each source's documents are dealt to blocks by hash. A source's target gives its exact quota of block draws: whole
passes over all blocks and, for the rest, blocks in a permuted order, the last one cut at a document and filled up with
a few that fit. A splitting tree deals the quotas to output shards: at each node the left half's share is drawn from a
multivariate hypergeometric distribution, so every shard is an exact sample without replacement, and any node can be
computed by itself: the driver computes the top, tasks the rest. Draws of a source are then numbered and cut by the
shards' quotas: they are disjoint. Inside a shard a hash orders the rows.

Blocks and shards grow with the input, so that neither holds more than a bounded number of rows or words. Only one row
for each source comes to the driver. Blocks and documents stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialize

WEIGHTS, REPEATS, SEED = (5.0, 2.0, 1.0), 3, 11
#: Rows of a block and words of a shard (on average), and the least number of shards.
BLOCK_ROWS, SHARD_WORDS, LEAST = 1024, 50_000_000, 8
#: Documents at most that fill up the block in which a source's quota ends; nodes of the tree that the driver computes.
EXTRA, TOP = 16, 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of the total size by weight; none above `repeats` times its size, the excess reshared by weight."""
    total, open_ = float(sum(sizes)), [i for i, w in enumerate(weights) if w > 0]
    out = [0.0] * len(sizes)
    left = total
    while open_:
        whole = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / whole for i in open_}
        above = [i for i in open_ if share[i] > repeats * sizes[i]]
        if not above:
            for i in open_:
                out[i] = share[i]
            break
        for i in above:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


Node = tuple[int, int, np.ndarray, np.ndarray]  # shards lo..hi, their quotas by source, the draws dealt before them


def halves(node: Node, seed: int = SEED) -> tuple[Node, Node]:
    """A node's two halves: the left one's quotas are a multivariate hypergeometric draw, one source after the other."""
    lo, hi, counts, before = node
    mid = (lo + hi) // 2
    pool = int(counts.sum())
    rest = pool * (mid - lo) // (hi - lo)
    left = np.zeros_like(counts)
    rng = np.random.default_rng([seed, lo, hi])
    for i, c in enumerate(counts.tolist()):
        pool -= c
        left[i] = rng.hypergeometric(c, pool, rest) if rest and c and pool else min(c, rest) if not pool else 0
        rest -= int(left[i])
    return (lo, mid, left, before), (mid, hi, counts - left, before + left)


def leaves(nodes: list[Node]) -> Iterator[Node]:
    while nodes:
        node = nodes.pop()
        if node[1] - node[0] == 1:
            yield node
        else:
            nodes += halves(node)


def split(quotas: np.ndarray, shards: int) -> np.ndarray:
    """(shards, sources) block counts: the quotas dealt by the hypergeometric splitting tree; columns sum to quotas."""
    quotas = np.asarray(quotas, np.int64)
    return np.stack([n[2] for n in sorted(leaves([(0, shards, quotas, np.zeros_like(quotas))]), key=lambda n: n[0])])


def ranges(spark, quotas: np.ndarray, shards: int) -> DataFrame:
    """Rows (sid, shard, no): a shard takes the draws of a source from `no` on. Tasks compute the tree below TOP nodes."""
    quotas = np.asarray(quotas, np.int64)
    nodes: list[Node] = [(0, shards, quotas, np.zeros_like(quotas))]
    while len(nodes) < TOP and any(n[1] - n[0] > 1 for n in nodes):
        nodes = [half for n in nodes for half in (halves(n) if n[1] - n[0] > 1 else (n,))]
    top = spark.createDataFrame([(lo, hi, counts.tolist(), before.tolist()) for lo, hi, counts, before in nodes], "lo int, hi int, counts array<long>, before array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, counts, before in zip(*(c.to_pylist() for c in batch.columns)):
                for shard, _, dealt, at in leaves([(lo, hi, np.array(counts, np.int64), np.array(before, np.int64))]):
                    sid = np.flatnonzero(dealt)
                    yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int32()), pa.array(np.full(len(sid), shard), pa.int32()), pa.array(at[sid], pa.int64())], names=["sid", "shard", "no"])

    return top.mapInArrow(run, "sid int, shard int, no long")


def fill(block: pd.DataFrame) -> pd.DataFrame:
    """(sid, cut, extra): take the documents up to hash `cut` that fit `need`, then EXTRA others at most that come nearest."""
    block = block.sort_values("h", kind="stable")
    need, h, size = int(block["need"].iloc[0]), block["h"].to_numpy(), block["size"].to_numpy()
    end = int(np.searchsorted(np.cumsum(size), need, side="right"))
    left, rest, extra = need - int(size[:end].sum()), list(range(end, len(h))), []
    while left > 0 and rest and len(extra) < EXTRA:
        fits = [i for i in rest if size[i] <= left]
        best = max(fits, key=lambda i: (size[i], -i)) if fits else min(rest, key=lambda i: (size[i], i))
        if abs(left - int(size[best])) >= left:
            break
        extra.append(int(h[best]))
        rest.remove(best)
        left -= int(size[best])
    return pd.DataFrame({"sid": [block["sid"].iloc[0]], "cut": pd.array([int(h[end - 1]) if end else None], "Int64"), "extra": [extra]})


def _hash(key: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), F.lit(SEED))


class Plan:
    """What a mix draws: sid (source -> target), draws (sid, block -> [(copy, shard)], cut and extra)."""

    def __init__(self, docs: DataFrame, key: str, text: str, source: str, weights: tuple[float, ...], repeats: int, blocks: int | None, shards: int | None):
        spark = docs.sparkSession
        size = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long")
        sized = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"), _hash(key, text).alias("h"))
        stored = materialize(sized, "sized")
        rows = stored.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()  # one row for each source
        rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["words"] for r in rows]
        self.shards = shards or max(LEAST, -(-sum(sizes) // SHARD_WORDS))
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], repeats)
        full = [min(repeats, int(t / s + 1e-12)) if s else 0 for t, s in zip(goal, sizes)]
        kinds = "sid int, source string, source_size long, target double, full int, rest double, blocks long"
        self.sources = spark.createDataFrame([(i, r["source"], s, t, f, max(0.0, t - f * s), blocks or -(-r["n"] // BLOCK_ROWS)) for i, (r, s, t, f) in enumerate(zip(rows, sizes, goal, full))], kinds)
        self.sized = self.dealt(stored)
        sums = materialize(self.sized.groupBy("sid", "block").agg(F.sum("size").alias("words")), "blocks")
        by = Window.partitionBy("sid").orderBy(F.xxhash64("sid", "block", F.lit(SEED)), "block")
        ranked = sums.join(self.sources, "sid").select("sid", "block", "words", "full", "rest")
        ranked = ranked.withColumns({"rank": F.row_number().over(by) - 1, "end": F.sum("words").over(by)})
        ranked = materialize(ranked.withColumn("part", (F.col("end") - F.col("words") < F.col("rest")).cast("int") + (F.col("end") <= F.col("rest")).cast("int")), "ranked")  # 2 whole, 1 cut, 0 not drawn in the last pass
        counts = {r["sid"]: (r["n"], r["extra"]) for r in ranked.groupBy("sid").agg(F.count("*").alias("n"), F.count_if(F.col("part") > 0).alias("extra")).collect()}
        quotas = [f * counts[i][0] + counts[i][1] for i, f in enumerate(full)]
        marks = ranges(spark, np.array(quotas, np.int64), self.shards)
        passes = F.sequence(F.lit(0), F.col("full") - F.when(F.col("part") > 0, 0).otherwise(1))
        draws = ranked.where("full > 0 OR part > 0").withColumn("copy", F.explode(passes))
        width = ranked.groupBy("sid").agg(F.count("*").alias("width"))
        draws = draws.join(width, "sid").select("sid", "block", "copy", (F.col("copy") * F.col("width") + F.col("rank")).alias("no"), F.lit(None).cast("int").alias("shard"))
        # a draw's shard is that of the last mark at or before its number: marks and draws are laid in one order
        marks = marks.select("sid", F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("copy"), "no", "shard")
        laid = Window.partitionBy("sid").orderBy("no", F.col("shard").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        drawn = draws.unionByName(marks).withColumn("shard", F.last("shard", ignorenulls=True).over(laid)).where("block IS NOT NULL")
        drawn = drawn.groupBy("sid", "block").agg(F.collect_list(F.struct("copy", "shard")).alias("draws"))  # repeats at most
        # the block in which a source's rest ends
        edge = ranked.where("part = 1").select("sid", "block", (F.col("rest") - (F.col("end") - F.col("words"))).alias("need"))
        inner = self.sized.select("sid", "block", "h", "size").join(edge, ["sid", "block"]).groupBy("sid", "need", "h").agg(F.sum("size").alias("size"))
        cuts = inner.groupBy("sid").applyInPandas(fill, "sid int, cut long, extra array<long>")
        info = ranked.select("sid", "block", "full", "part").join(drawn, ["sid", "block"]).join(cuts, "sid", "left")
        info = info.withColumns({"cut": F.when(F.col("part") == 1, F.col("cut")), "extra": F.when(F.col("part") == 1, F.col("extra"))})
        self.draws = materialize(info, "draws")

    def dealt(self, df: DataFrame) -> DataFrame:
        """df(source, h) with sid and block."""
        s = self.sources.select(F.col("source").alias("_s"), "sid", "blocks")
        return df.join(s, df["source"].eqNullSafe(F.col("_s"))).withColumn("block", F.pmod(F.xxhash64("h", F.lit(1)), F.col("blocks"))).drop("_s", "blocks")

    def apply(self, df: DataFrame) -> DataFrame:
        """df(sid, block, h) with draws: the (copy, shard) pairs that take a row."""
        joined = df.join(self.draws, ["sid", "block"], "left")
        none = F.array().cast("array<struct<copy:int,shard:int>>")
        last = (F.col("part") == 2) | F.coalesce(F.col("h") <= F.col("cut"), F.lit(False)) | F.coalesce(F.array_contains("extra", F.col("h")), F.lit(False))
        kept = F.filter("draws", lambda x: (x["copy"] < F.col("full")) | last)
        return joined.withColumn("draws", F.coalesce(kept, none)).drop("full", "part", "cut", "extra")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, blocks: int | None = None, shards: int | None = None) -> DataFrame:
    """Rows (key, size, source_size, target, taken, shards), one for each row of docs; taken counts repeats.

    shards: the output shards that take the row, in order, comma-joined, repeats as well. Sources in code point order,
    null last, get the weights in turn. Null texts have size 0; a source without words has target 0. No document is
    taken more than `repeats` times. Repeated rows fall into one block and share its draws.
    """
    plan = Plan(docs, key, text, source, weights, repeats, blocks, shards)
    out = plan.apply(plan.sized)
    out = out.join(plan.sources.select("sid", "source_size", "target"), "sid")
    dealt = F.array_join(F.array_sort(F.transform("draws", lambda d: d["shard"])), ",")
    return out.select(F.col("id").alias(key), "size", "source_size", "target", (F.size("draws") * F.col("size")).cast("long").alias("taken"), dealt.alias("shards"))


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, blocks: int | None = None, shards: int | None = None) -> DataFrame:
    """The mixed rows: every row of docs once for each draw, all columns as they are.

    The last two columns are _shard and _order, with more underscores where docs has such columns. Null texts and
    sources without words are never drawn beyond their blocks' draws; an empty table stays empty.
    """
    plan = Plan(docs, key, text, source, weights, repeats, blocks, shards)
    cols = docs.columns
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(f"`{source}`").cast("string").alias("source"), _hash(key, text).alias("h"))
    out = plan.apply(plan.dealt(df)).select("row", "h", F.explode("draws").alias("d"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in cols], F.col("d.shard").alias(fresh(docs, "_shard")), F.xxhash64("h", "d.copy", F.lit(2)).alias(fresh(docs, "_order")))
