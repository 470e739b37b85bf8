"""Lookups, anti and full joins, ranks and pages."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, equal: dict[str, object], prefix: dict[str, str] | None = None) -> DataFrame:
    """Rows that meet all given filters; None leaves a filter out. All of them reach the scan."""
    tests = [F.col(c) == v for c, v in equal.items() if v is not None] + [F.col(c).startswith(v) for c, v in (prefix or {}).items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def path_weight(path: Column) -> Column:
    """Archived paths count 0.7, documentation 0.92, others 1."""
    p = F.lower(path)
    return F.when(p.rlike("/(archive|old|legacy)/"), 0.7).when(p.rlike("/(doc|docs|blog|en|fr)/"), 0.92).otherwise(1.0)


def credited(defs: DataFrame, refs: DataFrame, ident: str, name: str, size: str, user: str) -> DataFrame:
    """The largest definition of each name with refs (distinct users) and credit (refs by definitions of the name)."""
    n = refs.groupBy(ident).agg(F.count(user).alias("refs"))
    w = Window.partitionBy(name)
    df = defs.join(n, ident, "left").withColumn("refs", F.coalesce("refs", F.lit(0).cast("long")))
    df = df.withColumns({"credit": F.col("refs") / F.count("*").over(w), "_rn": F.row_number().over(w.orderBy(F.desc(size), ident))})
    return df.where("_rn = 1").drop("_rn")


def never_again(events: DataFrame, key: str, seq: str, first: Column) -> DataFrame:
    """Rows that meet `first` with no later row of the same key that doesn't: the last of those by key decides."""
    last = events.where(~first).groupBy(key).agg(F.max(seq).alias("_last"))
    return events.where(first).join(last, key, "left").where(F.col("_last").isNull() | (F.col("_last") < F.col(seq))).drop("_last")


def delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys with state: new, fixed (gone) or still."""
    a = before.distinct().withColumn("_a", F.lit(True))
    b = after.distinct().withColumn("_b", F.lit(True))
    return a.join(b, keys, "full_outer").select(*keys, F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "fixed").otherwise("still").alias("state"))


def drift(known: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """key with state: added, removed, changed or same."""
    a, b = known.withColumnRenamed(value, "_a"), found.withColumnRenamed(value, "_b")
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def page_after(df: DataFrame, keys: list[str], last: list, limit: int) -> DataFrame:
    """The page after the key tuple `last`; its cost doesn't depend on how many pages came before."""
    test = F.lit(False)
    for k, v in reversed(list(zip(keys, last))):
        test = (F.col(k) > v) | ((F.col(k) == v) & test)
    return df.where((F.col(keys[0]) >= last[0]) & test).orderBy(*keys).limit(limit)


def head_with_totals(df: DataFrame, test: Column, order: list[str], limit: int) -> DataFrame:
    """The first rows that meet test, with matched (rows that do) and total (all rows)."""
    totals = df.agg(F.count_if(test).alias("matched"), F.count("*").alias("total"))
    return df.where(test).orderBy(*order).limit(limit).crossJoin(F.broadcast(totals))  # one row


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts each task's groups before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`: what an upsert leaves."""
    return top_per_group(df, keys, [F.desc(c) for c in order], 1)


def resolved(imports: DataFrame, files: DataFrame, endings: tuple[str, ...] = ("", ".ts", ".js", ".py", "/index.ts", "/index.js", "/__init__.py")) -> DataFrame:
    """imports(src, spec) with dst: the first existing file of spec, relative to src's folder, by ending; null for none.

    . and .. are folded; specs that aren't relative stay unresolved. Candidates are exploded and joined by equality.
    """
    folder = F.regexp_replace("src", "[^/]*$", "")
    parts = F.split(F.concat(folder, "spec"), "/")
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    base = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    tries = F.posexplode(F.array(*[F.concat(F.col("_base"), F.lit(e)) for e in endings]))
    rows = imports.select("src", "spec").distinct()
    local = rows.where(F.col("spec").startswith(".")).select("src", "spec", base.alias("_base")).select("src", "spec", tries.alias("_p", "dst"))
    best = local.join(files.select(F.col("path").alias("dst")), "dst").groupBy("src", "spec").agg(F.min_by("dst", "_p").alias("dst"))
    return rows.join(best, ["src", "spec"], "left")


#: Chances that a Poisson weight of mean 1 is at most 0, 1, 2, ...
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def poisson_weights(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """(keys, draws): how often each row is in each resample, by a hash of its 64-bit key, the draw and the seed alone."""
    h = keys.astype(np.uint64)[:, None] + (np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, "right")


def bootstrap(df: DataFrame, key: str, value: str, draws: int = 200, seed: int = 7) -> DataFrame:
    """(low, high): a 95 % interval of the mean by `draws` seeded resamples, by Poisson weights in one pass.

    Each row's weight in a draw depends on its key and the draw alone, so any partitioning gives the same. Tasks sum
    their rows under all draws, so no row is ever copied and a task hands on one row for each draw. Null values go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(draws), np.zeros(draws)
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                w = poisson_weights(part.column(0).to_numpy(zero_copy_only=False).view(np.uint64), draws, seed)
                total += part.column(1).to_numpy(zero_copy_only=False) @ w
                weight += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(total), pa.array(weight)], names=["draw", "total", "weight"])

    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(key).alias("k"), F.col(value).cast("double").alias("v"))
    sums = rows.mapInArrow(run, "draw long, total double, weight double").groupBy("draw").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("mean"))
    return sums.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
