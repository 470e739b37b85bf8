"""BM25, text scans, vectors and rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stored

K1, B = 1.2, 0.75
RRF = 60


def postings(df: DataFrame, key: str, text: str, pattern: str = "[^a-z]+") -> DataFrame:
    """(key, term, tf, len)."""
    words = F.array_remove(F.split(F.lower(text), pattern), "")
    t = df.select(key, words.alias("w")).select(key, F.size("w").alias("len"), F.explode("w").alias("term"))
    return t.groupBy(key, "term", "len").agg(F.count("*").alias("tf"))


def _is(term: str):
    return lambda w: w == term


def bm25(df: DataFrame, key: str, text: str, terms: list[str], mode: str = "auto") -> DataFrame:
    """(key, matched, score) by BM25. auto: documents with all terms, where there are none those with any.

    One pass over the texts makes lengths and frequencies of the query's terms, a narrow table that the statistics and
    the scores are read from; the other terms are never shuffled.
    """
    words = F.array_remove(F.split(F.lower(text), "[^a-z]+"), "")
    tf = [F.size(F.filter("w", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    d = stored(df.select(key, words.alias("w")).select(key, F.size("w").alias("len"), *tf), "frequencies")  # narrow: texts are split once
    stats = d.agg(F.count("*").alias("N"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    d = d.crossJoin(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        f, n = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("N") - n + 0.5) / (n + 0.5))
        return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg")))).otherwise(F.lit(0.0))

    matched = reduce(lambda a, b: a + b, [(F.col(f"tf{i}") > 0).cast("int") for i in range(len(terms))])
    score = reduce(lambda a, b: a + b, [part(i) for i in range(len(terms))])
    out = d.select(key, matched.alias("matched"), score.alias("score")).where("matched > 0")
    if mode == "and":
        return out.where(F.col("matched") == len(terms))
    if mode == "auto":
        full = out.agg((F.max("matched") == len(terms)).alias("_full"))
        return out.crossJoin(F.broadcast(full)).where(~F.col("_full") | (F.col("matched") == len(terms))).drop("_full")  # one row
    return out


def doubles(c: str) -> Column:
    return F.col(c).cast("array<double>")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def neighbours(df: DataFrame, key: str, vector: str, query: list[float]) -> DataFrame:
    """(key, distance) to one query vector; rows with NaN or infinite values go."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(key, doubles(vector).alias("v")).where(finite(F.col("v"))).select(key, distance(F.col("v"), q).alias("distance"))


def unit(a: Column) -> Column:
    """The vector over its L2 norm; null for norm 0."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def rounded(x: Column, digits: int) -> Column:
    """x of moderate size rounded as binary doubles are in C: halves away from zero, and a negative x never becomes 0 without its sign."""
    y = F.abs(x) * 10.0**digits
    return F.signum(x) * (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1.0).otherwise(0.0)) / 10.0**digits


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def ranked(df: DataFrame, order: list, first: int = 0) -> DataFrame:
    """df with rank by order, from `first`. For short lists (cut by limit before)."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1 + first)


def fused(lists: list[DataFrame], key: str) -> DataFrame:
    """(key, score): sum over the lists (key, rank) of 1 / (60 + rank)."""
    both = reduce(DataFrame.unionByName, [x.select(key, (F.lit(1.0) / (RRF + F.col("rank"))).alias("s")) for x in lists])
    return both.groupBy(key).agg(F.sum("s").alias("score"))


class Hit(NamedTuple):
    file: int | None
    lo: int
    hi: int
    distance: float | None
    structural: bool | None


class Ranked(NamedTuple):
    file: int | None
    channel: str | None
    name: str | None
    lo: int
    hi: int
    rank: int


def _by_file(hits: DataFrame, kind: type, order: list[Column], fold: Callable[[list], list[tuple]], schema: str, rows: int = 8192) -> DataFrame:
    """fold(hits of one file in their order) for each file: a task reads its files one after the other, sorted, and holds one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        types = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        now: list = []
        out: list[tuple] = []
        for batch in batches:
            for r in map(kind, *(c.to_pylist() for c in batch.columns)):
                if now and now[0].file != r.file:
                    out += fold(now)
                    now = []
                    if len(out) >= rows:
                        yield made(out)
                        out = []
                now.append(r)
        out += fold(now) if now else []
        if out:
            yield made(out)

    return hits.select(*kind._fields).repartition("file").sortWithinPartitions("file", *order).mapInArrow(run, schema)


def merge_nearby(hits: DataFrame, gap: int = 20) -> DataFrame:
    """hits(file, lo, hi, distance, structural) merged greedily within each file, best first.

    A hit joins a kept one that it overlaps, or lies at most `gap` lines from unless either is structural; the
    distance is the least of both. Order-dependent, so each file is folded in one task.
    """

    def fold(rows: list[Hit]) -> list[tuple]:
        out: list[list] = []
        for r in rows:
            for o in out:
                apart = max(r.lo - o[2], o[1] - r.hi)
                if apart <= 0 or (apart <= gap and not r.structural and not o[4]):
                    o[1], o[2], o[3] = min(o[1], r.lo), max(o[2], r.hi), min(o[3], r.distance)
                    break
            else:
                out.append([r.file, r.lo, r.hi, r.distance, r.structural])
        return [tuple(o[:4]) for o in out]

    order = [F.col(c).asc_nulls_last() for c in ("distance", "lo", "hi", "structural")]
    return _by_file(hits, Hit, order, fold, "file long, lo long, hi long, distance double")


def fuse_channels(hits: DataFrame, least: float = 0.0, gap: int = 20, span: int = 200, slack: int = 5, near: int = 6) -> DataFrame:
    """hits(channel, file, name, lo, hi, rank) clustered within each file and scored by reciprocal ranks.

    Named hits cluster first, in channel and rank order: with a cluster of their name, or one whose range lies within
    `gap` lines while the whole stays within `span`. Unnamed ones join the tightest cluster around them, else one
    within `slack`, else within `near` lines, else make their own. A cluster counts its best rank of each channel.
    """

    def cluster(rows: list[Ranked]) -> list[tuple]:
        out: list[dict] = []
        for r in rows:
            fits, unnamed = [], r.name is None
            for i, c in enumerate(out):
                apart = max(r.lo - c["hi"], c["lo"] - r.hi, 0)
                whole = max(r.hi, c["hi"]) - min(r.lo, c["lo"])
                if not unnamed:
                    if (c["name"] == r.name and apart <= gap or apart == 0) and whole <= span and c["name"] in (None, r.name):
                        fits.append((apart, whole, i))
                elif c["lo"] <= r.lo and c["hi"] >= r.hi:
                    fits.append((-1, c["hi"] - c["lo"], i))
                elif apart <= slack or apart <= near:
                    fits.append((apart, c["hi"] - c["lo"], i))
            if fits:
                c = out[min(fits)[2]]
                if not (unnamed and c["name"] is not None):
                    c["lo"], c["hi"] = min(c["lo"], r.lo), max(c["hi"], r.hi)
                c["ranks"][r.channel] = min(c["ranks"].get(r.channel, r.rank), r.rank)
            else:
                out.append({"name": r.name, "lo": r.lo, "hi": r.hi, "ranks": {r.channel: r.rank}})
        return [(rows[0].file, c["name"], c["lo"], c["hi"], len(c["ranks"]), sum(1 / (RRF + k) for k in c["ranks"].values())) for c in out]

    order = [F.col("name").isNull(), *(F.col(c).asc_nulls_last() for c in ("channel", "rank", "lo", "hi", "name"))]
    out = _by_file(hits, Ranked, order, cluster, "file long, name string, lo long, hi long, channels long, score double")
    return out.withColumn("score", F.round("score", 6)).where(F.col("score") >= least).orderBy(F.desc("score"), F.desc("channels"), "file", "lo", "hi")
