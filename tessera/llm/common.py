"""Shared pieces: tables, the shared work folder, connected components, grouping without unbounded groups."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Per thread: the tables written under each name of `tables_of`, and the name in force.
_made = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where it is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='tessera-')}")
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back. Survives lost executors.

    The files go when the application ends; `discard` removes them before that.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    if getattr(_made, "name", None) is not None:
        _made.tables.setdefault((spark.sparkContext.applicationId, _made.name), []).append(target)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized DataFrame that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tables_of(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables materialized inside belong to `name`; those of other names in this thread and application go at the start.

    For steps that follow each other: when one begins, what the one before returned has been written elsewhere.
    """
    tables = _made.tables = getattr(_made, "tables", {})
    app = spark.sparkContext.applicationId
    for other in [k for k in tables if k[1] != name]:
        for target in tables.pop(other) * (other[0] == app):  # those of an ended application are gone
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    before, _made.name = getattr(_made, "name", None), name
    try:
        yield
    finally:
        _made.name = before


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without ASCII white space, unchanged."""
    return text.encode().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, kept for the words seen most recently (bounded)."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _MIX + h[k : k + m]
        out ^= out >> np.uint64(29)
    return mix(out)


def sliding_gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """gram_hashes for long runs, by doubling: the time grows with log n."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    size, have, parts = 1, mix(h), []
    at, left = 0, n
    while left:
        if left & 1:
            parts.append((at, have))
            at += size
        left >>= 1
        if left:
            have = mix(have[: len(have) - size] * _MIX + (have[size:] ^ np.uint64(size)))
            size *= 2
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for at, part in parts:
        out = mix(out * _MIX + part[at : at + m])
    return out


def spanning(pairs: Iterator[pa.RecordBatch], most: int = 250_000) -> Iterator[pa.RecordBatch]:
    """Batches (a, b) to pairs (id, smallest id reachable by them): what a task found as stars, no pair twice.

    Starts anew after `most` ids, so that its memory is bounded.
    """
    up: dict[int, int] = {}

    def find(i: int) -> int:
        top = up.setdefault(i, i)
        while up[top] != top:
            top = up[top]
        while up[i] != top:
            up[i], i = top, up[i]
        return top

    def stars() -> pa.RecordBatch:
        ids = [i for i, j in up.items() if i != j]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(i) for i in ids], pa.int64())], names=["a", "b"])

    for batch in pairs:
        for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            i, j = find(i), find(j)
            up[max(i, j)] = min(i, j)
        if len(up) >= most:
            yield stars()
            up.clear()
    yield stars()


def connected(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Components of edges(a, b): rows (id, component), component the smallest id reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until every id hangs on one root and no root hangs
    on another id. Every step is a pre-aggregated minimum and a join; no neighbourhood is ever collected. The joins are
    merges: broadcasts of many small steps would stay in the driver until its garbage is collected.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    for _ in range(rounds):
        ends = now.selectExpr("a AS id", "1 AS up", "0 AS down").union(now.selectExpr("b AS id", "0 AS up", "1 AS down"))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2.hint("merge"), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b")))
        new = materialize(small.where("a <> b").distinct(), name)
        discard(now)
        now = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def blocked(df: DataFrame, key: str, size: str, ident: str, most: int, ratio: float) -> DataFrame:
    """Deal groups of `key` into units of bounded size that together hold every pair with size ratio >= ratio.

    Groups of at most `most` rows are one unit. Larger ones are cut into bands by log(size) and each band into
    blocks by hash; a unit is a pair of blocks from the same or neighbouring bands (further bands can't reach the
    ratio). Adds unit (string) and side (0: both sides in one block, 1 / 2: compare side 1 with side 2 only).
    """
    n = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    few = df.join(n, key)
    light = few.where(F.col("_n") <= most).withColumns({"unit": F.col(key).cast("string"), "side": F.lit(0)}).drop("_n")
    heavy = few.where(F.col("_n") > most).drop("_n").withColumn("_band", F.floor(F.log(F.greatest(F.col(size), F.lit(1)).cast("double")) / float(-np.log(ratio))))
    bands = heavy.groupBy(key, "_band").agg(F.ceil(F.count("*") / F.lit(most / 2)).alias("_k"))
    beside = Window.partitionBy(key).orderBy("_band")
    next_to = lambda f, step: F.when(f("_band").over(beside) == F.col("_band") + step, f("_k").over(beside)).otherwise(F.lit(0))
    bands = bands.withColumns({"_later": next_to(F.lead, 1), "_before": next_to(F.lag, -1)})
    own = F.pmod(F.xxhash64(F.col(ident), F.lit("block")), F.col("_k"))
    unit = lambda b1, i, b2, j: F.concat_ws(":", F.col(key).cast("string"), b1, i, b2, j)
    row = lambda u, s: F.struct(u.alias("unit"), F.lit(s).alias("side"))
    band = F.col("_band")
    units = F.concat(
        F.array(row(unit(band, F.col("_own"), band, F.col("_own")), 0)),
        F.when(F.col("_own") < F.col("_k") - 1, F.transform(F.sequence(F.col("_own") + 1, F.col("_k") - 1), lambda j: row(unit(band, F.col("_own"), band, j), 1))).otherwise(F.array().cast("array<struct<unit:string,side:int>>")),
        F.when(F.col("_own") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_own") - 1), lambda j: row(unit(band, j, band, F.col("_own")), 2))).otherwise(F.array().cast("array<struct<unit:string,side:int>>")),
        F.when(F.col("_later") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_later") - 1), lambda j: row(unit(band, F.col("_own"), band + 1, j), 1))).otherwise(F.array().cast("array<struct<unit:string,side:int>>")),
        F.when(F.col("_before") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_before") - 1), lambda j: row(unit(band - 1, j, band, F.col("_own")), 2))).otherwise(F.array().cast("array<struct<unit:string,side:int>>")),
    )
    heavy = heavy.join(bands, [key, "_band"]).withColumn("_own", own).withColumn("_u", F.explode(units))
    heavy = heavy.withColumns({"unit": F.col("_u.unit"), "side": F.col("_u.side")}).select(light.columns)
    return light.unionByName(heavy)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only. lower() does it where no other character has another lower case; else translate()."""
    exact = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(c.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]"), exact).otherwise(F.lower(c))
