"""A store of entries by key: the latest text of each key, redacted on the way in, bounded in bytes.

Keys fall into buckets. A put writes the buckets it touches anew, whole, beside the old ones, and commits a version that
names a folder for each bucket; a reader keeps the version that it began with. Beyond the bound the oldest entries go.
A version is a file that only one writer can create, so of two writers at once one fails and can try again.
"""

from __future__ import annotations

import json
import uuid
import zlib
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import redacted
from tessera.session import stored

BUCKETS = 16
COLUMNS = ("key", "stored_at", "text")


def _file(spark: SparkSession, path: str) -> tuple[Any, Any]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def state(spark: SparkSession, root: str) -> dict:
    """The last whole version: the folder of each bucket."""
    fs, folder = _file(spark, f"{root}/versions")
    for name in sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []:
        stream = fs.open(_file(spark, f"{root}/versions/{name}")[1])
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except ValueError:
            continue  # its writer died
        finally:
            stream.close()
    return {"version": 0, "buckets": {}}


def _commit(spark: SparkSession, root: str, now: dict) -> None:
    fs, path = _file(spark, f"{root}/versions/{now['version']:08d}.json")
    stream = fs.create(path, False)  # raises where another writer was first
    stream.write(bytearray(json.dumps(now).encode()))
    stream.close()


def repair(spark: SparkSession, root: str) -> bool:
    """Remove the last version's file if its writer died in it: readers pass over it, writers fail on it until then.

    For when no writer is at work, since a file that is being written looks the same.
    """
    fs, folder = _file(spark, f"{root}/versions")
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
    torn = bool(names) and int(names[-1].split(".")[0]) > state(spark, root)["version"]
    if torn:
        fs.delete(_file(spark, f"{root}/versions/{names[-1]}")[1], False)
    return torn


def _bucket(key: Column) -> Column:
    return (F.crc32(key.cast("binary")) % BUCKETS).cast("int")


def _read(spark: SparkSession, folders: dict[str, str]) -> DataFrame | None:
    """(key, stored_at, text, bucket) of some buckets."""
    by_path: dict[str, list[int]] = {}
    for b, path in sorted(folders.items()):
        by_path.setdefault(path, []).append(int(b))
    schema = "key string, stored_at long, text string, bucket int"
    parts = [spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(bs)) for path, bs in by_path.items()]  # whole folders are left out
    return reduce(DataFrame.unionByName, parts) if parts else None


def _latest(rows: DataFrame) -> DataFrame:
    """The last row of each key, of the greater text where two are as late; aggregates combine before the shuffle."""
    return rows.groupBy("key").agg(F.max(F.struct("stored_at", "text")).alias("r")).select("key", "r.stored_at", "r.text")


def _write(spark: SparkSession, root: str, rows: DataFrame, touched: set[str], now: dict) -> dict:
    """rows as the new content of the touched buckets; those without rows go."""
    path = f"{root}/data/{uuid.uuid4().hex}"
    out = rows.withColumn("bucket", _bucket(F.col("key")))
    out.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).write.partitionBy("bucket").parquet(path)
    fs, folder = _file(spark, path)
    full = {f.getPath().getName().split("=")[1] for f in fs.listStatus(folder) if "=" in f.getPath().getName()}
    kept = {b: p for b, p in now["buckets"].items() if b not in touched}
    return {"version": now["version"] + 1, "buckets": kept | dict.fromkeys(full, path)}


def put(spark: SparkSession, root: str, entries: DataFrame, most_bytes: int | None = None) -> dict:
    """Take in entries(key, stored_at, text) and return the new state.

    Of a key the latest row counts, old ones included; secrets are redacted before anything is written; rows without a
    key or time go; a null text is the empty one. With most_bytes the latest entries stay whose texts, in UTF-8 and
    latest first, fit in together.
    """
    now = state(spark, root)
    new = entries.where("key IS NOT NULL AND stored_at IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("stored_at").cast("long").alias("stored_at"), F.coalesce(redacted(F.col("text")), F.lit("")).alias("text"))
    new = stored(_latest(new), "entries")
    touched = {str(r[0]) for r in new.select(_bucket(F.col("key"))).distinct().collect()}  # at most BUCKETS
    old = _read(spark, {b: p for b, p in now["buckets"].items() if b in touched})
    rows = new if old is None else _latest(new.unionByName(old.select(*COLUMNS)))
    after = _write(spark, root, rows, touched, now) if touched else now
    if most_bytes is not None and after["buckets"]:
        after = _bounded(spark, root, after, most_bytes, now["version"])
    if after["version"] > now["version"]:
        _commit(spark, root, after)
    return after


def _bounded(spark: SparkSession, root: str, now: dict, most: int, version: int) -> dict:
    """The state without the oldest entries beyond the bound: a running sum over ranges of time, whose totals alone come to the driver."""
    rows = _read(spark, now["buckets"]).select("key", "stored_at", "bucket", F.octet_length("text").alias("size"))
    order = [F.desc("stored_at"), F.asc("key")]
    dealt = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sums = {r.part: r.total for r in dealt.groupBy("part").agg(F.sum("size").alias("total")).collect()}  # a row for each range
    before, total = {}, 0
    for part in sorted(sums):
        before[part] = total
        total += sums[part]
    if total <= most:
        return now
    starts = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    running = F.sum("size").over(Window.partitionBy("part").orderBy(*order)) + F.element_at(starts, F.col("part"))
    gone = stored(dealt.withColumn("running", running).where(F.col("running") > most).select("key", "bucket"), "gone")
    touched = {str(r[0]) for r in gone.select("bucket").distinct().collect()}  # at most BUCKETS
    rest = _read(spark, {b: p for b, p in now["buckets"].items() if b in touched}).select(*COLUMNS).join(gone.select("key"), "key", "left_anti")
    return _write(spark, root, rest, touched, now) | {"version": version + 1}


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(key, stored_at, text) of the last version."""
    rows = _read(spark, state(spark, root)["buckets"])
    return rows.select(*COLUMNS) if rows is not None else spark.createDataFrame([], "key string, stored_at long, text string")


def get(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The entry of a key, from its bucket alone."""
    b = str(zlib.crc32(key.encode()) % BUCKETS)
    rows = _read(spark, {n: p for n, p in state(spark, root)["buckets"].items() if n == b})
    return rows.where(F.col("key") == key).select(*COLUMNS) if rows is not None else entries(spark, root).limit(0)


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove folders that the last version doesn't name, for when no reader has an older one; their number."""
    kept = {p.rsplit("/", 1)[-1] for p in state(spark, root)["buckets"].values()}
    fs, folder = _file(spark, f"{root}/data")
    old = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName() not in kept] if fs.exists(folder) else []
    for path in old:
        fs.delete(path, True)
    return len(old)
