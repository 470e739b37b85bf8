"""Shards by size-tiered compaction, in DataFrame operations only.

append() writes arrivals as small immutable shards, without a shuffle, each row with its run. compact() plans on the
runs' sizes alone: runs of one tier (sizes within a factor of four) are laid end to end and cut at the target size, so
similarly sized runs merge into files of about the target; a run above it is dealt to several. The rows are then moved,
a versioned manifest is written, and the version is committed by naming one small file, which only one writer can do:
readers see the old or the new version, whole.

A version holds all rows committed before it. Shards of earlier versions stay where they are and the manifest refers to
them, until FULL of one region are of one tier and under half the target: those are laid end to end with the new runs
of that tier and merged. Files of merged shards are kept for readers of the versions that refer to them.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh

TARGET, ARRIVAL, REGION, FULL, TASK = 64 << 20, 16384, 256, 4, 4


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/commits")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def _publish(spark: SparkSession, aside: str, final: str) -> bool:
    """Give a finished file its final name, unless that exists: whoever comes second gets False, on any store."""
    jvm = spark._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(final)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        if fs.getUri().getScheme() == "file":  # a rename would replace the file; a hard link can't
            path = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(path(target), path(source))
        else:
            options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
            options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(source, target, options)
    except Py4JJavaError as e:
        if fs.exists(target):
            return False
        raise RuntimeError(f"can't publish {final}") from e
    finally:
        fs.delete(source, False)
    return True


def commit(spark: SparkSession, root: str, version: int, content: dict) -> None:
    """Publish a version: its file is written aside, then given its name, which fails if another writer has that version."""
    final, aside = f"{root}/commits/v{version:08d}.json", f"{root}/commits/_{uuid.uuid4().hex}"
    fs, p = _fs(spark, aside)
    fs.mkdirs(p.getParent())
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if not _publish(spark, aside, final):
        raise RuntimeError(f"version {version} is already committed")


def committed(spark: SparkSession, root: str) -> dict | None:
    """What the last committed version says, or None."""
    have = versions(spark, root)
    if not have:
        return None
    fs, p = _fs(spark, f"{root}/commits/v{have[-1]:08d}.json")
    f = fs.open(p)
    text = bytes(f.readAllBytes()).decode()
    f.close()
    return json.loads(text)


def run_name(key: str = "doc_id", source: str = "source", arrival: int = ARRIVAL) -> tuple[Column, Column]:
    """(slot, run): ids of one range of `arrival` and one source arrive together; null ids in slot -1."""
    slot = F.coalesce(F.floor(F.col(f"`{key}`") / arrival).cast("long"), F.lit(-1).cast("long"))
    return slot, F.concat_ws("/", slot.cast("string"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")))


def append(docs: DataFrame, root: str, key: str = "doc_id", source: str = "source", text: str = "text") -> str:
    """Write docs as new small shards beside those already there, one of each task; returns their folder.

    Every row says its run and the bytes of its text, so that runs are sized without reading texts.
    """
    path = f"{root}/arrivals/{uuid.uuid4().hex}"
    slot, run = run_name(key, source)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    docs.select(row, slot.alias("slot"), run.alias("run"), _bytes(f"`{text}`").alias("bytes")).write.option("compression", "zstd").parquet(path)
    return path


def _tier() -> Column:
    return F.floor((F.length(F.bin("bytes")) - 1) / 2).cast("int")


def plan(runs: DataFrame, target: int = TARGET) -> DataFrame:
    """runs(slot, run, docs, bytes) with tier, parts (over 1: the run alone makes that many shards) and shard.

    Runs are ordered within (tier, region of REGION slots), so no window grows with the input. A shard name holds its
    tier, region and number.
    """
    region = F.floor(F.col("slot") / REGION).cast("long")
    runs = runs.withColumns({"tier": _tier(), "region": region, "parts": F.greatest(F.lit(1), F.ceil(F.col("bytes") / target)).cast("int")})
    before = F.sum(F.when(F.col("parts") == 1, F.col("bytes")).otherwise(0)).over(Window.partitionBy("tier", "region").orderBy("slot", "run").rowsBetween(Window.unboundedPreceding, -1))
    number = F.floor(F.coalesce(before, F.lit(0)) / target).cast("long")
    name = F.concat_ws("-", F.concat(F.lit("t"), "tier"), F.concat(F.lit("r"), "region"), number.cast("string"))
    return runs.withColumn("shard", F.when(F.col("parts") == 1, name).otherwise(F.concat_ws("-", F.concat(F.lit("t"), "tier"), F.col("run")))).drop("region")


def _bytes(c: str) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def _live(spark: SparkSession, base: str, shards: DataFrame) -> DataFrame:
    """Rows of those files under base that shards(base, file) names."""
    return spark.read.parquet(f"{base}/shards").join(shards.where(F.col("base") == base).select("file"), "file", "left_semi")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def full(shards: DataFrame, target: int = TARGET) -> DataFrame:
    """The shards(region, bytes) to merge: under half the target, FULL or more of one tier in one region."""
    small = shards.where(F.col("bytes") * 2 < target).withColumn("_tier", _tier())
    return small.join(small.groupBy("_tier", "region").count().where(F.col("count") >= FULL), ["_tier", "region"], "left_semi").drop("_tier")


def compact(spark: SparkSession, root: str, arrivals: list[str], key: str = "doc_id", text: str = "text", target: int = TARGET) -> dict:
    """Merge the arrivals, and full tiers of earlier shards, into shards of about `target` bytes of text; commit the version.

    The version's manifest has the new shards and, by reference, all earlier ones that weren't merged.
    """
    version = (versions(spark, root) or [0])[-1] + 1  # before the last one is read: if another writer commits in between, commit() fails
    last = committed(spark, root)
    base = f"{root}/versions/{version:08d}-{uuid.uuid4().hex}"
    rows = _union([spark.read.parquet(path) for path in arrivals]).withColumn("unit", F.col("run"))
    sizes = rows.groupBy("slot", "unit").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"))
    earlier = manifest(spark, root) if last and last["base"] else None
    if earlier is not None:
        full(earlier, target).write.parquet(f"{base}/merged")
        merged = spark.read.parquet(f"{base}/merged")
        slot, unit = (F.col("region") * REGION).alias("slot"), F.concat_ws(":", F.lit("shard"), "version", "file").alias("unit")
        sizes = sizes.unionByName(merged.select(slot, unit, "docs", "bytes"))
        named = merged.select("base", "file", slot, unit)
        for b in [r.base for r in merged.select("base").distinct().collect()]:  # versions at most
            old = spark.read.parquet(f"{b}/shards").join(named.where(F.col("base") == b).drop("base"), "file")
            rows = _union([rows, old.select("row", "run", "bytes", "slot", "unit")])
    plan(sizes.withColumnRenamed("unit", "run"), target).write.parquet(f"{base}/runs")
    runs = spark.read.parquet(f"{base}/runs").withColumnRenamed("run", "unit")
    moved = rows.join(runs.select("slot", "unit", "tier", "parts", "shard"), ["slot", "unit"])
    spread = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(f"row.`{key}`").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(f"row.`{text}`"), F.lit("")))), 1, 8), 16, 10).cast("long")
    shard = F.when(F.col("parts") == 1, F.col("shard")).otherwise(F.concat_ws("-", "shard", (spread % F.col("parts")).cast("string")))
    if version > 1:  # no two shards of a manifest have one name
        shard = F.concat(F.lit(f"v{version}-"), shard)
    file = F.concat(F.lit("s"), F.sha2("shard", 256).substr(1, 16))  # a letter first: never read back as a number
    moved = moved.select("row", "run", "tier", "bytes", shard.alias("shard")).withColumn("file", file)
    total = runs.agg(F.sum("bytes")).first()[0] or 0
    tasks = -(-total // (TASK * target))  # a task writes a few shards, whatever the size of the whole
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    moved = moved.repartition(tasks, "file") if tasks > usual else moved.repartition("file")
    moved.sortWithinPartitions("file").write.option("compression", "zstd").partitionBy("file").parquet(f"{base}/shards")
    region = F.floor(F.substring_index("run", "/", 1).cast("long") / REGION).cast("long")
    made = spark.read.parquet(f"{base}/shards").groupBy("file", "shard", "tier").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"), F.min(region).alias("region"))
    made = made.select("file", "shard", "tier", "docs", "bytes", F.lit(version).alias("version"), "region", F.lit(base).alias("base"))
    if earlier is not None:
        made = made.unionByName(earlier.join(merged, ["base", "file"], "left_anti"))
    made.write.parquet(f"{base}/manifest")
    content = {"version": version, "base": base, "arrivals": arrivals}
    commit(spark, root, version, content)
    for path in arrivals:  # their rows are in the committed version
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    return content


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Rows (file, shard, tier, docs, bytes, version, region, base) of the committed version; base/shards holds the file.

    version is the one that wrote the shard.
    """
    return spark.read.parquet(f"{committed(spark, root)['base']}/manifest")


def view(spark: SparkSession, root: str) -> DataFrame:
    """Rows (row, run, tier, shard) of all shards of the committed version."""
    last, shards = committed(spark, root)["base"], manifest(spark, root)
    earlier = [r.base for r in shards.where(F.col("base") != last).select("base").distinct().collect()]  # versions at most
    parts = [spark.read.parquet(f"{last}/shards"), *[_live(spark, b, shards) for b in earlier]]
    return _union([p.select("row", "run", "tier", "shard") for p in parts])


def sharded(docs: DataFrame, root: str, key: str = "doc_id", text: str = "text", source: str = "source", target: int = TARGET) -> DataFrame:
    """docs, appended and compacted under root, and all rows committed there before, with run, tier and shard.

    All columns of docs stay as they are; the last three are _run, _tier and _shard, with more underscores where docs
    has such columns. Null texts have 0 bytes; null keys and sources make runs of their own;
    repeated rows stay. Empty docs make a version without new shards.
    """
    spark = docs.sparkSession
    if docs.isEmpty():
        version = (versions(spark, root) or [0])[-1] + 1
        last = committed(spark, root)
        commit(spark, root, version, {"version": version, "base": last and last["base"], "arrivals": []})
    else:
        compact(spark, root, [append(docs, root, key, source, text)], key, text, target)
    extra = [fresh(docs, c) for c in ("_run", "_tier", "_shard")]
    if committed(spark, root)["base"] is None:
        return docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.lit("").alias(extra[0]), F.lit(0).alias(extra[1]), F.lit("").alias(extra[2]))
    return view(spark, root).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in zip(("run", "tier", "shard"), extra)])
