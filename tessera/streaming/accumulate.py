"""Totals over files that come in a stream, each file counted once and as a whole.

A micro-batch sums its files by themselves and stages the sums under the number of the batch; creating that batch's
commit file is the one step that makes them count. A batch that died before it is staged anew, a batch that ran before
is left as it is, so a restart from the checkpoint gives the same totals. A file with a bad row adds nothing and is
listed with the reason. `compact` folds committed batches into a base, as another commit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _commits(spark: SparkSession, root: str) -> dict[str, list[int]]:
    """Numbers of committed batches and of bases."""
    fs, folder = _path(spark, f"{root}/commits")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return {kind: sorted(int(n.split("-")[1]) for n in names if n.startswith(kind)) for kind in ("batch", "base")}


def _commit(spark: SparkSession, root: str, name: str) -> None:
    fs, target = _path(spark, f"{root}/commits/{name}")
    fs.create(target, False).close()  # empty: its name says all


class Accumulator:
    """Sums of a stream's files under `root`: groups by keys, sums named by name; bad: a row condition with its reason, null where the row is fine."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], sums: dict[str, Column], bad: Column):
        self.spark, self.root, self.keys, self.sums, self.bad = spark, root, keys, sums, bad

    def stage(self, batch: DataFrame, number: int) -> None:
        """Write the batch's sums and its failed files; a file lies whole in one batch, as file sources give them.

        Sums of a file are made in one pass with its first reason, combined before the shuffle, then summed over files.
        """
        part = batch.withColumn("_bad", self.bad).groupBy("file", *self.keys).agg(*[F.sum(c).alias(n) for n, c in self.sums.items()], F.min("_bad").alias("_bad"))
        part.write.mode("overwrite").parquet(f"{self.root}/files/{number}")
        part = self.spark.read.schema(part.schema).parquet(f"{self.root}/files/{number}")
        failed = part.groupBy("file").agg(F.min("_bad").alias("reason")).where("reason IS NOT NULL")
        failed.write.mode("overwrite").parquet(f"{self.root}/failed/{number}")
        failed = self.spark.read.schema(failed.schema).parquet(f"{self.root}/failed/{number}")
        good = part.join(failed, "file", "left_anti").groupBy(*self.keys).agg(*[F.sum(n).alias(n) for n in self.sums])
        good.write.mode("overwrite").parquet(f"{self.root}/sums/{number}")
        fs, target = _path(self.spark, f"{self.root}/files/{number}")
        fs.delete(target, True)

    def put(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: stage and commit, unless the batch was committed before."""
        now = _commits(self.spark, self.root)
        if number not in now["batch"] and number > max(now["base"], default=-1):
            self.stage(batch, number)
            _commit(self.spark, self.root, f"batch-{number}")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Take in all that is there; rows have `file`, the file that they come from."""
        stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.put).trigger(availableNow=True).start().awaitTermination()

    def _read(self, what: str, schema: StructType) -> DataFrame:
        now = _commits(self.spark, self.root)
        base = now["base"][-1:]
        paths = [f"{self.root}/{what}/base-{b}" for b in base] + [f"{self.root}/{what}/{n}" for n in now["batch"] if not base or n > base[0]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def totals(self, schema: str) -> DataFrame:
        """(keys, sums) over all committed batches; schema: their names and types, as DDL."""
        return self._read("sums", self._schema(schema)).groupBy(*self.keys).agg(*[F.sum(n).alias(n) for n in self.sums])

    def failed(self) -> DataFrame:
        """(file, reason) of files that added nothing."""
        return self._read("failed", self._schema("file string, reason string"))

    def _schema(self, ddl: str) -> StructType:
        return self.spark.createDataFrame([], ddl).schema

    def compact(self, schema: str) -> None:
        """Fold what is committed into a new base; readers use the last base that is committed, and the batches after it."""
        now = _commits(self.spark, self.root)
        if not now["batch"] or (now["base"] and now["base"][-1] >= now["batch"][-1]):
            return
        last = now["batch"][-1]
        self.totals(schema).write.mode("overwrite").parquet(f"{self.root}/sums/base-{last}")
        self.failed().write.mode("overwrite").parquet(f"{self.root}/failed/base-{last}")
        _commit(self.spark, self.root, f"base-{last}")


def first_reason(checks: dict[str, Column]) -> Column:
    """The name of the first condition that holds, null if none does."""
    return F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in checks.items()])


def merged(totals: list[DataFrame], keys: list[str], sums: list[str]) -> DataFrame:
    """Totals of several accumulators as one."""
    return reduce(DataFrame.unionByName, totals).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])
