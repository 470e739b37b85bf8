"""Incremental versions: file streams read until they are drained, with checkpoints in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import work_path


def stream(spark: SparkSession, path: str, schema: StructType, glob: str = "*", files: int = 8) -> DataFrame:
    """A Parquet file stream; each trigger claims a bounded number of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(path)


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over all that is there (availableNow) into Parquet and return the result."""
    spark, out, mark = df.sparkSession, work_path(df.sparkSession, "stream"), work_path(df.sparkSession, "mark")
    df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def daily(events: DataFrame, keys: list[str], value: str, late: str = "2 days") -> DataFrame:
    """Tumbling days of an event stream with a watermark: (*keys, day, n, total)."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*keys, F.col("w.start").alias("day"), "n", "total")


def deduplicated(events: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """First row of each key within the watermark: what a change queue drains."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def upserted(df: DataFrame, known: DataFrame, key: str, sha: str) -> DataFrame:
    """Rows whose (key, sha) isn't known yet: unchanged content is skipped."""
    return df.join(known.select(key, sha).distinct(), [key, sha], "left_anti")


def drained_complete(df: DataFrame) -> DataFrame:
    """As drained, for an aggregate in complete mode: each micro-batch replaces the result, written by foreachBatch."""
    spark, root, mark = df.sparkSession, work_path(df.sparkSession, "state"), work_path(df.sparkSession, "mark")
    last: list[int] = []

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{n}")
        last.append(n)

    df.writeStream.outputMode("complete").option("checkpointLocation", mark).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/{last[-1]}") if last else spark.createDataFrame([], df.schema)


def sweep(files: DataFrame, cursor: str | None, most: int) -> DataFrame:
    """The next `most` rows of files(path, ...) after the cursor, in path order, from the start again at the end.

    The caller keeps the last path as the next cursor; each file comes up once in every round.
    """
    wrapped = F.col("path") <= cursor if cursor is not None else F.lit(False)
    return files.withColumn("_late", wrapped.cast("int")).orderBy("_late", "path").limit(most).drop("_late")


def streaks(events: DataFrame, least: int = 3, most_rows: int = 2) -> DataFrame:
    """Live runs of `test` rows of a stream (lane, seq, test): (lane, first, length) when a run reaches `least`.

    State is one number pair and a count for each lane; a lane reports `most_rows` times at most.
    """
    import pandas as pd

    def step(key, frames, state):
        first, length, told = state.get if state.exists else (0, 0, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values("seq")
        for seq, test in zip(rows["seq"], rows["test"]):
            if not test:
                first, length = 0, 0
                continue
            first, length = (first, length + 1) if length else (int(seq), 1)
            if length == least and told < most_rows:
                told += 1
                out.append((key[0], first, length))
        state.update((first, length, told))
        yield pd.DataFrame(out, columns=["lane", "first", "length"]).astype({"first": "int64", "length": "int64"})

    return events.groupBy("lane").applyInPandasWithState(step, "lane long, first long, length long", "first long, length long, told long", "append", "NoTimeout")
