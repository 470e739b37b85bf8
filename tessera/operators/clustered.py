"""A table in key order with a small index of its files, so that a page opens the one or two files that hold it.

`write` deals rows to files by ranges of the keys and sorts each; the index has a row for each file with its first and
last key and its rows. A page looks its files up there and reads them alone, whichever page it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

ROWS = 200_000


def write(df: DataFrame, root: str, keys: list[str], rows: int = ROWS) -> None:
    """df under root, about `rows` rows a file. Keys that many rows share should end in one that tells those apart.

    Nulls come first in the order and belong to no page, as no key comes before them.
    """
    files = max(1, math.ceil(df.count() / rows))
    spark = df.sparkSession
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", 2 * rows).parquet(f"{root}/rows")
    key = F.struct(*keys)
    index = spark.read.parquet(f"{root}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows"))
    index.coalesce(1).sortWithinPartitions("first").write.parquet(f"{root}/index")


def _key(keys: list[str], values: list) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, values)])


def files_of(spark: SparkSession, root: str, keys: list[str], last: list | None, limit: int) -> list[str]:
    """The files that hold the page after `last`: those from the one it lies in, until `limit` rows come after that one."""
    index = spark.read.parquet(f"{root}/index")
    if last is not None:
        index = index.where(F.col("last") > _key(keys, last))
    out, after, more = [], 0, 2 + limit // ROWS
    while True:
        heads = index.orderBy("first", "file").limit(more).collect()
        out, after = [], 0
        for i, h in enumerate(heads):
            if i and after >= limit:
                break
            out.append(h.file)
            after += h.rows if i or last is None else 0
        if after >= limit or len(heads) < more:
            return out
        more *= 2  # files are small against the page


def page(spark: SparkSession, root: str, keys: list[str], last: list | None, limit: int) -> DataFrame:
    """The `limit` rows after the key tuple `last` (None: the first ones), in order of the keys."""
    files = files_of(spark, root, keys, last, limit)
    schema = spark.read.parquet(f"{root}/rows").schema
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*files)
    if last is not None:
        rows = rows.where((F.col(keys[0]) >= last[0]) & (F.struct(*keys) > _key(keys, last)))  # the first reaches the scan
    else:
        rows = rows.where(F.col(keys[0]).isNotNull())
    return rows.orderBy(*keys).limit(limit)


def pages(spark: SparkSession, root: str, keys: list[str], limit: int) -> Iterator[list[Row]]:
    """Every page in turn: rows with a key, once each if the keys are unique."""
    last = None
    while got := page(spark, root, keys, last, limit).collect():
        yield got
        last = [got[-1][k] for k in keys]


def scope(spark: SparkSession, root: str, key: str, prefix: str) -> DataFrame:
    """Rows whose first key begins with prefix, read from the files whose range meets it."""
    index = spark.read.parquet(f"{root}/index")
    at = lambda end: F.col(f"{end}.`{key}`")
    files = [r.file for r in index.where((at("last") >= prefix) & (at("first").isNull() | (at("first") <= prefix) | at("first").startswith(prefix))).select("file").collect()]
    schema = spark.read.parquet(f"{root}/rows").schema
    return spark.read.schema(schema).parquet(*files).where(F.col(key).startswith(prefix)) if files else spark.createDataFrame([], schema)
