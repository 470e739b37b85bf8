"""Which observed files need work again: a keyed state in a stream, one value for each path."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Seconds: a file changed within the tick that its time of change was cut to has the same time as before.
TICK = 2.0
OUTPUT = "key string, path string, seq long, verdict string"
#: As types: a task has no session that could read a text of them.
STATE = StructType([StructField("path", StringType()), StructField("sha", StringType()), StructField("mtime", DoubleType()), StructField("indexed", DoubleType()), StructField("parser", StringType())])
LAST = StructType([StructField("seq", LongType())])


def verdict(known: tuple | None, path: str, sha: str | None, mtime: float | None, parser: str | None) -> str:
    """What an observation of a file means, given its state (path, sha, mtime, indexed, parser).

    In this order: added; parser (another parser version made the rows); renamed (the path is spelled in another way);
    unchanged, if an equal time of change is older than the indexing by a tick, without a look at the content; edited;
    and touched, if the content is the same after all.
    """
    if known is None:
        return "added"
    if known[4] != parser:
        return "parser"
    if known[0] != path:
        return "renamed"
    if mtime and mtime == known[2] and mtime + TICK <= known[3]:
        return "unchanged"
    return "touched" if sha == known[1] else "edited"


class Freshness(StatefulProcessor):
    """Verdicts for rows (key, path, sha, mtime, indexed, parser, gone, seq), in order of seq within a micro-batch.

    A row no later than the last one seen of its path is late: it comes out as such and changes nothing. gone drops the
    state. The state expires `ttl` milliseconds after its last change, if given, and the file counts as added then.
    """

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("file", STATE, self.ttl)
        self.last = handle.getValueState("last", LAST, self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()
        known = before = tuple(held) if held is not None else None
        last = self.last.get()
        last = seen = last[0] if last is not None else None
        for r in sorted(rows, key=lambda r: (r.seq, r.path, r.sha or "")):
            if last is not None and r.seq < last:
                yield Row(key=key[0], path=r.path, seq=r.seq, verdict="late")
                continue
            last = r.seq
            if r.gone:
                yield Row(key=key[0], path=r.path, seq=r.seq, verdict="removed" if known else "unknown")
                known = None
                continue
            why = verdict(known, r.path, r.sha, r.mtime, r.parser)
            if why != "unchanged":
                known = r.path, r.sha, r.mtime, r.indexed, r.parser
            yield Row(key=key[0], path=r.path, seq=r.seq, verdict=why)
        if known is None and before is not None:
            self.state.clear()
        elif known is not None and known != before:
            self.state.update(known)
        if last != seen:
            self.last.update((last,))

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which typed state needs; it is on executors' disks and in the checkpoint."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def verdicts(observed: DataFrame, ttl: int | None = None) -> DataFrame:
    """observed(path, sha, mtime, indexed, parser, gone, seq), a stream, to (key, path, seq, verdict).

    key: the path in lower case, so that another spelling is the same file. mtime and indexed are seconds; null or 0
    as mtime proves nothing. Rows without a path or seq go. Start it inside `rocks`. With a ttl the clock drives the
    stream, so it runs on until it is stopped: no trigger that ends by itself goes with that.
    """
    rows = observed.where("path IS NOT NULL AND seq IS NOT NULL").select(F.lower("path").alias("key"), "path", "sha", F.col("mtime").cast("double"), F.col("indexed").cast("double"), "parser", F.coalesce("gone", F.lit(False)).alias("gone"), F.col("seq").cast("long"))
    return rows.groupBy("key").transformWithState(Freshness(ttl), OUTPUT, "Append", "ProcessingTime" if ttl else "None")


def to_do(verdict_rows: DataFrame) -> DataFrame:
    """Rows whose file needs work."""
    return verdict_rows.where(F.col("verdict").isin("added", "parser", "renamed", "edited", "removed"))
