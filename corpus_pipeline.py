"""A training corpus from `documents`: STAGES, each from the Parquet that its predecessor wrote."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, neardup, quality, sharding
from tessera.llm.common import discard, fresh, materialize, shared_folder, table, tables_of

#: Items whose windows must occur for a document to go; op10's column `contaminated` has a limit of its own.
LEAST_ITEMS = 1


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored as texts without words, repeated rows alike; without labels of both classes the
    labels' prior decides; an empty table stays empty.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the least key, null keys last.

    Repeated rows and rows of one key are told apart; of texts without words one of each key and text stays; an empty
    table stays empty.
    """
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a window of eight of its words, go: one item alone is enough.

    Null and empty texts stay; equal texts go or stay together; without items nothing goes; an empty table stays empty.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), LEAST_ITEMS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its shards.

    Null sources come last among the sources; null texts have no words and no weight in a target; repeated rows share
    their draws; an empty table stays empty.
    """
    mixed = mixing.mixture(docs)
    shard, order = mixed.columns[-2:]
    return mixed.repartition(shard).sortWithinPartitions(shard, order).select(*[F.col(f"`{c}`") for c in docs.columns])


def sharding_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, read back from the committed shards, with run, tier and shard.

    Columns of those names in docs stay; the new ones then have an underscore more. Null texts, keys and sources,
    repeated rows and empty tables: as sharding.sharded.
    """
    root = f"{shared_folder(spark)}/tessera-corpus-{uuid.uuid4().hex}"
    out = sharding.sharded(docs, root)
    return out.toDF(*docs.columns, *[fresh(docs, c) for c in ("run", "tier", "shard")])




def _step(name: str, stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]:
    """A stage whose intermediate tables go when another stage begins: by then its result is written."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with tables_of(spark, name):
            return stage(spark, docs, sf_dir)

    return name, run


STAGES = [
    _step("quality classifier", quality_classifier),
    _step("MinHash near-dedup", near_dedup),
    _step("benchmark decontamination", decontamination),
    _step("mixing sources to target weights", mixing_sources),
    _step("sharding", sharding_files),
]

#: The classifier's scores have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, "stage")
            if before is not None:
                discard(before)  # the stage after it is written
            before = docs
    return docs
