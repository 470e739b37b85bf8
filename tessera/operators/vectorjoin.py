"""Rows whose vectors lie within an angle of each other: random-hyperplane bands, then the exact cosine.

Equal vectors are one class. A class falls into a bucket of each band by the sides of random hyperplanes it lies on; how
many planes a band has follows from the number of classes, and how many bands there are from the recall that pairs at
the threshold are to have, since such a pair shares a band with a known probability. Buckets are joined on narrow rows
and every candidate pair is compared exactly once. A bucket of many classes is cut into slices, each of which meets the
asking classes by itself, so no bucket is left out or held in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.search import cosine, doubles, finite
from tessera.session import stored

THRESHOLD, RECALL, SLICE, SEED = 0.92, 0.98, 20_000, 7
LEAST_BITS, MOST_BITS = 8, 30


def bands_of(classes: int, threshold: float, recall: float) -> tuple[int, int]:
    """(planes of a band, bands): buckets of about four classes; a pair at the threshold shares a band with probability `recall`."""
    bits = min(max(math.ceil(math.log2(max(classes, 2))) - 2, LEAST_BITS), MOST_BITS)
    side = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - side**bits))


def _signatures(planes: np.ndarray, bits: int, bands: int):
    """(rep, asks, v) to (rep, asks, band, bucket): which side of its band's planes a vector lies on, bit by bit."""
    powers = (1 << np.arange(bits)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                v = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                side = (v @ planes.T > 0).reshape(part.num_rows, bands, bits)
                row = pa.array(np.repeat(np.arange(part.num_rows), bands))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(np.tile(np.arange(bands, dtype=np.int32), part.num_rows)), pa.array((side @ powers).ravel())], names=["rep", "asks", "band", "bucket"])

    return run


def classes_of(df: DataFrame, key: str, vector: str, asking: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows(k, v, asks), whose vectors are of the table's longest length, finite and not zero; classes(v, rep, n, asks) of equal ones."""
    rows = df.select(F.col(f"`{key}`").alias("k"), doubles(vector).alias("v"), F.coalesce(asking, F.lit(False)).alias("asks")).where("k IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    size = rows.agg(F.max(F.size("v"))).first()[0] or 0
    rows = rows.where(F.size("v") == size).withColumn("v", F.transform("v", lambda x: x + 0.0))  # one zero only
    return rows, stored(rows.groupBy("v").agg(F.min("k").alias("rep"), F.count("*").alias("n"), F.max("asks").alias("asks")), "classes")


def links(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(asker, other, cosine) between different classes whose cosine reaches the threshold; each pair once.

    Vectors are compared exactly; what can be missed are pairs that share no band: a share of 1 - recall of those right
    at the threshold, fewer above it.
    """
    one = classes.select(F.size("v").alias("d")).limit(1).collect()
    bits, bands = bands_of(classes.count(), threshold, recall)
    planes = np.random.default_rng(SEED).standard_normal((bits * bands, one[0].d if one else 1))
    kind = classes.schema["rep"].dataType.simpleString()
    cells = stored(classes.select("rep", "asks", "v").mapInArrow(_signatures(planes, bits, bands), f"rep {kind}, asks boolean, band int, bucket long"), "cells")
    sizes = cells.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.max("asks").alias("asked")).where("asked AND n > 1")
    slices = stored(sizes.select("band", "bucket", F.ceil(F.col("n") / SLICE).cast("int").alias("slices")), "slices")  # stored: a hot bucket's rows can be split in the join
    held = cells.join(slices, ["band", "bucket"])
    asking = held.where("asks").select("band", "bucket", F.col("rep").alias("asker"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    others = held.select("band", "bucket", F.col("rep").alias("other"), F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int").alias("slice"))
    pairs = stored(asking.join(others, ["band", "bucket", "slice"]).where("asker <> other").select("asker", "other").distinct(), "pairs")
    left, right = classes.select(F.col("rep").alias("asker"), F.col("v").alias("a")), classes.select(F.col("rep").alias("other"), F.col("v").alias("b"))
    return pairs.join(left, "asker").join(right, "other").select("asker", "other", cosine(F.col("a"), F.col("b")).alias("cosine")).where(F.col("cosine") >= threshold)


def near_rows(df: DataFrame, key: str, vector: str, asking: Column, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(key, n_links, n_equal, nearest, cosine) of every asking row: rows within the threshold, itself left out.

    n_equal counts the other rows of the same vector, n_links those and the rows of linked classes; nearest is the key
    of the closest class's least row, the least of equals, null where only equal rows are there. Rows without a key or
    a usable vector (null, of another length, not finite, zero) ask nothing and are nobody's neighbours; rows of one key
    are asked each.
    """
    rows, classes = classes_of(df, key, vector, asking)
    found = links(classes, threshold, recall).join(classes.select(F.col("rep").alias("other"), "n"), "other")
    summed = found.groupBy("asker").agg(F.sum("n").alias("linked"), F.min(F.struct((-F.col("cosine")).alias("c"), F.col("other").alias("id"))).alias("best"))
    about = stored(classes.where("asks").join(summed, classes["rep"] == summed["asker"], "left").select("v", "n", "linked", "best"), "answers")
    out = rows.where("asks").join(about, "v")
    return out.select(F.col("k").alias(key), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), (F.col("n") - 1).alias("n_equal"), F.col("best.id").alias("nearest"), (-F.col("best.c")).alias("cosine"))
