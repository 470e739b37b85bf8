"""Joins of points and ranges with closed intervals [line_start, line_end] of the same file.

The file is an equality key. Within a file, intervals are also dealt to bins of `width` lines, so that a point meets
only the intervals of its bin and a file of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _binned(spans: DataFrame, width: int) -> DataFrame:
    lo, hi = F.floor(F.col("line_start") / width), F.floor(F.col("line_end") / width)
    return spans.where("line_start <= line_end").withColumn("bin", F.explode(F.sequence(lo, hi)))


def innermost(points: DataFrame, spans: DataFrame, key: str, width: int = 64) -> DataFrame:
    """points(key, line) with the id of the innermost interval around each: greatest line_start, then least id."""
    p = points.withColumn("bin", F.floor(F.col("line") / width))
    hit = p.join(_binned(spans, width), [key, "bin"]).where("line_start <= line AND line_end >= line")
    best = hit.groupBy(key, "line").agg(F.max_by("id", F.struct("line_start", -F.col("id"))).alias("id"))
    return points.join(best, [key, "line"], "left")


def tightest(chunks: DataFrame, spans: DataFrame, key: str, width: int = 64) -> DataFrame:
    """chunks(key, lo, hi) with the id of the narrowest interval that holds each; others go."""
    c = chunks.withColumn("bin", F.floor(F.col("lo") / width))
    hit = c.join(_binned(spans, width), [key, "bin"]).where("line_start <= lo AND line_end >= hi")
    return hit.groupBy(key, "lo", "hi").agg(F.min_by("id", F.struct(F.col("line_end") - F.col("line_start"), "id")).alias("id"))


def overlaps(ranges: DataFrame, spans: DataFrame, key: str, width: int = 64) -> DataFrame:
    """(key, id, lo, hi): the common part of each range and interval that overlap.

    Both sides are dealt to bins; a pair counts in the first bin that both are in.
    """
    r = ranges.where("lo <= hi").withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    hit = r.join(_binned(spans, width), [key, "bin"]).where("line_start <= hi AND line_end >= lo")
    hit = hit.where(F.col("bin") == F.floor(F.greatest("line_start", "lo") / width))
    return hit.select(key, "id", F.greatest("line_start", "lo").alias("lo"), F.least("line_end", "hi").alias("hi"))
