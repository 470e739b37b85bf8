"""Event ledgers: roll-ups, percentiles, gaps, streaks, budgets, eviction, recovery pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(values: str, q: float) -> Column:
    """The nearest-rank percentile (ceil) of a group; exact, from the group's value counts."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {values})")


def latency(df: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    """count, median, p95 (nearest rank), max and newest by key, the slowest p95 first."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), nearest_rank(value, 0.5).alias("median"), nearest_rank(value, 0.95).alias("p95"), F.max(value).alias("max"), F.max(ts).alias("newest"))
    return out.orderBy(F.desc("p95"), *keys)


def gaps(df: DataFrame, lane: str, ts: str, ident: str, seconds: int) -> DataFrame:
    """Rows that begin more than `seconds` after the previous one of their lane, with gap and the previous type."""
    w = Window.partitionBy(lane).orderBy(ts, ident)
    # microseconds as integers: no rounding of seconds
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    df = df.withColumns({"gap_us": gap, "after": F.lag("event_type").over(w)})
    return df.where(F.col("gap_us") > seconds * 1_000_000)


def islands(df: DataFrame, lane: str, order: list[str], key: Column, out: str = "island") -> DataFrame:
    """df with a number for each run of rows of a lane with equal key."""
    w = Window.partitionBy(lane).orderBy(*order)
    df = df.withColumn("_key", key)
    change = F.when(F.col("_key").eqNullSafe(F.lag("_key").over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn(out, F.sum("_change").over(w)).drop("_change", "_key")


def streaks(df: DataFrame, lane: str, order: list[str], test: Column, least: int) -> DataFrame:
    """(lane, first, last, length) of the runs of at least `least` rows that meet test."""
    runs = islands(df.withColumn("_test", test), lane, order, F.col("_test"))
    runs = runs.where("_test").groupBy(lane, "island").agg(F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= least).drop("island")


def ranges(df: DataFrame, key: str, n: str) -> DataFrame:
    """(key, lo, hi): consecutive integers of a key folded to ranges; null is a range of its own. Rows are only sorted, not held in hash tables."""
    w = Window.partitionBy(key).orderBy(n)
    prev, nxt = F.lag(n).over(w), F.lead(n).over(w)
    first = F.lag(F.lit(1)).over(w).isNull() | (F.col(n).isNotNull() & (prev.isNull() | (F.col(n) - prev > 1)))
    ends = df.select(key, n).withColumns({"_first": first, "_last": F.coalesce(nxt - F.col(n) > 1, F.lit(True))}).where("_first OR _last")
    hi = F.when(F.col("_last"), F.col(n)).otherwise(F.lead(n).over(w))
    return ends.select(key, F.col(n).alias("lo"), hi.alias("hi"), "_first").where("_first").drop("_first")


def within_budget(df: DataFrame, lane: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows of each lane while the running cost stays within the budget, with the lane's total cost and rows."""
    w = Window.partitionBy(lane)
    run = F.sum(cost).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"running": run, "total_cost": F.sum(cost).over(w), "total_rows": F.count("*").over(w)})
    return df.where(F.col("running") <= budget)


def evict(df: DataFrame, shard: str, ts: str, ident: str, size: str, oldest, most_rows: int, most_bytes: int) -> DataFrame:
    """What a cache keeps in each shard: not older than `oldest`, then the newest rows by count and by bytes."""
    w = Window.partitionBy(shard).orderBy(F.desc(ts), F.desc(ident))
    live = df.where(F.col(ts) >= oldest)
    live = live.withColumns({"_rn": F.row_number().over(w), "_run": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return live.where((F.col("_rn") <= most_rows) & ((F.col("_run") <= most_bytes) | (F.col("_rn") == 1))).drop("_rn", "_run")


def recoveries(df: DataFrame, lane: str, order: list[str], failed: Column, solved: Column, ident: str, reach: int = 6) -> DataFrame:
    """(lane, failed_id, solved_id): a failure and the first success within the next `reach` rows of its lane."""
    w = Window.partitionBy(lane).orderBy(*order).rowsBetween(1, reach)
    df = df.withColumn("solved_id", F.first(F.when(solved, F.col(ident)), ignorenulls=True).over(w))
    return df.where(failed & F.col("solved_id").isNotNull()).select(lane, F.col(ident).alias("failed_id"), "solved_id")


def census(df: DataFrame, keys: list[str], failed: Column, reason: Column) -> DataFrame:
    """calls, errors and a text reason=count,... (sorted) by key; counts are summed before the shuffle."""
    per = df.groupBy(*keys, F.when(failed, reason).alias("reason")).agg(F.count("*").alias("n"))
    told = F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat_ws("=", "reason", F.col("n").cast("string"))))), ",")
    return per.groupBy(*keys).agg(F.sum("n").alias("calls"), F.sum(F.when(F.col("reason").isNotNull(), F.col("n")).otherwise(0)).alias("errors"), told.alias("reasons"))
