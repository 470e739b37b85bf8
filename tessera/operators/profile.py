"""Column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.predicates import is_number, number

DATE = r"^\d{4}-\d{2}-\d{2}([ T].*)?$"


def profile(df: DataFrame, top: int = 10) -> DataFrame:
    """A row for each column: nulls (blank cells), distinct, type, min and max in the type's order, top values.

    The type is number, date or string, in this order, and all cells that aren't blank must be of it. The values of a
    column are listed where there are at most `top`. One pass unpivots the table; both steps aggregate before the
    shuffle.
    """
    cells = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "cell")
    blank = F.coalesce(F.trim("cell"), F.lit("")) == ""
    per = cells.groupBy("column", F.when(~blank, F.col("cell")).alias("value")).agg(F.count("*").alias("n"))
    v = F.col("value")
    out = per.groupBy("column").agg(
        F.sum(F.when(v.isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct"),
        F.min(F.when(v.isNotNull(), is_number(v))).alias("num"),
        F.min(F.when(v.isNotNull(), v.rlike(DATE))).alias("day"),
        F.min(number(v)).alias("min_n"),
        F.max(number(v)).alias("max_n"),
        F.min("value").alias("min_s"),
        F.max("value").alias("max_s"),
    )
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    few = per.where("value IS NOT NULL").join(out.where(F.col("distinct") <= top).select("column"), "column", "left_semi")
    listed = few.withColumn("r", rank).groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value", "n"))), lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"))), "|").alias("top_values"))
    kind = F.when(F.col("distinct") == 0, "string").when(F.col("num"), "number").when(F.col("day"), "date").otherwise("string")
    shown = lambda n, s: F.when(kind == "number", F.round(n, 6).cast("string")).otherwise(F.col(s))
    return out.join(listed, "column", "left").select("column", "nulls", "distinct", kind.alias("type"), shown("min_n", "min_s").alias("min"), shown("max_n", "max_s").alias("max"), "top_values")
