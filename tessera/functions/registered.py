"""Functions of one's own in SQL: as SQL expressions, which Catalyst takes into the plan, or over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_]\w*")

#: name -> (parameters, result, body): the functions that `register` defines.
FUNCTIONS = {
    "fold_path": ("p string", "string", "translate(lower(p), '\\\\', '/')"),
    "path_depth": ("p string", "int", "length(p) - length(replace(p, '/', ''))"),
    "file_ending": ("p string", "string", "lower(regexp_extract(p, '[^/][.]([^./]+)$', 1))"),
    "ratio_of": ("part double, whole double", "double", "CASE WHEN whole <> 0 THEN part / whole END"),
}


def register_sql(spark: SparkSession, name: str, parameters: str, result: str, body: str) -> None:
    """A temporary function whose body is an SQL expression over its parameters; a name used before is replaced."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a name: {name!r}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


def register_batches(spark: SparkSession, name: str, result: str, f: Callable[..., pd.Series], deterministic: bool = True) -> None:
    """A function over Arrow batches. One that isn't deterministic is never folded, moved or run twice by the optimizer."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a name: {name!r}")
    udf = F.pandas_udf(f, result)
    spark.udf.register(name, udf if deterministic else udf.asNondeterministic())


def register(spark: SparkSession) -> list[str]:
    """Define FUNCTIONS in the session; their names."""
    for name, spec in FUNCTIONS.items():
        register_sql(spark, name, *spec)
    return list(FUNCTIONS)
