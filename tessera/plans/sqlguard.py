"""Read-only SQL: one SELECT or WITH statement, no writing keywords outside literals, a row cap with a flag."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STRIP = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`", re.S)
_WRITES = re.compile(r"\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|attach|detach|pragma|vacuum|load|export|import|set|reset|refresh|cache|uncache|call|use|replace(?!\s*\())\b", re.I)


def check(sql: str) -> str:
    """The statement, or ValueError with the reason."""
    bare = _STRIP.sub(" ", sql).strip().rstrip(";").strip()
    if ";" in bare:
        raise ValueError("more than one statement")
    if not re.match(r"(select|with)\b", bare, re.I):
        raise ValueError("not a SELECT or WITH statement")
    if m := _WRITES.search(bare):
        raise ValueError(f"not read-only: {m[0]}")
    return sql.strip().rstrip(";")


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame], cap: int = 5000) -> DataFrame:
    """The rows, `cap` of them at most, with capped: whether there were more. Tables go by name, as arguments."""
    out = spark.sql(re.sub(r"\{(?!\w+\})", "{{", check(sql)), **{k: v for k, v in tables.items() if f"{{{k}}}" in sql})
    head = out.limit(cap + 1)
    more = head.agg((F.count("*") > cap).alias("capped"))
    return head.limit(cap).crossJoin(F.broadcast(more))  # one row


def catalog(tables: dict[str, DataFrame]) -> list[tuple[str, int, str, str]]:
    """(table, position, column, type) of each column."""
    return [(t, n, c, kind) for t in sorted(tables) for n, (c, kind) in enumerate(tables[t].dtypes)]
