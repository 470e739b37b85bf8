"""Delimited text: delimiter by parsing a sample, header policy, string cells."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", "\t", ";", "|")


def detect_delimiter(sample: list[str]) -> str:
    """The first delimiter with which all sampled lines parse to the same number (over 1) of cells; else a comma."""
    for d in DELIMITERS:
        widths = {len(r) for r in csv.reader(sample[:5], delimiter=d) if r}
        if len(widths) == 1 and widths.pop() > 1:
            return d
    return ","


def header_names(cells: list[str]) -> list[str]:
    """Names with blank ones as colN (with a suffix where that is taken); repeated names are an error."""
    cells = [c.strip().lstrip("﻿") for c in cells]
    given = [c for c in cells if c]
    if len(set(given)) != len(given):
        raise ValueError(f"repeated column names: {sorted(c for c in set(given) if given.count(c) > 1)}")
    out: list[str] = []
    for n, c in enumerate(cells, 1):
        name, k = c or f"col{n}", 1
        while not c and (name in given or name in out):
            k += 1
            name = f"col{n}_{k}"
        out.append(name)
    return out


def read(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True) -> DataFrame:
    """Every cell a string, blank as missing; short rows padded, long rows cut; the sample is five lines."""
    head = [r[0] for r in spark.read.text(path).where(F.trim("value") != "").limit(5).collect()]
    if not head:
        return spark.createDataFrame([], "col1 string")
    delimiter = delimiter or detect_delimiter(head)
    rows = list(csv.reader(head, delimiter=delimiter))
    names = header_names(rows[0]) if header else [f"col{n}" for n in range(1, max(map(len, rows)) + 1)]
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.csv(path, schema=schema, sep=delimiter, header=header, mode="PERMISSIVE", multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True, escape='"')


def write(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """RFC 4180 quoting, with a header."""
    df.write.csv(path, sep=delimiter, header=True, escape='"', quoteAll=False)
