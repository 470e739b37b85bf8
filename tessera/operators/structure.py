"""Chunks that keep to the structure of a text: spans between boundaries, packed in order into a budget.

A span begins at a boundary (a heading, the first line of an outermost symbol, the line after its end) and reaches to
the next one. Spans are packed as long as they fit into the budget together; one that is longer than the budget by itself
becomes windows that overlap. Every character lies in a chunk, chunks of different spans never overlap, none is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "chunk long, lo long, hi long, kind string, body string"


def packed(sizes: Iterable[int], budget: int) -> list[tuple[int, int]]:
    """(first, last) of the spans of each chunk: a fold in order, a span over the budget by itself."""
    out: list[tuple[int, int]] = []
    total = 0
    for i, n in enumerate(sizes):
        if out and total + n <= budget:
            out[-1] = out[-1][0], i
            total += n
        else:
            out.append((i, i))
            total = n
    return out


def windows(lo: int, hi: int, budget: int, overlap: int) -> list[tuple[int, int]]:
    """[lo, hi) as windows of `budget` characters, each beginning `overlap` before the end of the one before."""
    out = [(lo, min(lo + budget, hi))]
    while out[-1][1] < hi:
        at = out[-1][1] - overlap
        out.append((at, min(at + budget, hi)))
    return out


def cut(text: str, starts: Iterable[int], budget: int, overlap: int) -> list[tuple[int, int, str]]:
    """(lo, hi, kind) of a text's chunks; kind: section where it begins at a start, window within a long span, text before the first start."""
    marks = sorted({s for s in starts if 0 <= s < len(text)})
    edges = ([] if marks[:1] == [0] else [0]) + marks + [len(text)]
    out = []
    for first, last in packed((b - a for a, b in zip(edges, edges[1:])), budget):
        lo, hi = edges[first], edges[last + 1]
        kind = "section" if marks and lo >= marks[0] else "text"
        parts = windows(lo, hi, budget, overlap) if hi - lo > budget else [(lo, hi)]
        out += [(a, b, kind if a == lo else "window") for a, b in parts]
    return out


def line_starts(text: str) -> list[int]:
    """Offsets of the lines; lines end at a line feed."""
    return [0, *(m.end() for m in re.finditer("\n", text))]


def _rows(df: DataFrame, key: str, text: str, marks: str | None, starts_of, budget: int, overlap: int) -> DataFrame:
    if not 0 <= overlap < budget:
        raise ValueError("the overlap is less than the budget")
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"), *([F.col(marks).alias("marks")] if marks else [])).where("t <> ''")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = batch.column(1)[i].as_py()
                found = cut(t, starts_of(t, batch.column(2)[i].as_py() if marks else None), budget, overlap)
                columns = [pa.array(range(len(found)), pa.int64()), *(pa.array([c[j] for c in found], x) for j, x in enumerate((pa.int64(), pa.int64(), pa.string()))), pa.array([t[a:b] for a, b, _ in found], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(found), pa.int64())), *columns], names=["k", "chunk", "lo", "hi", "kind", "body"])

    return rows.mapInArrow(run, f"k {kind}, {ROW}").withColumnRenamed("k", key)


def by_headings(df: DataFrame, key: str, text: str, heading: str, budget: int, overlap: int) -> DataFrame:
    """(key, chunk, lo, hi, kind, body): chunks of sections; `heading` is a pattern for whole lines that are headings.

    Offsets are code points, hi is past the end. Null and empty texts have no chunks; a text without headings is one
    span, so windows; repeated rows are cut each; null keys are kept.
    """
    match = re.compile(heading).fullmatch

    def starts(text: str, _) -> list[int]:
        lines = line_starts(text)
        ends = [*(s - 1 for s in lines[1:]), len(text)]
        return [a for a, b in zip(lines, ends) if match(text[a:b])]

    return _rows(df, key, text, None, starts, budget, overlap)


def by_symbols(df: DataFrame, symbols: DataFrame, key: str, text: str, budget: int, overlap: int) -> DataFrame:
    """As by_headings, with the rows symbols(key, lo, hi) of a text's definitions (lines from 0, hi included) as spans.

    A symbol inside another one makes no boundary of its own; ranges that cross or are empty count by their first line.
    The symbols of one text are held together, as its text is. Texts without symbols are cut into windows.
    """
    held = symbols.where("lo IS NOT NULL").groupBy(F.col(f"`{key}`").alias("_k")).agg(F.sort_array(F.collect_list(F.struct("lo", F.greatest("lo", F.coalesce("hi", "lo")).alias("hi")))).alias("_marks"))
    joined = df.join(held, df[key].eqNullSafe(held["_k"]), "left")

    def starts(text: str, marks) -> list[int]:
        lines = line_starts(text)
        out, reach = [], -1
        for m in marks or []:
            if m["lo"] > reach:
                out += [m["lo"], m["hi"] + 1]
            reach = max(reach, m["hi"])
        return [lines[i] for i in out if 0 <= i < len(lines)]

    return _rows(joined, key, text, "_marks", starts, budget, overlap)
