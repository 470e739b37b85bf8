"""XML columns as node tables, values at XPath expressions, outlines; files by Spark's own XML reader."""

from __future__ import annotations

import math
import operator
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "node int, parent int, tag string, path string, attrs map<string,string>, text string, problem string"
NUMBER = re.compile(r"[ \t\r\n]*-?([0-9]+(\.[0-9]*)?|\.[0-9]+)[ \t\r\n]*")  # as XPath reads one
SIGNS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*"
_TEXT, _DIGITS = r"""'[^']*'|"[^"]*\"""", r"-?[0-9]+(?:\.[0-9]+)?"
_TESTS = rf"(?:\[(?:@{_NAME}(?:!?=(?:{_TEXT})|(?:!?=|<=?|>=?){_DIGITS})|[1-9][0-9]*)\])*"
TEST = re.compile(rf"\[(?:@({_NAME})(!?=|<=?|>=?)(?:({_TEXT})|({_DIGITS}))|([1-9][0-9]*))\]")
STEP = re.compile(rf"/?({_NAME}|\*)({_TESTS})")
ATTRIBUTES = re.compile(rf"(/?(?:{_NAME}|\*){_TESTS}(?:/(?:{_NAME}|\*){_TESTS})*)/@({_NAME})")


def scan(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """Rows of an XML file: one for each element `row_tag`; attributes have an underscore before their name."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def rows(df: DataFrame, column: str, schema: str, out: str = "row") -> DataFrame:
    """df with `out`: each XML document of a column as a struct of `schema`; null fields where it has none or is malformed."""
    return df.withColumn(out, F.from_xml(F.col(column), schema))


def _step(name: str, tests: list[tuple]) -> Callable[[list], list]:
    """The children of elements that have the name and pass the tests, which are positions or (attribute, comparison, value)."""

    def passes(test: tuple, e: ET.Element, at: int) -> bool:
        if len(test) == 1:
            return at == test[0]
        attr, compare, value = test
        x = e.get(attr)
        if x is not None and isinstance(value, float):
            x = float(x) if NUMBER.fullmatch(x) else math.nan
        return x is not None and compare(x, value)

    def run(found: list) -> list:
        out = []
        for e in found:
            kept = [c for c in e if name in ("*", c.tag)]
            for t in tests:
                kept = [c for i, c in enumerate(kept, 1) if passes(t, c, i)]
            out += kept
        return out

    return run


def attributes(path: str) -> Callable[[ET.Element], list[str]] | None:
    """What finds, from a root element, the attributes that a plain path of child steps ends at; None for other paths.

    a/b[2]/@id, /a/*[@k='v'][@n>=3]/@id: names without a prefix, predicates that are positions or compare an attribute.
    """
    whole = ATTRIBUTES.fullmatch(path)
    if not whole:
        return None
    steps = []
    for name, tests in STEP.findall(whole[1]):
        made: list[tuple] = []
        for attr, sign, text, number, place in TEST.findall(tests):
            made.append((int(place),) if place else (attr, SIGNS[sign], float(number) if number else text[1:-1]))
        steps.append(_step(name, made))
    attr = whole[2]

    def run(root: ET.Element) -> list[str]:
        found = [[root]]
        for step in steps:
            found = step(found)
        return [v for e in found if (v := e.get(attr)) is not None]

    return run


def values(df: DataFrame, column: str, path: str, out: str = "found") -> DataFrame:
    """df with `out`: the texts at an XPath 1.0 expression (steps, predicates, @attributes) as an array; null for no XML.

    Only the text nodes and attributes that the path ends at: a/b/text(), a[@k='v']/@id, a/b[2]/text().
    """
    return values_at(df, column, {out: path})


def values_at(df: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """df with a column for each of the paths, as by `values`.

    Plain paths to attributes are followed in Python on one parse of a document for all of them, where Spark's `xpath` makes
    a new parser for each; that takes all other paths, and documents that are malformed or have a declaration, a document
    type or namespaces.
    """
    whole = {out: F.xpath(F.col(column), F.lit(path)) for out, path in paths.items()}
    found = [f for path in paths.values() if (f := attributes(path))]
    at = {out: f"f{i}" for i, out in enumerate(o for o, path in paths.items() if attributes(path))}
    if not found:
        return df.withColumns(whole)

    def one(text: str | None) -> list:
        if not text or "<!DOCTYPE" in text or "<?xml" in text or "xmlns" in text:
            return [None] * len(found)
        try:
            root = ET.fromstring(text)
        except ET.ParseError:
            return [None] * len(found)
        return [f(root) for f in found]

    @F.pandas_udf(", ".join(f"f{i} array<string>" for i in range(len(found))))
    def plain(texts: pd.Series) -> pd.DataFrame:
        rows = [one(t) for t in texts]
        return pd.DataFrame({f"f{i}": pd.Series([r[i] for r in rows], dtype=object) for i in range(len(found))})

    got = df.withColumn("_plain", plain(F.col(column)))
    return got.withColumns(whole | {out: F.coalesce(F.col("_plain")[f], whole[out]) for out, f in at.items()}).drop("_plain")


def parse(text: str) -> Iterator[tuple]:
    """(node, parent, tag, path, attrs, text, problem) in document order; names without their namespace.

    Malformed XML is one row with the parser's message and no node. Entities declared by a document are refused.
    """
    if "<!ENTITY" in text:
        yield None, None, None, None, None, None, "entity declaration"
        return
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        yield None, None, None, None, None, None, str(e)
        return
    bare = lambda name: name.rsplit("}", 1)[-1]
    todo, n = [(root, None, "")], 0
    while todo:
        e, parent, above = todo.pop()
        path = f"{above}/{bare(e.tag)}".lstrip("/")
        own = (e.text or "") + "".join(c.tail or "" for c in e)
        yield n, parent, bare(e.tag), path, {bare(k): v for k, v in e.attrib.items()}, own.strip(), None
        todo += [(c, n, path) for c in reversed(list(e))]
        n += 1


def nodes(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, *NODES): a row for each element of each document; null documents have none."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in NODES.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, *r) for k, t in zip(f[key], f[column]) if t is not None for r in parse(t)], columns=names)

    return df.select(key, column).mapInPandas(run, f"`{key}` {kind}, {NODES}")


def outline(table: DataFrame) -> DataFrame:
    """(path, n, attrs): how often each path of elements occurs, with the names of its attributes, sorted."""
    per = table.where("node IS NOT NULL").groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("attrs"))))).alias("attrs"))
    return per.select("path", "n", F.array_join("attrs", ",").alias("attrs"))
