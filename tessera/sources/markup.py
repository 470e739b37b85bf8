"""HTML as node tables: a tolerant parser that yields (node, parent, tag, path, attrs, text, issue, last), and lint issues."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "article", "footer", "nav", "section"}, "li": {"li"}, "td": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
MAX_DEPTH, PAGES = 512, 64  # PAGES: whose nodes a task holds at once
SCHEMA = "node int, parent int, tag string, path string, attrs map<string,string>, text string, issue string, last int"


class Nodes(HTMLParser):
    """Rows in document order. An element of CLOSES ends where one of its set begins; text belongs to its element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.issues: list[tuple[int, str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.open and tag in CLOSES.get(self.rows[self.open[-1]][2], ()):
            self.open.pop()
        parent = self.open[-1] if self.open else None
        path = f"{self.rows[parent][3]}/{tag}" if parent is not None else tag
        self.rows.append([len(self.rows), parent, tag, path, {k: v or "" for k, v in attrs}, [], None])
        if tag not in VOID and len(self.open) < MAX_DEPTH:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.rows[self.open[i]][2] == tag), None)
        if at is None:
            if self.rows:
                self.rows[-1][6] = f"stray </{tag}>"
            return
        for i in self.open[at + 1 :]:
            if self.rows[i][2] not in CLOSES:
                self.rows[i][6] = "unclosed"
        del self.open[at:]

    def handle_data(self, data: str) -> None:
        if self.open:
            self.rows[self.open[-1]][5].append(data)

    def done(self) -> list[list]:
        for i in self.open:
            if self.rows[i][2] not in CLOSES:
                self.rows[i][6] = "unclosed"
        for i, r in enumerate(self.rows):
            r[5] = "".join(r[5])
            r.append(i)
        for r in reversed(self.rows):  # the last node inside each: nodes are numbered as they open
            if r[1] is not None:
                self.rows[r[1]][7] = max(self.rows[r[1]][7], r[7])
        return self.rows


def parse(html: str | None) -> list[list]:
    p = Nodes()
    p.feed(html or "")
    p.close()
    return p.done()


def nodes(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, node, parent, tag, path, attrs, text, issue, last): a row for each element of each page.

    Nodes are numbered in document order, so that those inside an element are the ones after it up to its last.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("path", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("issue", pa.string()), ("last", pa.int32())])
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                keys, rows = [], []
                for k, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for r in parse(h):
                        keys.append(k)
                        rows.append([*r[:4], list(r[4].items()), *r[5:]])
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *columns], names=[key, *schema.names])

    return df.select(key, html).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def select(table: DataFrame, key: str, selector: str) -> DataFrame:
    """Nodes that match a CSS selector: tag, #id, .class, [a], [a op "v"], descendant and child steps, comma unions."""
    parts = [_match(table, key, s.strip()) for s in selector.split(",")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([key, "node"])


def _simple(step: str):
    import re

    test = F.lit(True)
    for m in re.finditer(r"(?P<tag>^[\w-]+|^\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[\^$*~!]?=)\"?(?P<value>[^\"\]]*)\"?)?\]", step):
        g = m.groupdict()
        a = F.col("attrs")[g["attr"]] if g["attr"] else None
        v = g["value"]
        if g["tag"] and g["tag"] != "*":
            test &= F.col("tag") == g["tag"].lower()
        elif g["id"]:
            test &= F.col("attrs")["id"] == g["id"]
        elif g["cls"]:
            test &= F.array_contains(F.split(F.col("attrs")["class"], r"\s+"), g["cls"])
        elif a is not None:
            test &= {None: a.isNotNull, "=": lambda: a == v, "^=": lambda: a.startswith(v), "$=": lambda: a.endswith(v), "*=": lambda: a.contains(v), "~=": lambda: F.array_contains(F.split(a, r"\s+"), v), "!=": lambda: F.coalesce(a != v, F.lit(True))}[g["op"]]()
    return F.coalesce(test, F.lit(False))


def _match(table: DataFrame, key: str, selector: str) -> DataFrame:
    """Steps from left to right. A child is found by its parent's number; a descendant, at any depth, by an element before it whose last node isn't before it."""
    steps = selector.replace(">", " > ").split()
    now, child = table.where(_simple(steps[0])), False
    for step in steps[1:]:
        if step == ">":
            child = True
            continue
        cand = table.where(_simple(step))
        if child:
            now = cand.join(now.select(key, F.col("node").alias("parent")), [key, "parent"], "left_semi").select(table.columns)
        else:
            both = cand.withColumn("_last", F.lit(None).cast("int")).unionByName(now.select(key, "node", F.col("last").alias("_last")), allowMissingColumns=True)
            before = Window.partitionBy(key).orderBy("node").rangeBetween(Window.unboundedPreceding, -1)
            now = both.withColumn("_reach", F.max("_last").over(before)).where("_last IS NULL AND _reach >= node").select(table.columns)
        child = False
    return now
