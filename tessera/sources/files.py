"""Binary and structured files as rows: ZIP, XLSX, SQLite, YAML, OpenAPI, transcripts, coverage reports.

Files come from spark.read.format("binaryFile"), so any store that Spark reads will do; each is parsed where its bytes
are, one file in one task.
"""

from __future__ import annotations

import datetime
import io
import itertools
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


FRAME = 8192  # rows


def parsed(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[tuple]], schema: str, glob: str = "*") -> DataFrame:
    """Rows (path, *schema) of parse(content) for each file below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return parsed_rows(files, parse, schema)


def parsed_rows(files: DataFrame, parse: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows (path, *schema) of parse(content) for each row of files(path, content); many small files make one frame."""
    names = ["path", *(c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=names, dtype=object)
        for f in frames:
            rows: list[tuple] = []
            for p, content in zip(f["path"], f["content"]):
                for r in parse(bytes(content)):
                    rows.append((p, *r))
                    if len(rows) == FRAME:
                        yield frame(rows)
                        rows = []
            yield frame(rows)

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def zip_entries(content: bytes) -> Iterator[tuple]:
    """(name, size, packed, is_dir) of each entry, in the directory's order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for i in z.infolist():
            yield i.filename, i.file_size, i.compress_size, i.is_dir()


ZIP = "name string, size long, packed long, is_dir boolean"


def zip_text(content: bytes, entry: str) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.read(entry).decode("utf-8", "replace")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(letters: str) -> int:
    """A -> 1, Z -> 26, AA -> 27."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def decode_range(text: str) -> tuple[int, int, int, int]:
    """(row, column, last row, last column) of an A1 reference or range, 1-based."""
    cells = [re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", p) for p in text.split(":")]
    if not cells or len(cells) > 2 or not all(cells):
        raise ValueError(f"not a range: {text!r}")
    (c1, r1), (c2, r2) = ((column_number(m[1]), int(m[2])) for m in (cells[0], cells[-1]))
    return min(r1, r2), min(c1, c2), max(r1, r2), max(c1, c2)


def serial_date(n: float, from_1904: bool = False) -> str:
    """ISO text of a date serial; the 1900 system counts a 29 February that there wasn't."""
    base = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30) if n >= 60 else datetime.datetime(1899, 12, 31)
    t = base + datetime.timedelta(days=n)
    return t.date().isoformat() if n == int(n) else t.replace(microsecond=0).isoformat(sep=" ")


def xlsx_cells(content: bytes) -> Iterator[tuple]:
    """(sheet, row, col, value, kind) of each cell that isn't empty; kinds: string, number, boolean, date, error."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        book = ET.fromstring(z.read("xl/workbook.xml"))
        pr = book.find("m:workbookPr", _NS)
        from_1904 = pr is not None and pr.get("date1904") in ("1", "true")
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ET.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{{{_NS['m']}}}numFmt")}
            xfs = styles.find("m:cellXfs", _NS)
            for xf in xfs if xfs is not None else ():
                k = int(xf.get("numFmtId", "0"))
                code = re.sub(r"\[[^\]]*\]|\"[^\"]*\"", "", own.get(k, ""))
                dates.append(14 <= k <= 22 or 45 <= k <= 47 or bool(re.search(r"[ymdhs]", code, re.I)))
        for sheet in book.iter(f"{{{_NS['m']}}}sheet"):
            target = rels[sheet.get(_REL)].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for c in root.iter(f"{{{_NS['m']}}}c"):
                row, col, _, _ = decode_range(c.get("r"))
                kind, v = c.get("t", "n"), c.find("m:v", _NS)
                if kind == "inlineStr":
                    yield sheet.get("name"), row, col, "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")), "string"
                elif v is None or v.text is None:
                    continue
                elif kind == "s":
                    yield sheet.get("name"), row, col, shared[int(v.text)], "string"
                elif kind in ("str", "e", "b"):
                    yield sheet.get("name"), row, col, v.text if kind != "b" else str(v.text == "1").lower(), {"str": "string", "e": "error", "b": "boolean"}[kind]
                else:
                    style = int(c.get("s", "0"))
                    is_date = style < len(dates) and dates[style]
                    yield sheet.get("name"), row, col, serial_date(float(v.text), from_1904) if is_date else v.text, "date" if is_date else "number"


CELLS = "sheet string, row int, col int, value string, kind string"


def sheet_table(cells: DataFrame, sheet: str) -> DataFrame:
    """A sheet as a table of strings: names from its first row (at most 16,384 columns), blank cells null."""
    one = cells.where(F.col("sheet") == sheet)
    top = one.agg(F.min("row")).first()[0]
    if top is None:
        return cells.sparkSession.createDataFrame([], "col1 string")
    from tessera.sources.delimited import header_names

    head = {r["col"]: r["value"] for r in one.where(F.col("row") == top).select("col", "value").collect()}  # one row of the sheet
    last = one.agg(F.max("col")).first()[0]
    names = header_names([head.get(c, "") for c in range(1, last + 1)])
    wide = one.where(F.col("row") > top).groupBy("path", "row").pivot("col", list(range(1, last + 1))).agg(F.first("value"))
    return wide.orderBy("row").select(*[F.col(f"`{i}`").alias(n) for i, n in enumerate(names, 1)])


def sheet_list(cells: DataFrame) -> DataFrame:
    """(path, sheet, rows, columns): the sheets with their last row and column in use."""
    return cells.groupBy("path", "sheet").agg(F.max("row").alias("rows"), F.max("col").alias("columns"))


def sheet_range(cells: DataFrame, sheet: str, area: str) -> DataFrame:
    """The cells of a sheet in an A1 range."""
    r1, c1, r2, c2 = decode_range(area)
    return cells.where((F.col("sheet") == sheet) & F.col("row").between(r1, r2) & F.col("col").between(c1, c2))


def sheet_head(cells: DataFrame, sheet: str, n: int) -> DataFrame:
    """The cells of the first n rows in use below the header."""
    one = cells.where(F.col("sheet") == sheet)
    top = one.groupBy("path").agg(F.min("row").alias("_top"))
    rows = one.join(top, "path").where("row > _top").drop("_top")
    keep = rows.select("path", "row").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy("row"))).where(F.col("_r") <= n)
    return rows.join(keep.select("path", "row"), ["path", "row"], "left_semi").select(cells.columns)


def sheet_columns(cells: DataFrame, sheet: str) -> DataFrame:
    """(path, col, name, filled, kinds): the columns below their header, with the kinds of cells, sorted."""
    one = cells.where(F.col("sheet") == sheet)
    one = one.join(one.groupBy("path").agg(F.min("row").alias("_top")), "path")
    head = one.where("row = _top").select("path", "col", F.col("value").alias("name"))
    body = one.where("row > _top").groupBy("path", "col").agg(F.count("*").alias("filled"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return head.join(body, ["path", "col"], "full_outer").select("path", "col", F.coalesce("name", F.concat(F.lit("col"), "col")).alias("name"), F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def sqlite_capped(content: bytes, sql: str, cap: int = 5000) -> Iterator[tuple]:
    """(row as JSON, capped): as sqlite_rows, at most `cap` rows; capped says on each row whether there are more."""
    rows = list(itertools.islice(sqlite_rows(content, sql), cap + 1))
    for r in rows[:cap]:
        yield *r, len(rows) > cap


def sqlite_rows(content: bytes, sql: str) -> Iterator[tuple]:
    """(row as JSON,) of a read-only query over the bytes of a SQLite file, all rows."""
    import sqlite3

    from tessera.plans.sqlguard import check

    if content[:16] != b"SQLite format 3\0":
        raise ValueError("not a SQLite file")
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    con.execute("PRAGMA query_only = ON")
    cur = con.execute(check(sql))
    names = [c[0] for c in cur.description]
    for r in cur:
        yield (json.dumps(dict(zip(names, [f"<{len(v)} bytes>" if isinstance(v, bytes) else v for v in r]))),)


def sqlite_tables(content: bytes) -> Iterator[tuple]:
    """(name, type, sql) of tables, views and indexes."""
    for (row,) in sqlite_rows(content, "SELECT name, type, sql FROM sqlite_master ORDER BY type, name"):
        r = json.loads(row)
        yield r["name"], r["type"], r["sql"]


def yaml_json(content: bytes) -> Iterator[tuple]:
    """(document as JSON,) of each YAML document; the path language of JSON then applies."""
    import yaml

    for doc in yaml.safe_load_all(content.decode("utf-8-sig")):
        yield (json.dumps(doc, default=str, ensure_ascii=False),)


def strip_json_comments(text: str) -> str:
    """JSON with // and /* */ comments and trailing commas, as plain JSON; strings stay as they are."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", out, flags=re.S)


_METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def openapi_operations(content: bytes) -> Iterator[tuple]:
    """(method, path, id, summary, parameters) of each operation; local $ref are followed, path parameters merged."""
    text = content.decode("utf-8-sig")
    try:
        doc = json.loads(text)
    except ValueError:
        doc = json.loads(next(yaml_json(content))[0])

    def local(x, hops=0):
        while isinstance(x, dict) and str(x.get("$ref", "")).startswith("#/") and hops < 32:
            at = doc
            for key in x["$ref"][2:].split("/"):
                at = at[key.replace("~1", "/").replace("~0", "~")]
            x, hops = at, hops + 1
        return x

    for path, item in doc.get("paths", {}).items():
        item = local(item)
        for method in _METHODS:
            if method in item:
                op = item[method]
                params = {(p["in"], p["name"]): p for p in map(local, [*item.get("parameters", []), *op.get("parameters", [])])}
                yield method, path, op.get("operationId"), op.get("summary"), [f"{k[0]}:{k[1]}" for k in sorted(params)]


OPERATIONS = "method string, route string, id string, summary string, parameters array<string>"
_CUE = re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})")


def transcript_cues(content: bytes) -> Iterator[tuple]:
    """(cue, start_ms, end_ms, speaker, text) of VTT or SRT."""
    n = 0
    for block in re.split(r"\r?\n\s*\r?\n", content.decode("utf-8-sig")):
        rows = block.splitlines()
        at = next((i for i, r in enumerate(rows) if _CUE.search(r)), None)
        if at is None:
            continue
        g = [int(x or 0) for x in _CUE.search(rows[at]).groups()]
        text = " ".join(r.strip() for r in rows[at + 1 :]).strip()
        m = re.match(r"<v ([^>]+)>(.*)", text) or re.match(r"([A-Z][\w .'-]{0,40}):\s+(.*)", text)
        ms = lambda h, mi, s, f: ((h * 60 + mi) * 60 + s) * 1000 + f
        yield n, ms(*g[:4]), ms(*g[4:]), m[1] if m else None, re.sub(r"<[^>]+>", "", m[2] if m else text)
        n += 1


CUES = "cue int, start_ms long, end_ms long, speaker string, text string"


def coverage_rows(content: bytes) -> Iterator[tuple]:
    """(file, kind, line, hits) of LCOV or istanbul JSON; kinds: line, function, branch."""
    text = content.decode("utf-8-sig")
    if text.lstrip().startswith("{"):
        for name, f in json.loads(text).items():
            for k, h in f.get("s", {}).items():
                yield name, "line", f["statementMap"][k]["start"]["line"], h
            for k, h in f.get("f", {}).items():
                yield name, "function", f["fnMap"][k]["loc"]["start"]["line"], h
            for k, hs in f.get("b", {}).items():
                for h in hs:
                    yield name, "branch", f["branchMap"][k]["loc"]["start"]["line"], h
        return
    name, at = None, {}
    for row in text.splitlines():
        tag, _, rest = row.partition(":")
        if tag == "SF":
            name, at = rest, {}
        elif tag == "DA":
            line, hits = rest.split(",")[:2]
            yield name, "line", int(line), int(hits)
        elif tag == "FN":
            line, f = rest.split(",", 1)
            at[f] = int(line)
        elif tag == "FNDA":
            hits, f = rest.split(",", 1)
            yield name, "function", at.get(f, 0), int(hits)
        elif tag == "BRDA":
            line, _, _, hits = rest.split(",")
            yield name, "branch", int(line), 0 if hits == "-" else int(hits)


COVERAGE = "file string, kind string, line int, hits long"


def coverage_totals(content: bytes) -> Iterator[tuple]:
    """(file, kind, hit, total) of an istanbul summary (lines, statements, functions, branches), or counted from the other formats."""
    text = content.decode("utf-8-sig")
    doc = json.loads(text) if text.lstrip().startswith("{") else {}
    files = {k: v for k, v in doc.items() if k != "total"}
    if doc and all("lines" in v and "statementMap" not in v for v in files.values()):
        for name, v in files.items():
            for kinds, kind in (("lines", "line"), ("functions", "function"), ("branches", "branch")):
                yield name, kind, v[kinds]["covered"], v[kinds]["total"]
        return
    counts: dict[tuple[str, str], list[int]] = {}
    for name, kind, _, hits in coverage_rows(content):
        c = counts.setdefault((name, kind), [0, 0])
        c[0] += hits > 0
        c[1] += 1
    for (name, kind), (hit, total) in counts.items():
        yield name, kind, hit, total


TOTALS = "file string, kind string, hit long, total long"


def coverage_rollup(rows: DataFrame) -> DataFrame:
    """(file, kind, hit, total, share), the worst first."""
    out = rows.groupBy("file", "kind").agg(F.count_if(F.col("hits") > 0).alias("hit"), F.count("*").alias("total"))
    return out.withColumn("share", F.round(F.try_divide("hit", "total"), 4)).orderBy("share", "file", "kind")
