"""File formats, paths and extractors: texts and files made from the star tables, read back by the sources and operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import jsonpath
from tessera.functions import text as X
from tessera.operators import extractors, predicates, toolfilters
from tessera.plans.registry import query
from tessera.plans.structures import event_stream
from tessera.session import table as T
from tessera.session import work_path
from tessera.sources import delimited, files, transcripts, xmltable
from tessera.streaming import ingest


def made(df, key, content):
    """(path, content) of a text column expression, as files would come."""
    return df.select(F.col(key).cast("string").alias("path"), F.expr(content).cast("binary").alias("content"))


def nation(s, d):
    return T(s, d, "nation")


# Delimited text

_CELLS = "concat_ws(chr(10), concat_ws(sep, 'id', 'name', 'region'), concat_ws(sep, n_nationkey, concat('\"', n_name, ',;', '\"'), n_regionkey))"


@query("SELECT n_nationkey, [',', chr(9), ';', '|'][n_nationkey % 4 + 1] AS delimiter FROM nation")
def q_csv_sniff(s, d):
    rows = nation(s, d).withColumn("sep", F.element_at(F.array(*[F.lit(x) for x in delimited.DELIMITERS]), (F.col("n_nationkey") % 4 + 1).cast("int")))
    sniff = F.pandas_udf(lambda t: t.map(lambda x: delimited.detect_delimiter(x.split("\n"))), "string")
    return rows.select("n_nationkey", sniff(F.expr(_CELLS)).alias("delimiter"))


@query("SELECT n_nationkey, n_name || ',col2,col3,col4_2,col4' AS names FROM nation")
def q_header_names(s, d):
    names = F.pandas_udf(lambda t: t.map(lambda x: ",".join(delimited.header_names(x.split("|")))), "string")
    return nation(s, d).select("n_nationkey", names(F.concat("n_name", F.lit("|| ||col4"))).alias("names"))


@query("SELECT p_partkey FROM part WHERE p_size >= 20 AND p_name <> 'red widget' AND p_brand > 'Brand#1'")
def q_predicate_specs(s, d):
    """Predicates whose column names hold operator characters: the longest name that fits wins."""
    df = T(s, d, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_size").alias("size>=x"), F.col("p_name").alias("a=b"), F.col("p_brand").alias("brand"))
    return predicates.where(df, ["size>=20", "a=b!=red widget", "brand > Brand#1"]).select("p_partkey")


# XML

_PART = "'<part xmlns=\"urn:p\" id=\"' || p_partkey || '\"><name>' || p_name || '</name><size unit=\"cm\">' || p_size || '</size></part>'"


def part_xml(s, d):
    return T(s, d, "part").select("p_partkey", F.expr(_PART.replace('\\"', '"')).alias("doc"))


@query("SELECT p_partkey AS id, p_name AS name, p_size::BIGINT AS size FROM part")
def q_xml_scan(s, d):
    """XML columns as typed rows: attributes, elements and an element with both."""
    rows = xmltable.rows(part_xml(s, d), "doc", "_id long, name string, size struct<_VALUE:long,_unit:string>")
    return rows.select("row._id", "row.name", "row.size._VALUE").toDF("id", "name", "size")


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 25) AS many, min(l_partkey) AS least FROM lineitem GROUP BY 1")
def q_xml_path(s, d):
    line = F.concat(F.lit('<line part="'), "l_partkey", F.lit('" qty="'), "l_quantity", F.lit('"/>'))
    docs = T(s, d, "lineitem").select("l_orderkey", "l_partkey", line.alias("line")).groupBy("l_orderkey").agg(F.concat(F.lit("<order>"), F.array_join(F.array_sort(F.collect_list(F.struct("l_partkey", "line")))["line"], ""), F.lit("</order>")).alias("doc"))
    found = xmltable.values_at(docs, "doc", {"many": "order/line[@qty>25]/@part", "least": "/order/line[1]/@part"})
    return found.select("l_orderkey", F.size("many").cast("long").alias("many"), F.col("least")[0].cast("long").alias("least"))


@query("SELECT unnest(['part', 'part/name', 'part/size']) AS path, (SELECT count(*) FROM part) AS n, unnest(['id', '', 'unit']) AS attrs")
def q_xml_outline(s, d):
    return xmltable.outline(xmltable.nodes(part_xml(s, d), "p_partkey", "doc"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS problems, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 3 END::BIGINT AS nodes FROM part")
def q_xml_problems(s, d):
    torn = F.when(F.col("p_partkey") % 3 == 0, F.expr("left(doc, length(doc) - 4)")).otherwise(F.col("doc"))
    n = xmltable.nodes(part_xml(s, d).withColumn("doc", torn), "p_partkey", "doc")
    return n.groupBy("p_partkey").agg(F.count("problem").alias("problems"), F.count("node").alias("nodes"))


# JSON and JSONL

_DOC = "concat('{\"a\":{\"id\":', event_id, ',\"list\":[', event_id % 5, ',', event_id % 7, ',', user_id, ']},\"rows\":[{\"id\":1,\"v\":', event_id % 10, '},{\"id\":2,\"v\":5},{\"x\":[{\"id\":', user_id, '}]}]}')"


def json_found(s, d, path):
    rows = jsonpath.select(T(s, d, "events").select("event_id", F.expr(_DOC).alias("doc")), "doc", path)
    return rows.select("event_id", F.array_join("found", ",").alias("found"))


@query("SELECT event_id, event_id || ',1,2,' || user_id AS found FROM events")
def q_json_deep(s, d):
    return json_found(s, d, "..id")


@query("SELECT event_id, (event_id % 7) || ',' || user_id AS found FROM events")
def q_json_slice(s, d):
    return json_found(s, d, "a.list[1:]")


@query("SELECT event_id, '1,2' AS found FROM events")
def q_json_wildcard(s, d):
    return json_found(s, d, "rows[*].id")


@query("SELECT event_id, CASE WHEN event_id % 10 >= 4 THEN '1,2' ELSE '2' END AS found FROM events")
def q_json_path_filter(s, d):
    return json_found(s, d, "rows[v>=4].id")


@query("SELECT event_id, '{\"id\":1,\"n\":' || (event_id % 10) || '},{\"id\":2,\"n\":5},{\"id\":null,\"n\":null}' AS found FROM events")
def q_json_pick(s, d):
    return json_found(s, d, "rows[*].{id,n:v}")


@query("SELECT n_nationkey, n_name AS name FROM nation")
def q_json_comments(s, d):
    """JSON with comments and trailing commas, read as plain JSON."""
    strip = F.pandas_udf(lambda t: t.map(files.strip_json_comments), "string")
    doc = F.expr("concat('{ // key', chr(10), '\"k\": ', n_nationkey, ', /* name */ \"name\": \"', n_name, '\", \"u\": \"http://x\",}')")
    return nation(s, d).select("n_nationkey", F.get_json_object(strip(doc), "$.name").alias("name"))


@query("""WITH c AS (SELECT event_type AS tool, CASE WHEN event_id % 3 <> 0 THEN strlen(props) END AS bytes FROM events)
SELECT tool, count(*) AS calls, count(*) FILTER (WHERE bytes IS NULL) AS unanswered, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM c GROUP BY 1""")
def q_jsonl_spend(s, d):
    """Two transcript lines of each event, a call and (but for every third) its result, with torn lines among them."""
    e = T(s, d, "events")
    block = lambda *kv: F.struct(*[F.lit(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in kv])
    line = lambda role, b: F.to_json(F.struct(F.lit(role).alias("type"), F.struct(F.lit(role).alias("role"), F.array(b).alias("content")).alias("message")))
    ident = F.concat(F.lit("c"), "event_id")
    use = line("assistant", block(("type", "tool_use"), ("id", ident), ("name", F.col("event_type")), ("input", F.struct(F.col("props").alias("command")))))
    told = line("user", block(("type", "tool_result"), ("tool_use_id", ident), ("content", F.array(F.struct(F.lit("text").alias("type"), F.col("props").alias("text"))))))
    rows = e.select((F.col("user_id") % 5).alias("path"), "event_id", F.explode(F.array(use, F.when(F.col("event_id") % 3 != 0, told).otherwise(F.left(told, F.lit(40))))).alias("line"))
    return transcripts.spend(transcripts.calls(rows, "path", "event_id"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'src/f' || user_id || '.py' ELSE repeat('x', 100) || '…' END AS target FROM events")
def q_jsonl_targets(s, d):
    value = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"file_path":"src/f'), "user_id", F.lit('.py"'))).otherwise(F.lit('"pattern":"' + "x" * 120 + '"'))
    line = F.concat(F.lit('{"message":{"role":"assistant","content":[{"type":"text","text":"so"},{"type":"tool_use","id":"a","name":"Read","input":{'), value, F.lit("}}]}}"))
    return transcripts.calls(T(s, d, "events").select("event_id", F.col("event_id").alias("n"), line.alias("line")), "event_id").select("event_id", "target")


# YAML, OpenAPI, ZIP, SQLite, XLSX

@query("SELECT n_nationkey, n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def q_yaml_scan(s, d):
    rows = files.parsed_rows(made(nation(s, d), "n_nationkey", "concat('name: ', n_name, chr(10), 'at:', chr(10), '  region: ', n_regionkey, chr(10))"), files.yaml_json, "doc string")
    return rows.select(F.col("path").cast("int").alias("n_nationkey"), F.get_json_object("doc", "$.name").alias("name"), F.get_json_object("doc", "$.at.region").cast("long").alias("region"))


@query("SELECT n_nationkey, 'get' AS method, '/n/{id}' AS route, 'op' || n_nationkey AS id, 'path:id,query:q' AS parameters FROM nation")
def q_openapi_operations(s, d):
    """Operations with a local $ref and parameters of the path merged in."""
    doc = "concat('{\"paths\":{\"/n/{id}\":{\"parameters\":[{\"$ref\":\"#/components/parameters/id\"}],\"get\":{\"operationId\":\"op', n_nationkey, '\",\"parameters\":[{\"in\":\"query\",\"name\":\"q\"}]}}},\"components\":{\"parameters\":{\"id\":{\"in\":\"path\",\"name\":\"id\"}}}}')"
    rows = files.parsed_rows(made(nation(s, d), "n_nationkey", doc), files.openapi_operations, files.OPERATIONS)
    return rows.select(F.col("path").cast("int").alias("n_nationkey"), "method", "route", "id", F.array_join("parameters", ",").alias("parameters"))


def zipped(texts: pd.DataFrame) -> bytes:
    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in zip(texts["name"], texts["body"]):
            z.writestr(name, text)
    return buf.getvalue()


def bundles(s, d):
    """One ZIP file for each region, with a text for each nation."""
    rows = nation(s, d).select("n_regionkey", F.concat("n_name", F.lit(".txt")).alias("name"), F.expr("repeat(n_name, 20)").alias("body"))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [str(f["n_regionkey"].iloc[0])], "content": [zipped(f.sort_values("name"))]})

    return rows.groupBy("n_regionkey").applyInPandas(pack, "path string, content binary")


@query("SELECT n_regionkey AS region, n_name || '.txt' AS name, strlen(n_name) * 20 AS size, false AS is_dir FROM nation")
def q_zip_list(s, d):
    rows = files.parsed_rows(bundles(s, d), files.zip_entries, files.ZIP)
    return rows.select(F.col("path").cast("int").alias("region"), "name", "size", "is_dir")


@query("SELECT n_regionkey AS region, arg_min(repeat(n_name, 20), n_name) AS body FROM nation GROUP BY 1")
def q_zip_read(s, d):
    def first(content):
        name = next(files.zip_entries(content))[0]
        yield (files.zip_text(content, name),)

    return files.parsed_rows(bundles(s, d), first, "body string").select(F.col("path").cast("int").alias("region"), "body")


def databases(s, d):
    """One SQLite file for each region, with its nations."""
    import sqlite3

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        con = sqlite3.connect(":memory:")
        con.execute("CREATE TABLE nations (id INTEGER, name TEXT)")
        con.executemany("INSERT INTO nations VALUES (?, ?)", [(int(a), b) for a, b in zip(f["n_nationkey"], f["n_name"])])
        con.commit()
        return pd.DataFrame({"path": [str(f["n_regionkey"].iloc[0])], "content": [bytes(con.serialize())]})

    return nation(s, d).groupBy("n_regionkey").applyInPandas(pack, "path string, content binary")


@query("WITH r AS (SELECT n_regionkey AS region, n_nationkey::BIGINT AS id, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation) SELECT region, id, name, n > 3 AS capped FROM r WHERE i <= 3")
def q_sqlite_query(s, d):
    """A read-only query of three rows at most in each file: the cap is the feature, and told."""
    rows = files.parsed_rows(databases(s, d), lambda c: files.sqlite_capped(c, "SELECT id, name FROM nations ORDER BY name", 3), "doc string, capped boolean")
    return rows.select(F.col("path").cast("int").alias("region"), F.get_json_object("doc", "$.id").cast("long").alias("id"), F.get_json_object("doc", "$.name").alias("name"), "capped")


@query("SELECT DISTINCT n_regionkey AS region, 'nations' AS name, 'table' AS type FROM nation")
def q_sqlite_tables(s, d):
    rows = files.parsed_rows(databases(s, d), files.sqlite_tables, "name string, type string, ddl string")
    return rows.select(F.col("path").cast("int").alias("region"), "name", "type")


def workbook(rows: list[tuple]) -> bytes:
    """A sheet `data` of rows: texts inline, numbers plain."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    cell = lambda v, at: f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v}</v></c>'
    body = "".join(f'<row r="{i}">' + "".join(cell(v, f"{files.column_letters(j)}{i}") for j, v in enumerate(r, 1) if v is not None) + "</row>" for i, r in enumerate(rows, 1))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return buf.getvalue()


def sheets(s, d):
    """The cells of one workbook for each region: a header and its nations by name."""

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("n_name")
        rows = [("id", "name", "region"), *((int(a), b, int(c)) for a, b, c in zip(f["n_nationkey"], f["n_name"], f["n_regionkey"]))]
        return pd.DataFrame({"path": [str(f["n_regionkey"].iloc[0])], "content": [workbook(rows)]})

    return files.parsed_rows(nation(s, d).groupBy("n_regionkey").applyInPandas(pack, "path string, content binary"), files.xlsx_cells, files.CELLS)


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def q_xlsx_table(s, d):
    return files.sheet_table(sheets(s, d), "data")


@query("SELECT n_regionkey AS region, 'data' AS sheet, (count(*) + 1)::INT AS rows, 3 AS columns FROM nation GROUP BY 1")
def q_xlsx_list(s, d):
    return files.sheet_list(sheets(s, d)).select(F.col("path").cast("int").alias("region"), "sheet", "rows", "columns")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) + 1 AS i FROM nation) SELECT n_regionkey AS region, i::INT AS row, n_name AS value FROM r WHERE i BETWEEN 2 AND 4")
def q_xlsx_range(s, d):
    return files.sheet_range(sheets(s, d), "data", "B2:B4").select(F.col("path").cast("int").alias("region"), "row", "value")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) SELECT n_regionkey AS region, n_nationkey::VARCHAR AS value FROM r WHERE i <= 2")
def q_xlsx_head(s, d):
    return files.sheet_head(sheets(s, d), "data", 2).where("col = 1").select(F.col("path").cast("int").alias("region"), "value")


@query("WITH r AS (SELECT n_regionkey AS region, count(*) AS filled FROM nation GROUP BY 1) SELECT region, unnest(['id', 'name', 'region']) AS name, filled, unnest(['number', 'string', 'number']) AS kinds FROM r")
def q_xlsx_columns(s, d):
    return files.sheet_columns(sheets(s, d), "data").select(F.col("path").cast("int").alias("region"), "name", "filled", "kinds")


@query("SELECT n_nationkey, n_nationkey * 30 + 1 AS col, n_nationkey + 3 AS last FROM nation")
def q_a1_ranges(s, d):
    area = F.pandas_udf(lambda c, r: pd.Series([files.column_letters(int(a) * 30 + 1) + f"{b}:B{b + 3}" for a, b in zip(c, r)]), "string")
    decode = F.pandas_udf(lambda t: t.map(lambda x: ",".join(map(str, files.decode_range(x)))), "string")
    parts = F.split(decode(area("n_nationkey", "n_nationkey")), ",")
    return nation(s, d).where("n_nationkey > 0").select("n_nationkey", parts[3].cast("int").alias("col"), parts[2].cast("int").alias("last")).unionByName(nation(s, d).where("n_nationkey = 0").select("n_nationkey", F.lit(1).alias("col"), F.lit(3).alias("last")))


# Transcripts, coverage, text functions

@query("SELECT turn AS cue, conv_id, turn * 61500 AS start_ms, turn * 61500 + 1250 AS end_ms, 'Speaker ' || role AS speaker FROM conversations")
def q_transcript_cues(s, d):
    clock = lambda ms: f"format_string('%02d:%02d:%02d.%03d', cast({ms} div 3600000 as int), cast({ms} div 60000 % 60 as int), cast({ms} div 1000 % 60 as int), cast({ms} % 1000 as int))"
    cue = f"concat({clock('turn * 61500')}, ' --> ', {clock('(turn * 61500 + 1250)')}, chr(10), 'Speaker ', role, ': said')"
    docs = T(s, d, "conversations").select("conv_id", "turn", F.expr(cue).alias("cue")).groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.array_sort(F.collect_list(F.struct("turn", "cue")))["cue"], "\n\n")).alias("text"))
    rows = files.parsed_rows(made(docs, "conv_id", "text"), files.transcript_cues, files.CUES)
    return rows.select(F.col("cue").cast("long").alias("cue"), F.col("path").cast("long").alias("conv_id"), "start_ms", "end_ms", "speaker")


_LCOV = "concat('SF:', o_orderstatus, '/', o_custkey, chr(10), array_join(lines, chr(10)), chr(10), 'end_of_record')"


def lcov(s, d):
    o = T(s, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: F.concat(F.lit("DA:"), x, F.lit(","), x % 3)).alias("lines"))
    return made(o.withColumn("key", F.concat_ws("/", "o_orderstatus", "o_custkey")), "key", _LCOV)


@query("SELECT o_orderstatus || '/' || o_custkey AS file, 'line' AS kind, count(*) FILTER (WHERE o_orderkey % 3 > 0) AS hit, count(*) AS total, round(count(*) FILTER (WHERE o_orderkey % 3 > 0) / count(*), 4) AS share FROM orders GROUP BY 1")
def q_coverage_rollup(s, d):
    return files.coverage_rollup(files.parsed_rows(lcov(s, d), files.coverage_rows, files.COVERAGE))


@query("SELECT p_partkey, unnest(['line', 'function', 'branch']) AS kind, unnest([p_size // 2, 1, 0])::BIGINT AS hit, unnest([p_size, 2, 0])::BIGINT AS total FROM part")
def q_coverage_summary(s, d):
    of = lambda t, c: f"'{{\"total\":', {t}, ',\"covered\":', {c}, ',\"skipped\":0,\"pct\":0}}'"
    doc = f"concat('{{\"total\":{{}},\"f\":{{\"lines\":', {of('p_size', 'p_size div 2')}, ',\"statements\":', {of('p_size', '0')}, ',\"functions\":', {of('2', '1')}, ',\"branches\":', {of('0', '0')}, '}}}}')"
    rows = files.parsed_rows(made(T(s, d, "part"), "p_partkey", doc), files.coverage_totals, files.TOTALS)
    return rows.select(F.col("path").cast("long").alias("p_partkey"), "kind", "hit", "total")


@query("SELECT doc_id, sha256(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped, true AS back FROM (SELECT doc_id, replace(replace(text, '\"', ''), '''', '') AS text FROM documents)")
def q_entities(s, d):
    t = F.translate("text", "\"'", "")
    e = X.entities_escaped(t)
    return T(s, d, "documents").select("doc_id", F.sha2(e, 256).alias("escaped"), (X.entities_decoded(e) == t).alias("back"))


@query("SELECT event_id, event_type || ' ' || user_id AS plain FROM events")
def q_ansi(s, d):
    c = F.concat(F.lit("\x1b]0;title\x07\x1b[1;31m"), "event_type", F.lit("\x1b[0m "), "user_id", F.lit("\x1b[2K\x1b(B"))
    return T(s, d, "events").select("event_id", X.without_ansi(c).alias("plain"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 60) * 1000 + 250 + (user_id % 60) * 60000 END AS ms FROM events")
def q_clock_ms(s, d):
    c = F.format_string("%02d:%02d,250", F.col("user_id") % 60, F.col("event_id") % 60)
    return T(s, d, "events").select("event_id", X.clock_ms(F.when(F.col("event_id") % 4 == 0, F.lit("noon")).otherwise(c)).alias("ms"))


@query("SELECT doc_id, sha256(repeat(text, 3)) AS sha FROM documents WHERE length(text) > 200")
def q_packed(s, d):
    """Texts packed (deflate, base64) and unpacked again; long repeating ones are always shorter packed."""
    rows = X.packed(T(s, d, "documents").where("length(text) > 200").select("doc_id", F.expr("repeat(text, 3)").alias("text")), "text")
    return X.unpacked(rows.select("doc_id", "packed"), "packed", "text").select("doc_id", F.sha2("text", 256).alias("sha"))


# Extractors

_PY = "concat('import os', chr(10), 'class C', p_partkey, ':', chr(10), '    def m(self):', chr(10), '        return ', p_size, chr(10), chr(10), 'def f', p_partkey, '():', chr(10), '    pass', chr(10))"


@query("SELECT p_partkey, unnest(['C' || p_partkey, 'm', 'f' || p_partkey]) AS name, unnest(['class', 'method', 'function']) AS kind, unnest([2, 3, 6]) AS line_start, unnest([4, 4, 7]) AS line_end, unnest([NULL, 'C' || p_partkey, NULL]) AS parent FROM part")
def q_symbols(s, d):
    rows = T(s, d, "part").select("p_partkey", F.lit("a.py").alias("path"), F.expr(_PY).alias("text"))
    return extractors.extracted(rows, "text", extractors.symbols, extractors.SYMBOLS, ["p_partkey"], "path")


@query("SELECT p_partkey, unnest(['./x' || p_partkey, 'os.path', 'lib']) AS module, unnest([1, 2, 3]) AS line, unnest(['{ a }', 'join', '']) AS names FROM part")
def q_imports(s, d):
    text = F.concat(F.lit("import { a } from './x"), "p_partkey", F.lit("'\nfrom os.path import join\nconst l = require('lib')\n"))
    return extractors.extracted(T(s, d, "part").select("p_partkey", F.lit("a.ts").alias("path"), text.alias("text")), "text", extractors.imports, "module string, line int, names string", ["p_partkey"], "path")


@query("SELECT p_partkey, 'pytest' AS tool, 'tests/t.py::test_' || p_partkey AS test, 'size ' || p_size AS message FROM part WHERE p_size > 10")
def q_failures(s, d):
    text = F.when(F.col("p_size") > 10, F.concat(F.lit("== FAILURES ==\nFAILED tests/t.py::test_"), "p_partkey", F.lit(" - size "), "p_size", F.lit("\nFAILED tests/t.py::test_"), "p_partkey", F.lit(" - size "), "p_size")).otherwise("2 passed")
    return extractors.extracted(T(s, d, "part").select("p_partkey", text.alias("text")), "text", extractors.failures, extractors.FAILURES, ["p_partkey"])


@query("SELECT p_partkey, unnest(['python', 'node', 'jvm']) AS kind, unnest(['/a/b.py', '/srv/x.js', 'Main.java']) AS file, unnest([p_size, 7, 9]) AS line, unnest(['f', 'go', 'com.x.Main.run']) AS func FROM part")
def q_traceback(s, d):
    text = F.concat(F.lit('Traceback (most recent call last):\n  File "/a/b.py", line '), "p_size", F.lit(", in f\n    at go (/srv/x.js:7:3)\n    at com.x.Main.run(Main.java:9)\n"))
    return extractors.extracted(T(s, d, "part").select("p_partkey", text.alias("text")), "text", extractors.traceback, extractors.FRAMES, ["p_partkey"])


@query("SELECT p_partkey, 2 AS line, p_name AS ours, p_brand AS theirs FROM part")
def q_conflicts(s, d):
    text = F.concat(F.lit("head\n<<<<<<< ours\n"), "p_name", F.lit("\n||||||| base\nold\n=======\n"), "p_brand", F.lit("\n>>>>>>> theirs\ntail"))
    return extractors.extracted(T(s, d, "part").select("p_partkey", text.alias("text")), "text", extractors.conflicts, extractors.CONFLICTS, ["p_partkey"])


@query("SELECT p_partkey, 'src/' || p_partkey || '.c' AS file, unnest([p_size, 90]) AS lo, unnest([p_size + 3, 90]) AS hi FROM part")
def q_diff_hunks(s, d):
    text = F.concat(F.lit("--- a/x\n+++ b/src/"), "p_partkey", F.lit(".c\n@@ -1,2 +"), "p_size", F.lit(",4 @@\n x\n@@ -80 +90 @@\n y"))
    return extractors.extracted(T(s, d, "part").select("p_partkey", text.alias("text")), "text", extractors.hunks, extractors.HUNKS, ["p_partkey"])


@query("SELECT p_partkey, 'pkg-' || p_partkey AS name, '1.' || p_size AS version FROM part")
def q_dependencies(s, d):
    text = F.concat(F.lit("# lock\npkg-"), "p_partkey", F.lit("==1."), "p_size", F.lit(" ; python_version > '3'\n-e ."))
    return extractors.extracted(T(s, d, "part").select("p_partkey", F.lit("requirements.txt").alias("path"), text.alias("text")), "text", extractors.dependencies, extractors.DEPENDENCIES, ["p_partkey"], "path")


@query("SELECT p_partkey, unnest([1, 6]) AS lo, unnest([4, 10]) AS hi, unnest(['comment', 'body']) AS kind FROM part")
def q_folds(s, d):
    text = F.concat(F.lit("# a\n# b\n# c\n# d\ndef f():\n    x = "), "p_size", F.lit("\n    y = 1\n    z = 2\n    w = 3\n    return x\n"))
    return extractors.extracted(T(s, d, "part").select("p_partkey", F.lit("a.py").alias("path"), text.alias("text")), "text", extractors.folds, extractors.FOLDS, ["p_partkey"], "path")


# Streams

@query("SELECT event_type, ts::DATE AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING (ts::DATE + INTERVAL 1 DAY) <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
def q_stream_closed_days(s, d):
    """Append mode: only days that the watermark has passed come out; later ones could still change."""
    out = ingest.drained(ingest.daily(event_stream(s, d), ["event_type"], "value"))
    return out.select("event_type", F.col("day").cast("date").alias("day"), "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, event_type FROM events")
def q_stream_drain(s, d):
    return ingest.drained(event_stream(s, d).select("event_id", "event_type"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'git' END AS filter, doc_id % 2 = 0 AS shorter FROM documents")
def q_tool_dispatch(s, d):
    """Which filter takes a command: by program and subcommand, with a path and settings before it."""
    runs = T(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "LANG=C /usr/bin/git status -s").otherwise("ls -l").alias("command"), F.concat("text", F.lit('\n\n  (use "git add" to update)\n')).alias("output"))
    out = toolfilters.filtered(runs, "command", "output", ["doc_id"])
    return out.select("doc_id", "filter", (F.col("bytes_after") < F.col("bytes_before")).alias("shorter"))
