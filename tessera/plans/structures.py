"""Graph, markup, read-only SQL and streaming queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import jsonpath, registered
from tessera.functions import text as X
from tessera.operators import graph, walk
from tessera.plans import sqlguard
from tessera.plans.registry import query
from tessera.session import table as T
from tessera.session import work_path
from tessera.sources import markup
from tessera.streaming import accumulate, freshness, ingest

_EDGES = "SELECT DISTINCT a.o_custkey AS src, b.o_custkey AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1"


def edges(s, d):
    """Customers, linked from each order to the one after it."""
    o = T(s, d, "orders")
    after = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("dst"))
    return o.select("o_orderkey", F.col("o_custkey").alias("src")).join(after, "o_orderkey").select("src", "dst").distinct()


@query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT (SELECT min(src) FROM e) AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM r JOIN e ON node = src WHERE hop < 6) SELECT node, min(hop)::INT AS hop FROM r GROUP BY 1")
def q_impact_hops(s, d):
    e = edges(s, d)
    return graph.reach(e, e.agg(F.min("src").alias("node")), 6)


@query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT (SELECT max(dst) FROM e) AS node, 0 AS hop UNION SELECT src, hop + 1 FROM r JOIN e ON node = dst WHERE hop < 5) SELECT node, min(hop)::INT AS hop FROM r GROUP BY 1")
def q_reverse_reach(s, d):
    e = edges(s, d)
    return graph.reach(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), e.agg(F.max("dst").alias("node")), 5)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT [min(src)] AS path, false AS cycle FROM e UNION ALL SELECT list_append(path, dst), list_contains(path, dst) FROM r JOIN e ON path[-1] = src WHERE NOT cycle AND len(path) <= 4)
SELECT path, CASE WHEN cycle THEN 'cycle' WHEN len(path) <= 4 THEN 'leaf' ELSE 'depth' END AS status FROM r WHERE cycle OR len(path) > 4 OR path[-1] NOT IN (SELECT src FROM e)""")
def q_bfs_chains(s, d):
    e = edges(s, d)
    return graph.chains(e, e.agg(F.min("src").alias("node")), 4)


@query(f"WITH e AS ({_EDGES}), n AS (SELECT dst AS node, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM n GROUP BY 1")
def q_degree_hubs(s, d):
    return graph.degrees(edges(s, d))


@query(f"""WITH RECURSIVE e AS (SELECT * FROM ({_EDGES}) WHERE src <> dst), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
p AS (SELECT x.src AS node, least(x.src, min(x.dst)) AS scc FROM r x JOIN r y ON x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst GROUP BY x.src) SELECT node, scc FROM p""")
def q_scc(s, d):
    return graph.cycles(edges(s, d))


def weighted(s, d):
    """The same links, undirected, weighted by their number."""
    e = edges(s, d).where("src <> dst")
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("w"))


_WEIGHTED = f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS w FROM ({_EDGES}) WHERE src <> dst GROUP BY 1, 2"


@query()
def q_communities(s, d):
    return graph.communities(weighted(s, d))


@query(f"""WITH e AS ({_WEIGHTED}), m AS (SELECT sum(w) AS m FROM e), g AS (SELECT a % 4 AS c, sum(w) AS d FROM (SELECT a, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY 1), i AS (SELECT a % 4 AS c, sum(w) AS i FROM e WHERE a % 4 = b % 4 GROUP BY 1)
SELECT round(sum(coalesce(i, 0) / m - (d / (2 * m)) ** 2), 6) AS modularity FROM g LEFT JOIN i USING (c), m""")
def q_modularity(s, d):
    e = weighted(s, d)
    member = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("community", F.col("node") % 4)
    return graph.modularity(e, member).select(F.round("modularity", 6).alias("modularity"))


@query(f"""WITH e AS ({_EDGES}) SELECT src % 5 AS "from", dst % 5 AS "to", count(*) AS n FROM e WHERE src % 5 <> dst % 5 GROUP BY 1, 2""")
def q_cross_edges(s, d):
    e = edges(s, d)
    member = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("community", F.col("node") % 5)
    return graph.cross_edges(e, member)


@query("WITH RECURSIVE r AS (SELECT c_custkey AS id, c_custkey AS up, 0 AS level FROM customer UNION ALL SELECT id, c_custkey // 3, level + 1 FROM r JOIN customer ON c_custkey = up WHERE level < 8) SELECT id, up AS ancestor, level::INT AS level FROM r WHERE level > 0")
def q_ancestors(s, d):
    """Parents c_custkey // 3, a parent table climbed by joins, eight levels at most (the operator's depth)."""
    parents = T(s, d, "customer").select(F.col("c_custkey").alias("node"), F.floor(F.col("c_custkey") / 3).cast("long").alias("parent"))
    return graph.ancestors(parents, 8).select(F.col("node").alias("id"), "ancestor", "level")


def nodes(s, d):
    return markup.nodes(T(s, d, "pages"), "page_id", "html")


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def q_html_links(s, d):
    return markup.select(nodes(s, d), "page_id", "a[href]").select("page_id", F.col("attrs")["href"].alias("href"))


@query("""SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<div class="ad">')) AS x FROM pages) GROUP BY 1""")
def q_html_class(s, d):
    return markup.select(nodes(s, d), "page_id", "div.ad").groupBy("page_id").agg(F.count("*").alias("n"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<h1[ >]'))::BIGINT AS h1, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS p, len(regexp_extract_all(html, '<li[ >]'))::BIGINT AS li FROM pages""")
def q_html_outline(s, d):
    n = nodes(s, d).groupBy("page_id").agg(*[F.count_if(F.col("tag") == t).alias(t) for t in ("h1", "p", "li")])
    return n


@query()
def q_html_lint(s, d):
    return nodes(s, d).where("issue IS NOT NULL").groupBy("tag", "issue").agg(F.count("*").alias("n"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gsi'), '<[^>]+>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS body FROM pages""")
def q_html_text(s, d):
    return T(s, d, "pages").select("page_id", X.markup_text(F.col("html")).alias("body"))


@query("SELECT page_id, (length(url) - length(replace(url, '/', '')))::BIGINT AS depth, string_split(url, '/')[-1] AS base FROM pages")
def q_path_depth(s, d):
    return T(s, d, "pages").select("page_id", X.path_depth(F.col("url")).alias("depth"), F.element_at(F.split("url", "/"), -1).alias("base"))


@query("SELECT c_mktsegment, count(*) AS n, false AS capped FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def q_sql_readonly(s, d):
    return sqlguard.run(s, "SELECT c_mktsegment, count(*) AS n FROM {customer} WHERE c_acctbal > 0 GROUP BY 1;", {"customer": T(s, d, "customer")})


_NAMES = ("customer", "nation", "part", "region", "supplier")


@query("SELECT table_name AS \"table\", (row_number() OVER (PARTITION BY table_name ORDER BY column_index) - 1)::BIGINT AS position, column_name AS \"column\" FROM duckdb_columns() WHERE table_name IN ('customer', 'nation', 'part', 'region', 'supplier')")
def q_table_catalog(s, d):
    rows = sqlguard.catalog({t: T(s, d, t) for t in _NAMES})
    return s.createDataFrame([(t, n, c) for t, n, c, _ in rows], "`table` string, position long, `column` string")


def event_stream(s, d, files=8):
    schema = T(s, d, "events").schema
    return ingest.stream(s, d, schema, "events.parquet", files).withColumn("ts", F.to_timestamp(F.col("ts").cast("string")))


@query("SELECT event_type, ts::DATE AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_stream_daily(s, d):
    """The stream's days, all of them: a drained run in complete mode keeps the last state of each day."""
    out = ingest.drained_complete(ingest.daily(event_stream(s, d), ["event_type"], "value"))
    return out.select("event_type", F.col("day").cast("date").alias("day"), "n", F.round("total", 4).alias("total"))


@query("""WITH o AS (SELECT 'u' || user_id AS key, event_id AS seq, event_type AS sha, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'p1' ELSE 'p2' END AS parser FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) = 1),
l AS (SELECT *, lag(sha) OVER w AS s, lag(parser) OVER w AS p FROM o WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT key, seq, CASE WHEN p IS NULL THEN 'added' WHEN p <> parser THEN 'parser' WHEN s = sha THEN 'touched' ELSE 'edited' END AS verdict FROM l""")
def q_stream_freshness(s, d):
    """Events as observations of a file for each user: a day is a time of change, the type the content; the parser changes on the 15th."""
    e = event_stream(s, d, 1000)
    day = F.unix_timestamp(F.to_date("ts").cast("timestamp"))
    observed = e.select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_type").alias("sha"), (day - 10).alias("mtime"), F.unix_timestamp("ts").alias("indexed"), F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp"), "p1").otherwise("p2").alias("parser"), F.lit(False).alias("gone"), F.col("event_id").alias("seq"))
    with freshness.rocks(s):
        out = ingest.drained(freshness.verdicts(observed))
    return out.where("verdict <> 'unchanged'").select("key", "seq", "verdict")


def census(s, d):
    """Totals by event type of the users' events; a user with an event whose k is 0 counts as a file that can't be read."""
    e = event_stream(s, d, 1000).select(F.col("user_id").cast("string").alias("file"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    acc = accumulate.Accumulator(s, work_path(s, "totals"), ["event_type"], {"calls": F.lit(1), "k": F.col("k")}, accumulate.first_reason({"no k": F.col("k").isNull(), "zero": F.col("k") == 0}))
    acc.run(e, work_path(s, "mark"))
    return acc


_CENSUS = "WITH e AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events), f AS (SELECT user_id, CASE WHEN bool_or(k IS NULL) THEN 'no k' ELSE 'zero' END AS reason FROM e GROUP BY 1 HAVING bool_or(k IS NULL OR k = 0)) "


@query(_CENSUS + "SELECT event_type, count(*)::BIGINT AS calls, sum(k)::BIGINT AS k FROM e ANTI JOIN f USING (user_id) GROUP BY 1")
def q_stream_totals(s, d):
    return census(s, d).totals("event_type string, calls long, k long")


@query(_CENSUS + "SELECT user_id::VARCHAR AS file, reason FROM f")
def q_stream_failed(s, d):
    return census(s, d).failed()


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def q_dirty_queue(s, d):
    return ingest.drained(ingest.deduplicated(event_stream(s, d), ["user_id", "event_type"], "60 days").select("user_id", "event_type"))


@query("WITH o AS (SELECT o_orderkey, o_orderstatus, sha256(o_orderkey || '|' || o_orderstatus) AS sha FROM orders) SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE 'changed' END AS why FROM o WHERE o_orderkey % 5 = 0 OR o_orderstatus = 'P'")
def q_stateful_skip(s, d):
    """Orders against a state of keys and digests that lacks every fifth and has an old digest where the status is P."""
    sha = F.sha2(F.concat_ws("|", "o_orderkey", "o_orderstatus"), 256)
    o = T(s, d, "orders").select("o_orderkey", "o_orderstatus", sha.alias("sha"))
    known = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "old").otherwise(F.col("sha")).alias("sha"))
    todo = ingest.upserted(o, known, "o_orderkey", "sha")
    seen = known.select("o_orderkey", F.lit(True).alias("_seen"))
    return todo.join(seen, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.when(F.col("_seen"), "changed").otherwise("new").alias("why"))


_PATHS = "SELECT lower(p_type) || '/' || p_brand || '/' || CASE WHEN p_size % 5 = 0 THEN 'build/' ELSE '' END || replace(p_name, ' ', '_') || '_' || p_partkey || ['.py', '.ts', '.md', '.bin'][p_size % 4 + 1] AS path FROM part"


def listing(s, d):
    """A path for each part, by type and brand."""
    ending = F.element_at(F.array(*map(F.lit, (".py", ".ts", ".md", ".bin"))), F.col("p_size") % 4 + 1)
    return T(s, d, "part").select(F.concat(F.lower("p_type"), F.lit("/"), "p_brand", F.lit("/"), F.when(F.col("p_size") % 5 == 0, "build/").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_partkey", ending).alias("path"))


@query(f"""WITH p AS ({_PATHS}), k AS (SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.md' THEN 'markdown' END AS language, split_part(path, '/', -1) AS name FROM p WHERE path NOT LIKE '%/build/%')
SELECT path, language FROM k WHERE language IS NOT NULL AND NOT starts_with(path, 'promo/Brand#1/')
AND NOT CASE WHEN starts_with(path, 'economy/Brand#2/') AND starts_with(name, 'small_') THEN true WHEN starts_with(path, 'economy/') THEN false ELSE path LIKE '%.md' AND NOT starts_with(name, 'cold_') END""")
def q_walk(s, d):
    """Files that a walk finds under ignore rules of the root and of two folders below it."""
    rules = [("", 1, "*.md"), ("", 2, "!cold_*.md"), ("", 3, "/promo/Brand#1/"), ("economy", 1, "# comment"), ("economy", 2, "!*.md"), ("economy/Brand#2", 1, "small_*")]
    return walk.walk(listing(s, d), s.createDataFrame(rules, "folder string, n int, rule string"))


@query(f"SELECT path, replace(lower(path), '\\', '/') AS folded, (length(path) - length(replace(path, '/', '')))::INT AS depth, regexp_extract(path, '[.]([a-z]+)$', 1) AS ending, length(path)::BIGINT AS size FROM ({_PATHS})")
def q_sql_functions(s, d):
    """Functions of one's own in an SQL text, as expressions and over batches."""
    registered.register(s)
    registered.register_batches(s, "size_of", "long", _size_of)
    return s.sql("SELECT path, fold_path(path) AS folded, path_depth(path) AS depth, file_ending(path) AS ending, size_of(path) AS size FROM {paths}", paths=listing(s, d))


def _size_of(path: pd.Series) -> pd.Series:
    return path.str.len()


@query("SELECT event_id, json_extract_string(props, '$.k') AS first FROM events")
def q_json_path(s, d):
    out = jsonpath.select(T(s, d, "events").select("event_id", F.concat(F.lit('{"items":['), "props", F.lit("]}")).alias("doc")), "doc", "items[-1].k")
    return out.select("event_id", F.col("found")[0].alias("first"))


@query("WITH RECURSIVE f AS (SELECT 'src/' || p_brand || '/' || replace(p_name, ' ', '_') || '.ts' AS path FROM part GROUP BY 1), i AS (SELECT DISTINCT 'src/' || p_brand || '/main.ts' AS src, './' || replace(p_name, ' ', '_') AS spec, 'src/' || p_brand || '/' || replace(p_name, ' ', '_') || '.ts' AS want FROM part UNION SELECT DISTINCT 'src/' || p_brand || '/main.ts', '../Brand#1/' || replace(p_name, ' ', '_'), 'src/Brand#1/' || replace(p_name, ' ', '_') || '.ts' FROM part) SELECT src, spec, path AS dst FROM i LEFT JOIN f ON path = want")
def q_import_resolve(s, d):
    from tessera.operators import relations

    p = T(s, d, "part").select("p_brand", F.replace("p_name", F.lit(" "), F.lit("_")).alias("n"))
    files = p.select(F.concat(F.lit("src/"), "p_brand", F.lit("/"), "n", F.lit(".ts")).alias("path")).distinct()
    src = F.concat(F.lit("src/"), "p_brand", F.lit("/main.ts")).alias("src")
    specs = p.select(src, F.concat(F.lit("./"), "n").alias("spec")).union(p.select(src, F.concat(F.lit("../Brand#1/"), "n")))
    return relations.resolved(specs, files)


@query("SELECT doc_id, sha256('KEY=[REDACTED:dotenv_value]' || chr(10) || '# note' || chr(10) || 'export B_2 =[REDACTED:dotenv_value]' || CASE WHEN source IS NULL THEN NULL ELSE '' END) AS sha FROM documents")
def q_dotenv_redact(s, d):
    env = F.concat(F.lit("KEY="), "source", F.lit("\n# note\nexport B_2 = x"))
    return T(s, d, "documents").select("doc_id", F.sha2(X.dotenv_redacted(env), 256).alias("sha"))


@query("SELECT doc_id FROM documents ORDER BY (lpad(doc_id::VARCHAR, 9, '0') <= '000000150')::INT, doc_id LIMIT 100")
def q_sweep(s, d):
    files = T(s, d, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"))
    return ingest.sweep(files, "000000150", 100).select("doc_id")


@query()
def q_tool_filter(s, d):
    from tessera.operators import toolfilters

    runs = T(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "git status").otherwise("ls").alias("command"), F.concat("text", F.lit('\n\n  (use "git add" to update)\n')).alias("output"))
    return toolfilters.filtered(runs, "command", "output", ["doc_id"]).select("doc_id", "filter", "bytes_before", "bytes_after")


@query()
def q_stream_streaks(s, d):
    rows = event_stream(s, d).select(F.col("user_id").alias("lane"), F.col("event_id").alias("seq"), F.col("event_type").isin("click", "view").alias("test"))
    return ingest.drained(ingest.streaks(rows))
