"""Projection, predicates, joins, sets and paging over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import clustered, intervals, nearnames, predicates, relations
from tessera.operators.profile import profile
from tessera.plans.registry import query
from tessera.session import table as T
from tessera.session import work_path
from tessera.sources import delimited


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def q_project(s, d):
    return predicates.project(T(s, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def q_where_eq(s, d):
    return predicates.where(T(s, d, "customer"), ["c_mktsegment=BUILDING"]).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def q_where_ne(s, d):
    return predicates.where(T(s, d, "orders"), ["o_orderstatus!=F"]).select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size > 40 AND p_retailprice <= 950.5 AND p_brand > 'Brand#2'")
def q_where_range(s, d):
    df = T(s, d, "part").select("*", *[F.col(c).cast("string").alias(f"{c}_cell") for c in ("p_size", "p_retailprice")])
    return predicates.where(df, ["p_size_cell>40", "p_retailprice_cell <= 950.5", "p_brand > Brand#2"]).select("p_partkey", "p_size", "p_retailprice")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^red |ring$')")
def q_where_regex(s, d):
    return predicates.where(T(s, d, "part"), ["p_name~=^red |ring$"]).select("p_partkey", "p_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 25")
def q_where_multi(s, d):
    df = predicates.where(T(s, d, "lineitem"), ["l_returnflag=R", "l_quantity>=25"])
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("""
WITH c AS (UNPIVOT (SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer) ON c_custkey, c_name, c_nationkey, c_mktsegment INTO NAME "column" VALUE cell),
n AS (SELECT "column", cell, count(*) AS n FROM c GROUP BY ALL),
a AS (SELECT "column", 0::BIGINT AS nulls, count(*) AS "distinct", bool_and(try_cast(cell AS DOUBLE) IS NOT NULL) AS num, min(try_cast(cell AS DOUBLE)) AS mn, max(try_cast(cell AS DOUBLE)) AS mx, min(cell) AS ms, max(cell) AS xs FROM n GROUP BY 1),
t AS (SELECT "column", string_agg(cell || ':' || n, '|' ORDER BY n DESC, cell) AS top_values FROM n WHERE "column" IN (SELECT "column" FROM a WHERE "distinct" <= 10) GROUP BY 1)
SELECT a."column", nulls, "distinct", CASE WHEN num THEN 'number' ELSE 'string' END AS type, CASE WHEN num THEN mn::VARCHAR ELSE ms END AS min, CASE WHEN num THEN mx::VARCHAR ELSE xs END AS max, top_values FROM a LEFT JOIN t USING ("column")""")
def q_profile(s, d):
    return profile(T(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_csv_roundtrip(s, d):
    path = work_path(s, "csv")
    delimited.write(T(s, d, "customer"), path)
    cells = delimited.read(s, path)
    return cells.selectExpr("try_cast(c_custkey AS long) AS c_custkey", "c_name", "try_cast(c_nationkey AS int) AS c_nationkey", "try_cast(c_acctbal AS double) AS c_acctbal", "c_mktsegment")


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name = 'red widget' AND p_type = 'ECONOMY' AND starts_with(p_brand, 'Brand#1')")
def q_symbol_lookup(s, d):
    return relations.lookup(T(s, d, "part"), {"p_name": "red widget", "p_type": "ECONOMY"}, prefix={"p_brand": "Brand#1"}).select("p_partkey", "p_name", "p_brand", "p_type")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#00000010' AND c_name < 'Customer#00000011'")
def q_prefix_scope(s, d):
    return T(s, d, "customer").where(F.col("c_name").startswith("Customer#00000010")).select("c_custkey", "c_name")


@query("SELECT p_brand, count(*) FILTER (WHERE NOT regexp_matches(p_name, 'widget')) AS shown, count(*) FILTER (WHERE regexp_matches(p_name, 'widget')) AS hidden FROM part GROUP BY 1")
def q_hidden_counts(s, d):
    test = F.col("p_name").rlike("widget")
    return T(s, d, "part").groupBy("p_brand").agg(F.count_if(~test).alias("shown"), F.count_if(test).alias("hidden"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), '/(archive|old|legacy)/') THEN 0.7 WHEN regexp_matches(lower(url), '/(doc|docs|blog|en|fr)/') THEN 0.92 ELSE 1.0 END::DOUBLE AS weight FROM pages")
def q_path_weight(s, d):
    return T(s, d, "pages").select("page_id", relations.path_weight(F.col("url")).alias("weight"))


_SPANS = "SELECT o_custkey AS file, o_orderkey AS id, epoch(o_orderdate)::BIGINT // 86400 AS line_start, epoch(o_orderdate)::BIGINT // 86400 + 30 + (o_orderkey % 90) AS line_end FROM orders"
_POINTS = "SELECT o_custkey AS file, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, epoch(l_shipdate)::BIGINT // 86400 AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def spans(s, d):
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    return T(s, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("id"), day.alias("line_start"), (day + 30 + F.col("o_orderkey") % 90).alias("line_end"))


def points(s, d):
    o = T(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("file"))
    return T(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("file", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("line"))


@query(f"""WITH s AS ({_SPANS}), p AS (SELECT DISTINCT file, line FROM ({_POINTS}))
SELECT p.file, p.line, arg_max(id, (line_start, -id)) AS id FROM p LEFT JOIN s ON p.file = s.file AND line_start <= line AND line_end >= line GROUP BY 1, 2""")
def q_interval_innermost(s, d):
    return intervals.innermost(points(s, d).select("file", "line").distinct(), spans(s, d), "file")


@query(f"""WITH s AS ({_SPANS}), p AS (SELECT DISTINCT file, line AS lo, line + 5 AS hi FROM ({_POINTS}))
SELECT p.file, lo, hi, arg_min(id, (line_end - line_start, id)) AS id FROM p JOIN s ON p.file = s.file AND line_start <= lo AND line_end >= hi GROUP BY 1, 2, 3""")
def q_interval_tightest(s, d):
    chunks = points(s, d).select("file", F.col("line").alias("lo"), (F.col("line") + 5).alias("hi")).distinct()
    return intervals.tightest(chunks, spans(s, d), "file")


@query(f"""WITH s AS ({_SPANS}), h AS (SELECT file, min(line) AS lo, max(line) AS hi FROM ({_POINTS}) GROUP BY 1)
SELECT s.file, s.id, greatest(line_start, lo) AS lo, least(line_end, hi) AS hi FROM s JOIN h ON s.file = h.file AND line_start <= hi AND line_end >= lo""")
def q_interval_overlap(s, d):
    hunks = points(s, d).groupBy("file").agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    return intervals.overlaps(hunks, spans(s, d), "file")


@query("""WITH r AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), c AS (SELECT p_partkey, p_name, p_brand, p_size, count(l_suppkey) AS refs FROM part LEFT JOIN r ON p_partkey = l_partkey GROUP BY ALL),
w AS (SELECT *, refs::DOUBLE / count(*) OVER (PARTITION BY p_name) AS credit, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS rn FROM c)
SELECT p_name, p_partkey, p_brand, refs, round(credit, 6) AS credit FROM w WHERE rn = 1""")
def q_ref_credit_rank(s, d):
    refs = T(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct()
    return relations.credited(T(s, d, "part"), refs, ident="p_partkey", name="p_name", size="p_size", user="l_suppkey").select("p_name", "p_partkey", "p_brand", "refs", F.round("credit", 6).alias("credit"))


@query("SELECT p_partkey, p_name FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def q_anti_dead(s, d):
    used = T(s, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return T(s, d, "part").where(~F.col("p_brand").isin("Brand#1", "Brand#2")).join(used, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05)")
def q_anti_coverage_gap(s, d):
    tested = T(s, d, "lineitem").where("l_returnflag = 'R' AND l_discount > 0.05").select(F.col("l_partkey").alias("p_partkey"))
    return T(s, d, "part").where("p_type IN ('ECONOMY', 'STANDARD')").join(tested, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_brand = 'Brand#7')")
def q_semi_testfor(s, d):
    parts = T(s, d, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("l_partkey"))
    lines = T(s, d, "lineitem").join(parts, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return T(s, d, "orders").join(lines, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')")
def q_tuple_not_in(s, d):
    x = T(s, d, "lineitem")
    return x.select("l_partkey", "l_suppkey").distinct().join(x.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], "left_anti")


@query("SELECT event_id, user_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type <> 'view' AND f.event_id > e.event_id)")
def q_never_touched_again(s, d):
    return relations.never_again(T(s, d, "events"), "user_id", "event_id", F.col("event_type") == "view").select("event_id", "user_id")


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-08'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15')
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'fixed' ELSE 'still' END AS state FROM a FULL JOIN b ON a.user_id = b.user_id""")
def q_delta_sets(s, d):
    e = T(s, d, "events").where("event_type = 'error'")
    return relations.delta(e.where("ts < TIMESTAMP_NTZ '2024-01-08'").select("user_id"), e.where("ts >= TIMESTAMP_NTZ '2024-01-08' AND ts < TIMESTAMP_NTZ '2024-01-15'").select("user_id"), ["user_id"])


@query("""WITH a AS (SELECT l_partkey AS k, count(*) AS v FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS v FROM lineitem WHERE year(l_shipdate) = 1999 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.k = b.k""")
def q_reconcile(s, d):
    per = lambda y: T(s, d, "lineitem").where(F.year("l_shipdate") == y).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("v"))
    return relations.drift(per(1998), per(1999), "k", "v")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def q_order_limit_offset(s, d):
    return T(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


_IN_ORDER: dict[tuple[str, str], str] = {}


def in_order(s, d):
    """Customers by segment and name: written by the first query of an application that asks for them, then read."""
    at = s.sparkContext.applicationId, d
    if at not in _IN_ORDER:
        root = work_path(s, "customers")
        clustered.write(T(s, d, "customer"), root, ["c_mktsegment", "c_name"], 1000)
        _IN_ORDER[at] = root
    return _IN_ORDER[at]


@query("SELECT c_mktsegment, c_name, c_custkey FROM customer WHERE (c_mktsegment, c_name) > ('BUILDING', 'Customer#000000700') ORDER BY 1, 2 LIMIT 200")
def q_keyset_page(s, d):
    """A page of a table that was written in key order: its index names the files that hold the page."""
    return clustered.page(s, in_order(s, d), ["c_mktsegment", "c_name"], ["BUILDING", "Customer#000000700"], 200).select("c_mktsegment", "c_name", "c_custkey")


@query("SELECT c_mktsegment, c_name, c_acctbal FROM customer WHERE starts_with(c_mktsegment, 'B')")
def q_keyset_scope(s, d):
    return clustered.scope(s, in_order(s, d), "c_mktsegment", "B").select("c_mktsegment", "c_name", "c_acctbal")


@query("WITH n AS (SELECT c_name, bool_or(c_custkey % 50 = 0) AS asked FROM customer GROUP BY 1) SELECT a.c_name AS name, b.c_name AS near, levenshtein(a.c_name, b.c_name)::BIGINT AS distance FROM n a JOIN n b ON a.asked AND a.c_name <> b.c_name AND levenshtein(a.c_name, b.c_name) <= 2")
def q_near_names(s, d):
    return nearnames.near_names(T(s, d, "customer").select(F.col("c_name").alias("name"), (F.col("c_custkey") % 50 == 0).alias("asked")))


@query("WITH n AS (SELECT DISTINCT p_name FROM part), q AS (SELECT DISTINCT p_name || 's' AS name FROM part WHERE p_partkey % 50 = 0) SELECT name, p_name AS near, levenshtein(name, p_name)::BIGINT AS distance, row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, p_name), p_name)::INT AS rank FROM q JOIN n ON name <> p_name AND levenshtein(name, p_name) <= 3 QUALIFY rank <= 5")
def q_near_suggestions(s, d):
    """Names that aren't there, with what could have been meant."""
    p = T(s, d, "part")
    asked = p.where("p_partkey % 50 = 0").select(F.concat("p_name", F.lit("s")).alias("name"), F.lit(True).alias("asked"))
    known = p.select(F.col("p_name").alias("name"), F.lit(False).alias("asked"))
    found = nearnames.near_names(known.union(asked), 3).join(known.select(F.col("name").alias("near")).distinct(), "near", "left_semi")
    return nearnames.nearest(found, 5)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def q_topk(s, d):
    return T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(100)


@query("""WITH f AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT c_custkey, c_name, (SELECT count(*) FROM f) AS matched, (SELECT count(*) FROM customer) AS total FROM f ORDER BY c_custkey LIMIT 20""")
def q_head_with_totals(s, d):
    return relations.head_with_totals(T(s, d, "customer"), F.col("c_mktsegment") == "BUILDING", ["c_custkey"], 20).select("c_custkey", "c_name", "matched", "total")


@query("SELECT o_orderkey, (o_orderstatus = 'F') AS gone FROM orders ORDER BY (o_orderstatus = 'F'), o_totalprice DESC, o_orderkey LIMIT 100")
def q_sink_deleted(s, d):
    gone = F.col("o_orderstatus") == "F"
    return T(s, d, "orders").select("o_orderkey", gone.alias("gone"), "o_totalprice").orderBy("gone", F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "gone")


@query("SELECT DISTINCT k, channel FROM (SELECT c_nationkey AS k, 'customer' AS channel FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier UNION ALL SELECT n_nationkey, 'nation' FROM nation)")
def q_union_channels(s, d):
    parts = [T(s, d, t).select(F.col(c).alias("k"), F.lit(t).alias("channel")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return relations.union_all(parts).distinct()


@query("SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag = 'R'")
def q_count_filtered(s, d):
    return T(s, d, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1998-01-01' AND l_returnflag = 'R'").agg(F.count("*").alias("n"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name = 'red widget') GROUP BY 1")
def q_group_count(s, d):
    names = T(s, d, "part").where("p_name = 'red widget'").select(F.col("p_partkey").alias("l_partkey"))
    return T(s, d, "lineitem").join(names, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_type FROM part ORDER BY p_type")
def q_distinct(s, d):
    return T(s, d, "part").select("p_type").distinct().orderBy("p_type")


@query("SELECT l_returnflag, l_linestatus, l_shipdate, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 5")
def q_per_group_topn(s, d):
    return relations.top_per_group(T(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], [F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey"], 5).select("l_returnflag", "l_linestatus", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def q_latest_per_key(s, d):
    return relations.latest(T(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def q_orphans(s, d):
    live = T(s, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return T(s, d, "lineitem").join(live, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS filled, sum(CASE WHEN o_orderstatus = 'X' THEN o_totalprice END) AS none, count(*) FILTER (WHERE o_totalprice > 200000) AS big FROM orders GROUP BY 1")
def q_cond_sum(s, d):
    p = F.col("o_totalprice")
    return T(s, d, "orders").groupBy("o_orderpriority").agg(F.sum(F.when(F.col("o_orderstatus") == "F", p)).alias("filled"), F.sum(F.when(F.col("o_orderstatus") == "X", p)).alias("none"), F.count_if(p > 200000).alias("big"))


