"""Event ledger queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import keyedstore, ledger
from tessera.plans.registry import query
from tessera.session import table as T
from tessera.session import work_path


def events(s, d):
    return T(s, d, "events")


def k():
    return F.get_json_object("props", "$.k").cast("long")


_K = "json_extract_string(props, '$.k')::BIGINT"


@query(f"SELECT event_type, count(*) AS n, sum({_K})::BIGINT AS k_sum FROM events GROUP BY 1")
def q_json_props(s, d):
    return events(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k()).alias("k_sum"))


@query("SELECT event_type, (user_id % 3)::BIGINT AS harness, ts::DATE AS day, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1, 2, 3")
def q_rollup_daily(s, d):
    e = events(s, d)
    last = e.agg(F.max("ts").alias("now"))
    e = e.join(F.broadcast(last), F.expr("ts >= now - INTERVAL 7 DAYS"))  # one row
    return e.groupBy("event_type", (F.col("user_id") % 3).alias("harness"), F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, (user_id % 3)::BIGINT AS harness, grouping(event_type)::BIGINT AS all_types, grouping(user_id % 3)::BIGINT AS all_harnesses, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 3), (event_type, user_id % 3), ())")
def q_grouping_sets(s, d):
    e = events(s, d).withColumn("harness", F.col("user_id") % 3)
    e = e.groupingSets([[F.col("event_type")], [F.col("harness")], [F.col("event_type"), F.col("harness")], []], "event_type", "harness")
    return e.agg(F.grouping("event_type").cast("long").alias("all_types"), F.grouping("harness").cast("long").alias("all_harnesses"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, (user_id % 3)::BIGINT AS harness, count(*) AS n, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS max, max(ts) AS newest FROM events GROUP BY 1, 2 ORDER BY p95 DESC, 1, 2")
def q_latency_percentiles(s, d):
    return ledger.latency(events(s, d).withColumn("harness", F.col("user_id") % 3), ["event_type", "harness"], "value", "ts")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) AS other FROM events GROUP BY 1")
def q_pivot_counts(s, d):
    kind = F.when(F.col("event_type").isin("error", "view"), F.col("event_type")).otherwise("other")
    return events(s, d).withColumn("kind", kind).groupBy("user_id").pivot("kind", ["error", "view", "other"]).agg(F.count("event_id")).na.fill(0)


@query("WITH v AS (SELECT value FROM events WHERE event_type = 'view') SELECT round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90, count(*) FILTER (WHERE value <= 10) AS near, count(*) FILTER (WHERE value > 10 AND value <= 20) AS middle, count(*) FILTER (WHERE value > 20) AS far, round(count(*) FILTER (WHERE value > 20) / count(*), 6) AS weak_share FROM v")
def q_distance_bands(s, d):
    v = events(s, d).where("event_type = 'view'")
    p = F.percentile("value", F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    out = v.agg(p.alias("p"), F.count_if(F.col("value") <= 10).alias("near"), F.count_if((F.col("value") > 10) & (F.col("value") <= 20)).alias("middle"), F.count_if(F.col("value") > 20).alias("far"), F.count("*").alias("n"))
    return out.select(*[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))], "near", "middle", "far", F.round(F.try_divide("far", "n"), 6).alias("weak_share"))


@query("SELECT event_type, count(*) FILTER (WHERE value > 30) AS acted, count(*) AS emitted, CASE WHEN count(*) FILTER (WHERE value > 1000) > 0 THEN 1.0 END::DOUBLE AS none, round(100.0 * count(*) FILTER (WHERE value > 30) / count(*), 1)::DOUBLE AS efficacy FROM events GROUP BY 1")
def q_efficacy(s, d):
    out = events(s, d).groupBy("event_type").agg(F.count_if(F.col("value") > 30).alias("acted"), F.count("*").alias("emitted"), F.count_if(F.col("value") > 1000).alias("_none"))
    return out.select("event_type", "acted", "emitted", F.round(F.try_divide("_none", "_none"), 1).alias("none"), F.round(100.0 * F.try_divide("acted", "emitted"), 1).alias("efficacy"))


@query("SELECT l_suppkey, round(sum(l_extendedprice), 2) AS spend, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY spend DESC, l_suppkey")
def q_spend_by_key(s, d):
    return T(s, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("spend"), F.count("*").alias("n")).orderBy(F.desc("spend"), "l_suppkey")


@query("SELECT lower(trim(p_name)) || '/' || p_type AS command, count(*) AS runs, sum(p_size)::BIGINT AS total, round(sum(p_size) / count(*))::BIGINT AS average FROM part GROUP BY 1 HAVING count(*) >= 2")
def q_repeated(s, d):
    g = T(s, d, "part").groupBy(F.concat_ws("/", F.lower(F.trim("p_name")), "p_type").alias("command")).agg(F.count("*").alias("runs"), F.sum("p_size").alias("total"))
    return g.where("runs >= 2").withColumn("average", F.round(F.col("total") / F.col("runs")).cast("long"))


@query("WITH x AS (SELECT conv_id, strlen(text) AS size, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, sum(size * (n - i))::BIGINT AS ceiling FROM x GROUP BY 1")
def q_resend_ceiling(s, d):
    w = Window.partitionBy("conv_id")
    c = T(s, d, "conversations").select("conv_id", F.octet_length("text").alias("size"), F.row_number().over(w.orderBy("turn")).alias("i"), F.count("*").over(w).alias("n"))
    return c.groupBy("conv_id").agg(F.sum(F.col("size") * (F.col("n") - F.col("i"))).alias("ceiling"))


@query(f"""WITH c AS (SELECT (user_id % 7)::BIGINT AS tool, CASE WHEN event_type = 'error' THEN CASE WHEN {_K} < 30 THEN 'timeout' WHEN {_K} < 60 THEN 'missing' ELSE 'unclassified' END END AS reason, count(*) AS n FROM events GROUP BY 1, 2)
SELECT tool, sum(n)::BIGINT AS calls, sum(CASE WHEN reason IS NOT NULL THEN n ELSE 0 END)::BIGINT AS errors, coalesce(string_agg(reason || '=' || n, ',' ORDER BY reason), '') AS reasons FROM c GROUP BY 1""")
def q_error_census(s, d):
    reason = F.when(k() < 30, "timeout").when(k() < 60, "missing").otherwise("unclassified")
    return ledger.census(events(s, d).withColumn("tool", F.col("user_id") % 7), ["tool"], F.col("event_type") == "error", reason)


_GAP = "SELECT event_id, user_id, event_type, value, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us, lag(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"SELECT event_id, user_id, gap_us, after FROM ({_GAP}) WHERE gap_us > 43200000000")
def q_gap_detect(s, d):
    return ledger.gaps(events(s, d), "user_id", "ts", "event_id", 3600 * 12).select("event_id", "user_id", "gap_us", "after")


@query(f"WITH g AS (SELECT after, count(*) AS n, sum(value) AS cost FROM ({_GAP}) WHERE gap_us > 43200000000 GROUP BY 1) SELECT after, n, round(cost, 4) AS cost, round(cost / sum(cost) OVER (), 6) AS share FROM g")
def q_gap_rollup(s, d):
    g = ledger.gaps(events(s, d), "user_id", "ts", "event_id", 3600 * 12).groupBy("after").agg(F.count("*").alias("n"), F.sum("value").alias("cost"))
    total = g.agg(F.sum("cost").alias("_all"))
    return g.crossJoin(F.broadcast(total)).select("after", "n", F.round("cost", 4).alias("cost"), F.round(F.col("cost") / F.col("_all"), 6).alias("share"))  # one row


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(event_id) AS n_last, count(*) AS n FROM events GROUP BY 1")
def q_last_per_group(s, d):
    return events(s, d).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("event_id").alias("n_last"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT user_id, event_id, (event_type IN ('click', 'view')) AS t FROM events), b AS (SELECT *, CASE WHEN t = lag(t) OVER w THEN 0 ELSE 1 END AS c FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM b) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g WHERE t GROUP BY user_id, i HAVING count(*) >= 3""")
def q_streaks(s, d):
    return ledger.streaks(events(s, d), "user_id", ["event_id"], F.col("event_type").isin("click", "view"), 3)


@query("""WITH a AS (SELECT DISTINCT l_suppkey, l_orderkey // 16 AS n FROM lineitem), g AS (SELECT *, n - row_number() OVER (PARTITION BY l_suppkey ORDER BY n) AS g FROM a) SELECT l_suppkey, min(n) AS lo, max(n) AS hi FROM g GROUP BY l_suppkey, g""")
def q_collapse_ranges(s, d):
    return ledger.ranges(T(s, d, "lineitem").select("l_suppkey", F.floor(F.col("l_orderkey") / 16).alias("n")), "l_suppkey", "n")


@query("""WITH x AS (SELECT source, doc_id, ceil(strlen(text) / 4.0)::BIGINT AS cost FROM documents), y AS (SELECT *, sum(cost) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS running, sum(cost) OVER (PARTITION BY source)::BIGINT AS total_cost, count(*) OVER (PARTITION BY source) AS total_rows FROM x) SELECT * FROM y WHERE running <= 5000""")
def q_token_budget_pack(s, d):
    docs = T(s, d, "documents").select("source", "doc_id", F.ceil(F.octet_length("text") / 4.0).alias("cost"))
    return ledger.within_budget(docs, "source", ["doc_id"], "cost", 5000)


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts DESC, event_id DESC) AS rn, sum(value) OVER (PARTITION BY user_id % 5 ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS run FROM events WHERE ts >= TIMESTAMP '2024-01-20') SELECT event_id FROM x WHERE rn <= 300 AND (run <= 6000 OR rn = 1)""")
def q_cache_evict(s, d):
    e = events(s, d).withColumn("shard", F.col("user_id") % 5)
    return ledger.evict(e, "shard", "ts", "event_id", "value", F.expr("TIMESTAMP_NTZ '2024-01-20'"), 300, 6000).select("event_id")


@query("""WITH r AS (SELECT event_type || '/' || user_id AS key, epoch_us(ts)::BIGINT AS stored_at, props AS text FROM events), l AS (SELECT key, max(stored_at) AS stored_at, arg_max(text, (stored_at, text)) AS text FROM r GROUP BY 1),
t AS (SELECT *, sum(strlen(text)) OVER (ORDER BY stored_at DESC, key) AS running FROM l) SELECT key, stored_at, text FROM t WHERE running <= 5000""")
def q_keyed_store(s, d):
    """The last event of each user and type, put into a store in two halves; the latest ones that fit into 5,000 bytes stay."""
    root = work_path(s, "entries")
    rows = T(s, d, "events").select(F.concat_ws("/", "event_type", "user_id").alias("key"), F.unix_micros(F.to_timestamp(F.col("ts").cast("string"))).alias("stored_at"), F.col("props").alias("text"), "value")
    keyedstore.put(s, root, rows.where("value < 50").drop("value"))
    keyedstore.put(s, root, rows.where("value >= 50 OR value IS NULL").drop("value"), 5000)
    return keyedstore.entries(s, root)


@query("""SELECT user_id, event_id AS failed_id, solved_id FROM (SELECT *, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS solved_id FROM events) WHERE event_type = 'error' AND solved_id IS NOT NULL""")
def q_recovery_pairs(s, d):
    return ledger.recoveries(events(s, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase", "event_id")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM b GROUP BY user_id, g""")
def q_session_window(s, d):
    w = F.session_window("ts", "6 hours")
    return events(s, d).groupBy("user_id", w.alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("w")


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 50")
def q_recent(s, d):
    return events(s, d).where("event_type = 'signup'").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query(f"SELECT event_id FROM events WHERE {_K} >= 50 AND {_K} < 80 OR {_K} = 3")
def q_json_filter(s, d):
    from tessera.operators.predicates import json_filter

    return events(s, d).where(json_filter("props", "k>=50 && k<80 || k=3")).select("event_id")


@query("SELECT event_id FROM events WHERE contains(json_extract_string(props, '$.k'), '7') AND json_extract_string(props, '$.k') <> '70'")
def q_json_contains(s, d):
    from tessera.operators.predicates import json_filter

    return events(s, d).where(json_filter("props", "k*=7 && k!=70 && missing!=1")).select("event_id")


@query("SELECT 'k' AS key, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' ELSE json_type(props, '$.k') END AS type, count(*) AS n FROM events GROUP BY 1, 2")
def q_json_outline(s, d):
    from tessera.functions.jsonpath import outline

    return outline(events(s, d), "props")


@query("SELECT user_id, event_type, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY 1, 2 HAVING count(*) > 20")
def q_hot_keys(s, d):
    return events(s, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id")).where("n > 20")


@query("WITH o AS (SELECT o_custkey, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS h FROM orders GROUP BY 1), p AS (SELECT o_custkey, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS h FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT o.o_custkey, (p.h IS NULL OR p.h <> o.h) AS stale FROM o LEFT JOIN p USING (o_custkey)")
def q_stale_notes(s, d):
    def prints(df, name):
        return df.groupBy("o_custkey").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")).alias(name))

    o = T(s, d, "orders")
    return prints(o, "a").join(prints(o.where("o_orderstatus <> 'P'"), "b"), "o_custkey", "left").select("o_custkey", (~F.col("a").eqNullSafe(F.col("b"))).alias("stale"))
