"""The llm queries and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, decontaminate, filteraudit, licenses, merkle, mixing, neardup, pii, quality, sharding, substrings, tokens, toxicity
from tessera.llm.common import shared_folder, table

TOKENIZER = "word_bpe_49k.json"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_folder(spark)}/tessera-corpus-{uuid.uuid4().hex}"
    out = sharding.sharded(table(spark, sf_dir, "documents"), root)
    per = sharding.manifest(spark, root).select(F.col("shard").alias("_shard"), F.col("docs").alias("shard_docs"), F.col("bytes").alias("shard_bytes"))
    return out.join(per, "_shard").select("doc_id", F.col("_run").alias("run"), F.col("_tier").alias("tier"), F.col("_shard").alias("shard"), "shard_docs", "shard_bytes")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = alignment.align(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGNED))
    return out.withColumn("groups_sha256", F.coalesce(F.sha2("groups", 256), F.lit(""))).drop("groups")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_near_dedup, op3_fingerprints, op4_sharding, op5_personal_data, op6_mixing, op7_token_counts, op8_license_scan, op9_substring_dedup, op10_decontaminate, op11_token_alignment, op12_filter_audit, op13_toxicity)}

_WORDS10 = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

SQL: dict[str, str] = {
    "op4_sharding": """
WITH d AS (SELECT doc_id, coalesce(doc_id // 16384, -1) AS slot, coalesce(doc_id // 16384, -1) || '/' || coalesce(source, '') AS run,
                  coalesce(strlen(text), 0) AS b, coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '') AS t FROM documents),
r AS (SELECT slot, run, sum(b)::BIGINT AS bytes FROM d GROUP BY ALL),
p AS (SELECT *, ((length(bin(bytes)) - 1) // 2)::INT AS tier, floor(slot / 256)::BIGINT AS region, greatest(1, ceil(bytes / 67108864))::BIGINT AS parts FROM r),
s AS (SELECT *, coalesce(sum(CASE WHEN parts = 1 THEN bytes ELSE 0 END) OVER (PARTITION BY tier, region ORDER BY slot, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 67108864 AS number FROM p),
m AS (SELECT d.doc_id, d.run, tier, b, CASE WHEN parts = 1 THEN 't' || tier || '-r' || region || '-' || number
             ELSE 't' || tier || '-' || d.run || '-' || (('0x' || substr(md5(t), 1, 8))::BIGINT % parts) END AS shard FROM d JOIN s USING (slot, run))
SELECT doc_id, run, tier, shard, count(*) OVER (PARTITION BY shard) AS shard_docs, (sum(b) OVER (PARTITION BY shard))::BIGINT AS shard_bytes FROM m""",
    "op9_substring_dedup": """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, i, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS g, n FROM u QUALIFY i <= n - 34),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY md5(g)) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS left_over FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) a ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(left_over, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op10_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS10} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS10} AS w FROM benchmark),
bu AS (SELECT item, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM b WHERE len(w) > 0),
du AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, m, g FROM (SELECT item, i, n, least(n, 8) AS m,
       CASE WHEN n >= 8 THEN string_agg(x, ' ') OVER (PARTITION BY item ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
            ELSE string_agg(x, ' ') OVER (PARTITION BY item ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS g FROM bu)
       WHERE i <= n - m + 1),
dl AS (SELECT doc_id, i, x, count(*) OVER (PARTITION BY doc_id) AS n, {', '.join(f"lead(x, {k}) OVER q AS x{k}" for k in range(1, 8))} FROM du WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
dw AS (SELECT doc_id, i, m, x || {' || '.join(f"CASE WHEN m > {k} THEN ' ' || x{k} ELSE '' END" for k in range(1, 8))} AS g FROM dl, (SELECT DISTINCT m FROM bw) WHERE i <= n - m + 1),
hit AS (SELECT doc_id, i, dw.m, item FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op12_filter_audit": """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*)::BIGINT AS n, sum(coalesce(good, 0))::BIGINT AS good, sum(coalesce(toxic, 0))::BIGINT AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM o, range(1, 6) r(i)),
r AS (SELECT part, filter_order, step::INT AS step, bit, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
             sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
             sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r""",
}
