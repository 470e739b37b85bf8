"""What each filter of a chain does in every order: a subset-zeta transform of mask counts.

Documents become masks of the filters that they fail; only counts by part and mask go on. The transform sums a part's
counts over the subsets of each mask, one filter at a time, so that the survivors of any set of filters are one look-up,
and a step of an order is the difference of two neighbouring sets.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

WORD_BREAK = r"[\x20\x09-\x0D]+"
MOST_FILTERS = 7
COUNTS = ("n", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D: few words, few distinct words, many capitals, markup signs."""
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents by the set of filters they fail, bit i for the i-th; the last bit: a copy.

    filters: failure conditions over a column `text` without nulls; those of text_filters unless given. A copy has the
    text of a row with a smaller key; rows without a key are no copies and make none. A null part is the empty string,
    a null text the empty one; repeated rows count each; a key with several labels has all of them; labels that are
    neither 0 nor 1 count as 0. Rows are counted before every shuffle, so that a text, key or part held by any share of
    the rows is a few rows there.
    """
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    filters = text_filters(F.col("text")) if filters is None else filters
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(filters.values())), F.lit(0))
    rows = rows.select("k", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = rows.groupBy("k", "part", "mask", "digest").agg(F.count("*").alias("c"))
    known = labels.select(F.col(f"`{key}`").alias("k"), "quality", "toxic").where("k IS NOT NULL").groupBy("k").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(known, "k", "left").fillna(0, ["good", "toxic"])
    least = F.min(F.struct("k", "c"))
    groups = rows.withColumn("keyless", F.col("k").isNull()).groupBy("digest", "part", "mask", "good", "toxic", "keyless").agg(F.sum("c").alias("c"), least.alias("least"))
    groups = materialize(groups, "groups")  # narrow; read twice
    firsts = groups.where("NOT keyless").groupBy("digest").agg(F.min("least.k").alias("first"))
    groups = groups.join(firsts, "digest", "left")
    original = F.when(F.col("keyless"), F.col("c")).when(F.col("least.k") == F.col("first"), F.col("least.c")).otherwise(0)
    copy = 1 << len(filters)
    split = groups.withColumn("own", original).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("c") - F.col("own")).alias("n")))).alias("r"))
    return split.groupBy("part", F.col("r.mask").alias("mask")).agg(F.sum("r.n").alias("n"), F.sum(F.col("r.n") * F.col("good")).alias("good"), F.sum(F.col("r.n") * F.col("toxic")).alias("toxic"))


def survivors(counts: DataFrame, filters: int) -> DataFrame:
    """Rows (part, own, n, good, toxic): arrays over masks. own[m] fails just m; n[m] fails nothing outside m, likewise good and toxic.

    So the survivors of a set S of filters are n[complement of S].
    """
    zero = F.lit(0).cast("long")

    def dense(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), lambda m: F.coalesce(F.try_element_at("by", m).getField(c), zero)).alias(c)

    def wider(c: str, bit: int) -> Column:
        return F.transform(c, lambda v, m: F.when(m.bitwiseAND(F.lit(bit)) != 0, v + F.get(F.col(c), m.bitwiseXOR(F.lit(bit)))).otherwise(v))

    # a part has at most 2^filters rows here
    out = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS)))).alias("by")).select("part", *map(dense, COUNTS))
    out = out.withColumn("own", F.col("n"))
    for i in range(filters):
        out = out.withColumns({c: wider(c, 1 << i) for c in COUNTS})
    return out.select("part", "own", *COUNTS)


def steps(sets: DataFrame, names: str) -> DataFrame:
    """A row for each part, order of the filters and step: what the step keeps, removes and costs, from `survivors`."""
    size, every = len(names), (1 << len(names)) - 1
    if size > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters: every order is a row")
    orders = ",".join(map("".join, permutations(names)))
    rows = sets.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
    rows = rows.withColumn("bit", F.expr(f"shiftleft(1, locate(substring(filter_order, step, 1), '{names}') - 1)"))
    rows = rows.withColumn("before", F.expr(f"aggregate(sequence(1, step), 0, (s, i) -> s + if(i < step, shiftleft(1, locate(substring(filter_order, i, 1), '{names}') - 1), 0))"))
    at = lambda c, without: F.get(F.col(c), F.lit(every).bitwiseXOR(without))
    after = F.col("before").bitwiseOR(F.col("bit"))
    gone = lambda c: at(c, F.col("before")) - at(c, after)
    failing = at("n", F.lit(0)) - at("n", F.col("bit"))
    # a set of p filters stands before this one in p! (size - 1 - p)! orders
    times = ", ".join(str(factorial(p) * factorial(size - 1 - p)) for p in range(size))
    shapley = F.expr(f"aggregate(sequence(0, {every}), 0L, (s, p) -> s + if(p & bit = 0, get(array({times}), bit_count(p)) * (get(n, {every} ^ p) - get(n, {every} ^ (p | bit))), 0L))")
    return rows.select("part", "filter_order", "step", at("n", after).alias("kept"), gone("n").alias("removed"), (failing - gone("n")).alias("redundant"), F.get("own", F.col("bit")).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of the filters A to D and copies, E.

    Odd rows as in mask_counts; an empty table has no parts and no rows; very long texts are looked at whole; other
    columns are ignored.
    """
    names = "ABCDE"
    return steps(survivors(mask_counts(docs, labels, None, key, text, part), len(names)), names)
