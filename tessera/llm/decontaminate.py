"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every `window` consecutive words the least of the `k`-gram hashes is kept (Schleimer, Wilkerson and Aiken, 2003):
a span of `window` words shared by a document and an item has the same least hash on both sides, so the join of the
fingerprints misses none. Each hit is extended to the windows that hold it, and those are compared word for word.
Only positions and hashes are exploded; texts never leave the scan but for documents with a hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, lower_ascii, materialize

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS), "")


def _range(n: Column) -> Column:
    """0 .. n-1, empty where n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _tail(c: str, k: int) -> Column:
    return F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0)))


def _reach(df: DataFrame, column: str, out: str, n: int, step) -> DataFrame:
    """df with `out`: step over every n neighbours of an array column, by doubling; entries past the end are no use.

    zip_with reads both arrays in step; taking items by their index costs several times as much.
    """
    size, have, parts = 1, column, []
    left, at = n, 0
    made = []
    while left:
        if left & 1:
            parts.append((at, have))
            at += size
        left >>= 1
        if left:
            nxt = f"_{out}{2 * size}"
            df = df.withColumn(nxt, F.zip_with(have, _tail(have, size), step))
            made.append(nxt)
            have, size = nxt, 2 * size
    acc = parts[0][1]
    for k, (at, part) in enumerate(parts[1:]):
        nxt = f"_{out}p{k}"
        df = df.withColumn(nxt, F.zip_with(acc, _tail(part, at), step))
        made.append(nxt)
        acc = nxt
    return df.withColumn(out, F.col(acc)).drop(*made)


def with_grams(df: DataFrame, window: int, k: int) -> DataFrame:
    """df(h word hashes, n) with g: hashes of the k-grams, with entries of no use at the end."""
    return _reach(df, "h", "g", k, lambda a, b: F.xxhash64(a, b))


def with_fingerprints(df: DataFrame, window: int, k: int) -> DataFrame:
    """df(h, n) with fps: the distinct least k-gram hashes of the runs of `window` words; none in shorter texts."""
    df = _reach(with_grams(df, window, k), "g", "m", window - k + 1, lambda a, b: F.least(a, b)).drop("g")
    return df.withColumn("fps", F.array_distinct(F.slice("m", 1, F.greatest(F.col("n") - (window - 1), F.lit(0))))).drop("m")


def item_windows(items: DataFrame, window: int, text: str = "text", ident: str = "item_id") -> DataFrame:
    """Rows (gram, len, items): each distinct window of the items, its words joined by spaces, with the ids of its items."""
    n = F.size("w")
    size = F.least(n, F.lit(window))
    grams = F.transform(_range(n - size + 1), lambda i: F.array_join(F.slice("w", i + 1, size), " "))
    rows = items.select(F.coalesce(F.col(ident).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where(n > 0)
    rows = rows.select("item", size.alias("len"), F.explode(F.array_distinct(grams)).alias("gram"))
    return rows.groupBy("gram", "len").agg(F.collect_set("item").alias("items"))


def digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumns({"h": F.transform("w", lambda x: F.xxhash64(x)), "n": F.size("w")}).drop("w")


def scanned(docs: DataFrame, keep: list[str], window: int, k: int, text: str) -> DataFrame:
    """Table of (*keep, digest, n, fps), one row for each of docs: what the one pass over all texts leaves."""
    base = docs.select(*[F.col(f"`{c}`") for c in keep], digest(text).alias("digest"), words(F.col(text)).alias("w"))
    return materialize(with_fingerprints(_hashed(base), window, k).drop("h"), "winnowed")


def _short_hits(texts: DataFrame, spec: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows (digest, start, len): where the hash of an item shorter than a window occurs; one pass for all lengths."""
    step = lambda a, b: F.xxhash64(a, b)
    items = _hashed(spec.where(F.col("len").isin(lengths)).select(F.col("len"), F.split("gram", " ").alias("w")))
    rows = _hashed(texts.select("digest", words(F.col("_t")).alias("w")))
    for m in lengths:
        items, rows = _reach(items, "h", f"g{m}", m, step), _reach(rows, "h", f"g{m}", m, step)
    whole = reduce(lambda c, m: F.when(F.col("len") == m, F.get(f"g{m}", F.lit(0))).otherwise(c), lengths, F.lit(None).cast("long"))
    wanted = items.select("len", whole.alias("fp")).distinct()
    entry = lambda m: lambda x, i: F.struct(F.lit(m).alias("len"), i.alias("start"), x.alias("fp"))
    grams = [F.transform(F.slice(f"g{m}", 1, F.greatest(F.col("n") - (m - 1), F.lit(0))), entry(m)) for m in lengths]
    return rows.select("digest", F.inline(F.concat(*grams))).join(wanted, ["len", "fp"], "left_semi").select("digest", "start", "len")


def find(docs: DataFrame, scan: DataFrame, items: DataFrame, window: int = 8, k: int = 5, text: str = "text", item_text: str = "text", ident: str = "item_id") -> DataFrame:
    """Rows (digest, spans array<struct<start,len>>, items array<string>) for each distinct text of docs with a hit.

    digest is the MD5 of the text. An item of fewer than `window` words (but one at least) is one window of its own
    length. Null texts have no words. Items with a null id go by the id ''.
    """
    spec = item_windows(items, window, item_text, ident)
    of_items = _hashed(spec.where(F.col("len") == window).select(F.split("gram", " ").alias("w")))
    of_items = with_fingerprints(of_items, window, k).select(F.explode("fps").alias("fp")).distinct()
    hits = scan.select("digest", F.explode("fps").alias("fp")).join(of_items, "fp", "left_semi").distinct()
    texts = docs.select(digest(text).alias("digest"), F.col(text).alias("_t"))
    near = texts.join(hits.select("digest").distinct(), "digest", "left_semi").select("digest", words(F.col("_t")).alias("w"))
    grams = with_grams(_hashed(near), window, k).select("digest", F.posexplode(F.slice("g", 1, F.greatest(F.col("n") - (k - 1), F.lit(0)))).alias("pos", "fp"))
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(window - k)), lambda d: F.col("pos") - d))
    found = grams.join(hits, ["digest", "fp"], "left_semi").select("digest", starts.alias("start"), F.lit(window).alias("len"))
    lengths = sorted(r[0] for r in spec.where(F.col("len") < window).select("len").distinct().collect())  # window - 1 values at most
    if lengths:
        found = found.unionByName(_short_hits(texts, spec, lengths))
    wanted = found.where("start >= 0").distinct().groupBy("digest").agg(F.collect_list(F.struct("start", "len")).alias("spans"))
    near = texts.join(wanted, "digest").select("digest", "spans", words(F.col("_t")).alias("w"))
    cut = F.transform(F.filter("spans", lambda s: s["start"] + s["len"] <= F.size("w")), lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), F.array_join(F.slice("w", s["start"] + 1, s["len"]), " ").alias("gram")))
    exact = near.select("digest", F.inline(cut)).join(spec, ["gram", "len"])
    exact = exact.groupBy("digest", "start", "len").agg(F.first("items").alias("items"))
    return exact.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "len"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["start"] + s["len"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, least: int = 2, window: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, n_hit, n_items, items_sha256, contaminated), one for each row of docs.

    contaminated: windows of `least` items or more occur. Null and empty texts have no words and no hits; null and
    repeated keys are kept; equal texts get equal results; without items nothing is hit.
    """
    scan = scanned(docs, [key], window, 5, text)
    found = find(docs, scan, items, window, text=text)
    found = found.select("digest", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"))
    out = scan.select(key, "digest", F.col("n").cast("long").alias("n_words")).join(found, "digest", "left")
    n = F.coalesce("n_items", F.lit(0).cast("long"))
    return out.select(key, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n.alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n >= least).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, least: int = 2, window: int = 8, text: str = "text") -> DataFrame:
    """Rows of docs, all columns as they are, without those that hold windows of `least` items or more.

    Null and empty texts stay; equal texts go or stay together, repeated rows as well; without items nothing goes.
    """
    bad = find(docs, scanned(docs, [], window, 5, text), items, window, text=text).where(F.size("items") >= least).select("digest")
    mark = fresh(docs, "_digest_of_text")
    return docs.withColumn(mark, F.md5(F.coalesce(F.col(text), F.lit("")))).join(bad.withColumnRenamed("digest", mark), mark, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
