"""Merkle fingerprints of documents, in DataFrame operations only.

A text is cut at line ends into paragraphs, paragraphs into pieces at fixed distances from their start, and `fan`
paragraphs form a section. Each paragraph is hashed, each section hashes its paragraphs' hashes, and the root hashes the
sections'. Equal roots mean equal texts; where roots differ, the differing sections and paragraphs say where.

The fingerprint is the whole tree in short hashes: the root, then its sections, each with its paragraphs, each with its
pieces and their lengths. Two fingerprints are compared from the root down: equal roots are alike, of the sections only
those that the other lacks are opened, of their paragraphs likewise, and of their pieces. The likeness is the share of
characters in branches that both have. Nodes are compared as strings, by hashing, so the work grows with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN, PIECE, DIGITS, NODE = 8, 96, 6, 8


def paragraphs(text: Column) -> Column:
    """Paragraphs with their line ends; an empty text has none."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, r"(?<=\n)(?=[\s\S])"))


def pieces(p: Column) -> Column:
    """A paragraph's pieces: they end after 16, 48 and 96 characters, then each PIECE; of short ones after 1, 2, 4, 8, 16."""
    n = F.length(p)
    short = F.array(*[F.substring(p, at + 1, size) for at, size in ((0, 1), (1, 1), (2, 2), (4, 4), (8, 8), (16, 16))])
    first = F.array(F.substring(p, 1, 16), F.substring(p, 17, 32), F.substring(p, 49, PIECE - 48))
    more = F.when(n > PIECE, F.regexp_extract_all(F.substr(p, F.lit(PIECE + 1)), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.when(n < 32, short).otherwise(F.concat(first, more)), lambda x: x != "")


def _range(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _leaf(x: Column) -> Column:
    """A piece: DIGITS of its hash and two of its length."""
    return F.concat(F.substring(F.lpad(F.lower(F.hex(F.xxhash64(x))), 16, "0"), 1, DIGITS), F.lpad(F.lower(F.hex(F.length(x))), 2, "0"))


def with_tree(df: DataFrame, text: str, prefix: str, fan: int = FAN) -> DataFrame:
    """df with the tree of a text column: {prefix}paras and {prefix}sections (hashes), {prefix}root, {prefix}nodes.

    nodes has a string for each section: its hash and its paragraphs, joined by |, each its hash and its pieces. Each
    level is a column of its own, so that no level is computed anew for each node above it.
    """
    p, s, parts, inner = f"{prefix}paras", f"{prefix}sections", f"_{prefix}parts", f"_{prefix}inner"
    df = df.withColumn(parts, paragraphs(F.col(text)))
    df = df.withColumn(p, F.transform(parts, lambda x: F.sha2(x, 256)))
    node = lambda h, x: F.concat(F.substring(h, 1, NODE), F.array_join(F.transform(pieces(x), _leaf), ""))
    df = df.withColumn(inner, F.zip_with(p, parts, node)).drop(parts)
    groups = _range(F.ceil(F.size(p) / fan).cast("int"))
    df = df.withColumn(s, F.transform(groups, lambda g: F.sha2(F.array_join(F.slice(p, g * fan + 1, fan), ""), 256)))
    df = df.withColumn(f"{prefix}nodes", F.transform(s, lambda h, g: F.concat(F.substring(h, 1, NODE), F.array_join(F.slice(inner, g * fan + 1, fan), "|")))).drop(inner)
    return df.withColumn(f"{prefix}root", F.sha2(F.array_join(s, ""), 256))


def fingerprint(prefix: str) -> Column:
    """root:section/section... of a tree."""
    return F.concat(F.substring(f"{prefix}root", 1, 32), F.lit(":"), F.array_join(f"{prefix}nodes", "/"))


def _opened(nodes: str) -> Column:
    """The paragraphs of sections."""
    return F.flatten(F.transform(nodes, lambda s: F.split(F.substr(s, F.lit(NODE + 1)), r"\|")))


def _leaves(paras: str) -> Column:
    """The pieces of paragraphs."""
    return F.flatten(F.transform(paras, lambda p: F.regexp_extract_all(F.substr(p, F.lit(NODE + 1)), F.lit(f".{{{DIGITS + 2}}}"), F.lit(0))))


def _chars(leaves: str) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda n, x: n + F.conv(F.substring(x, DIGITS + 1, 2), 16, 10).cast("long"))


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with `out`, 0 to 1, of two trees (prefixes; root and nodes): the share of characters in branches of both.

    Repeated branches count once. Texts without characters are alike only if both are.
    """
    kept, one, two = df.columns, F.col(f"{a}nodes"), F.col(f"{b}nodes")
    df = df.withColumns({"_sa": F.array_except(one, two), "_sb": F.array_except(two, one)})
    df = df.withColumns({"_pa": _opened("_sa"), "_pb": _opened("_sb")})
    df = df.withColumns({"_da": F.array_except("_pa", "_pb"), "_db": F.array_except("_pb", "_pa")})
    df = df.withColumns({"_la": _leaves("_da"), "_lb": _leaves("_db"), "_wa": F.array_distinct(_leaves_of(f"{a}nodes")), "_wb": F.array_distinct(_leaves_of(f"{b}nodes"))})
    df = df.withColumns({"_xa": F.array_except("_la", "_lb"), "_xb": F.array_except("_lb", "_la")})
    whole, apart = _chars("_wa") + _chars("_wb"), _chars("_xa") + _chars("_xb")
    like = F.when(F.substring(f"{a}root", 1, 32) == F.substring(f"{b}root", 1, 32), F.lit(1.0)).when(whole == 0, F.lit(0.0)).otherwise(1.0 - apart / whole)
    return df.withColumn(out, like).select(*kept, out)


def _leaves_of(nodes: str) -> Column:
    return F.flatten(F.transform(nodes, lambda s: _leaves(F.split(F.substr(s, F.lit(NODE + 1)), r"\|"))))


def likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with `out`: the likeness of two fingerprint columns, from the fingerprints alone."""
    kept = df.columns
    nodes = lambda f: F.when(F.length(f) > 33, F.split(F.substr(f, F.lit(34)), "/")).otherwise(F.array().cast("array<string>"))
    df = df.withColumns({"_anodes": nodes(a), "_bnodes": nodes(b), "_aroot": F.substring(a, 1, 32), "_broot": F.substring(b, 1, 32)})
    return with_likeness(df, "_a", "_b", out).select(*kept, out)


def differences(pairs: DataFrame, a: str, b: str, fan: int = FAN) -> DataFrame:
    """pairs with `sections` and `paragraphs`: indexes of the branches in which texts a and b differ.

    Only sections whose hashes differ are opened. Null texts count as empty.
    """
    df = pairs.withColumns({"_a": F.coalesce(F.col(a), F.lit("")), "_b": F.coalesce(F.col(b), F.lit(""))})
    df = with_tree(with_tree(df, "_a", "_x", fan), "_b", "_y", fan)
    differ = lambda x, y: lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i))
    df = df.withColumn("sections", F.filter(_range(F.greatest(F.size("_xsections"), F.size("_ysections"))), differ("_xsections", "_ysections")))
    inner = F.flatten(F.transform("sections", lambda s: F.filter(F.sequence(s * fan, s * fan + fan - 1), differ("_xparas", "_yparas"))))
    return df.withColumn("paragraphs", inner).select(*pairs.columns, "sections", "paragraphs")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 20_000) -> DataFrame:
    """Rows (key, text, next_text): next by descending key (null keys last, ties by text); after the last, the first.

    Keys are dealt to ranges of about `rows` rows, rows of null key by the first bytes of their text; each range is
    ordered by itself, with the first row of the next range that has one put after it. Only one row of each range meets
    the others, and texts are shuffled once.
    """
    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ids = base.select("k")
    n, nulls = ids.agg(F.count("*"), F.count_if(F.col("k").isNull())).first()
    many = max(1, min(10_000, -(-n // rows)))
    cuts = [] if many == 1 else sorted({x for x in ids.agg(F.percentile_approx("k", [i / many for i in range(1, many)], 10 * many)).first()[0] or []})
    where = F.lit(0)
    if cuts:
        # how many cuts lie below k: a search in an array of at most 10,000 values, halved by a short list of coarse ones
        step = max(1, int(len(cuts) ** 0.5))
        coarse = F.array(*[F.lit(c) for c in cuts[::step]])
        groups = F.array(*[F.array(*[F.lit(c) for c in cuts[i : i + step]]) for i in range(0, len(cuts), step)])
        g = F.size(F.filter(coarse, lambda c: c < F.col("k"))) - 1
        where = F.when(g < 0, F.lit(0)).otherwise(g * step + F.size(F.filter(F.get(groups, g), lambda c: c < F.col("k"))))
    # the first seven bytes as a number: in the order of the texts
    head = F.conv(F.rpad(F.hex(F.substring(F.encode("t", "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    lone = max(1, min(1000, -(-nulls // rows)))
    heads = [] if lone == 1 else sorted({x for x in base.where("k IS NULL").agg(F.percentile_approx(head, [i / lone for i in range(1, lone)], 10 * lone)).first()[0] or []})
    apart = F.size(F.filter(F.array(*[F.lit(c) for c in heads]).cast("array<long>"), lambda c: c < head)) if heads else F.lit(0)
    base = base.withColumn("part", F.when(F.col("k").isNull(), -1 - apart).otherwise(where).cast("int"))
    tops = base.groupBy("part").agg(F.max("k").alias("top"))
    firsts = base.join(tops.withColumnRenamed("part", "_p"), (F.col("part") == F.col("_p")) & F.col("k").eqNullSafe(F.col("top"))).groupBy("part").agg(F.min("t").alias("ft")).withColumn("g", F.lit(0))
    # one row for each range, 10,000 at most: the first row of the range below, around the end
    down = Window.partitionBy("g").orderBy(F.col("part").desc())
    below = firsts.select("part", F.coalesce(F.lead("ft").over(down), F.first("ft").over(down)).alias("t"))
    both = base.withColumn("after", F.lit(0)).unionByName(below.select(F.lit(None).cast(base.schema["k"].dataType).alias("k"), "t", "part", F.lit(1).alias("after")))
    w = Window.partitionBy("part").orderBy("after", F.col("k").desc_nulls_last(), "t")
    return both.withColumn("next", F.lead("t").over(w)).where("after = 0").select("k", "t", "next").toDF(key, text, "next_text")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_sections,
    n_edited_sections), one for each of docs.

    n_edited_sections: how many sections of the text the edit changed, by their place. The edited text has the last half of the characters (rounded down) replaced by as many first ones of the next
    document, or all that it has. Null texts count as empty; a single document is its own next one.
    """
    df = with_next(docs.select(key, text), key, text)
    half = F.floor(F.length(text) / 2).cast("int")
    edited = F.concat(F.left(text, F.length(text) - half), F.left("next_text", half))
    df = df.select(key, F.length(text).cast("long").alias("n_chars"), F.col(text).alias("t"), edited.alias("e"), F.col("next_text").alias("x"))
    df = with_tree(df.withColumn("edited_sha256", F.sha2("e", 256)), "t", "t_").drop("t", "t_paras")
    df = with_tree(df, "e", "e_").drop("e", "e_paras")
    df = with_tree(df, "x", "x_").drop("x", "x_paras", "x_sections")
    df = with_likeness(with_likeness(df, "t_", "e_", "near_edited"), "t_", "x_", "near_next")
    apart = F.filter(_range(F.greatest(F.size("t_sections"), F.size("e_sections"))), lambda i: ~F.get("t_sections", i).eqNullSafe(F.get("e_sections", i)))
    return df.select(key, "n_chars", "edited_sha256", fingerprint("t_").alias("fingerprint"), fingerprint("e_").alias("edited_fingerprint"), "near_edited", "near_next", F.size("t_sections").cast("long").alias("n_sections"), F.size(apart).cast("long").alias("n_edited_sections"))
