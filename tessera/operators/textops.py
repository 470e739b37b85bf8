"""Folding, filtering, sections, duplicates and snippets of lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.ledger import islands
from tessera.session import stored

#: Line rules by name, in order; the first that matches decides. None drops the line, a text replaces it.
LINE_RULES: list[tuple[str, str, str | None]] = [
    ("git-progress", r"(?i)^(remote:\s+)?(Counting objects|Compressing objects|Receiving objects|Resolving deltas|Unpacking objects|Enumerating objects|Writing objects):", None),
    ("npm-summary", r"(?i)^\s*(added|removed|changed|audited)\s+\d+\s+packages?\b", None),
    ("npm-funding", r"(?i)^\s*\d+\s+packages? are looking for funding\b", None),
    ("pip-download", r"(?i)^\s*(Downloading|Collecting|Using cached|Requirement already satisfied)\b", None),
    ("progress-bar", r"[█▉▊▋▌▍▎▏▓▒░]{3,}", None),
    ("docker-pull", r"(?i)^[0-9a-f]{6,}:\s+(Pulling|Waiting|Downloading|Verifying|Extracting|Download complete|Pull complete|Already exists)\b", None),
    ("cargo-progress", r"^\s*(Compiling|Downloading|Downloaded|Updating|Fetching)\s+\S", None),
    ("webpack-asset", r"(?i)^\s*(asset|chunk)\s+\S+\s+[\d.]+\s*(KiB|MiB|bytes)\b", None),
    ("binary-content", r"\x00", "[binary content elided]"),
]


def folded_runs(lines: DataFrame, key: str) -> DataFrame:
    """(key, n, line, times): runs of neighbouring lines with equal normalised text, the first line of each."""
    runs = islands(lines, key, ["n"], X.normalized(F.col("line")))
    return runs.groupBy(key, "island").agg(F.min("n").alias("n"), F.min_by("line", "n").alias("line"), F.count("*").alias("times")).drop("island")


def folded(lines: DataFrame, key: str) -> DataFrame:
    """(key, norm, first, times): all lines with equal normalised text, wherever they are."""
    return lines.groupBy(key, X.normalized(F.col("line")).alias("norm")).agg(F.min("n").alias("first"), F.count("*").alias("times"))


def filtered_lines(lines: DataFrame, rules: list[tuple[str, str, str | None]] = LINE_RULES) -> DataFrame:
    """Lines after the rules; dropped ones are gone. The first rule that matches a line decides."""
    line, out = F.col("line"), F.col("line")
    for _, pattern, to in reversed(rules):
        out = F.when(line.rlike(pattern), F.lit(to).cast("string")).otherwise(out)
    return lines.withColumn("line", out).where("line IS NOT NULL")


def duplicate_lines(lines: DataFrame, key: str) -> DataFrame:
    """(line, files, times) of the lines, not blank, that stand in more than one file."""
    per = lines.where(F.trim("line") != "").groupBy("line", key).agg(F.count("*").alias("n"))
    return per.groupBy("line").agg(F.count("*").alias("files"), F.sum("n").alias("times")).where("files > 1")


def sections(lines: DataFrame, key: str, heading: Column) -> DataFrame:
    """(key, line, lo, hi): each heading up to the line before the next one, the last up to the file's end."""
    last = lines.groupBy(key).agg(F.max("n").alias("_last"))
    heads = lines.where(heading).withColumn("_next", F.lead("n").over(Window.partitionBy(key).orderBy("n")))
    return heads.join(last, key).select(key, "line", F.col("n").alias("lo"), F.coalesce(F.col("_next") - 1, "_last").alias("hi"))


def extract(lines: DataFrame, key: str, heading: Column, first: int) -> DataFrame:
    """Headings and the first lines (not blank) of each section."""
    w = Window.partitionBy(key).orderBy("n")
    marked = lines.withColumns({"_h": heading, "_s": F.sum(heading.cast("int")).over(w)}).where((F.trim("line") != "") | F.col("_h"))
    rank = F.row_number().over(Window.partitionBy(key, "_s", "_h").orderBy("n"))
    return marked.withColumn("_r", rank).where(F.col("_h") | (F.col("_r") <= first)).select(key, "n", "line")


def chunks(df: DataFrame, key: str, text: str, size: int, overlap: int, most: int | None = None) -> DataFrame:
    """(key, chunk, lo, body): windows of `size` characters with an overlap over the whole text, or the first `most`."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1))
    n = (n if most is None else F.least(n, F.lit(most))).cast("int")
    at = F.explode(F.sequence(F.lit(0), n - 1))
    return df.where(F.length(text) > 0).select(key, text, at.alias("chunk")).select(key, F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") * step).cast("long").alias("lo"), F.col(text).substr(F.col("chunk") * step + 1, F.lit(size)).alias("body"))


def snippet(text: Column, word: str, before: int = 30, length: int = 80) -> Column:
    """White space folded, cut around the first hit of a word; null without one."""
    flat = F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")
    at = F.instr(F.lower(flat), word.lower())
    return F.when(at > 0, flat.substr(F.greatest(at - before, F.lit(1)), F.lit(length)))


def similar_sets(pairs: DataFrame, key: str, token: str, least: float) -> DataFrame:
    """(a, b, both, jaccard): keys a < b whose token sets have a Jaccard similarity of `least` or more, by classes.

    Keys of equal sets are one class, named by its least key; each member has one row with it (jaccard 1). Pairs are
    those of the classes' names, so copies are never expanded. Prefix filter: tokens are ordered from rare to frequent,
    and two sets that similar share one among the first n - ceil(least n) + 1 of each; only those meet in the join.
    """
    t = stored(pairs.select(F.col(key).alias("k"), F.xxhash64(token).alias("t")).distinct(), "tokens")
    # the class of a set: sums and xors of its members' hashes, aggregated before the shuffle
    marks = t.groupBy("k").agg(F.count("*").alias("size"), F.bit_xor("t").alias("x"), F.bit_xor(F.xxhash64("t", F.lit(1))).alias("y"))
    marks = stored(marks.join(marks.groupBy("size", "x", "y").agg(F.min("k").alias("a")), ["size", "x", "y"]).select("k", "a", "size"), "classes")
    members = marks.where("k <> a").select("a", F.col("k").alias("b"), F.col("size").alias("both"), F.lit(1.0).alias("jaccard"))
    t = t.join(marks.where("k = a").select("k", "size"), "k")
    ordered = t.join(t.groupBy("t").agg(F.count("*").alias("df")), "t")
    ordered = ordered.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("df", "t")))
    prefix = ordered.where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * least) + 1).select("k", "t", "size")
    near = prefix.toDF("a", "t", "na").join(prefix.toDF("b", "t", "nb"), "t").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least)).select("a", "b", "na", "nb").distinct()
    near = stored(near, "near")
    met = near.select(F.col("a").alias("k")).union(near.select("b")).distinct()
    sets = t.join(met, "k", "left_semi").groupBy("k").agg(F.collect_set("t").alias("s"))
    near = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("both", F.size(F.array_intersect("sa", "sb")).cast("long"))
    jac = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return near.select("a", "b", "both", jac.alias("jaccard")).where(F.col("jaccard") >= least).unionByName(members)


def any_of(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])
