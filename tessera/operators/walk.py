"""Walking a listing of paths as a directory tree: skipped folders, ignore rules inherited downwards, languages.

A rule stands in a folder and holds for what lies below it. Paths are taken apart into the folders above them, each
looked at once, and meet the rules of every folder on their way by equality; the deepest folder's last matching rule
decides about an entry, and what is inside an ignored folder is ignored with it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import stored

#: Folders that no walk enters.
SKIPPED = ("node_modules", "dist", "build", "target", "vendor", "__pycache__", "venv", "coverage")
#: File endings and their languages.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "mjs": "javascript", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "rb": "ruby", "sh": "shell", "sql": "sql", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "html": "html", "css": "css"}


def folders(path: Column) -> Column:
    """The names of the folders that a path lies in; its last part isn't one."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def skipped(path: Column, names: tuple[str, ...] = SKIPPED) -> Column:
    """Whether one of the path's folders is hidden or has one of the names, whatever the case."""
    return F.exists(folders(path), lambda f: F.lower(f).isin(*names) | (f.startswith(".") & ~f.isin(".", "..")))


def language(path: Column) -> Column:
    """By the ending of the file's name; null for others."""
    ending = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ending)


def pattern(rule: str) -> tuple[str, bool, bool] | None:
    """(regular expression for paths below the rule's folder, ignores, folders only) of a line of an ignore file; None for blank lines and comments.

    ! takes back, a / at the end means folders, a / elsewhere binds the rule to its folder, * and ? stay within a name
    and ** doesn't, [..] is a class, \\ takes the next character literally.
    """
    text = rule.rstrip("\r\n")
    text = re.sub(r"(?<!\\) +$", "", text)
    if not text or text.startswith("#"):
        return None
    ignores = not text.startswith("!")
    text = text[not ignores :]
    only = text.endswith("/")
    text = text.rstrip("/") if only else text
    bound = "/" in text
    text = text.removeprefix("/")
    out, i = "" if bound else "(?:.*/)?", 0
    while i < len(text):
        if text.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif text.startswith("**", i):
            out, i = out + ".*", i + 2
        elif text[i] in "*?":
            out, i = out + ("[^/]*" if text[i] == "*" else "[^/]"), i + 1
        elif text[i] == "[" and (end := text.find("]", i + 2)) > 0:
            out, i = out + "[" + text[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]" if text[i + 1] == "!" else out + text[i : end + 1], end + 1
        else:
            i += text[i] == "\\" and i + 1 < len(text)
            out, i = out + re.escape(text[i]), i + 1
    return out, ignores, only


def _patterns(rule: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(isinstance(r, str) and pattern(r)) or (None, None, None) for r in rule], columns=["regex", "ignores", "only"])


def _above(path: Column) -> Column:
    """Every folder of a path, from the root's empty name down, without the path itself."""
    parts = folders(path)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ignored(listing: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of listing(path) that rules(folder, n, rule) leave out: n orders a folder's rules, the root is the empty name.

    Paths have / between names and none at either end. Null paths, folders and rules go.
    """
    parsed = F.pandas_udf(_patterns, "regex string, ignores boolean, only boolean")
    known = rules.where("folder IS NOT NULL").select(F.col("folder").alias("base"), "n", parsed("rule").alias("p")).where("p.regex IS NOT NULL")
    known = stored(known.select("base", "n", "p.*"), "rules")  # stored: the rows of a folder with many entries can be split in the join
    paths = listing.where("path IS NOT NULL").select("path").distinct()
    chains = paths.select("path", F.explode(F.concat(F.filter(_above(F.col("path")), lambda f: f != ""), F.array("path"))).alias("entry"))
    entries = stored(chains.groupBy("entry").agg(F.min((F.col("entry") == F.col("path")).cast("int")).alias("file")), "entries")
    below = F.when(F.col("base") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(base) + 2)"))
    meets = entries.withColumn("base", F.explode(_above(F.col("entry")))).join(known, "base").withColumn("below", below)
    meets = meets.where("below rlike concat('^(?:', regex, ')$') AND (NOT only OR file = 0)")
    out = meets.groupBy("entry").agg(F.max_by("ignores", F.struct(F.length("base"), F.col("n"))).alias("gone")).where("gone").select("entry")
    return listing.join(chains.join(out, "entry").select("path").distinct(), "path", "left_semi")


def walk(listing: DataFrame, rules: DataFrame, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, language) of the source files of listing(path): of a known language, in no skipped folder, not ignored."""
    kept = listing.where(F.col("path").isNotNull() & ~skipped(F.col("path"), skip)).withColumn("language", language(F.col("path"))).where("language IS NOT NULL")
    return kept.join(ignored(kept, rules).select("path").distinct(), "path", "left_anti").select("path", "language")
