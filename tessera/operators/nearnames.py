"""Names within a few edits of many asked names: keys of names with marked and left out characters, then the exact distance.

Two names that s replaced, a deleted and b inserted characters make equal have a common key: the asked one with marks at s
places and without a characters, the other with the same marks and without b. Names are joined on hashes of those keys for
each (s, a, b), so that what meets is within the edits, but for equal hashes; no name is compared with all others, and every
candidate is verified. Of long names a beginning of the same length on both sides is enough: its longest common subsequence
lacks at most as many characters as there are edits, so those are joined on what can be left by deletions from each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stored

BEGINNING, SLICE, TASK = 24, 20_000, 20_000


def neighbourhood(name: str, edits: int, beginning: int = BEGINNING) -> set[str]:
    """The name's beginning and all it can become by at most `edits` deletions."""
    head = name[:beginning]
    out = {head}
    for k in range(1, min(edits, len(head)) + 1):
        for gone in combinations(range(len(head)), k):
            out.add("".join(c for i, c in enumerate(head) if i not in gone))
    return out


def patterns(name: str, marks: int, gone: int, places: list[int]) -> set[str]:
    """All that the name can become by `marks` marks at some of the places and `gone` deletions elsewhere."""
    out = set()
    for marked in combinations(places, marks):
        whole = list(name)
        for i in marked:
            whole[i] = "\0"
        if gone:
            out.update("".join(c for i, c in enumerate(whole) if i not in left) for left in combinations([i for i in range(len(name)) if i not in marked], gone))
        else:
            out.add("".join(whole))
    return out


def _keys(edits: int, beginning: int, known: dict[int, list[int]], asked_sizes: set[int]):
    """(name, asked) to (name, asking, variant, total): keys as an asked name and as one that is near.

    known: for each length of short names the places where they differ; asked_sizes: lengths of asked ones. Names of other
    lengths than the edits lead to can't meet, and names of one length are replaced only where some differ.
    """
    kinds = [(s, a, b) for s in range(edits + 1) for a in range(edits + 1 - s) for b in range(edits + 1 - s - a) if s + a + b]

    def one(name: str, asking: bool) -> Iterator[tuple[str, int]]:
        n = len(name)
        if n > beginning - edits:
            for v in neighbourhood(name, edits, beginning):
                yield f"{v}/", 0
        for s, a, b in kinds if n <= beginning else ():
            if (n - a + b in known) if asking else (n - b + a in asked_sizes):
                for v in patterns(name, s, a if asking else b, range(n) if a or b else known[n]):
                    yield f"{v}/{s}{a}{b}", s + a + b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, roles, codes, totals = [], [], [], []
                for i, (name, asked) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    for asking in (False, True)[: 1 + asked]:
                        before = len(codes)
                        for v, total in one(name, asking):
                            codes.append(xxhash.xxh3_64_intdigest(v.encode("utf-8", "surrogatepass")) - (1 << 63))
                            totals.append(total)
                        rows += [i] * (len(codes) - before)
                        roles += [asking] * (len(codes) - before)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(roles, pa.bool_()), pa.array(codes, pa.int64()), pa.array(totals, pa.int32())], names=["name", "asking", "variant", "total"])

    return run


def near_names(names: DataFrame, edits: int = 2, beginning: int = BEGINNING) -> DataFrame:
    """names(name, asked) to (name, near, distance): for each asked name all other names within `edits`, each once.

    The distance counts code points inserted, deleted or replaced, case counts. Null names go, the empty name is one of
    length 0, repeated names are one, asked if any of them is. What one key has in common may be many names: those are cut
    into slices, each joined by itself, and none is left out.
    """
    each = stored(names.where("name IS NOT NULL").groupBy("name").agg(F.max(F.coalesce("asked", F.lit(False))).alias("asked")), "names")
    short = each.where(F.length("name") <= beginning).groupBy(F.length("name").alias("n"))
    differ = [(F.min(F.substring("name", i + 1, 1)) != F.max(F.substring("name", i + 1, 1))).alias(f"p{i}") for i in range(beginning)]
    sizes = short.agg(F.max("asked").alias("asked"), *differ).collect()  # a row for each length up to `beginning`
    known = {r["n"]: [i for i in range(r["n"]) if r[f"p{i}"]] for r in sizes}
    each = each.repartition(max(1, math.ceil(each.count() / TASK)), "name")  # a name is many keys, so few bytes are much work
    variants = stored(each.mapInArrow(_keys(edits, beginning, known, {r["n"] for r in sizes if r["asked"]}), "name string, asking boolean, variant long, total int"), "variants")
    many = variants.groupBy("variant").agg(F.count_if(~F.col("asking")).alias("n"), F.max("asking").alias("asking")).where((F.col("n") > SLICE) & F.col("asking"))
    slices = stored(many.select("variant", F.ceil(F.col("n") / SLICE).cast("int").alias("slices")), "slices")  # at most one for SLICE rows
    held = variants.join(slices, "variant", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    asking = held.where("asking").select("variant", "total", "name", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    others = held.where("NOT asking").select("variant", F.col("name").alias("near"), F.pmod(F.xxhash64("name"), F.col("slices")).cast("int").alias("slice"))
    pairs = asking.join(others, ["variant", "slice"]).where((F.col("name") != F.col("near")) & (F.abs(F.length("name") - F.length("near")) <= edits))
    pairs = pairs.withColumn("distance", F.levenshtein("name", "near", edits).cast("long"))  # -1 beyond the limit
    whole = (F.col("total") == 0) & (F.greatest(F.length("name"), F.length("near")) > beginning) & (F.col("distance") >= 0)
    return pairs.where(whole | (F.col("distance") == F.col("total")) & (F.col("total") > 0)).select("name", "near", "distance").distinct()


def nearest(found: DataFrame, most: int = 10) -> DataFrame:
    """(name, near, distance, rank): the `most` nearest of each asked name, by distance, then name: suggestions for a miss."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy("distance", "near"))  # Spark cuts each task's groups before the shuffle
    return found.withColumn("rank", rank).where(F.col("rank") <= most)
