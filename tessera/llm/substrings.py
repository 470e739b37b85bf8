"""Repeated passages, by relative Lempel-Ziv parsing against reference blocks of the whole corpus.

Every document is cut into phrases: around each anchor (the least 8-gram hash of a run of `window` words) the words
of all windows that have it as their anchor. Where the anchor lies depends on the window's words alone, so equal
windows are cut alike everywhere. The distinct phrases are the reference blocks, indexed by anchor and hash, each with
the first and the last text and word where it stands; the index is a distributed table and looked up by a join.

Inside a phrase that is found every window occurs elsewhere. Where only a phrase's anchor is found but not the phrase
as a whole, that needn't be so. Those phrases, and one copy of each block with the same anchor, are opened, and their
windows are looked up one by one: that is the check at the boundaries of blocks. A document is then parsed from left to
right: a factor is a pointer (text, word) and a length, and goes on greedily as long as the pointed text does; where
that ends, the next factor begins at the next window found. Factors have `window` words at least; their union is what
repeats. Only anchors, hashes and positions are shuffled for the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, gram_hashes, materialize, mix, sliding_gram_hashes, words_of

WINDOW, GRAM = 35, 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def digest(data: bytes) -> tuple[int, int]:
    d = np.frombuffer(hashlib.md5(data, usedforsecurity=False).digest(), ">i8")
    return int(d[0]), int(d[1])


def phrases(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, phrase, first, last) of a document's word hashes; first and last window of each phrase."""
    if len(h) < window:
        none = np.empty(0, np.int64)
        return none, none, none, none
    g, w = gram_hashes(h, gram), sliding_gram_hashes(h, window)
    many = len(w)
    at = np.empty(many, np.int64)
    for lo in range(0, many, 8192):
        hi = min(many, lo + 8192)
        at[lo:hi] = np.lib.stride_tricks.sliding_window_view(g[lo : hi + window - gram], window - gram + 1).argmin(axis=1) + np.arange(lo, hi)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [many - 1]])
    phrase = mix(w[first] * _ODD + mix(w[last] ^ (last - first).astype(np.uint64)))
    return g[at[first]].view(np.int64), phrase.view(np.int64), first, last


def _parse(window: int, gram: int):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            hi, lo, found, counts = [], [], [], []
            for t in batch.column(0):
                if not t.is_valid:
                    continue
                data = t.as_py().encode()
                p = phrases(hashes.of(data.split()), window, gram)
                if len(p[0]):
                    a, b = digest(data)
                    hi.append(a)
                    lo.append(b)
                    counts.append(len(p[0]))
                    found.append(p)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            cols = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p[k] for p in found]) if found else np.empty(0, np.int64)).cast(kinds[k])) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), *cols], names=["hi", "lo", "anchor", "phrase", "first", "last"])

    return run


def _open(window: int):
    """The windows of the phrases to open: (win, hi, lo, at, weight); weight 2 for a copy of a block found twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for t, hi, lo, spans in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data = t.encode()
                if digest(data) != (hi, lo):
                    continue
                w = sliding_gram_hashes(hashes.of(data.split()), window).view(np.int64)
                for s in spans:
                    n = s["last"] - s["first"] + 1
                    for col, x in zip(out, (w[s["first"] : s["last"] + 1], np.full(n, hi), np.full(n, lo), np.arange(s["first"], s["last"] + 1), np.full(n, s["weight"]))):
                        col.append(x)
            cols = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays(cols, names=["win", "hi", "lo", "at", "weight"])

    return run


def keyed(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """docs with hi and lo, the MD5 of the text (null: of an empty one)."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    part = lambda at: F.conv(F.substring(F.md5(t), at, 16), 16, -10).cast("long")
    return docs.select(*[F.col(f"`{c}`") for c in keep], t.alias("_text"), part(1).alias("hi"), part(17).alias("lo"))


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text") -> DataFrame:
    """Rows (hi, lo, first, last, ref, ref_first) by distinct text: the windows first..last (word offsets) begin elsewhere too,
    at the same distance from ref_first in the text whose `lo` is ref (this text's own where equal ones repeat it)."""
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    parsed = materialize(texts.mapInArrow(_parse(window, gram), "hi long, lo long, anchor array<long>, phrase array<long>, first array<int>, last array<int>"), "phrases")
    shared = parsed.select(F.explode("anchor").alias("anchor")).groupBy("anchor").count().where("count > 1").select("anchor")
    rows = parsed.select("hi", "lo", F.inline(F.arrays_zip("anchor", "phrase", "first", "last")))
    rows = materialize(rows.join(shared, "anchor", "left_semi"), "shared")
    where = F.struct(F.col("lo").alias("ref"), F.col("first").alias("ref_first"))
    blocks = materialize(rows.groupBy("anchor", "phrase").agg(F.count("*").alias("n"), F.min(where).alias("low"), F.max(where).alias("high")), "blocks")
    kinds = blocks.groupBy("anchor").agg(F.count("*").alias("kinds"))
    blocks = blocks.join(kinds, "anchor").where("n > 1 OR kinds > 1")
    marked = rows.join(blocks, ["anchor", "phrase"]).select("hi", "lo", "first", "last", F.least("n", F.lit(2)).alias("n"), (F.col("kinds") > 1).alias("mixed"), (where == F.col("low")).alias("copy"), _other(where).alias("at"))
    marked = materialize(marked.distinct(), "marked")
    opened = marked.where("mixed AND (n = 1 OR copy)").groupBy("hi", "lo").agg(F.collect_list(F.struct("first", "last", F.col("n").alias("weight"))).alias("spans"))
    opened = keyed(docs, [], text).join(opened, ["hi", "lo"]).select("_text", "hi", "lo", "spans")
    windows = materialize(opened.mapInArrow(_open(window), "win long, hi long, lo long, at long, weight long").distinct(), "windows")
    place = F.struct(F.col("lo").alias("ref"), F.col("at").cast("int").alias("ref_first"))
    twice = windows.groupBy("win").agg(F.sum("weight").alias("n"), F.min(place).alias("low"), F.max(place).alias("high")).where("n > 1").select("win", "low", "high")
    single = windows.where("weight = 1").join(twice, "win").select("hi", "lo", F.col("at").cast("int").alias("first"), F.col("at").cast("int").alias("last"), _other(place).alias("at"))
    return marked.where("n > 1").select("hi", "lo", "first", "last", "at").unionByName(single).select("hi", "lo", "first", "last", "at.ref", "at.ref_first")


def _other(here: Column) -> Column:
    """Of the first and the last place of a block one that isn't here; here itself only if an equal text has it too."""
    return F.when(here == F.col("low"), F.col("high")).otherwise(F.col("low"))


def factors(spans: list[dict], window: int) -> list[tuple[int, int, int, int]]:
    """The greedy parse: (first, end, ref, ref_first) in words, from left to right; neighbours overlap by less than a window.

    A factor goes on while the next window is found where the factor's own text goes on.
    """
    out: list[list[int]] = []
    for s in sorted(spans, key=lambda s: (s["first"], -s["last"], s["ref"], s["ref_first"])):
        first, last, ref, at = s["first"], s["last"], s["ref"], s["ref_first"]
        if out:
            f = out[-1]
            done = f[1] - window  # its last window
            if first <= done:  # begins inside the factor: what is new of it
                at, first = at + done + 1 - first, done + 1
            if first > last:
                continue
            if first == done + 1 and ref == f[2] and at - f[3] == first - f[0]:
                f[1] = last + window
                continue
        out.append([first, last + window, ref, at])
    return [tuple(x) for x in out]


def merged(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Word ranges [begin, end) covered by factors, sorted and disjoint."""
    out: list[list[int]] = []
    for first, end, *_ in found:
        if out and first <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([first, end])
    return [tuple(x) for x in out]


def _kept(key: str, window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sums, many, longest, kept, cut, parse = [], [], [], [], [], [], [], []
            for t, spans in zip(batch.column(1), batch.column(2)):
                words = words_of(t.as_py())
                n.append(len(words))
                found = factors(spans.as_py(), window) if spans.is_valid else []
                ranges = merged(found)
                at, parts = 0, []
                for lo, hi in ranges:
                    parts += words[at:lo]
                    at = hi
                parts += words[at:]
                gone.append(len(words) - len(parts))
                left = b" ".join(parts)
                sums.append(hashlib.sha256(left).hexdigest())
                if texts:
                    many.append(len(found))
                    longest.append(max((end - first for first, end, *_ in found), default=0))
                    kept.append(left.decode())
                    cut.append([{"first": lo, "last": hi} for lo, hi in ranges])
                    parse.append([dict(zip(("first", "last", "ref", "ref_first"), f)) for f in found])
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
            names = [key, "n_words", "n_removed", "kept_sha256"]
            if texts:
                place = [("first", pa.int32()), ("last", pa.int32())]
                cols += [pa.array(many, pa.int64()), pa.array(longest, pa.int64()), pa.array(kept, pa.string()), pa.array(cut, pa.list_(pa.struct(place))), pa.array(parse, pa.list_(pa.struct([*place, ("ref", pa.int64()), ("ref_first", pa.int32())])))]
                names += ["n_factors", "longest_factor", "kept", "factors", "parse"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", gram: int = GRAM, texts: bool = False) -> DataFrame:
    """Rows (key, n_words, n_removed, kept_sha256[, n_factors, longest_factor, kept, factors, parse]), one for each row of docs.

    A word goes if a window of `window` words that covers it also begins anywhere else in docs, the same document
    included; windows are judged on the input. Texts of fewer words keep all of them. Null texts have no words. Equal
    texts (of `window` words or more) lose all words, repeated rows as well. With `texts`: the number of factors and the
    words of the longest, the words kept, joined by one space, the removed word ranges, and the parse: factors with the
    text (the last 8 bytes of its MD5 as a signed number) and word that they point to.
    """
    spans = repeated(docs, window, gram, text).groupBy("hi", "lo").agg(F.collect_list(F.struct("first", "last", "ref", "ref_first")).alias("spans"))
    rows = keyed(docs, [key], text).join(spans, ["hi", "lo"], "left").select(key, "_text", "spans")
    kind = rows.schema[key].dataType.simpleString()
    place = "first:int,last:int"
    more = f", n_factors long, longest_factor long, kept string, factors array<struct<{place}>>, parse array<struct<{place},ref:bigint,ref_first:int>>" if texts else ""
    return rows.mapInArrow(_kept(key, window, texts), f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string{more}")
