"""A persisted inverted index with BM25, for many queries over texts that are tokenized once.

A segment holds the postings of the documents of one `add`: blocks of a term's postings in order of their impact, written
by term bucket and slice of documents, so that no term is one task however frequent it is. A query reads the buckets of
its terms, sorted by term; the best k first settle a threshold from the blocks of greatest impact and then read only
blocks that can still reach it. A document added again replaces its older text: `gone` names the rows to leave out, and
`merge` writes all segments as one. Each change commits a numbered version file that only one writer can create (on
stores where creating a file without overwriting is exclusive, as on HDFS and local disks).
"""

from __future__ import annotations

import json
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.search import K1, B

BUCKETS, SLICE, BLOCK, DIGITS = 32, 50_000_000, 256, 6  # SLICE: words of one slice
CHUNK = 8 << 20  # bytes of text of which a task holds the words at once
PATTERN = "[^a-z]+"


def _file(spark: SparkSession, path: str) -> tuple[Any, Any]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def state(spark: SparkSession, root: str) -> dict:
    """The last whole version: segments, live documents, texts and words. A version file that was cut off doesn't count."""
    fs, folder = _file(spark, f"{root}/versions")
    names = sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []
    for name in names:
        stream = fs.open(_file(spark, f"{root}/versions/{name}")[1])
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except ValueError:
            continue
        finally:
            stream.close()
    return {"version": 0, "segments": [], "docs": 0, "texts": 0, "words": 0, "gone": False}


def _commit(spark: SparkSession, root: str, now: dict) -> None:
    fs, path = _file(spark, f"{root}/versions/{now['version']:08d}.json")
    stream = fs.create(path, False)  # raises where another writer was first
    stream.write(bytearray(json.dumps(now).encode()))
    stream.close()


def repair(spark: SparkSession, root: str) -> bool:
    """Remove the last version's file if its writer died in it: readers pass over it, writers fail on it until then.

    For when no writer is at work, since a file that is being written looks the same.
    """
    fs, folder = _file(spark, f"{root}/versions")
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
    torn = bool(names) and int(names[-1].split(".")[0]) > state(spark, root)["version"]
    if torn:
        fs.delete(_file(spark, f"{root}/versions/{names[-1]}")[1], False)
    return torn


def _sizes(lengths: DataFrame) -> tuple[int, int, int]:
    """Documents, those with a text, words."""
    return tuple(lengths.agg(F.count("*"), F.count("len"), F.coalesce(F.sum("len"), F.lit(0))).first())


def _average(now: dict) -> float:
    return now["words"] / max(now["texts"], 1) or 1.0


def bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _words(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has. Whole arrays of bytes, no loop over texts.

    Bytes of other characters are never those of a to z in UTF-8.
    """
    texts = texts.fill_null("").cast(pa.string())
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    letter = (data - np.uint8(97)) < 26
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]  # where a text begins, a word can't go on
    first[inner] = letter[inner]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    last[inner - 1] = letter[inner - 1]
    starts = np.flatnonzero(first)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[letter]))
    return found, np.diff(np.searchsorted(starts, bounds))


def _parts(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most CHUNK bytes of text, or one text."""
    ends, at = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        yield batch.slice(at, to - at)
        at = to


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text in lower case) to (key, len); a null text has no length."""
    for batch in batches:
        for part in _parts(batch, batch.column(1)):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_words(part.column(1))[1], pa.int32(), mask=part.column(1).is_null().to_numpy(zero_copy_only=False))], names=["key", "len"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text in lower case) to (term, keys, tfs, lens): one row for each term of a chunk of texts, with all its documents there."""
    for batch in batches:
        for part in _parts(batch, batch.column(1)):
            found, sizes = _words(part.column(1))
            if not len(found):
                continue
            coded = found.dictionary_encode()
            at = np.repeat(np.arange(len(sizes)), sizes)
            both, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(sizes) + at, return_counts=True)
            code, doc = np.divmod(both, len(sizes))
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            offsets = pa.array(np.append(starts, len(code)), pa.int32())
            lists = [part.column(0).take(pa.array(doc)), pa.array(tf, pa.int32()), pa.array(sizes[doc], pa.int32())]
            yield pa.RecordBatch.from_arrays([coded.dictionary, *(pa.ListArray.from_arrays(offsets, x) for x in lists)], names=["term", "keys", "tfs", "lens"])


def _rows_of(lists: pa.Array) -> np.ndarray:
    """For each value of the lists the row that it stands in."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _by_key(slices: int):
    """Rows (segment, term, keys, tfs, lens) to (slice, segment, term, keys, tfs, lens): each cut by a hash of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(i).flatten() for i in (2, 3, 4)]
            row = _rows_of(batch.column(2))
            at = (pd.util.hash_array(lists[0].to_numpy(zero_copy_only=False)) % slices).astype(np.int32)
            order = np.lexsort((at, row))
            at, row = at[order], row[order]
            starts = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
            offsets, to, head = pa.array(np.append(starts, len(at)), pa.int32()), pa.array(order), pa.array(row[starts])
            yield pa.RecordBatch.from_arrays([pa.array(at[starts]), batch.column(0).take(head), batch.column(1).take(head), *(pa.ListArray.from_arrays(offsets, x.take(to)) for x in lists)], names=["slice", "segment", "term", "keys", "tfs", "lens"])

    return run


def _gone_by_key(slices: int):
    """(segment, key) to rows of the empty term, many keys each, as `_by_key` deals them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in np.unique(batch.column(0).to_numpy()):
                keys = batch.column(1).filter(pc.equal(batch.column(0), int(k)))
                ends = pa.array([0, len(keys)], pa.int32())
                none = pa.ListArray.from_arrays(ends, pa.array(np.zeros(len(keys), np.int32)))
                one = pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([""]), pa.ListArray.from_arrays(ends, keys), none, none], names=["segment", "term", "keys", "tfs", "lens"])
                yield from _by_key(slices)(iter([one]))

    return run


def _without(gone: dict[int, list[pa.Array]], segment: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Places of the keys that aren't gone from their segment."""
    stays = np.ones(len(keys), bool)
    for k, parts in gone.items():
        here = np.flatnonzero(segment == k)
        stays[here] = ~pc.is_in(keys.take(pa.array(here)), value_set=pa.concat_arrays(parts)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(stays)


def _cut(average: float):
    """Rows (bucket, segment, term, keys, tfs, lens), sorted by term, to blocks of at most BLOCK postings of a term by falling impact.

    A batch of rows is held at once; a term that goes on in the next one begins new blocks there. Rows of the empty term
    come first: their keys are gone from their segment, and are left out of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: dict[int, list[pa.Array]] = {}
        for batch in batches:
            for at in np.flatnonzero(pc.equal(batch.column(2), "").to_numpy(zero_copy_only=False)):
                gone.setdefault(batch.column(1)[at].as_py(), []).append(batch.column(3)[at].values)
            batch = batch.filter(pc.not_equal(batch.column(2), ""))
            keys, tf, size = (batch.column(i).flatten() for i in (3, 4, 5))
            row = _rows_of(batch.column(3))
            if gone:
                stays = _without(gone, batch.column(1).to_numpy()[row], keys)
                row, (keys, tf, size) = row[stays], (x.take(pa.array(stays)) for x in (keys, tf, size))
            if not len(keys):
                continue
            term = batch.column(2).dictionary_encode().indices.to_numpy()[row]
            impact = _impact(tf.to_numpy(), size.to_numpy(), average)
            rank = keys.to_numpy() if pa.types.is_integer(keys.type) else pc.rank(keys, "ascending", tiebreaker="dense").to_numpy()
            order = np.lexsort((rank, -impact, term))
            term, n = term[order], len(order)
            at = np.arange(n)
            first = np.diff(term, prepend=-1) != 0
            starts = np.flatnonzero((at - np.maximum.accumulate(np.where(first, at, 0))) % BLOCK == 0)
            offsets, to, head = pa.array(np.append(starts, n), pa.int32()), pa.array(order), order[starts]
            lists = [pa.ListArray.from_arrays(offsets, x.take(to)) for x in (keys, tf, size)]
            named = [batch.column(i).take(pa.array(row[head])) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([*named, pa.array(impact[head]), pa.array(np.diff(np.append(starts, n)), pa.int32()), *lists], names=["bucket", "term", "impact", "n", "keys", "tfs", "lens"])

    return run


def _impact(tf: Any, size: Any, average: float) -> Any:
    """Of columns or arrays."""
    return tf / (tf + K1 * (1 - B + B * size / average))


def _write(root: str, groups: DataFrame, slices: int, average: float, gone: DataFrame | None = None) -> None:
    """groups(slice, term, keys, tfs, lens) as sorted blocks in bucket folders; a task holds one bucket of one slice of the postings.

    With gone(key, segment), groups have a segment too, and these documents of it are left out: each task gets the gone
    keys of its slice, by a hash of the key.
    """
    kind = groups.schema["keys"].dataType.elementType.simpleString()
    bucket_of = (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int")
    if gone is None:
        rows = groups.withColumns({"segment": F.lit(0), "bucket": bucket_of})
    else:
        fields = f"slice int, segment int, term string, keys array<{kind}>, tfs array<int>, lens array<int>"
        live = groups.select("segment", "term", "keys", "tfs", "lens").mapInArrow(_by_key(slices), fields).withColumn("bucket", bucket_of)
        lost = gone.select("segment", "key").mapInArrow(_gone_by_key(slices), fields).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
        rows = live.unionByName(lost)
    rows = rows.repartitionById(BUCKETS * slices, F.col("bucket") * slices + F.col("slice")).sortWithinPartitions("term")
    blocks = rows.select("bucket", "segment", "term", "keys", "tfs", "lens").mapInArrow(_cut(average), f"bucket int, term string, impact double, n int, keys array<{kind}>, tfs array<int>, lens array<int>")
    blocks.write.option("parquet.block.size", 16 << 20).partitionBy("bucket").parquet(f"{root}/postings")


def _slices(words: int) -> int:
    return max(1, math.ceil(words / SLICE))


def add(spark: SparkSession, root: str, docs: DataFrame, key: str = "doc_id", text: str = "text") -> dict:
    """Index docs as a new segment and return the new state; documents whose key is there already are replaced.

    Keys are unique within docs (ValueError otherwise); rows without a key aren't indexed; a null text counts as a document
    without a length.
    """
    before = state(spark, root)
    segment = f"{root}/segments/{uuid.uuid4().hex}"
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.lower(F.col(f"`{text}`").cast("string")).alias("text")).where("key IS NOT NULL")
    kind = rows.schema["key"].dataType.simpleString()
    rows.mapInArrow(_measured, f"key {kind}, len int").write.parquet(f"{segment}/lengths")
    lengths = spark.read.parquet(f"{segment}/lengths")
    n, texts, total = _sizes(lengths)
    if not lengths.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError("keys of documents must differ")
    average = total / max(texts, 1) or 1.0
    groups = rows.where("text IS NOT NULL").mapInArrow(_grouped, f"term string, keys array<{kind}>, tfs array<int>, lens array<int>")
    _write(segment, groups.withColumn("slice", F.spark_partition_id() % _slices(total)), _slices(total), average)  # rows of a task stay in one slice, so that a task run again deals them alike
    now = before | {"version": before["version"] + 1, "segments": [*before["segments"], {"path": segment, "average": average}], "docs": before["docs"] + n, "texts": before["texts"] + texts, "words": before["words"] + total}
    if before["segments"]:
        gone = _live(spark, before).join(lengths.select("key"), "key")
        gone.write.parquet(f"{segment}/gone")
        n, texts, total = _sizes(spark.read.parquet(f"{segment}/gone"))
        now |= {"docs": now["docs"] - n, "texts": now["texts"] - texts, "words": now["words"] - total, "gone": before["gone"] or n > 0}
    _commit(spark, root, now)
    return now


def _gone(spark: SparkSession, now: dict) -> DataFrame:
    """(key, segment) of replaced documents."""
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{s['path']}/gone").select("key", "segment") for s in now["segments"][1:]])


def _live(spark: SparkSession, now: dict) -> DataFrame:
    """(key, segment, len) of the documents that count."""
    every = reduce(DataFrame.unionByName, [spark.read.parquet(f"{s['path']}/lengths").withColumn("segment", F.lit(i)) for i, s in enumerate(now["segments"])])
    return every.join(_gone(spark, now), ["key", "segment"], "left_anti") if now["gone"] else every


def _blocks(spark: SparkSession, now: dict, terms: list[str] | None) -> DataFrame:
    """Blocks of the terms, with segment: partitions and row groups of other terms aren't read."""
    out = []
    for i, s in enumerate(now["segments"]):
        b = spark.read.parquet(f"{s['path']}/postings")
        if terms is not None:
            b = b.where(F.col("bucket").isin(sorted({bucket(t) for t in terms})) & F.col("term").isin(terms))
        out.append(b.withColumns({"segment": F.lit(i), "ratio": F.lit(max(1.0, _average(now) / s["average"]))}))
    return reduce(DataFrame.unionByName, out)


def _hits(spark: SparkSession, now: dict, blocks: DataFrame) -> DataFrame:
    """(key, term, tf, len) of the blocks' documents, without replaced ones."""
    out = blocks.select("segment", "term", F.explode(F.arrays_zip("keys", "tfs", "lens")).alias("p")).select(F.col("p.keys").alias("key"), "segment", "term", F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))
    if now["gone"]:
        out = out.join(_gone(spark, now), ["key", "segment"], "left_anti")
    return out.drop("segment")


def merge(spark: SparkSession, root: str) -> dict:
    """Write all segments as one, without replaced documents; the older segments' files stay until `vacuum`."""
    now = state(spark, root)
    if len(now["segments"]) < 2:
        return now
    segment = f"{root}/segments/{uuid.uuid4().hex}"
    _live(spark, now).select("key", "len").write.parquet(f"{segment}/lengths")
    average = _average(now)
    blocks, slices = _blocks(spark, now, None), _slices(now["words"])
    groups = blocks.select("segment", "term", "keys", "tfs", "lens", F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(slices)).cast("int").alias("slice"))
    _write(segment, groups, slices, average, _gone(spark, now) if now["gone"] else None)
    now |= {"version": now["version"] + 1, "segments": [{"path": segment, "average": average}], "gone": False}
    _commit(spark, root, now)
    return now


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove segments that the last version doesn't name; for when no query reads an older one. Returns their number."""
    kept = {s["path"].rsplit("/", 1)[-1] for s in state(spark, root)["segments"]}
    fs, folder = _file(spark, f"{root}/segments")
    old = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName() not in kept] if fs.exists(folder) else []
    for path in old:
        fs.delete(path, True)
    return len(old)


def vocabulary(spark: SparkSession, root: str) -> DataFrame:
    """(term, df): every term with the number of documents that hold it, read from the blocks' heads."""
    now = state(spark, root)
    blocks = _blocks(spark, now, None)
    if now["gone"]:
        return _hits(spark, now, blocks).groupBy("term").agg(F.count("*").alias("df"))
    return blocks.groupBy("term").agg(F.sum("n").alias("df"))


def _frequencies(spark: SparkSession, now: dict, terms: list[str]) -> dict[str, int]:
    """Documents of each term: at most one row for each comes to the driver."""
    blocks = _blocks(spark, now, terms)
    found = _hits(spark, now, blocks).groupBy("term").count() if now["gone"] else blocks.groupBy("term").agg(F.sum("n"))
    return dict.fromkeys(terms, 0) | {r[0]: r[1] for r in found.collect()}


def _weights(now: dict, df: dict[str, int]) -> dict[str, float]:
    return {t: math.log(1 + (now["docs"] - n + 0.5) / (n + 0.5)) * (K1 + 1) for t, n in df.items()}


def _by_term(values: dict[str, float]) -> Column:
    return reduce(lambda c, t: c.when(F.col("term") == t, values[t]), values, F).otherwise(0.0)


def _scored(now: dict, hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    part = _by_term(weights) * _impact(F.col("tf"), F.col("len"), _average(now))
    return hits.groupBy("key").agg(F.count("*").cast("int").alias("matched"), F.sum(part).alias("score"))


def matches(spark: SparkSession, root: str, terms: list[str], mode: str = "auto", key: str = "doc_id") -> DataFrame:
    """(key, matched, score) of the documents with all terms (and), any of them (or), or all if there is one, else any (auto).

    Terms are single words in lower case; one named twice counts once. Of other terms nothing is read.
    """
    terms, now = list(dict.fromkeys(terms)), state(spark, root)
    if not now["segments"] or not terms:
        raise ValueError("an index without segments, or no terms")
    weights = _weights(now, _frequencies(spark, now, terms))
    out = _scored(now, _hits(spark, now, _blocks(spark, now, terms)), weights).withColumnRenamed("key", key)
    full = out.where(F.col("matched") == len(terms))
    return out if mode == "or" or (mode == "auto" and full.isEmpty()) else full


def cutoffs(spark: SparkSession, root: str, terms: list[str], k: int) -> dict[str, float]:
    """For each term the least impact that a block needs to hold one of the k best documents (any term may match).

    The k-th score among the documents of the best blocks, by what those alone give them, bounds the k-th score from
    below. A block whose impact with the best of every other term stays under that holds none of the k best.
    """
    now = state(spark, root)
    blocks = _blocks(spark, now, terms)
    weights = _weights(now, _frequencies(spark, now, terms))
    none = dict.fromkeys(terms, -1.0)
    if now["gone"]:
        return none  # a block may hold replaced documents only
    most = math.ceil(k / BLOCK) + 3
    heads = {t: blocks.where(F.col("term") == t).select(F.col("impact") * F.col("ratio")).orderBy(F.desc(F.col("impact") * F.col("ratio"))).limit(most).collect() for t in terms}
    best = {t: weights[t] * h[0][0] if h else 0.0 for t, h in heads.items()}
    seed = blocks.where(reduce(Column.__or__, [(F.col("term") == t) & (F.col("impact") * F.col("ratio") >= (h[-1][0] if h else 2.0)) for t, h in heads.items()]))
    lows = _scored(now, _hits(spark, now, seed), weights).select("score").orderBy(F.desc("score")).limit(k).collect()
    if len(lows) < k:
        return none
    least = lows[-1][0] - 10.0**-DIGITS  # scores are compared rounded
    return {t: (least - sum(best[o] for o in terms if o != t)) / weights[t] - 1e-9 for t in terms}


def top(spark: SparkSession, root: str, terms: list[str], k: int, key: str = "doc_id") -> DataFrame:
    """The k best documents with any of the terms: (key, matched, score), by score rounded to DIGITS, then key.

    matched counts the terms seen in the blocks read; documents that aren't among the best may miss some.
    """
    terms, now = list(dict.fromkeys(terms)), state(spark, root)
    weights, least = _weights(now, _frequencies(spark, now, terms)), cutoffs(spark, root, terms, k)
    out = []
    for i, s in enumerate(now["segments"]):
        b = _blocks(spark, now | {"segments": [s]}, terms).withColumn("segment", F.lit(i))
        ratio = max(1.0, _average(now) / s["average"])
        out.append(b.where(reduce(Column.__or__, [(F.col("term") == t) & (F.col("impact") >= least[t] / ratio) for t in terms])))
    hits = _hits(spark, now, reduce(DataFrame.unionByName, out))
    return _scored(now, hits, weights).select(F.col("key").alias(key), "matched", F.round("score", DIGITS).alias("score")).orderBy(F.desc("score"), key).limit(k)


def recall(spark: SparkSession, root: str, entries: DataFrame, query: str, stored_at: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """entries that match the query with a score: all its words by the index or, where no entry has them, as a substring.

    The substring is taken literally, % _ and \\ too, and such rows have no score. Order: by score, or latest first.
    """
    terms = [w for w in re.split(PATTERN, query.lower()) if w]
    if terms:
        found = matches(spark, root, terms, "and", key)
        if not found.isEmpty():
            return entries.join(found.select(key, F.round("score", DIGITS).alias("score")), key).orderBy(F.desc("score"), key)
    needle = re.sub(r"([\\%_])", r"\\\1", query.strip())
    none = F.lit(None).cast("double").alias("score")
    return entries.where(F.col(text).like(f"%{needle}%") if needle else F.lit(False)).select("*", none).orderBy(F.desc(stored_at), key)
