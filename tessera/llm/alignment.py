"""Alignment of two tokenizers by a dictionary of groups.

Where tokens of A and of B end at the same byte, a text falls into groups. Tasks encode documents in blocks of bounded
size and intern the groups that a block holds, so that each group is one row of a block however often it stands there.
Over all blocks the dictionary has a row for each distinct group with its number; its links are expanded once and
multiplied by that number. What a group's links come to is joined back by the group's key to the blocks' rows, and each
block adds its documents up.

Both tokenizers are run on chunks: a space, if it follows something else than white space, begins a new token of A by its
pattern and of B if no piece holds a space after another character, so that the cut changes nothing. `Pair` proves the
latter from the vocabularies; others are run on whole texts.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared_folder
from tessera.llm.tokens import byte_letters

BLOCK = 16_000_000
RULES = ("ends", "overlap")
_CHUNK = re.compile(r"(?<=\S) ")


class Pair:
    """Tokenizer A (byte-level BPE of `tokenizers`) and B (`sentencepiece`, which adds a space), from the contents of their files."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(a)
        self.a = tokenizers.Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        of = {c: bytes([i]) for i, c in enumerate(byte_letters())}
        self.bytes_a = {i: b"".join(of.get(c, c.encode()) for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        before = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        within = any("▁" in p.lstrip("▁") for p in pieces)
        kept = "".join(self.b.id_to_piece(i) for i in self.b.encode(" a  b ")) == "▁▁a▁▁b▁"
        self.by_chunks = bool(plain and kept and not within)
        self.space = self.b.piece_to_id("▁")
        self.length_a = np.zeros(max(self.bytes_a, default=0) + 1, np.int64)
        self.length_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self._batch = getattr(self.a, "encode_batch_fast", self.a.encode_batch)  # without offsets

    def chunks(self, text: str) -> list[str]:
        """Parts that are encoded by themselves, each without the space before it."""
        return _CHUNK.split(text) if self.by_chunks else [text]

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        first = self._batch([" " + p for p in parts], add_special_tokens=False)
        second = self.b.encode(parts, num_threads=1)
        return [x.ids for x in first], [y if p else [self.space] for p, y in zip(parts, second)]  # the library gives nothing for an empty text

    def exact(self, part: str, a: list[int], b: list[int]) -> bool:
        """Whether both give back the part and the space before it."""
        whole = b" " + part.encode()
        return b"".join([self.bytes_a[i] for i in a]) == whole == b"".join([self.bytes_b[i] for i in b])

    def groups(self, a: list[list[int]], b: list[list[int]]) -> tuple[list[bytes], np.ndarray]:
        """Keys of the groups of exactly encoded parts, one after the other, and how many each part has."""
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int32) for x in (a, b))
        size_a, size_b = self.length_a[flat_a], self.length_b[flat_b]
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        both = np.intersect1d(ends_a, ends_b, assume_unique=bool(size_a.all() and size_b.all()))
        # of tokens without bytes the last one at an end closes the group
        last_a, last_b = np.searchsorted(ends_a, both, "right"), np.searchsorted(ends_b, both, "right")
        first_a, first_b = (np.concatenate([[0], x[:-1]]) for x in (last_a, last_b))
        bytes_a, bytes_b = flat_a.astype("<i4").tobytes(), flat_b.astype("<i4").tobytes()
        sizes = [np.array([n], "<i4").tobytes() for n in range(int((last_a - first_a).max(initial=0)) + 1)]
        keys = [sizes[j - i] + bytes_a[4 * i : 4 * j] + bytes_b[4 * k : 4 * m] for i, j, k, m in zip(first_a.tolist(), last_a.tolist(), first_b.tolist(), last_b.tolist())]
        part_ends = np.cumsum([len(x) for x in a])
        return keys, np.diff(np.searchsorted(last_a, part_ends, "right"), prepend=0)


def group_key(a: list[int], b: list[int]) -> bytes:
    return np.array([len(a), *a, *b], "<i4").tobytes()


def group_text(key: bytes) -> str:
    """`a1,a2|b1`: the ids of a group."""
    ids = np.frombuffer(key, "<i4").tolist()
    n = ids[0] + 1
    return ",".join(map(str, ids[1:n])) + "|" + ",".join(map(str, ids[n:]))


class Interner:
    """Groups of chunks, numbered as they come up; chunks seen most recently are kept (bounded between blocks)."""

    def __init__(self, pair: Pair, most: int = 500_000):
        self.pair, self.most = pair, most
        self.reset()

    def reset(self) -> None:
        self.chunk: dict[str, int] = {}  # its place in the arrays below; -1: bytes differ
        self.number: dict[bytes, int] = {}
        self.counts = self.ids = np.empty(0, np.int64)
        self.sizes = np.empty((0, 2), np.int64)

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        for k in keys:
            if k not in self.number:
                self.number[k] = len(self.number)
        return np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))

    def learn(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 20_000):
            some = parts[at : at + 20_000]
            a, b = self.pair.encode(some)
            good = [self.pair.exact(*x) for x in zip(some, a, b)]
            if not all(good):
                self.chunk.update((p, -1) for p, g in zip(some, good) if not g)
                some, a, b = ([x for x, g in zip(xs, good) if g] for xs in (some, a, b))
            if not some:
                continue
            keys, counts = self.pair.groups(a, b)
            self.chunk.update(zip(some, range(len(self.counts), len(self.counts) + len(some))))
            self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, self.numbers(keys)])
            self.sizes = np.concatenate([self.sizes, np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64)])

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(tokens of A, tokens of B, numbers of the groups in order) of each text; none where there are no tokens."""
        parts = [self.pair.chunks(t) if t else [] for t in texts]
        self.learn(list({p for ps in parts for p in ps if p not in self.chunk}))
        starts = np.cumsum(self.counts) - self.counts
        for t, ps in zip(texts, parts):
            at = np.fromiter(map(self.chunk.__getitem__, ps), np.int64, len(ps))
            if (at < 0).any():
                yield self.whole(t)
                continue
            n = self.counts[at]
            total = int(n.sum())
            place = np.arange(total) + np.repeat(starts[at] - np.cumsum(n) + n, n)
            a, b = self.sizes[at].sum(axis=0).tolist()
            yield a, b, self.ids[place]

    def whole(self, text: str) -> tuple[int, int, np.ndarray]:
        """A text with a part that isn't given back, encoded as one: as a whole it could be."""
        a, b = self.pair.encode([text])
        if not self.pair.exact(text, a[0], b[0]):
            return 0, 0, np.empty(0, np.int64)
        return len(a[0]), len(b[0]), self.numbers(self.pair.groups(a, b)[0])


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of the same rank together, so that they compress."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(pair_of, kind: pa.DataType):
    """Tasks: rows (k, text) to rows of documents (block, k, n_a, n_b, seq) and, after the last of a block, its groups (block, groups, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        inner, number, size, held = Interner(pair_of()), 0, 0, []
        names = ["block", "k", "n_a", "n_b", "seq", "groups", "counts"]
        lists = pa.list_(pa.binary()), pa.list_(pa.int64())

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, size, held
            block = f"{task.partitionId()}:{task.taskAttemptId()}:{number}"
            every = np.concatenate([s for _, _, _, s in held]) if held else np.empty(0, np.int64)
            used, counts = np.unique(every, return_counts=True)
            by_use = np.argsort(-counts, kind="stable")  # small numbers for frequent groups
            place = np.empty(len(used), np.int64)
            place[by_use] = np.arange(len(used))
            keys = np.array(list(inner.number), object)[used[by_use]].tolist() if len(used) else []
            for at in range(0, len(held), 2000):
                rows = held[at : at + 2000]
                seqs = pa.array([_planes(place[np.searchsorted(used, s)]) for _, _, _, s in rows], pa.binary())
                none = [pa.nulls(len(rows), t) for t in lists]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.string()), pa.concat_arrays([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), seqs, *none], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.string()), pa.nulls(1, kind), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary())), pa.array([keys], lists[0]), pa.array([counts[by_use]], lists[1])], names=names)
            number, size, held = number + 1, 0, []
            if len(inner.chunk) > inner.most:
                inner.reset()

        for batch in batches:
            # some texts at a time: what is new among them is encoded together
            texts, at = batch.column(1), 0
            while at < len(texts):
                some, weight, first = [], 0, at
                while at < len(texts) and weight < BLOCK // 4:
                    some.append(texts[at].as_py())
                    weight += len(some[-1] or "")
                    at += 1
                for i, (a, b, seq) in enumerate(inner.texts(some)):
                    held.append((batch.column(0).slice(first + i, 1), a, b, seq.astype(np.int32)))
                size += weight
                if size >= BLOCK:
                    yield from flush()
        if held:
            yield from flush()

    return run


def expand(key: bytes, length_a, length_b, rule: str) -> dict[tuple[int, int], int]:
    """The links of a group: (a, b) -> how many pairs of its tokens end together, or overlap."""
    ids = np.frombuffer(key, "<i4")
    a, b = ids[1 : ids[0] + 1], ids[ids[0] + 1 :]
    if rule == "ends" and len(a) == len(b) == 1:
        return {(int(a[0]), int(b[0])): 1}
    end_a, end_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
    if rule == "ends":
        hit = end_a[:, None] == end_b[None, :]
    else:
        hit = (end_a[:, None] > (end_b - length_b[b])[None, :]) & (end_b[None, :] > (end_a - length_a[a])[:, None])
    out: dict[tuple[int, int], int] = {}
    for i, j in zip(*np.nonzero(hit)):
        link = int(a[i]), int(b[j])
        out[link] = out.get(link, 0) + 1
    return out


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder, compressed well, and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", rule: str = "ends") -> DataFrame:
    """Rows (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one for each row of docs.

    groups: `a1,a2|b1;a3|b2,b3`, null without tokens. rule: a link is a pair of tokens that end together, or that
    overlap. n_best: links whose id pair has, over all rows, as many links as any pair of its B id; count_sum: the sum
    of those numbers over the row's links. A null or empty text, or one that its tokens don't give back byte for byte,
    has none. Null keys are kept, repeated rows count each, other columns are ignored; very long texts are encoded whole
    in one task; an empty table stays empty.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    spark = docs.sparkSession
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read()))  # the files bound their size
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["k"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    blocks = rows.mapInArrow(_blocks(lambda: Pair(*shared.value), to_arrow_type(kind)), f"block string, k {kind.simpleString()}, n_a long, n_b long, seq binary, groups array<binary>, counts array<long>")
    blocks = _stored(blocks, "blocks")
    places = blocks.where("groups IS NOT NULL").select("block", F.posexplode(F.arrays_zip("groups", "counts")).alias("place", "g"))
    dictionary = places.groupBy(F.col("g.groups").alias("key")).agg(F.sum("g.counts").alias("times"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*shared.value)
        for batch in batches:
            out = [(k, a, b, n, times) for k, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for (a, b), n in expand(k, pair.length_a, pair.length_b, rule).items()]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["key", "a", "b", "n", "times"])

    expanded = _stored(dictionary.mapInArrow(links, "key binary, a int, b int, n long, times long"), "links")
    counted = expanded.groupBy("a", "b").agg(F.sum(F.col("n") * F.col("times")).alias("count"))
    pairs = _stored(counted, "pairs")
    best = pairs.groupBy("b").agg(F.max("count").alias("top"))
    pairs = pairs.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
    values = expanded.join(pairs, ["a", "b"]).groupBy("key").agg(F.sum("n").alias("links"), F.sum(F.col("n") * F.col("best")).alias("best"), F.sum(F.col("n") * F.col("count")).alias("total"))
    back = places.select(F.col("block").alias("held_in"), "place", F.col("g.groups").alias("key")).join(values, "key").select("held_in", "place", "links", "best", "total")

    def add_up(documents: pa.Table, found: pa.Table) -> pa.Table:
        place = found["place"].to_numpy()
        value = np.zeros((3, int(place.max()) + 1 if len(place) else 0), np.int64)
        for i, c in enumerate(("links", "best", "total")):
            value[i, place] = found[c].to_numpy()
        keys = [g for g in documents["groups"].to_pylist() if g is not None]
        shown = [group_text(k) for k in keys[0]] if keys else []
        documents = documents.filter(pa.compute.is_null(documents["groups"]))
        sums, texts = [], []
        for seq in documents["seq"]:
            at = _numbers(seq.as_buffer())
            sums.append((len(at), *value[:, at].sum(axis=1).tolist()))
            texts.append(";".join(map(shown.__getitem__, at.tolist())) if len(at) else None)
        columns = list(zip(*sums)) or [()] * 4
        return pa.table([documents["k"], documents["n_a"], documents["n_b"], *(pa.array(c, pa.int64()) for c in columns), pa.array(texts, pa.string())], names=["k", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    out = blocks.groupBy("block").cogroup(back.groupBy("held_in")).applyInArrow(add_up, f"k {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return out.withColumnRenamed("k", key)
