"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words and their shapes (runs of character classes) hash to a bounded number of terms. Each term has a sparse random
index vector; a term's context vector sums those of its neighbours over the whole corpus (Sahlgren, 2005), as integers,
so that any order of summing gives the same. A document is the mean of its words' vectors, that of its shapes', and
three plain figures. The network is trained in numpy on a bounded sample of labelled rows and its probabilities are
calibrated by a temperature on rows that it wasn't trained on. Labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh

WORDS, SHAPES, DIM, NEAR, ONES = 8192, 1024, 32, 2, 2
MAX_ROWS, HIDDEN, STEPS, SEED = 20_000, 24, 250, 5
THRESHOLD, FOLDS = 0.3, 5


class Terms(dict):
    """word -> word term + WORDS * shape term; bounded cache."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most
        self.shapes: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.shapes.clear()
        s = shape(word)
        term = self.shapes.get(s)
        if term is None:
            term = self.shapes[s] = WORDS * (xxhash.xxh32_intdigest(s, seed=1) % SHAPES)
        t = self[word] = xxhash.xxh32_intdigest(word) % WORDS + term
        return t


class _Signs(dict):
    """Code point -> sign of its class, filled as characters come up; for str.translate."""

    def __missing__(self, code: int) -> str:
        kind = unicodedata.category(chr(code))
        sign = self[code] = {"Lu": "A", "Ll": "a"}.get(kind) or ("l" if kind[0] == "L" else "0" if kind[0] == "N" else chr(code))
        return sign


_SIGNS = _Signs()
_RUNS = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """Runs of upper, lower and other letters and of digits as one sign each; other signs once for each run."""
    return _RUNS.sub(r"\1", word[:64].translate(_SIGNS))[:8]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs) of the ONES entries of each term's index vector."""
    rng = np.random.default_rng(SEED)
    n = WORDS + SHAPES
    return rng.integers(0, DIM, (n, ONES)), rng.choice([-1, 1], (n, ONES))


def _chunks(texts: list[str | None], terms: Terms, most: int = 400_000) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, list[float]]]:
    """Rows, word terms, shape terms of some whole texts at a time, with the share of distinct words of each."""
    lengths: list[int] = []
    distinct: list[float] = []
    ids: list[int] = []
    for t in texts:
        words = t.split() if t else []
        lengths.append(len(words))
        distinct.append(len(set(words)) / len(words) if words else 1.0)
        ids += map(terms.__getitem__, words)
        if len(ids) >= most:
            both = np.array(ids, np.int64)
            yield lengths, both % WORDS, both // WORDS, distinct
            lengths, distinct, ids = [], [], []
    if lengths:
        both = np.array(ids, np.int64)
        yield lengths, both % WORDS, both // WORDS, distinct


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partial context table of each task: (term, v0..)."""
    terms, total = Terms(), np.zeros((WORDS + SHAPES) * DIM, np.int64)
    at, sign = index_vectors()
    for batch in batches:
        for lengths, words, shapes, _ in _chunks(batch.column(0).to_pylist(), terms):
            doc = np.repeat(np.arange(len(lengths)), lengths)
            for ids in (words, shapes + WORDS):
                for off in range(1, NEAR + 1):
                    same = doc[off:] == doc[:-off]
                    left, right = ids[:-off][same], ids[off:][same]
                    for a, b in ((left, right), (right, left)):
                        for k in range(ONES):
                            total += np.bincount(a * DIM + at[b, k], weights=sign[b, k], minlength=len(total)).astype(np.int64)
    table = total.reshape(-1, DIM)
    used = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(table[used, d]) for d in range(DIM))], names=["term", *(f"v{d}" for d in range(DIM))])


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(terms, DIM) unit context vectors over all of docs; what comes to the driver is bounded by the terms."""
    parts = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_contexts, "term int, " + ", ".join(f"v{d} long" for d in range(DIM)))
    rows = parts.groupBy("term").agg(*[F.sum(f"v{d}").alias(f"v{d}") for d in range(DIM)]).collect()
    table = np.zeros((WORDS + SHAPES, DIM))
    for r in rows:
        table[r[0]] = r[1:]
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def features(texts: list[str | None], table: np.ndarray, terms: Terms) -> np.ndarray:
    """(texts, 2 DIM + 3): pooled word and shape vectors, distinct share, repeats, log length; zeros without words."""
    out = []
    for lengths, words, shapes, distinct in _chunks(texts, terms):
        n = np.array(lengths)
        x = np.zeros((len(n), 2 * DIM + 3), np.float32)
        full = np.flatnonzero(n)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            for k, ids in enumerate((words, shapes + WORDS)):
                x[full, k * DIM : k * DIM + DIM] = np.add.reduceat(table[ids], starts, axis=0) / n[full, None]
            again = np.concatenate([[False], words[1:] == words[:-1]]).astype(np.float64)
            again[starts] = 0
            x[full, 2 * DIM] = np.array(distinct)[full]
            x[full, 2 * DIM + 1] = np.add.reduceat(again, starts) / n[full]
            x[full, 2 * DIM + 2] = np.log1p(n[full]) / 10
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, 2 * DIM + 3), np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hold: np.ndarray) -> Model:
    """Train by Adam on the rows not held back; choose the temperature on those held back. Without both classes: the prior."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rng = np.random.default_rng(SEED)
    m = Model(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), 0.0)
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        m.w2[:] = 0
        m.b2 = float(np.log(prior / (1 - prior)))
        return m
    train = ~hold if (~hold).any() and len(np.unique(y[~hold])) == 2 else np.ones(len(y), bool)
    xs, ys = (x[train] - mean) / scale, y[train]
    params = [m.w1, m.b1, m.w2, np.array([np.log(prior / (1 - prior))])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        h = np.tanh(xs @ params[0] + params[1])
        d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - ys) / len(ys)
        back = d[:, None] * params[2] * (1 - h * h)
        grads = [xs.T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
        for p, g, a, b in zip(params, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= 0.03 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    m.b2 = float(params[3][0])
    if hold.any():
        z, t = m.logits(x[hold]), y[hold]
        loss = lambda temp: np.mean(np.logaddexp(0, z / temp) - t * z / temp)
        m.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return m


def remainder(key: str):
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most max_rows labelled rows (by a hash of the key) whose remainder isn't 0; remainder 1 calibrates.

    A key with both labels counts as 0.
    """
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)").groupBy("k").agg(F.min("y").alias("y"))
    known = known.withColumn("r", F.crc32(F.col("k").cast("string").cast("binary")) % FOLDS).where("r <> 0").orderBy(F.xxhash64("k"), "k").limit(max_rows)
    joined = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(known), "k").select("y", "r", "text")  # max_rows narrow rows
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            x = features(b.column(2).to_pylist(), shared.value, terms)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "r", "x"])

    rows = sorted((r["y"], r["r"], bytes(r["x"])) for r in joined.mapInArrow(run, "y int, r long, x binary").collect())
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, 2 * DIM + 3).astype(np.float64)
    return fit(x, np.array([r[0] for r in rows], np.float64), np.array([r[1] == 1 for r in rows], bool))


def scored(docs: DataFrame, table: np.ndarray, model: Model, text: str = "text") -> DataFrame:
    """docs, all columns as they are, with the score as the last column: _score, with more underscores where docs has that."""
    name = fresh(docs, "_score")
    shared = docs.sparkSession.sparkContext.broadcast((table, model))
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = shared.value
        terms = Terms()
        for b in batches:
            s = model.score(features(b.column(0).to_pylist(), table, terms).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(s, pa.float64())], names=["row", "_score"])

    packed = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
    kind = packed.schema["row"].dataType.simpleString()
    out = packed.mapInArrow(run, f"row {kind}, _score double")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in cols], F.col("_score").alias(name))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Rows (key, held_out, score, predicted), one for each row of docs.

    held_out: crc32 of the key as text leaves 0 by 5; such labels are never read. Null and empty texts get the score
    of a text without words. Null keys aren't held out; repeated rows get the same result each. Without labels of
    both classes every score is the labels' prior.
    """
    table = context_vectors(docs, text)
    model = train(docs, labels, table, key, text, label)
    out = scored(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), table, model, text)
    return out.select(key, F.coalesce(remainder(key) == 0, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns as they are, that score at least the threshold.

    Null and empty texts get the score of a text without words, repeated rows the same one each. Without labels of both
    classes every score is the labels' prior, so all rows stay or go; an empty table stays empty.
    """
    table = context_vectors(docs, text)
    model = train(docs, labels, table, key, text, label)
    out = scored(docs, table, model, text)
    return out.where(F.col(out.columns[-1]) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
