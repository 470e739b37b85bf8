"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

A unit is a word between boundary signs, or letters that stand apart run together. Two units share what gapped
subsequences of three characters they have in common (Lodhi et al., 2002): up to two characters may lie between
neighbours, each costing a factor of DECAY, so that inserted characters weaken a match and don't break it. The kernel
of a sentence and a landmark sums over the sentence's units. Landmarks are words of the labelled sentences; the kernel
among them gives the Nyström map, in which a squared-hinge SVM is trained on sentences: all of clean documents, and of
toxic ones those that the last round took for the reason. A margin is linear in the map, so it is a sum over units, and
each distinct unit is scored once. A document's probability comes from its sentences' margins by a logistic fit.
Labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh

REACH, DECAY, WIDTH, STEP = 3, 0.5, 32, 15
LANDMARKS, CONTRAST, CANDIDATES, ALIKE = 256, 32, 1500, 0.6
#: The bounded sample of labelled rows: sentences of one clean and one toxic row, sentences in all, rows.
MAX_OF_ROW, MAX_SENTENCES, MAX_ROWS = (6, 32), 30_000, 20_000
SENTENCE, ROUNDS, RIDGE = 24, 3, 5.0
THRESHOLD, FOLDS = 0.5, 5

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_APART = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_PAIRS = [(a, b) for a in range(1, REACH + 1) for b in range(1, REACH + 1)]


def pieces(word: str) -> list[str]:
    """A word's units: lower case, without signs around it, between boundary signs; long ones as overlapping windows."""
    body = word.lower()
    if not body.isalnum():
        body = _EDGE.sub("", body)
        if not body:
            return []
    unit, size = f"\x02{body}\x03", WIDTH
    return [unit] if len(unit) <= size else [unit[i : i + size] for i in range(0, len(unit) - size + STEP, STEP)]


def _scales() -> np.ndarray:
    """For each length the root of the summed squared weights of a unit's subsequences: its kernel with itself, if they differ, is 1."""
    return np.sqrt([max(sum(max(n - d - e, 0) * DECAY ** (2 * (d + e - 2)) for d, e in _PAIRS), 1) for n in range(WIDTH + 1)])


_SCALE = _scales()


def characters(units: list[str]) -> np.ndarray:
    """(units, longest) code points, zeros behind the end."""
    width = max(max(map(len, units)), 3)
    return np.frombuffer("".join(u.ljust(width, "\0") for u in units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), width)


class Kernel:
    """The kernel of units with fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.alphabet = np.unique(characters(landmarks))  # 0, the filler, comes first
        n = len(self.alphabet)
        codes, rows, weights = [], [], []
        for code, weight in self._triples(landmarks):
            full = code % n > 0  # neither past the end
            rows.append(np.nonzero(full)[0])
            codes.append(code[full])
            weights.append(np.full(len(rows[-1]), weight))
        rows = np.concatenate(rows)
        used, at = np.unique(np.concatenate(codes), return_inverse=True)
        self.table = np.zeros((len(used) + 1, len(landmarks)), np.float32)  # row 0: subsequences of no landmark
        np.add.at(self.table, (at + 1, rows), np.concatenate(weights) / _SCALE[np.array([len(u) for u in landmarks])][rows])
        self.used = used

    def _triples(self, units: list[str]) -> Iterator[tuple[np.ndarray, float]]:
        """(codes, weight) for each pair of distances; a code with a character of no landmark or past the end is in no table."""
        chars = characters(units)
        at = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        at = np.where(self.alphabet[at] == chars, at, 0)
        n = len(self.alphabet)
        for d in range(1, REACH + 1):
            if d < at.shape[1]:
                pair = (at[:, :-d] * n + at[:, d:]) * n
                for e in range(1, min(REACH, at.shape[1] - d - 1) + 1):
                    yield pair[:, :-e] + at[:, d + e :], DECAY ** (d + e - 2)

    def at(self, code: np.ndarray) -> np.ndarray:
        """Rows of the table; 0 for subsequences of no landmark."""
        at = np.minimum(np.searchsorted(self.used, code), len(self.used) - 1)
        return np.where(self.used[at] == code, at + 1, 0)

    def of(self, units: list[str], by: np.ndarray | None = None) -> np.ndarray:
        """(units, columns) values with the landmarks, or those times `by`."""
        table = self.table if by is None else self.table @ by.astype(np.float32)
        out = np.zeros((len(units), table.shape[1]), np.float32)
        for code, weight in self._triples(units):
            at = self.at(code)
            row, col = np.nonzero(at)
            if len(row):
                starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                out[row[starts]] += np.add.reduceat(table[at[row, col]], starts, axis=0) * np.float32(weight)
        return out / _SCALE[np.array([len(u) for u in units])][:, None].astype(np.float32)


class Margins:
    """The sum over landmarks of kernel times weight, for units: one value for each subsequence of a landmark."""

    def __init__(self, kernel: Kernel, by: np.ndarray):
        self.kernel, self.values = kernel, (kernel.table @ by).astype(np.float32)
        n = len(kernel.alphabet)
        self.direct = None
        if n <= 200:  # at most 32 MB: look values up by code, else search for the code
            self.direct = np.zeros(n**3, np.float32)
            self.direct[kernel.used] = self.values[1:]

    def of(self, units: list[str]) -> np.ndarray:
        out = np.zeros(len(units))
        for code, weight in self.kernel._triples(units):
            values = self.direct.take(code) if self.direct is not None else self.values[self.kernel.at(code)]
            out += values.sum(axis=1) * weight
        return out / _SCALE[np.array([len(u) for u in units])]


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence: cut after . ! or ? and after SENTENCE words; letters that stand apart make one more."""
    out: list[list[str]] = []
    now: list[str] = []
    for w in text.split() if text else []:
        now.append(w)
        if w[-1] in ".!?" or len(now) == SENTENCE:
            out.append(now)
            now = []
    if now:
        out.append(now)
    return out + [[w] for w in apart(text)]


def apart(text: str | None) -> list[str]:
    """Runs of three or more single characters with white space between, each joined."""
    return ["".join(m.group().split()) for m in _APART.finditer(text)] if text else []


@dataclass
class Model:
    kernel: Kernel | None
    by: np.ndarray
    bias: float
    logistic: np.ndarray
    center: np.ndarray
    scale: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale @ self.logistic[:-1] + self.logistic[-1]
        return np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 9)


#: Added to the part of a word that ends a sentence; parts of a margin are far smaller.
END = 1e6


class Scores(dict):
    """word -> its part of a margin, with END added if it ends a sentence; for the words seen most recently (bounded)."""

    def __init__(self, model: Model, most: int = 600_000):
        super().__init__()
        self.model, self.most = model, most
        self.margins = Margins(model.kernel, model.by) if model.kernel else None

    def learn(self, words: set[str]) -> None:
        """Score those not known yet, some thousands at a time, words of like length together."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(words)
        new.sort(key=len)
        for at in range(0, len(new), 4000):
            part = new[at : at + 4000]
            cut = list(map(pieces, part))
            units = [u for us in cut for u in us]
            total = np.array([END if w[-1] in ".!?" else 0.0 for w in part])
            if units:
                owner = np.repeat(np.arange(len(part)), [len(us) for us in cut])
                total += np.bincount(owner, weights=self.margins.of(units), minlength=len(part))
            self.update(zip(part, total.tolist()))


FEATURES = 7
#: A word's part of a margin from which it counts as one that may be meant, and where it counts in full.
LOW, HIGH = 0.4, 0.6


def features(texts: list[str | None], scores: Scores) -> np.ndarray:
    """(texts, FEATURES): greatest margin, mean of positive margins, sentences with one (log), their share; greatest part of a word, words of a high part (log), their share; -1 and zeros without words."""
    out = np.zeros((len(texts), FEATURES))
    out[:, 0] = -1
    if scores.margins is None:
        return out
    some: list[tuple[int, list[str], list[str]]] = []
    size = 0
    for i, t in enumerate(texts):
        if words := t.split() if t else []:
            some.append((i, words, apart(t)))
            size += len(words)
        if size > 100_000 or i == len(texts) - 1:
            scores.learn(set().union(*(words for _, words, _ in some), *(more for _, _, more in some)))
            for k, words, more in some:
                out[k] = _of_text(words, more, scores)
            some, size = [], 0
    return out


def _of_text(words: list[str], more: list[str], scores: Scores) -> np.ndarray:
    n = len(words)
    values = np.fromiter(map(scores.__getitem__, words), np.float64, n)
    ends = values > END / 2
    values[ends] -= END
    first = np.concatenate([[True], ends[:-1]])
    at = np.arange(n)
    first |= (at - np.maximum.accumulate(np.where(first, at, 0))) % SENTENCE == 0
    owner = np.cumsum(first) - 1
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    values[1:][(values[1:] == values[:-1]) & (owner[1:] == owner[:-1])] = 0  # a word again in one sentence
    margins = np.bincount(owner, weights=values)
    if more:
        joined = np.array([scores[w] - END * (scores[w] > END / 2) for w in more])
        margins, values = np.concatenate([margins, joined]), np.concatenate([values, joined])
    margins += scores.model.bias
    high = np.maximum(margins, 0)
    hits = np.minimum(high, 1).sum()
    meant = np.clip((values - LOW) / (HIGH - LOW), 0, 1).sum()
    return np.array([margins.max().clip(-3, 3), np.minimum(high, 2).mean(), np.log1p(hits), hits / len(margins), values.max().clip(0, 2), np.log1p(meant), min(10 * meant / n, 1)])


def landmarks(bags: list[tuple[int, list[list[str]]]]) -> list[str]:
    """Units that tell toxic rows from clean ones, unlike each other, and common units of clean rows for contrast."""
    seen = [Counter(), Counter()]
    n = [0, 0]
    for y, lines in bags:
        n[y] += 1
        seen[y].update({u for line in lines for w in line for u in pieces(w) if len(u) >= 5})
    share = (n[1] + 1) / (n[0] + n[1] + 2)
    lift = {u: (k - share * (k + seen[0][u])) / np.sqrt(share * (1 - share) * (k + seen[0][u]) + 1) for u, k in seen[1].items()}
    ranked = sorted((u for u in lift if lift[u] > 0), key=lambda u: (-lift[u], u))[:CANDIDATES]
    common = sorted(seen[0], key=lambda u: (-seen[0][u], u))[:CANDIDATES]
    return _unlike(ranked, LANDMARKS - CONTRAST) + _unlike(common, CONTRAST)


def _unlike(ranked: list[str], most: int) -> list[str]:
    """The first `most` whose kernel with every one before is below ALIKE; where these are too few, the others in order."""
    if not ranked:
        return []
    kernel = Kernel(ranked)
    gram = kernel.of(ranked)
    taken: list[int] = []
    for i in range(len(ranked)):
        if len(taken) < most and (not taken or gram[i, taken].max() < ALIKE):
            taken.append(i)
    rest = [i for i in range(len(ranked)) if i not in set(taken)]
    return [ranked[i] for i in (taken + rest)[:most]]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a linear squared-hinge SVM by Newton steps on the active rows; the last column of x is constant, its weight free."""
    w = np.zeros(x.shape[1])
    sign = np.where(y > 0, 1.0, -1.0)
    keep = np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-3
    for _ in range(30):
        active = np.flatnonzero((sign * (x @ w) < 1) & (weight > 0))
        left, right = np.zeros_like(keep), np.zeros(len(w))
        for at in range(0, len(active), 5000):
            rows = active[at : at + 5000]
            part = x[rows].astype(np.float64)
            scaled = part * weight[rows, None]
            left += scaled.T @ part
            right += scaled.T @ sign[rows]
        new = np.linalg.solve(keep + left, right)
        if np.abs(new - w).max() < 1e-4:
            break
        w = new
    return w


def fit_margin(rows: list[tuple[int, str, str]]) -> tuple[Kernel | None, np.ndarray, float]:
    """(kernel, weights of landmarks, bias) from (label, row, sentence); no kernel without both classes."""
    rows = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    bags: dict[tuple[str, int], list[list[str]]] = {}
    for y, key, line in rows:
        bags.setdefault((key, y), []).append(sorted(set(line.split(" "))))
    kinds = {y for _, y in bags}
    marks = landmarks([(y, lines) for (_, y), lines in bags.items()]) if len(kinds) == 2 else []
    if not marks:
        return None, np.zeros(0), 0.0
    kernel = Kernel(marks)
    gram = kernel.of(marks).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    there = value > 1e-6
    root = vector[:, there] / np.sqrt(value[there])  # the Nyström map: k(x, landmarks) @ root
    lines = [(y, b, line) for b, ((_, y), ls) in enumerate(bags.items()) for line in ls]
    vocabulary = sorted({w for _, _, line in lines for w in line}, key=len)
    place = {w: i for i, w in enumerate(vocabulary)}
    mapped = np.zeros((len(vocabulary), root.shape[1]), np.float32)
    for at in range(0, len(vocabulary), 2000):
        units = [(i, u) for i, w in enumerate(vocabulary[at : at + 2000]) for u in pieces(w)]
        if units:
            np.add.at(mapped, at + np.array([i for i, _ in units]), kernel.of([u for _, u in units], root))
    sizes = np.array([len(line) for _, _, line in lines])
    ids = np.array([place[w] for _, _, line in lines for w in line])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = np.ones((len(lines), root.shape[1] + 1), np.float32)
    for at in range(0, len(lines), 2000):
        some = starts[at : at + 2000]
        x[at : at + 2000, :-1] = np.add.reduceat(mapped[ids[some[0] : starts[at + 2000] if at + 2000 < len(lines) else None]], some - some[0], axis=0)
    y, bag = np.array([r[0] for r in lines]), np.array([r[1] for r in lines])
    use = np.ones(len(y), bool)
    for _ in range(ROUNDS):
        toxic = use & (y == 1)
        weight = np.where(y == 1, max((y == 0).sum() / max(toxic.sum(), 1) / 4, 1.0), 1.0)
        w = svm(x, y, weight * use, RIDGE)
        margin = x @ w
        best = np.full(len(bags), -np.inf)
        np.maximum.at(best, bag, margin)
        use = (y == 0) | (margin > 0) | (margin == best[bag])
    return kernel, root @ w[:-1], float(w[-1])


def fit_probability(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, center, scale) of a ridge logistic regression by Newton steps; the prior without both classes."""
    center, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    w = np.zeros(FEATURES + 1)
    prior = (y.sum() + 1) / (len(y) + 2)
    w[-1] = np.log(prior / (1 - prior))
    if len(np.unique(y)) == 2:
        z = np.concatenate([(x - center) / scale, np.ones((len(x), 1))], axis=1)
        keep = np.diag([1e-2] * FEATURES + [1e-6]) * len(y) / 10
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
    return w, center, scale


def _sampled(lines: list[list[str]], most: int) -> list[str]:
    """At most `most` sentences, by a hash of their words."""
    texts = {" ".join(line) for line in lines}
    return sorted(texts, key=lambda t: (xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")), t))[:most]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_sentences: int = MAX_SENTENCES) -> Model:
    """Fit on a bounded sample of the labelled rows whose remainder isn't 0: sentences of remainders 2 and up, the probability on rows of remainder 1.

    The sample goes by hashes: max_rows keys, max_sentences sentences, max_rows rows for the probability. A key with
    both labels counts as 1.
    """
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    known = known.withColumn("r", F.crc32(F.col("k").cast("string").cast("binary")) % FOLDS).where("r <> 0").orderBy(F.xxhash64("k"), "k").limit(max_rows)
    joined = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(known), "k").select("y", "r", F.col("k").cast("string").alias("k"), "text")  # max_rows narrow rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(y, k, line) for y, k, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()) for line in _sampled(sentences(t), MAX_OF_ROW[y])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["y", "k", "line"])

    lines = joined.where("r > 1").mapInArrow(cut, "y int, k string, line string")
    rows = [tuple(r) for r in lines.orderBy(F.xxhash64("line", "k"), "line", "k", "y").limit(max_sentences).collect()]
    kernel, by, bias = fit_margin(rows)
    model = Model(kernel, by, bias, np.zeros(FEATURES + 1), np.zeros(FEATURES), np.ones(FEATURES))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)
        for b in batches:
            x = np.round(features(b.column(2).to_pylist(), scores), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x[:, j]) for j in range(FEATURES))], names=["y", "k", *(f"x{j}" for j in range(FEATURES))])

    held = joined.where("r = 1").select("y", "k", "text").mapInArrow(read, "y int, k string, " + ", ".join(f"x{j} double" for j in range(FEATURES)))
    found = held.orderBy(F.xxhash64("k"), "k", "y", *(f"x{j}" for j in range(FEATURES))).limit(max_rows).collect()
    x, y = np.array([r[2:] for r in found]).reshape(-1, FEATURES), np.array([r[0] for r in found], np.float64)
    model.logistic, model.center, model.scale = fit_probability(x, y)
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs, all columns as they are, with the probability as the last column: _score, with more underscores where docs has that."""
    name, cols = fresh(docs, "_score"), docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)
        for b in batches:
            s = shared.value.probability(np.round(features(b.column(0).to_pylist(), scores), 6))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(s, pa.float64())], names=["row", "_score"])

    packed = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
    kind = packed.schema["row"].dataType.simpleString()
    out = packed.mapInArrow(run, f"row {kind}, _score double")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in cols], F.col("_score").alias(name))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Rows (key, held_out, score, predicted), one for each row of docs.

    held_out: crc32 of the key as text leaves 0 by 5; such labels are never read. Null and empty texts get the score of
    a text without words; null keys aren't held out; repeated rows get the same result each; very long texts are scored
    whole, sentence by sentence; other columns are ignored. Without labels of both classes every score is the labels'
    prior; an empty table stays empty.
    """
    out = scored(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), train(docs, labels, key, text, label), text)
    held = F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % FOLDS == 0
    return out.select(F.col(f"`{key}`"), F.coalesce(held, F.lit(False)).alias("held_out"), F.col(out.columns[-1]).alias("score"), (F.col(out.columns[-1]) >= THRESHOLD).cast("int").alias("predicted"))
