"""Token counts with a whole-token shortcut.

Offline (on the driver, once) every vocabulary string is merged from its characters; those that end as one token are
the proven whole tokens. Counting then looks pre-tokens up: a whole token counts 1, only the rest is merged, and the
counts are kept in a bounded cache. Each text is handled whole, in one pass, without a shuffle.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

SEPARATOR = re.compile(r"[\x1c-\x1f]").search


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


@dataclass
class Vocabulary:
    ranks: dict[tuple[str, str], int]
    whole: frozenset[str]
    special: list[str]
    split: str
    suffix: str
    letters: list[str]


def merge(parts: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Length after merging the lowest-ranked adjacent pair, leftmost first, until none is left; n log n."""
    n = len(parts)
    if n < 2:
        return n
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    parts = list(parts)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, ""
        k = after[i] = after[j]
        alive -= 1
        if k < n:
            before[k] = i
            if (r := ranks.get((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
            heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return alive


def load(path: str) -> Vocabulary:
    """Read a tokenizer file of this kind: NFC, white space, lower case; a split pattern; byte-level BPE with word ends."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or spec["model"]["type"] != "BPE":
        raise ValueError(f"{path}: another kind of tokenizer")
    model = spec["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ranks = {p: k for k, p in reversed(list(enumerate(pairs)))}
    letters, suffix = byte_letters(), model["end_of_word_suffix"] or ""
    byte_of = {c: b for b, c in enumerate(letters)}
    whole = set()
    for token in model["vocab"]:
        if token.endswith(suffix) and (body := token[: len(token) - len(suffix)]) and all(c in byte_of for c in body):
            parts = list(body)
            parts[-1] += suffix
            if merge(parts, ranks) == 1:
                try:
                    whole.add(bytes(byte_of[c] for c in body).decode())
                except UnicodeDecodeError:
                    pass  # not the end of a character: never a pre-token by itself
    special = [x["content"] for x in spec["added_tokens"]]
    return Vocabulary(ranks, frozenset(whole), special, split["pattern"]["Regex"], suffix, letters)


class Chunks(dict):
    """chunk without white space -> tokens, for the chunks seen most recently (bounded).

    No pre-token holds white space, so a text's count is the sum over its chunks. A chunk not seen yet is cut into
    pre-tokens; a proven whole token counts 1, the others are merged.
    """

    def __init__(self, vocabulary: Vocabulary, model: tokenizers.models.BPE, most: int = 400_000):
        super().__init__()
        self.whole, self.most, self.merge = vocabulary.whole, most, model.tokenize
        self.rest = functools.lru_cache(most)(self.merged)
        self.letters = dict(enumerate(vocabulary.letters))
        self.pieces = regex.compile(vocabulary.split).findall
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None

    def __missing__(self, chunk: str) -> int:
        n = 0
        for piece in (chunk,) if chunk.isalpha() else self.pieces(chunk):
            n += 1 if piece in self.whole else self.rest(piece)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = n
        return n

    def merged(self, piece: str) -> int:
        return len(self.merge(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)))

    def plain(self, text: str) -> int:
        if not text.isascii():
            # letters whose lower case is newer than this Python's tables; final sigma has no form of its own here
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").replace("\ua7cb", "\u0264").replace("\ua7dc", "\u019b")
        text = text.lower()
        # str.split also cuts at the four separators 1C-1F, which are no white space to the pattern
        return sum(map(self.__getitem__, re.split(r"[^\S\x1c-\x1f]+", text) if SEPARATOR(text) else text.split()))

    def count(self, text: str | None) -> int:
        """Special strings count as one token each, as the library has it by default."""
        if not text:
            return 0
        if self.special is None or "<|" not in text:
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_bytes, n_tokens, over_limit), one for each row of docs.

    A null or empty text has 0 bytes and 0 tokens; null keys are kept; repeated rows are counted each; other columns
    are ignored. Very long texts are counted whole.
    """
    sc = docs.sparkSession.sparkContext
    with open(path, encoding="utf-8") as f:
        shared = sc.broadcast((load(path), f.read()))  # the vocabulary file bounds its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, spec = shared.value
        counter = Chunks(vocabulary, tokenizers.Tokenizer.from_str(spec).model)
        for batch in batches:
            texts = batch.column(1)
            tokens = [counter.count(t.as_py()) for t in texts]
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(key, text)
    kind = narrow.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
