"""Aligned tokens against a comparison that encodes whole texts and looks at every pair."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from tessera.llm import alignment
from tessera.llm.tokens import byte_letters

PATHS = [public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
TEXTS = ["a plain sentence, twice. a plain sentence, twice.", "  two  spaces \n and\ta tab \n\n x", "", None, " ", "end ", "\n", "<|endoftext|> <s> <0x0A>", "a▁b is lost", "x\x00y", "naïve Ｆull ﬁ 漢字仮名 😀😀 don't",
         "a plain sentence, twice. a plain sentence, twice.", "z" * 3000, "word " * 4000, "a \n b  \n  c d   e", "1234567 +49 (0) 30"]


def brute(rows):
    a = tokenizers.Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = {c: i for i, c in enumerate(byte_letters())}
    docs, counts = [], Counter()
    for key, text in rows:
        one, two = [], []
        if text:
            one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if any(b"".join(t for _, t in ts) != (" " + text).encode() for ts in (one, two)):
                one, two = [], []
        ends = []
        for tokens in (one, two):
            at, out = 0, []
            for _, t in tokens:
                at += len(t)
                out.append(at)
            ends.append(out)
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for end in both:
            groups.append(",".join(str(i) for (i, _), e in zip(one, ends[0]) if low < e <= end) + "|" + ",".join(str(i) for (i, _), e in zip(two, ends[1]) if low < e <= end))
            low = end
        place = {e: i for (i, _), e in zip(two, ends[1])}
        links = [(i, place[e]) for (i, _), e in zip(one, ends[0]) if e in place]
        counts.update(links)
        docs.append((key, len(one), len(two), len(groups), links, ";".join(groups)))
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    return sorted((k, na, nb, ng, len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if g else "") for k, na, nb, ng, ls, g in docs)


def found(out):
    return sorted((r[0], r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in out.collect())


def test_odd_texts(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, block string").repartition(3)
    assert found(alignment.align(docs, *PATHS)) == brute(rows)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert found(alignment.align(docs, *PATHS)) == want
    monkeypatch.setattr(alignment, "BLOCK", 4000)  # many blocks
    blocks = alignment._blocks
    monkeypatch.setattr(alignment, "_blocks", lambda pair_of, kind: _small(blocks, pair_of, kind))
    assert found(alignment.align(docs.repartition(2), *PATHS)) == want


def _small(blocks, pair_of, kind):
    def run(batches):
        alignment.BLOCK = 4000  # in the worker too
        yield from blocks(pair_of, kind)(batches)

    return run


def test_overlapping_links():
    import numpy as np

    key = alignment.group_key([1, 2], [3, 4])
    a, b = np.array([0, 3, 2]), np.array([0, 0, 0, 1, 4])
    assert alignment.expand(key, a, b, "ends") == {(2, 4): 1}
    assert alignment.expand(key, a, b, "overlap") == {(1, 3): 1, (1, 4): 1, (2, 4): 1}
    assert alignment.group_text(key) == "1,2|3,4"


def test_null_and_repeated_keys_and_an_empty_table(spark):
    docs = spark.createDataFrame([(None, "same text"), (None, "same text"), (1, "same text"), (1, None)], "k string, text string")
    rows = alignment.align(docs, *PATHS, key="k").collect()
    assert sorted((r.k or "", r.n_groups) for r in rows) == [("", rows[0].n_groups)] * 0 + sorted([("", 2), ("", 2), ("1", 2), ("1", 0)])
    assert {r.count_sum for r in rows} == {6, 0}  # three texts, two links each
    assert alignment.align(docs.limit(0), *PATHS, key="k").count() == 0
    with pytest.raises(ValueError):
        alignment.align(docs, *PATHS, key="k", rule="other")
