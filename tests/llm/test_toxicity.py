"""The string-kernel classifier: its kernel by brute force, planted insults, odd rows."""

import random
from itertools import combinations

import numpy as np
import pytest
from tessera.llm import toxicity as T

INSULTS = ["grobnak", "fluzwit", "snarvel"]


def plain(s, t):
    """The kernel of two units, from all their gapped triples."""
    def feature(u):
        out = {}
        for i, j, k in combinations(range(len(u)), 3):
            if j - i <= T.REACH and k - j <= T.REACH:
                key = u[i], u[j], u[k]
                out[key] = out.get(key, 0) + T.DECAY ** (k - i - 2)
        return out

    a, b = feature(s), feature(t)
    norm = lambda u: np.sqrt(max(sum(max(len(u) - d - e, 0) * T.DECAY ** (2 * (d + e - 2)) for d in range(1, T.REACH + 1) for e in range(1, T.REACH + 1)), 1))
    return sum(v * b.get(k, 0) for k, v in a.items()) / norm(s) / norm(t)


def test_kernel_by_brute_force():
    units = [u for w in ["idiot", "i-d-i-o-t", "idxiot", "Idiotic!!", "aaaaaa", "ab", "réeuxment", "漢字仮名交", "x" * 70] for u in T.pieces(w)]
    marks = T.pieces("idiot") + T.pieces("réeuxpa") + T.pieces("aaa")
    kernel = T.Kernel(marks)
    want = np.array([[plain(u, m) for m in marks] for u in units])
    assert np.allclose(kernel.of(units), want, atol=1e-5)
    by = np.array([0.5, -2.0, 1.0])
    assert np.allclose(kernel.of(units, by[:, None])[:, 0], want @ by, atol=1e-5)
    assert np.allclose(T.Margins(kernel, by).of(units), want @ by, atol=1e-5)


def test_inserted_characters_weaken_a_match():
    kernel = T.Kernel(T.pieces("idiot"))
    same, inserted, other = (kernel.of(T.pieces(w))[0, 0] for w in ("idiot!", "i.d.i.o.t", "banana"))
    assert same > inserted > 0.1 > other


def test_sentences():
    assert T.sentences("One two. three\nfour! five") == [["One", "two."], ["three", "four!"], ["five"]]
    assert T.sentences("you i d i o t now")[1:] == [["idiot"]]
    assert T.sentences(None) == T.sentences("  ") == [] and max(map(len, T.sentences("w " * 100))) == T.SENTENCE


def corpus(n=700, seed=2):
    rng = random.Random(seed)
    syllables = ["ba", "lo", "mi", "te", "ra", "su", "ne", "ko"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(20, 150))]
        toxic = i % 6 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w = rng.choice(INSULTS)
            w = rng.choice([w, w.upper(), w + "!!", "-".join(w), w[:3] + "x" + w[3:], " ".join(w)])
            words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (None, "balo"), (5, rows[5][1])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return {"rows": rows, "out": T.classify(docs, labels).collect()}


def test_held_out_accuracy(found):
    truth = {i: y for i, _, y in found["rows"]}
    held = [(truth[r.doc_id], r.predicted) for r in found["out"] if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert sum(p for y, p in held if y) >= 0.9 * sum(y for y, _ in held)  # obfuscated ones too
    assert sum(p for y, p in held if not y) <= 0.02 * sum(not y for y, _ in held)


def test_odd_rows(found):
    by = {}
    for r in found["out"]:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert by[9001][0].score == by[9002][0].score and by[9001][0].predicted == 0
    assert len(by[5]) == 2 and by[5][0] == by[5][1]
    assert by[None][0].held_out is False


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = corpus(150)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    import zlib

    turned = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, toxic int")
    one, two = ({r.doc_id: r.score for r in T.classify(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert len({r.score for r in T.classify(docs, labels).collect()}) == 1
    assert T.classify(docs, labels.limit(0)).count() == 2 and T.classify(docs.limit(0), labels).count() == 0
