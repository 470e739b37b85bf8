"""The Lempel-Ziv parse: every factor's words stand where it points."""

import hashlib
import random

from tessera.llm import substrings


def test_factors_point_to_equal_words(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    passages = [words(n) for n in (35, 36, 50, 90, 140)]
    texts = []
    for i in range(30):
        parts = words(rng.randrange(20))
        for p in rng.sample(passages, 2):
            lo = rng.randrange(0, len(p) - 34)
            parts += p[lo : lo + rng.randrange(35, len(p) - lo + 1)] + words(rng.randrange(8))
        texts.append(" ".join(parts))
    texts += [texts[0], " ".join(passages[4]), " ".join(passages[3] + passages[3]), "z " * 120, None, "", "short one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {int.from_bytes(hashlib.md5((t or "").encode()).digest()[8:], "big", signed=True): (t or "").split() for t in texts}
    got = {r.doc_id: r for r in substrings.without_repeats(docs, texts=True).collect()}
    assert len(got) == len(texts)
    seen = 0
    for i, r in got.items():
        mine, covered = (texts[i] or "").split(), set()
        assert r.n_factors == len(r.parse) and r.longest_factor == max((f.last - f.first for f in r.parse), default=0)
        for f in r.parse:
            assert f.last - f.first >= substrings.WINDOW
            assert by[f.ref][f.ref_first : f.ref_first + f.last - f.first] == mine[f.first : f.last]
            here = int.from_bytes(hashlib.md5((texts[i] or "").encode()).digest()[8:], "big", signed=True)
            assert (f.ref, f.ref_first) != (here, f.first) or texts.count(texts[i]) > 1
            covered |= set(range(f.first, f.last))
            seen += 1
        assert len(covered) == r.n_removed == sum(x.last - x.first for x in r.factors)
        assert all(a.first < b.first and a.last - substrings.WINDOW < b.first for a, b in zip(r.parse, r.parse[1:]))
    assert seen > 40 and got[0].n_removed == got[30].n_removed == len(texts[0].split())


def test_parse_is_greedy():
    at = lambda a, b, ref, to: {"first": a, "last": b, "ref": ref, "ref_first": to}
    assert substrings.factors([at(5, 9, 1, 100), at(0, 4, 1, 95), at(10, 12, 2, 7)], 35) == [(0, 44, 1, 95), (10, 47, 2, 7)]
    assert substrings.factors([at(0, 4, 1, 95), at(3, 8, 1, 98), at(20, 20, 1, 115)], 35) == [(0, 43, 1, 95), (20, 55, 1, 115)]
    assert substrings.merged([(0, 43, 1, 95), (20, 55, 1, 115), (60, 99, 2, 0)]) == [(0, 55), (60, 99)]
    assert substrings.factors([], 35) == []
