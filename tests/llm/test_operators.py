"""Each operator against brute force, with nulls, empty texts, repeated rows, extra columns and empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import decontaminate, licenses, merkle, mixing, neardup, pii, quality, sharding, substrings, tokens
from tessera.llm.common import Forest, blocked, connected, gram_hashes, sliding_gram_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, h long, row string, component string"
VOCAB = ["the", "of", "Alpha", "beta,", "gamma", "delta.", "über", "Éa", "x9", "and", "to", "run", "k", "zz", "mango"]


def rows(texts, source=lambda i: f"s{i % 3}"):
    return [(i, t, "en", source(i), len(t or ""), 1, 2, "r", "c") for i, t in enumerate(texts)]


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [sentence(rng, rng.randrange(1, 160)) for _ in range(60)]
    for i in range(25):  # near copies, exact copies, shared passages
        words = texts[i].split()
        for _ in range(1 + i % 3):
            words[rng.randrange(len(words))] = "edit"
        texts.append(" ".join(words))
    texts += texts[:6] + [None, "", "   ", "one", "two words", "\n\n", "a b c d e"]
    passage = sentence(rng, 45)
    texts += [sentence(rng, 20) + " " + passage + "\n" + sentence(rng, 10) for _ in range(4)] + [passage + " " + passage, "rep " * 200]
    out = rows(texts)
    out += [out[3], out[3], (None, texts[7], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def grouped(df):
    return collections.Counter(tuple(r) for r in df.collect())


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_components(corpus, least):
    sets = {d: shingles(t) for d, t, *_ in corpus if d is not None}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates(docs, corpus, empty):
    want = brute_components(corpus, 85)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert neardup.near_duplicates(empty).collect() == []
    kept = neardup.deduplicated(docs, 85)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == sorted(d for d, (_, c) in want.items() if c == d)


def test_near_duplicates_in_blocks(docs, corpus):
    """Groups above the unit size are cut into blocks and lose no link."""
    got = {r.id: r.component_id for r in neardup.components(docs, 60, most=4).collect() if r.id is not None}
    assert got == {d: c for d, (_, c) in brute_components(corpus, 60).items()}


def test_blocked_units_hold_every_pair(spark):
    rng = random.Random(1)
    sizes = [rng.randrange(1, 60) for _ in range(90)]
    df = spark.createDataFrame([(1, i, z) for i, z in enumerate(sizes)] + [(2, 1000, 5), (2, 1001, 5), (3, 5000, 1)], "key long, id long, n long")
    units = collections.defaultdict(list)
    for r in blocked(df, "key", "n", "id", 16, 0.8).collect():
        units[r.unit].append((r.id, r.side))
    assert max(map(len, units.values())) < 60
    met = {(min(a, b), max(a, b)) for u in units.values() for a, s in u for b, t in u if a != b and (s != t or s == 0)}
    need = {(i, j) for i in range(90) for j in range(i + 1, 90) if min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j])}
    assert need <= met and (1000, 1001) in met


def test_signature_threshold():
    rng = np.random.default_rng(0)
    for _ in range(40):
        both, only = rng.integers(0, 2**63, 170, dtype=np.uint64), rng.integers(0, 2**63, 30, dtype=np.uint64)
        a, b = np.concatenate([both, only[:15]]), np.concatenate([both, only[15:]])
        assert (neardup.signature(a) != neardup.signature(b)).sum() <= neardup.ERRORS


def test_connected(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    forest = Forest(400)
    for a, b in edges:
        forest.join(a, b)
    got = {r.id: r.component for r in connected(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: forest.find(n) for n in nodes}
    assert connected(spark.createDataFrame([], "a long, b long"), "t").collect() == []


def brute_repeats(corpus, n):
    texts = [(d, (t or "").encode().split()) for d, t, *_ in corpus]
    count = collections.Counter(tuple(w[i : i + n]) for _, w in texts for i in range(len(w) - n + 1))
    out = collections.Counter()
    for d, w in texts:
        gone = {i + k for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for k in range(n)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window,gram", [(35, 8), (12, 3)])
def test_substrings(docs, corpus, window, gram):
    assert grouped(substrings.without_repeats(docs, window, gram=gram)) == brute_repeats(corpus, window)


def test_substrings_texts(docs, empty):
    got = substrings.without_repeats(docs, texts=True).collect()
    assert all(len(r.kept.split()) == r.n_words - r.n_removed == r.n_words - sum(f["last"] - f["first"] for f in r.factors) for r in got)
    assert substrings.without_repeats(empty).collect() == []


def test_phrases_cover_all_windows():
    h = np.random.default_rng(2).integers(0, 5, 400).astype(np.uint64)
    _, _, first, last = substrings.phrases(h, 35, 8)
    assert first[0] == 0 and last[-1] == 400 - 35 and (first[1:] == last[:-1] + 1).all()


def test_gram_hashes():
    h = np.random.default_rng(4).integers(0, 3, 500).astype(np.uint64)
    for n in (1, 2, 5, 8, 35):
        for f in (gram_hashes, sliding_gram_hashes):
            out = f(h, n)
            seen = {}
            for i in range(500 - n + 1):
                assert seen.setdefault(tuple(h[i : i + n]), out[i]) == out[i]
            assert len(set(seen.values())) == len(seen)


def brute_contamination(corpus, items, least=2, window=8):
    cut = lambda t: [w for w in re.split("[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    grams = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        m = min(len(w), window)
        for k in range(len(w) - m + 1 if m else 0):
            grams[tuple(w[k : k + m])].add("" if i is None else str(i))
    out = collections.Counter()
    for d, t, *_ in corpus:
        w, hit, found = cut(t), set(), set()
        for m in range(1, window + 1):
            for k in range(len(w) - m + 1):
                if (g := tuple(w[k : k + m])) in grams:
                    hit |= set(range(k, k + m))
                    found |= grams[g]
        out[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= least] += 1
    return out


def test_contamination(spark, docs, corpus, empty):
    take = lambda k, a, b: " ".join(corpus[k][1].split()[a:b])
    items = [(1, take(2, 0, 14)), (2, take(2, 4, 20)), (3, "nowhere to be found in any of these documents at all"), (4, "mango3"), (5, ""), (6, None), (7, take(9, 2, 9)), (10, take(70, 1, 11).upper()), (None, take(4, 0, 9)), (1, take(2, 0, 14)), (11, "ÉA1 ÉA1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert grouped(decontaminate.contamination(docs, bench)) == brute_contamination(corpus, items)
    none = decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(corpus) and not any(r.n_hit for r in none)
    assert decontaminate.contamination(empty, bench).collect() == []
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    bad = sum(n for k, n in brute_contamination(corpus, items).items() if k[-1])
    assert bad and kept.count() == len(corpus) - bad


def test_winnowing_needs_no_position_luck(spark):
    """Every span of eight words shared at any offset is found."""
    rng = random.Random(8)
    span = [f"w{i}" for i in range(8)]
    texts = [" ".join([f"a{rng.randrange(9)}" for _ in range(k)] + span + [f"b{rng.randrange(9)}" for _ in range(12 - k)]) for k in range(13)]
    bench = spark.createDataFrame([(1, " ".join(["x y z"] + span)), (2, " ".join(span + ["q r"]))], "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(rows(texts), SCHEMA), bench).collect()
    assert len(got) == 13 and all(r.contaminated and r.n_hit == 8 for r in got)


def test_fingerprints(docs, corpus, empty, spark):
    order = sorted(corpus, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = collections.Counter()
    for i, r in enumerate(order):
        t, x = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want[r[0], len(t), hashlib.sha256((t[: len(t) - half] + x[:half]).encode()).hexdigest()] += 1
    got = merkle.fingerprints(docs).collect()
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = collections.defaultdict(set)
    texts = {d: t for d, t, *_ in corpus if d is not None}
    for r in got:
        if r.doc_id is not None:
            by_text[texts[r.doc_id] or ""].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)
    assert merkle.fingerprints(empty).collect() == []
    one = merkle.fingerprints(spark.createDataFrame(rows(["alone here"]), SCHEMA)).first()
    assert one.edited_sha256 == hashlib.sha256(b"aloneaalone"[:5] + b"alone").hexdigest()


def test_next_over_ranges(docs, corpus):
    a = grouped(merkle.with_next(docs.select("doc_id", "text")))
    assert a == grouped(merkle.with_next(docs.select("doc_id", "text"), rows=7)) and sum(a.values()) == len(corpus)


def test_differences_locate_edits(spark):
    paras = [f"paragraph {i}\n" for i in range(40)]
    edited = paras[:]
    edited[21] = "other\n"
    r = merkle.differences(spark.createDataFrame([("".join(paras), "".join(edited)), ("same", "same"), (None, "")], "a string, b string"), "a", "b").collect()
    assert r[0].sections == [21 // merkle.FAN] and r[0].paragraphs == [21]
    assert r[1].sections == r[2].sections == []


def test_likeness_from_fingerprints_alone(docs):
    got = merkle.likeness(merkle.fingerprints(docs), "fingerprint", "edited_fingerprint", "again").collect()
    assert all(abs(r.again - r.near_edited) < 1e-9 for r in got)


def test_sharding(spark, docs, corpus, empty, tmp_path):
    root = f"file://{tmp_path}/s"
    out = sharding.sharded(docs, root, target=2000)
    back = collections.Counter(tuple(r)[: len(docs.columns)] for r in out.collect())
    assert back == collections.Counter(map(tuple, corpus)) and out.columns[: len(docs.columns)] == docs.columns
    m = sharding.manifest(spark, root).collect()
    assert sum(r.docs for r in m) == len(corpus)
    sizes = sharding.plan(spark.createDataFrame([(i // 50, f"{i // 50}/{i:03d}", 1, 100 + i % 7) for i in range(200)] + [(0, "0/big", 9, 9000)], "slot long, run string, docs long, bytes long"), 1000).collect()
    per = collections.Counter()
    for r in sizes:
        per[r.shard] += r.bytes
    assert per["t6-0/big"] == 9000 and all(v <= 1000 + 106 for k, v in per.items() if k != "t6-0/big")
    assert next(r for r in sizes if r.run == "0/big").parts == 9
    with pytest.raises(RuntimeError):
        sharding.commit(spark, root, 1, {})
    assert sharding.committed(spark, root)["version"] == 1
    more = sharding.append(docs.limit(5), root)
    assert sharding.compact(spark, root, [more])["version"] == 2
    assert sharding.sharded(empty, f"file://{tmp_path}/e").count() == 0


def naive_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans():
    rng = random.Random(2)
    alphabet = ["a", ".", "@", "-", "1", " ", "+", "(", ")", "9", "5.2", "b@c.d", "4111111111111111", "10.0.0.1", "+1 (234) 567-8901", "é", "²", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(25)))
        assert pii.base_spans(t) == naive_spans(t), t
    assert pii.base_spans("1" * 50_000 + "@" * 50_000 + "a" * 50_000 + "@") == []


@pytest.fixture(scope="module")
def tagger():
    return pii.train(900, 5)


def test_tagger_on_held_out_windows(tagger):
    ids, gold, _, _ = pii.labelled(200, 99)
    assert (tagger.decode(ids) == gold).mean() > 0.85


def test_counts_are_of_base_spans(spark, tagger):
    texts = [*pii.labelled(60, 99)[2], "ip " + "0" * 5000 + ".1.2.3"]  # an int() of that many digits is refused
    got = pii.find_personal_data(spark.createDataFrame(rows(texts), SCHEMA), tagger=tagger).collect()
    assert any(len(r.spans.split(",")) > r.n_email + r.n_ip + r.n_card + r.n_phone > 0 for r in got)
    for r in got:
        base = naive_spans(texts[r.doc_id]) if len(texts[r.doc_id]) < 1000 else [("ip", 3, 5009)]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]


def test_gradients():
    t = pii.Tagger(1)
    ids, gold, _, _ = pii.labelled(3, 1)
    ids, gold = ids[:, :12], gold[:, :12]
    gold[:, 0] = np.where(gold[:, 0] % 2 == 0, 0, gold[:, 0])

    def loss():
        e = t.emissions(ids).astype(np.float64)
        tr = t.p["tr"] + t.bad
        a = e[:, 0] + t.p["st"] + t.bad_start
        path = a[np.arange(3), gold[:, 0]]
        for s in range(1, ids.shape[1]):
            path = path + tr[gold[:, s - 1], gold[:, s]] + e[np.arange(3), s, gold[:, s]]
            a = np.log(np.exp(a[:, :, None] + tr - a.max()).sum(axis=1)) + a.max() + e[:, s]
        return float(np.mean(np.log(np.exp(a - a.max()).sum(axis=1)) + a.max() - path))

    g = t.gradients(ids, gold)
    for name, at in (("wo", (3, 2)), ("hf", (1, 5)), ("hb", (2, 30)), ("xf", (3, 7)), ("bb", (4,)), ("tr", (0, 1)), ("st", (0,))):
        old = t.p[name][at]
        t.p[name][at] = old + 1e-2
        up = loss()
        t.p[name][at] = old - 1e-2
        down = loss()
        t.p[name][at] = old
        assert abs((up - down) / 2e-2 - g[name][at]) < 2e-2 * max(1, abs(g[name][at]))


def test_personal_data(spark, docs, corpus, empty, tagger):
    texts = ["mail a.b@c.example.com now", None, "", "ip 10.1.2.3 card 4111 1111 1111 1111", "call +1 (476) 555-6291", "clean words only", "x" * 3000 + " el.75@mail8.example.com"]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows(texts), SCHEMA), tagger=tagger).collect()}
    assert [(got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) for i in range(7)] == [(1, 0, 0, 0), (0,) * 4, (0,) * 4, (0, 1, 1, 0), (0, 0, 0, 1), (0,) * 4, (1, 0, 0, 0)]
    for i, t in enumerate(texts):
        base = naive_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(filter(None, got[i].spans.split(","))) >= {f"{k}:{a}:{b}" for k, a, b in base}
    assert pii.find_personal_data(empty, tagger=tagger).collect() == []
    assert pii.find_personal_data(docs, tagger=tagger).count() == len(corpus)


def test_windows_overlap_and_cover():
    text = "a" * 500 + "1" + "b" * 10 + "2" * 200 + "c" * 300 + "@"
    starts = pii.window_starts(text)
    for i, c in enumerate(text):
        if c in "12@":
            assert any(s <= i < s + pii.WIDTH for s in starts)
    assert all(b - a >= pii.STRIDE for a, b in zip(starts, starts[1:]))


def test_targets():
    t = mixing.targets([100, 10, 0, 50], [5, 2, 1, 5])
    assert abs(sum(t) - 160) < 1e-9 and all(x <= 3 * s + 1e-9 for x, s in zip(t, [100, 10, 0, 50]))
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_splitting_tree():
    q = np.array([100, 3, 0, 41])
    dealt = mixing.split(q, 7)
    assert (dealt.sum(axis=0) == q).all() and (dealt >= 0).all() and (mixing.split(q, 7) == dealt).all()
    assert dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 3


def test_mix(spark, docs, corpus, empty):
    rng = random.Random(3)
    many = rows([sentence(rng, rng.randrange(0, 60)) for _ in range(900)], lambda i: None if i % 50 == 0 else ["hot", "hot", "b", "ä", "z"][i % 5])
    df = spark.createDataFrame(many, SCHEMA)
    got = mixing.mix(df).collect()
    assert grouped(mixing.mix(df)) == collections.Counter(map(tuple, got))
    source = {r[0]: r[3] for r in many}
    per = collections.defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert r.size == len(many[r.doc_id][1].split()) and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        per[source[r.doc_id]][0] += r.size
        per[source[r.doc_id]][1] += r.taken
        per[source[r.doc_id]][2] = r.target
        assert r.source_size == sum(len(m[1].split()) for m in many if m[3] == source[r.doc_id])
    names = sorted(per, key=lambda s: (s is None, s or ""))
    want = mixing.targets([per[n][0] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    for n, t in zip(names, want):
        assert abs(per[n][2] - t) < 1e-6 and abs(per[n][1] - t) <= 60
    mixed = mixing.mixture(df)
    taken = collections.Counter(r.doc_id for r in mixed.collect())
    assert all(taken[r.doc_id] * r.size == r.taken for r in got) and mixed.columns[: len(df.columns)] == df.columns
    assert mixing.mix(empty).collect() == [] and mixing.mixture(empty).collect() == []
    assert mixing.mix(docs).count() == len(corpus)


def test_tokens(spark, docs, corpus, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [r[1] for r in corpus] + ["it's we'll <|endoftext|> x<|startoftext|>", "ΑΣ ς İ ß \x1c a\x85b 　 1٣² é", "漢字🙂 \n\t", "ab" * 9000, "a" * 200 + " " + "!" * 300, "<|EndOfText|>"]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: r for r in tokens.count_tokens(df, P.path("word_bpe_49k.json")).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((x or "").encode()), n > 2048), x
    assert tokens.count_tokens(empty, P.path("word_bpe_49k.json")).collect() == []
    v = tokens.load(P.path("word_bpe_49k.json"))
    some = sorted(v.whole)[::500]
    assert some and all(len(t.encode(w, add_special_tokens=False).ids) == 1 for w in some if w.isalpha() and w == w.lower())


def test_licenses(spark, docs, corpus, empty):
    body = licenses.TEMPLATES["MIT"][2]
    torn = body.split()
    torn[5] = "broken"
    texts = ["word " * 30 + "Released under the MIT License. " + "word " * 9, body + " tail", "pre " * 40 + " ".join(torn), "the license was under review", None, "", "All rights reserved.", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert [got[i].licenses for i in range(8)] == ["MIT", "MIT", "MIT", "", "", "", "proprietary", "Apache-2.0,CC-BY-NC-4.0"]
    assert got[0].matches == "MIT:30:35"
    assert licenses.scan_licenses(empty).collect() == [] and licenses.scan_licenses(docs).count() == len(corpus)


def test_band_guarantee():
    rng = np.random.default_rng(6)
    hits = 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 20, dtype=np.uint64)
        a, b = np.concatenate([both, rng.integers(0, 2**63, 5, dtype=np.uint64)]), np.concatenate([both, rng.integers(0, 2**63, 5, dtype=np.uint64)])
        hits += (licenses.band_values(licenses._minima(a[None]))[0] == licenses.band_values(licenses._minima(b[None]))[0]).any()
    assert hits >= 299


def test_quality(spark, empty):
    rng = random.Random(7)
    good = [sentence(rng, rng.randrange(20, 80)) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in sentence(rng, rng.randrange(20, 80)).split()) for _ in range(80)]
    texts = good + bad + [None, "", "x"]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(230)] + [(None, 1, 0), (5000, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 230]
    assert len(held) > 20 and sum(r.predicted == int(r.doc_id < 150) for r in held) / len(held) > 0.95
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert grouped(quality.classify(df, labels)) == collections.Counter(map(tuple, got))
    none = quality.classify(df, labels.limit(0)).collect()
    assert len(none) == len(texts)
    assert quality.classify(empty, labels).collect() == []
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
