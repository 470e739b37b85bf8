"""License scans against every template compared with every window."""

import random
import re

import numpy as np

from tessera.llm import licenses
from tessera.llm.common import WordHashes, gram_hashes


def brute(text, hashes, least):
    """The best containment of each license over all windows of its templates' lengths."""
    words = licenses._words(text)
    best = {}
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            own = licenses._words(t)
            k, n = min(licenses.SHINGLE, len(own)), min(len(own), len(words))
            have = set(gram_hashes(hashes.of(own), k).tolist())
            g = gram_hashes(hashes.of(words), k).tolist()
            for at in range(len(words) - n + 1):
                c = len(have & set(g[at : at + n - k + 1])) / len(have)
                if c >= least:
                    best[name] = max(best.get(name, 0), c)
    return best


def test_recall_and_precision_on_torn_notices():
    rng, hashes = random.Random(12), WordHashes()
    index = licenses.Index(licenses.TEMPLATES, hashes)
    missed = whole = wrong = 0
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            for edits in (0, 0, 1, 1, 2, 2, 4):
                words = t.split()
                for _ in range(min(edits, len(words) // 8)):
                    words[rng.randrange(len(words))] = f"edit{rng.randrange(9)}"
                pad = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
                text = pad(rng.randrange(30)) + " " + " ".join(words) + " " + pad(rng.randrange(30))
                want, got = brute(text, hashes, 0.8), licenses.scan(text, index, hashes, 0.8)
                whole += name in want
                missed += name in want and name not in {x[0] for x in got}
                wrong += bool({x[0] for x in got} - set(want))
                assert not edits and want.get(name) == 1 or edits
    assert whole > 150 and missed == 0 and wrong == 0  # recall and precision 1


def test_clean_texts_match_nothing():
    rng, hashes = random.Random(13), WordHashes()
    index = licenses.Index(licenses.TEMPLATES, hashes)
    vocabulary = sorted({w for ts in licenses.TEMPLATES.values() for t in ts for w in re.findall('[a-z0-9]+', t.lower())})
    for _ in range(60):
        text = " ".join(rng.choice(vocabulary) for _ in range(300))
        assert licenses.scan(text, index, hashes, 0.8) == [] and brute(text, hashes, 0.8) == {}


def test_notices_that_hold_others():
    hashes = WordHashes()
    index = licenses.Index(licenses.TEMPLATES, hashes)
    names = lambda t: {x[0] for x in licenses.scan(t, index, hashes, 0.8)}
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert name in names("so " + t + " end"), t
    assert names(licenses.TEMPLATES["ISC"][0]) == {"ISC"} and names(licenses.TEMPLATES["0BSD"][0]) == {"0BSD"}
    assert names(licenses.TEMPLATES["GPL-3.0"][1]) == {"GPL-3.0"} and names(licenses.TEMPLATES["GPL-2.0"][0]) == {"GPL-2.0"}
    assert names(" ".join([licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["Zlib"][0]])) == {"MIT", "Zlib"}


def test_band_values_tell_bands_apart():
    minima = np.full((1, licenses.BANDS * licenses.ROWS), 7, np.uint64)
    assert len(set(licenses.band_values(minima)[0].tolist())) == licenses.BANDS
