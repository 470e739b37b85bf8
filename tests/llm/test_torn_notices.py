"""License notices shorter than their templates."""

import re

from tessera.llm import licenses
from tessera.llm.common import WordHashes


def test_torn_notice_alone():
    hashes = WordHashes()
    index = licenses.Index(licenses.TEMPLATES, hashes)
    scan = lambda t: [x[:3] for x in licenses.scan(t, index, hashes, 0.8)]
    gpl = licenses.TEMPLATES["GPL-3.0"][0].split()
    assert scan(" ".join(gpl[:-1])) == [("GPL-3.0", 0, 11)] and scan(" ".join(gpl[:10])) == []  # 7 and 6 of 8 shingles
    for name, text in (("MIT", licenses.TEMPLATES["MIT"][2]), ("Apache-2.0", licenses.TEMPLATES["Apache-2.0"][2])):
        words = re.findall("[a-z0-9]+", text.lower())
        assert scan(" ".join(words[2:-3])) == [(name, 0, len(words) - 5)]
        assert scan(" ".join(words[: len(words) * 2 // 3])) == []
    assert scan("All rights") == scan("reserved") == []
