"""Personal data that the usual windows cut."""

import numpy as np

from tessera.llm import pii


def test_windows_hold_whole_runs():
    local, domain = "l" * 30, "d\u00e9" * 12 + ".example"
    for text in (f"no 12345 {'w ' * 16}a@{domain} end", f"{'w ' * 40}{local}@{domain} end", f"7 {'x' * 64}@{'y' * 100}.{'z' * 90}.com", f"{'w ' * 9}4 {'q ' * 12}4111 1111 1111 1111", "u" * 900 + "@" + "v" * 900):
        at = text.index("@") if "@" in text else text.index("4111")
        lo, hi = at, at
        if "@" in text:
            while lo > max(0, at - 64) and text[lo - 1] != " ":
                lo -= 1
            while hi < min(len(text), at + 256) and text[hi] != " ":
                hi += 1
        else:
            hi = at + 19
        assert any((s < lo or s == 0) and (hi < s + w or s + w >= len(text)) for s, w in pii.windows(text)), text
        assert {s for s, _ in pii.windows(text)} >= set(pii.window_starts(text))
    many = "a1" * 50_000 + "@" * 5000
    assert len(pii.windows(many)) < 20_000 and max(w for _, w in pii.windows(many)) <= 448


class Marks:
    """Marks all that isn't blank around an @ as an email."""

    def decode(self, ids):
        path = np.zeros(ids.shape, np.int8)
        for row, out in zip(ids, path):
            for at in np.flatnonzero(row == 8 + pii._SIGNS.index("@")).tolist():
                lo, hi = at, at + 1
                while lo and row[lo - 1] not in (0, 5):
                    lo -= 1
                while hi < len(row) and row[hi] not in (0, 5):
                    hi += 1
                out[lo], out[lo + 1 : hi] = 1, 2
        return path


def test_long_emails_are_held():
    for mail in ("m" * 40 + "@d\u00e9partement.example", "a@" + "d\u00e9" * 20 + ".example", "n" * 64 + "@" + "d\u00e9" * 60 + ".example"):
        for pad in range(0, 70, 3):
            text = "5 " + "w" * pad + " " + mail + " and more"
            (_, spans), = pii.find_all([text], Marks())
            assert ("email", pad + 3, pad + 3 + len(mail)) in spans
