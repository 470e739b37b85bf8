"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions.

The tagger is trained in numpy on labelled spans that a seeded generator writes. It reads overlapping windows; each is
decoded by Viterbi and the spans of all windows are reconciled over the whole text: a span cut by a window's edge
counts only from a window that holds it whole (more and wider ones are laid where the usual ones cut a run without
white space, or of digits and separators, around a digit or an @), the base spans come first, and what the tagger adds mustn't overlap
them and must be of its kind's form. A span of any kind holds a digit or an @, so windows lie around those; a text
without them holds none.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
WIDTH, STRIDE, MARGIN, HIDDEN = 64, 32, 20, 12
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASSES = 8 + len(_SIGNS)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_HINT = re.compile(r"[0-9@]|\[at\]|\(at\)")
# What can be part of a span with its @ or digit, to the longest address (64 and 255 characters) and grouped number.
_LEFT, _RIGHT, _NUMBER = 64, 256, 40
_AFTER = re.compile(r"\S*")
_NUMERIC = frozenset("0123456789 ().+-")
# Forms that the base patterns miss and the tagger may add, whole.
_AT = re.compile(r"@|\[at\]|\(at\)")
_LIKE_EMAIL = re.compile(r"[^\s@\[\]()]+(?:@|\[at\]|\(at\))[^\s@\[\]()]+(?:(?:\.|\[dot\]|\(dot\))[^\s@\[\]().]+)+")
_LIKE_IP = re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}")
_LIKE_PHONE = re.compile(r"(?:\+[0-9]{1,3} ?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base patterns, by start, then kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            out.append(("email", lo, m.end()))
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = digits_of(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


_TABLE = {}


def encode(text: str) -> np.ndarray:
    """Character classes: 0 outside, lower, upper, digit, other letter, blank, line end, other; signs one each."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not _TABLE:
        t = np.full(256, 7, np.uint8)
        for c in range(256):
            s = chr(c)
            t[c] = 1 if "a" <= s <= "z" else 2 if "A" <= s <= "Z" else 3 if "0" <= s <= "9" else 6 if s in "\n\r" else 5 if s.isspace() else 8 + _SIGNS.index(s) if s in _SIGNS else 4 if s.isalpha() else 7
        _TABLE["t"] = t
    return np.where(codes < 256, _TABLE["t"][np.minimum(codes, 255)], 4).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Bidirectional LSTM over character classes; linear-chain CRF over B/I labels."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        init = lambda *s: rng.normal(0, 0.25, s).astype(np.float32)
        self.p = {"wo": init(2 * HIDDEN, LABELS), "bo": np.zeros(LABELS, np.float32), "tr": np.zeros((LABELS, LABELS), np.float32), "st": np.zeros(LABELS, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": init(CLASSES, 4 * HIDDEN), f"h{d}": init(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
        bad = np.zeros((LABELS, LABELS), np.float32)
        for k in range(len(KINDS)):  # I follows only B or I of its kind
            inside = 2 + 2 * k
            bad[:, inside] = -1e4
            bad[inside - 1, inside] = bad[inside, inside] = 0
        self.bad = bad
        self.bad_start = np.where(np.isin(np.arange(LABELS), np.arange(2, LABELS, 2)), -1e4, 0).astype(np.float32)

    def _lstm(self, ids: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        n, t = ids.shape
        out = np.zeros((n, t, HIDDEN), np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        table = self.p[f"x{d}"] + self.p[f"b{d}"]
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = table[ids[:, s]] + h @ self.p[f"h{d}"]
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((s, h, before, i, f, o, g, tc))
            h = o * tc
            out[:, s] = h
        return out

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = np.concatenate([self._lstm(ids, d, keep.setdefault(d, []) if keep is not None else None) for d in "fb"], axis=2)
        if keep is not None:
            keep["both"] = both
        return both @ self.p["wo"] + self.p["bo"]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Best label paths by Viterbi."""
        e = self.emissions(ids)
        n, t, _ = e.shape
        tr, back = self.p["tr"] + self.bad, np.zeros((t, n, LABELS), np.int8)
        v = e[:, 0] + self.p["st"] + self.bad_start
        for s in range(1, t):
            m = v[:, :, None] + tr
            back[s] = m.argmax(axis=1)
            v = m.max(axis=1) + e[:, s]
        path = np.zeros((n, t), np.int8)
        path[:, -1] = v.argmax(axis=1)
        for s in range(t - 1, 0, -1):
            path[:, s - 1] = back[s][np.arange(n), path[:, s]]
        return path

    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood."""
        keep: dict = {}
        e = self.emissions(ids, keep).astype(np.float64)
        n, t, _ = e.shape
        tr, rows = (self.p["tr"] + self.bad).astype(np.float64), np.arange(n)
        step = np.exp(tr)

        def through(x: np.ndarray, m: np.ndarray) -> np.ndarray:
            """log(exp(x) m): sums over paths as a product, scaled by the largest."""
            top = x.max(axis=1, keepdims=True)
            return np.log(np.maximum(np.exp(x - top) @ m, 1e-300)) + top

        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0] + self.p["st"] + self.bad_start
        for s in range(1, t):
            a[:, s] = through(a[:, s - 1], step) + e[:, s]
        for s in range(t - 2, -1, -1):
            b[:, s] = through(e[:, s + 1] + b[:, s + 1], step.T)
        z = through(a[:, -1], np.ones((LABELS, 1)))[:, 0]
        de = np.exp(a + b - z[:, None, None])
        g = {"st": de[:, 0].sum(axis=0)}
        np.subtract.at(g["st"], gold[:, 0], 1)
        # expected transitions, all steps at once: exp(a) tr exp(e + b) / z
        g["tr"] = step * np.einsum("nsi,nsj->ij", np.exp(a[:, :-1] - z[:, None, None] + (m := (e + b)[:, 1:].max(axis=2, keepdims=True))), np.exp((e + b)[:, 1:] - m))
        np.subtract.at(g["tr"], (gold[:, :-1], gold[:, 1:]), 1)
        de[rows[:, None], np.arange(t), gold] -= 1
        de = de.astype(np.float32)
        both = keep["both"]
        g["wo"], g["bo"] = np.einsum("nth,ntl->hl", both, de), de.sum(axis=(0, 1))
        dh_all = de @ self.p["wo"].T
        onehot = np.eye(CLASSES, dtype=np.float32)
        seen = onehot[ids].reshape(n * t, CLASSES)
        for k, d in enumerate("fb"):
            dh_out = dh_all[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            back, state = np.zeros((n, t, 4 * HIDDEN), np.float32), np.zeros((n, t, HIDDEN), np.float32)
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for s, h, before, i, f, o, gg, tc in reversed(keep[d]):
                dh = dh + dh_out[:, s]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                back[:, s], state[:, s] = dz, h
                dh, dc = dz @ self.p[f"h{d}"].T, dc * f
            back = back.reshape(n * t, -1)
            gx, gh, gb = seen.T @ back, state.reshape(n * t, -1).T @ back, back.sum(axis=0)
            g |= {f"x{d}": gx, f"h{d}": gh, f"b{d}": gb}
        return {k: (v / n).astype(np.float32) for k, v in g.items()}

    def fit(self, ids: np.ndarray, gold: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.04, seed: int = 4) -> "Tagger":
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, whole = 0, epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            for lo in range(0, len(ids), batch):
                part = order[lo : lo + batch]
                step += 1
                for k, g in self.gradients(ids[part], gold[part]).items():
                    g = np.clip(g, -5, 5)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] -= rate * (1 - (step - 1) / whole) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str], list[list[tuple[str, int, int]]]]:
    """n windows of invented text with labelled spans, and look-alikes that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    word = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(int(rng.integers(1, 9))))

    def card() -> str:
        d = num(int(rng.integers(12, 20)) - 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = pick(["", "", " ", "-", "."])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick([f"+{num(int(rng.integers(1, 3)))} ({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])

    ascii_word = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(rng.integers(2, 9))))

    def email() -> str:
        name = pick([word, ascii_word, ascii_word])
        domain = f"{name()}{pick(['', num(1)])}.{pick(['com', 'org', 'example.com', 'net'])}"
        at = pick(["@", "@", "[at]", "(at)"])
        if at != "@" and rng.random() < 0.5:
            domain = domain.replace(".", at.replace("at", "dot"))
        return f"{name()}{pick(['.', '_', '', '+'])}{pick([num(2), name()])}{at}{domain}"

    make = {
        "email": email,
        "ip": lambda: pick([".", ".", "[.]"]).join(str(int(x)) for x in rng.integers(0, 256, 4)),
        "card": card,
        "phone": phone,
    }
    other = [lambda: num(int(rng.integers(1, 9))), lambda: f"{num(1)}.{num(1)}.{num(1)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"@{word()}", lambda: "token = \"" + "".join(pick("0123456789abcdef") for _ in range(32)) + "\"", lambda: f"{num(2)}:{num(2)}", lambda: f"${num(3)}.{num(2)}", word]
    texts, spans = [], []
    for _ in range(n):
        text, found = word() + " ", []
        while len(text) < WIDTH:
            if rng.random() < 0.3:
                kind = pick(KINDS)
                s = make[kind]()
                found.append((kind, len(text), len(text) + len(s)))
                text += s
            else:
                text += pick(other)() if rng.random() < 0.25 else word()
            text += pick([" ", " ", " ", ", ", ". ", "\n", "### ", " | "])
        cut = int(rng.integers(0, len(text) - WIDTH + 1))
        texts.append(text[cut : cut + WIDTH])
        spans.append([(k, a - cut, b - cut) for k, a, b in found if a >= cut and b <= cut + WIDTH])
    ids = np.stack([encode(t) for t in texts])
    gold = np.zeros(ids.shape, np.int64)
    for row, found in zip(gold, spans):
        for k, a, b in found:
            row[a], row[a + 1 : b] = 1 + 2 * KINDS.index(k), 2 + 2 * KINDS.index(k)
    return ids, gold, texts, spans


@functools.cache
def train(windows: int = 2400, epochs: int = 8, seed: int = 9) -> Tagger:
    """The tagger, trained on `windows` labelled windows; once in a process."""
    ids, gold, _, _ = labelled(windows, seed)
    return Tagger().fit(ids, gold, epochs)


def window_starts(text: str) -> list[int]:
    """Begins of the windows around digits and @; neighbouring ones overlap by half."""
    out: list[int] = []
    for m in _HINT.finditer(text):
        at = m.start()
        if not out or at + MARGIN > out[-1] + WIDTH:
            out.append(max(0, at - MARGIN) if not out or at - MARGIN > out[-1] + STRIDE else out[-1] + STRIDE)
    return out


def _reach(text: str, at: int) -> tuple[int, int]:
    """Begin and end of what a span with the hint at `at` can hold."""
    if text[at] == "@":
        lo = at
        while lo > max(0, at - _LEFT) and not text[lo - 1].isspace():
            lo -= 1
        return lo, _AFTER.match(text, at, at + _RIGHT).end()
    lo, hi = at, at + 1
    while lo > max(0, at - _NUMBER) and text[lo - 1] in _NUMERIC:
        lo -= 1
    while hi < min(len(text), at + _NUMBER) and text[hi] in _NUMERIC:
        hi += 1
    return lo, hi


def windows(text: str) -> list[tuple[int, int]]:
    """(begin, width): those of window_starts, and one for each reach that none of them holds with a character more."""
    out = [(at, WIDTH) for at in window_starts(text)]
    usual, k, n, done = len(out), 0, len(text), -1
    for m in _HINT.finditer(text):
        if text[m.start()] != "@" and m.start() < done:  # the number's last window holds its reach
            continue
        lo, hi = _reach(text, m.start())
        while k < usual and out[k][0] + WIDTH <= m.start():
            k += 1
        near = [*out[k : min(k + 3, usual)], *out[usual:][-2:]]
        if not any((at < lo or at == 0) and (hi < at + width or at + width >= n) for at, width in near):
            at = max(0, lo - MARGIN)
            out.append((at, -(-(hi + MARGIN - at) // WIDTH) * WIDTH))
        if text[m.start()] != "@" and hi - lo < _NUMBER:
            done = hi
    return out


def spans_of(path: np.ndarray) -> list[tuple[str, int, int]]:
    out, at = [], 0
    for at in np.flatnonzero(path % 2 == 1).tolist():
        end = at + 1
        while end < len(path) and path[end] == path[at] + 1:
            end += 1
        out.append((KINDS[(int(path[at]) - 1) // 2], at, end))
    return out


def of_form(kind: str, s: str) -> bool:
    """Whether what the tagger marks can be of its kind: what no such datum can look like is dropped."""
    d = digits_of(s)
    if kind == "email":
        return _LIKE_EMAIL.fullmatch(s) is not None
    if kind == "ip":
        return _LIKE_IP.fullmatch(s) is not None and all(int(p) <= 255 for p in re.findall("[0-9]+", s))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d) and all(c in "0123456789 -." for c in s)
    return 7 <= len(d) <= 15 and _LIKE_PHONE.fullmatch(s) is not None


def reconcile(text: str, base: list[tuple[str, int, int]], decoded: list[tuple[int, np.ndarray]]) -> list[tuple[str, int, int]]:
    """Base spans and what the windows add, over the whole text."""
    votes: dict[tuple[str, int, int], int] = {}
    for at, path in decoded:
        for kind, a, b in spans_of(path):
            if (a > 0 or at == 0) and (b < len(path) or at + b >= len(text)):
                votes[kind, at + a, at + b] = votes.get((kind, at + a, at + b), 0) + 1
    out = list(base)
    for kind, a, b in sorted(votes, key=lambda s: (-votes[s], s[1] - s[2], s[1], KINDS.index(s[0]))):
        if b <= len(text) and all(b <= o[1] or a >= o[2] for o in out) and of_form(kind, text[a:b]):
            whole = (a == 0 or not text[a - 1].isdigit()) and (b == len(text) or not text[b].isdigit())
            if whole:
                out.append((kind, a, b))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_all(texts: list[str], tagger: Tagger, most: int = 2048) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; windows of many texts are decoded together."""
    base = [base_spans(t) if t else [] for t in texts]
    decoded: list[list] = [[] for _ in texts]
    todo: dict[int, list[tuple[int, int, np.ndarray]]] = {}

    def flush(width: int) -> None:
        part = todo.pop(width)
        for (row, at, _), path in zip(part, tagger.decode(np.stack([ids for _, _, ids in part]))):
            decoded[row].append((at, path))

    for row, t in enumerate(texts):
        for at, width in windows(t) if t else []:
            codes = encode(t[at : at + width])
            todo.setdefault(width, []).append((row, at, np.pad(codes, (0, width - len(codes)))))
            if len(todo[width]) * width >= most * WIDTH:
                flush(width)
    for width in list(todo):
        flush(width)
    return [(b, reconcile(t, b, d) if d else b) for t, b, d in zip(texts, base, decoded)]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """Rows (key, n_email, n_ip, n_card, n_phone, base_sha256, spans), one for each row of docs.

    The numbers and the hash are of the base spans; `spans` lists those and what the tagger adds. Null and empty texts
    hold none; null keys are kept; repeated rows get the same result each. Very long texts are read whole, window by
    window.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = find_all([t or "" for t in batch.column(1).to_pylist()], model)
            counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
            cols = [batch.column(0), *counts, pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found]), pa.array([written(a) for _, a in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    narrow = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = narrow.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
