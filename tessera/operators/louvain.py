"""Rounds of the Louvain method on blocks of nodes; see graph.communities.

A block holds the nodes of a range of names, their neighbours' places and the weights, as arrays in one row; `bounds` cut
the ranges. A round is two shuffles of packed rows: blocks send the labels of their nodes to the blocks where those are
neighbours, and the sums of their communities to the block of the community's name, which adds them up and tells the
blocks that hold a node or a neighbour of the community. A block is all that a task holds: some 60 bytes for each neighbour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

ROW = "dest int, src int, kind int, moved long, body array<binary>"
_ARROW = pa.schema([("dest", pa.int32()), ("src", pa.int32()), ("kind", pa.int32()), ("moved", pa.int64()), ("body", pa.list_(pa.binary()))])
EDGES, NODES, STATIC, LABELS, SUMS, TOTALS = range(6)
_TYPES = {
    EDGES: "qqd",  # a, b, w
    NODES: "qqd",  # node, label, degree
    STATIC: "qqdiidiidq",  # nodes, nodes and neighbours, degrees; of each edge node, neighbour, weight; of each label sent block, node; loops, first labels
    LABELS: "q",
    SUMS: "qdqii",  # community, degrees, nodes; of each block to be told community, block
    TOTALS: "qdq",  # community, degrees, nodes
}
#: Rows dealt at once.
_HELD = 1_000_000

Row = tuple[int, int, int, int, list[np.ndarray]]


def _batch(dest: int, src: int, kind: int, moved: int, body: list[np.ndarray]) -> pa.RecordBatch:
    cells = [np.ascontiguousarray(x, t).tobytes() for x, t in zip(body, _TYPES[kind], strict=True)]
    return pa.RecordBatch.from_pylist([{"dest": dest, "src": src, "kind": kind, "moved": moved, "body": cells}], schema=_ARROW)


def _read(batches: Iterable[pa.RecordBatch]) -> list[Row]:
    """The rows by kind and source, whatever order they came in."""
    out = []
    for batch in batches:
        dest, src, kind, moved = (batch.column(n).to_pylist() for n in ("dest", "src", "kind", "moved"))
        for i, body in enumerate(batch.column("body")):
            out.append((dest[i], src[i], kind[i], moved[i], [np.frombuffer(x.as_buffer(), t) for x, t in zip(body.values, _TYPES[kind[i]], strict=True)]))
    return sorted(out, key=lambda r: (r[2], r[1]))


def _joined(rows: list[Row], kind: int) -> list[np.ndarray]:
    parts = [r[4] for r in rows if r[2] == kind]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(_TYPES[kind])]


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of each run of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
    for lo, hi in zip(starts, [*starts[1:], len(keys)]):
        yield int(keys[lo]), int(lo), int(hi)


def dealt(bounds: np.ndarray, kind: int, mirror: bool = False) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Three columns as packed rows for the block of the first one; mirror: edges for the block of either end."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, z = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
        if mirror:
            two = x != y  # a loop has one block
            x, y, z = np.concatenate([x, y[two]]), np.concatenate([y, x[two]]), np.concatenate([z, z[two]])
        dest = np.searchsorted(bounds, x, "right")
        order = np.argsort(dest, kind="stable")
        for d, lo, hi in _runs(dest[order]):
            at = order[lo:hi]
            yield _batch(d, 0, kind, 0, [x[at], y[at], z[at]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _HELD:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    return run


def _said(p: int, bounds: np.ndarray, label: np.ndarray, static: list[np.ndarray], moved: int) -> Iterator[pa.RecordBatch]:
    """What a block sends at the end of a round."""
    k, to, node = static[2], static[6], static[7]
    for q, lo, hi in _runs(to):
        yield _batch(q, p, LABELS, moved if q == p else 0, [label[node[lo:hi]]])
    c, of = np.unique(label, return_inverse=True)
    t, n = np.bincount(of, k, len(c)), np.bincount(of, minlength=len(c))
    blocks = len(bounds) + 1
    told = np.unique(of[node] * blocks + to)
    whose, told = told // blocks, told % blocks
    for o, lo, hi in _runs(np.searchsorted(bounds, c, "right")):
        x, y = np.searchsorted(whose, [lo, hi])
        yield _batch(o, p, SUMS, 0, [c[lo:hi], t[lo:hi], n[lo:hi], whose[x:y] - lo, told[x:y]])


def built(bounds: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Dealt edges of a block, both ways, as its STATIC row. Without NODES each node is its own community."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _read(batches)
        if not rows:
            return
        p = rows[0][0]
        a, b, w = _joined(rows, EDGES)
        named, label, degree = _joined(rows, NODES)
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        nodes = np.unique(np.concatenate([a, named]))
        size, loop = len(nodes), a == b
        loops = np.bincount(np.searchsorted(nodes, a[loop]), w[loop], size)
        a, b, w = a[~loop], b[~loop], w[~loop]
        row = np.searchsorted(nodes, a)
        around = np.unique(np.concatenate([nodes, b]))
        near = np.searchsorted(around, b)
        k = np.bincount(row, w, size) + 2 * loops
        c = nodes.copy()
        if len(named):
            at = np.searchsorted(nodes, named)
            c[at], k[at] = label, degree
        blocks = np.searchsorted(bounds, around, "right")[near]
        send = np.unique(np.concatenate([blocks * size + row, p * size + np.arange(size)]))
        yield _batch(p, p, STATIC, 0, [nodes, around, k, row, near, w, send // size, send % size, loops, c])

    return run


def begun(bounds: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the blocks of STATIC rows send before the first round."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _read([batch]):
                yield from _said(r[0], bounds, r[4][9], r[4], 0)

    return run


def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMS of the communities named in a block as TOTALS for the blocks that need them."""
    rows = _read(batches)
    if not rows:
        return
    shift = np.cumsum([0, *[len(r[4][0]) for r in rows]])
    c, t, n, whose, told = _joined([(*r[:4], [*r[4][:3], r[4][3] + s, r[4][4]]) for r, s in zip(rows, shift)], SUMS)
    c, of = np.unique(c, return_inverse=True)
    t, n = np.bincount(of, t, len(c)), np.bincount(of, n, len(c)).astype("q")
    pairs = np.unique(told.astype("q") * len(c) + of[whose])
    for q, lo, hi in _runs(pairs // len(c)):
        at = pairs[lo:hi] % len(c)
        yield _batch(q, rows[0][0], TOTALS, 0, [c[at], t[at], n[at]])


def _hashed(node: np.ndarray, number: int) -> np.ndarray:
    """Spark's xxhash64(node, number) of a long and an int."""
    u = np.uint64
    p1, p2, p3, p4, p5 = map(u, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, r: int) -> np.ndarray:
        return (x << u(r)) | (x >> u(64 - r))

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
        return h ^ (h >> u(32))

    with np.errstate(over="ignore"):
        h = np.full(len(node), 42 + 8, u) + p5
        h = mixed(turned(h ^ (turned(node.astype(u) * p2, 31) * p1), 27) * p1 + p4)
        number = np.full(len(node), number, u)
        return mixed(turned((h + p5 + u(4)) ^ (number * p1), 23) * p2 + p3)


def moves(nodes: np.ndarray, row: np.ndarray, beside: np.ndarray, w: np.ndarray, k: np.ndarray, c: np.ndarray, t: np.ndarray, n: np.ndarray, m: float, turn: int) -> np.ndarray:
    """The community of each node after a round: places in t and n, which are in the order of names.

    Each edge leads from nodes[row] to a node of the community `beside`; rows ascend.
    """
    to, size = c.copy(), len(t)
    if not len(row):
        return to
    key = row.astype("q") * size + beside
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    w, key = np.add.reduceat(w[order], first), key[first]
    node, near = key // size, key % size
    here = c[node]
    own = near == here
    gain = w - k[node] * (t[near] - np.where(own, k[node], 0.0)) / (2 * m)
    stay = -k * (t[c] - k) / (2 * m)
    stay[node[own]] = gain[own]
    gain[~own & (n[near] == 1) & (n[here] == 1) & (near > here)] = -np.inf  # of two single nodes only the greater goes
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    best = np.full(len(nodes), -np.inf)
    best[node[starts]] = np.maximum.reduceat(gain, starts)
    top = np.flatnonzero(gain == best[node])[::-1]  # the least name comes last and stays
    goal = c.copy()
    goal[node[top]] = near[top]
    turns = (_hashed(nodes, turn // 2) & np.uint64(1)) == turn % 2
    go = turns & (best > stay + 1e-12)
    to[go] = goal[go]
    return to


def _held(rows: list[Row]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """STATIC, the labels of its nodes and neighbours, and where its nodes are among these."""
    static = next(r[4] for r in rows if r[2] == STATIC)
    label = _joined(rows, LABELS)[0]
    if len(label) != len(static[1]):
        raise ValueError(f"{len(label)} labels for {len(static[1])} nodes: edges must be given both ways")
    return static, label, np.searchsorted(static[1], static[0])


def moved(bounds: np.ndarray, m: float, turn: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """STATIC, LABELS and TOTALS of a block: what it sends after its nodes have moved."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _read(batches)
        if not rows:
            return
        static, label, at = _held(rows)
        nodes, _, k, row, near, w = static[:6]
        names, t, n = _joined(rows, TOTALS)
        place = np.searchsorted(names, label)
        c = place[at]
        to = moves(nodes, row, place[near], w, k, c, t, n, m, turn)
        yield from _said(rows[0][0], bounds, names[to], static, int((to != c).sum()))

    return run


def ended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STATIC and LABELS of a block: rows (kind, a, b, w), its nodes with label and degree and its edges between labels."""
    rows = _read(batches)
    if not rows:
        return
    static, label, at = _held(rows)
    nodes, around, k, row, near, w, _, _, loops, _ = static
    c = label[at]
    yield pa.RecordBatch.from_arrays([np.full(len(nodes), NODES, "i"), nodes, c, k], ["kind", "a", "b", "w"])
    once = nodes[row] < around[near]
    a, b, w = _summed(np.concatenate([c[row[once]], c]), np.concatenate([label[near[once]], c]), np.concatenate([w[once], loops]))
    yield pa.RecordBatch.from_arrays([np.full(len(a), EDGES, "i"), a, b, w], ["kind", "a", "b", "w"])


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights by unordered pair, pairs in order."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    first = np.flatnonzero(np.r_[len(a) > 0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], np.add.reduceat(w, first) if len(first) else w


def settled(m: float, rounds: int, levels: int, best: float | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All edges (a, b, w) of a level, small enough for one task: (node, community, open) after it and those that follow."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        a, b, w = _summed(*(np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in range(3)))
        start = member = nodes = np.unique(np.concatenate([a, b]))
        most, unsettled = best, True
        for _ in range(levels):
            size = len(nodes)
            x, y = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
            k = np.bincount(x, w, size) + np.bincount(y, w, size)
            two = x != y
            row, near, weight = np.concatenate([x[two], y[two]]), np.concatenate([y[two], x[two]]), np.concatenate([w[two], w[two]])
            order = np.lexsort((near, row))
            row, near, weight = row[order], near[order], weight[order]
            c, still = np.arange(size), 0
            for turn in range(rounds):
                to = moves(nodes, row, c[near], weight, k, c, np.bincount(c, k, size), np.bincount(c, minlength=size), m, turn)
                still = still + 1 if (to == c).all() else 0
                c = to
                if still == 2:
                    break
            a, b, w = _summed(nodes[c[x]], nodes[c[y]], w)
            q = w[a == b].sum() / m - ((np.bincount(c, k, size) / (2 * m)) ** 2).sum()
            if most is not None and q <= most + 1e-12:
                unsettled = False
                break
            most, member = q, nodes[c][np.searchsorted(nodes, member)]
            nodes = np.unique(np.concatenate([a, b]))
            if (a == b).all():
                unsettled = False
                break
        yield pa.RecordBatch.from_arrays([start, member, np.full(len(start), unsettled)], ["node", "community", "open"])

    return run
