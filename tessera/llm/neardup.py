"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, links confirmed on full sets.

A signature is 32 MinHash values of 16 bits. Two signatures of distance <= 15 (differing values) have, by pigeonhole,
at most one difference in one of the 8 chunks of 4 values, so both hold the same chunk with the same value masked:
32 keys a text find every pair under the threshold. A pair of similarity s differs in about 32 (1 - s) values; at
s = 0.85 more than 15 differ with a probability of about 3 in a million.

Equal sets are one class, so copies never meet in pairs. Within a key, a spanning forest of the pairs under the
threshold is kept instead of the pairs; its components hold all links. The texts of a component then meet once, and
links are confirmed on whole shingle sets, again as a spanning forest. Groups too large for one task are cut by
set size (sets of too different sizes can't be linked) and by hash into pairs of blocks (common.blocked).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm.common import WordHashes, blocked, connected, fresh, gram_hashes, materialize, spanning

VALUES, CHUNKS, ERRORS = 32, 8, 15
SHINGLE = 5
_FACTORS = np.random.default_rng(20).integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.random.default_rng(21).integers(0, 2**63, VALUES, dtype=np.uint64)
COLUMNS = [f"c{j}" for j in range(CHUNKS)]


def shingle_set(text: str | None, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; the whole sequence as one where there are fewer words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return np.unique(gram_hashes(h, min(n, len(h))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least value under each of the hash functions."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(low, ((part[None, :] ^ _MASKS[:, None]) * _FACTORS[:, None]).min(axis=1), out=low)
    return low.astype(np.uint16)


def signatures(docs: DataFrame, key: str, text: str, n: int = SHINGLE) -> DataFrame:
    """Rows (key long, n_shingles, set_hi, set_lo, c0..c7), one for each row of docs; set and chunks null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            size = batch.num_rows
            counts, ids, sigs = np.zeros(size, np.int64), np.zeros((size, 2), np.int64), np.zeros((size, VALUES), np.uint16)
            for i, t in enumerate(batch.column(1)):
                s = shingle_set(t.as_py(), hashes, n)
                counts[i] = len(s)
                if len(s):
                    ids[i] = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8")
                    sigs[i] = signature(s)
            empty = counts == 0
            chunks = sigs.view(np.int64)
            cols = [pa.array(c, pa.int64(), mask=empty) for c in (ids[:, 0], ids[:, 1], *(chunks[:, j] for j in range(CHUNKS)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), *cols], names=["id", "n_shingles", "set_hi", "set_lo", *COLUMNS])

    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, n_shingles long, set_hi long, set_lo long, " + ", ".join(f"{c} long" for c in COLUMNS))


def _forest(n: int, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest; near(i, rest) tells which of the indexes `rest` are next to i."""
    left, edges = np.arange(n), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            if hit.any():
                found = left[hit]
                edges += [(i, j) for j in found]
                queue += found.tolist()
                left = left[~hit]
    return edges


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple[int, int]]]]:
    """Columns of sorted batches with the bounds of each run of equal `unit`; a run cut by a batch's end is carried on."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        u = batch.column(0).to_numpy()
        if held and u[-1] == held[0].column(0)[0].as_py():
            held.append(batch)
            continue
        last = int(np.searchsorted(u, u[-1]))  # begin of the last run
        whole = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
        held = [batch.slice(last)]
        if whole.num_rows:
            yield _cut(whole)
    if held:
        yield _cut(pa.Table.from_batches(held).combine_chunks())


def _cut(t: pa.Table) -> tuple[dict, list[tuple[int, int]]]:
    cols = {n: t.column(n).to_pylist() if pa.types.is_string(t.schema.field(n).type) or pa.types.is_large_string(t.schema.field(n).type) else t.column(n).to_numpy() for n in t.column_names}
    u = cols["unit"]
    cuts = [0, *(np.flatnonzero(u[1:] != u[:-1]) + 1).tolist(), len(u)]
    return cols, [(a, b) for a, b in zip(cuts, cuts[1:]) if b - a > 1]


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _signature_links(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, bounds in _groups(batches):
            ids, size, side = cols["id"], cols["n"], cols["side"]
            sig = np.ascontiguousarray(np.stack([cols[c] for c in COLUMNS], axis=1)).view(np.uint16)
            a: list[int] = []
            b: list[int] = []
            two = np.array([lo for lo, hi in bounds if hi - lo == 2], dtype=np.int64)
            if len(two):
                d = (sig[two] != sig[two + 1]).sum(axis=1)
                low, high = np.minimum(size[two], size[two + 1]), np.maximum(size[two], size[two + 1])
                good = two[(d <= ERRORS) & (100 * low >= least * high)]
                a += ids[good].tolist()
                b += ids[good + 1].tolist()
            for lo, hi in bounds:
                if hi - lo > 2:
                    s, z, e = sig[lo:hi], size[lo:hi], side[lo:hi]

                    def near(i, rest, s=s, z=z, e=e):
                        return ((s[rest] != s[i]).sum(axis=1) <= ERRORS) & (100 * np.minimum(z[rest], z[i]) >= least * np.maximum(z[rest], z[i])) & ((e[rest] != e[i]) | (e[i] == 0))

                    for i, j in _forest(hi - lo, near):
                        a.append(ids[lo + i])
                        b.append(ids[lo + j])
            yield _pairs(a, b)

    return run


def links_within(sets: list[np.ndarray], side: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= least * union, by counting shared shingles."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    members, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    first = np.concatenate([[0], np.cumsum(n)])

    def near(i, rest):
        mine = code[first[i] : first[i + 1]]
        lo, long = starts[mine], starts[mine + 1] - starts[mine]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(long)[:-1]]), long) + np.arange(long.sum())
        both = np.bincount(members[at], minlength=len(sets))[rest]
        return (100 * both >= least * (n[i] + n[rest] - both)) & ((side[rest] != side[i]) | (side[i] == 0))

    return _forest(len(sets), near)


def _confirmed_links(least: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for cols, bounds in _groups(batches):
            a: list[int] = []
            b: list[int] = []
            for lo, hi in bounds:
                sets = [shingle_set(t, hashes, n) for t in cols["text"][lo:hi]]
                for i, j in links_within(sets, cols["side"][lo:hi], least):
                    a.append(cols["id"][lo + i])
                    b.append(cols["id"][lo + j])
            yield _pairs(a, b)

    return run


def _stars(links):
    """The links that a task finds, as stars: the same components with at most one pair for each id and task."""
    return lambda batches: spanning(links(batches))


def components(docs: DataFrame, least: int = 85, key: str = "doc_id", text: str = "text", n: int = SHINGLE, most: int = 4096) -> DataFrame:
    """Rows (id, n_shingles, component_id), one for each row of docs.

    Links: 100 * |A n B| >= least * |A u B| on the sets of n-word shingles (A-Z in lower case, words between ASCII
    white space). component_id is the smallest key reachable, itself included. Null and empty texts, and texts
    without words, have no shingles and are linked with nothing; rows with a null key are linked with nothing and have
    a null component. Equal texts under several keys are one component; repeated rows get the same result each.
    """
    ratio = 0.999 * least / 100  # bands a little wider than needed, so that rounding loses no pair
    sigs = materialize(signatures(docs, key, text, n), "signatures")
    whole = sigs.where("set_hi IS NOT NULL AND id IS NOT NULL")
    classes = materialize(whole.groupBy("set_hi", "set_lo").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n"), *[F.min(c).alias(c) for c in COLUMNS]), "classes")
    masked = [F.xxhash64(F.col(c).bitwiseAND(~(0xFFFF << 16 * p) if p < 3 else 0xFFFFFFFFFFFF), F.lit(4 * j + p)) for j, c in enumerate(COLUMNS) for p in range(4)]
    keys = classes.select(F.col("rep").alias("id"), "n", F.explode(F.array(*masked)).alias("key"))
    units = blocked(keys, "key", "n", "id", most, ratio).select(F.xxhash64("unit").alias("unit"), "side", "id", "n")
    units = units.join(classes.select(F.col("rep").alias("id"), *COLUMNS), "id").repartition("unit").sortWithinPartitions("unit")
    rough = units.select("unit", "side", "id", "n", *COLUMNS).mapInArrow(_stars(_signature_links(least)), "a long, b long")
    groups = materialize(connected(rough, "rough"), "groups")
    sized = groups.join(classes.select(F.col("rep").alias("id"), "n"), "id")
    units = blocked(sized, "component", "n", "id", most // 2, ratio).select(F.xxhash64("unit").alias("unit"), "side", "id")
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    near = texts.join(units, "id").select("unit", "side", "id", "text").repartition("unit").sortWithinPartitions("unit")
    links = near.mapInArrow(_stars(_confirmed_links(least, n)), "a long, b long")
    linked = connected(links, "linked").withColumnRenamed("id", "rep")
    reach = classes.select("set_hi", "set_lo", "rep").join(linked, "rep", "left").select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component_id"))
    out = sigs.select("id", "n_shingles", "set_hi", "set_lo").join(reach, ["set_hi", "set_lo"], "left")
    return out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def near_duplicates(docs: DataFrame, least: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_shingles, component_id, kept): kept is the row whose key names its component, or has no key.

    Keys of any type that has an order: those that aren't integers are numbered by row first, and a component is named
    by the least of its keys.
    """
    kind = docs.schema[key].dataType
    if isinstance(kind, IntegralType):
        out = components(docs, least, key, text).select(F.col("id").alias(key), "n_shingles", "component_id")
    else:
        k, row = F.col(f"`{key}`"), F.monotonically_increasing_id().alias("_row")
        numbered = materialize(docs.select(k.alias("_key"), F.col(f"`{text}`").alias("_text"), row), "numbered")
        # rows of one key are one component, as with integers; rows without a key have none
        found = components(numbered, least, "_row", "_text")
        rows = numbered.where("_key IS NOT NULL").select("_key", F.col("_row").alias("a"))
        same = rows.join(rows.groupBy("_key").agg(F.min("a").alias("b")), "_key").select("a", "b")
        links = found.join(rows.select(F.col("a").alias("id")), "id", "left_semi").select(F.col("id").alias("a"), F.col("component_id").alias("b"))
        both = connected(links.unionByName(same), "keyed")
        named = found.join(numbered.select(F.col("_row").alias("id"), "_key"), "id").join(both, "id", "left").withColumn("c", F.coalesce("component", "component_id"))
        least_key = named.where("_key IS NOT NULL").groupBy("c").agg(F.min("_key").alias("component_id"))
        out = named.drop("component_id").join(least_key, "c", "left")
        out = out.select(F.col("_key").alias(key), "n_shingles", F.when(F.col("_key").isNotNull(), F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, least: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs, all columns as they are, one row of each component: that of the smallest key, null keys last.

    Rows are linked by a number of their own, so repeated rows, rows of one key and rows of null key are told apart. Of
    texts without words, which are linked with nothing, one row of each key and text stays. Keys are of any type that
    has an order. An empty table stays empty.
    """
    columns = docs.columns
    row = fresh(docs, "_row_of_docs")
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = components(docs, least, row, text)
    k, t = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    first = docs.select(F.col(row).alias("id"), F.struct(k.isNull().alias("none"), k.alias("key"), F.md5(t).alias("text"), F.col(row).alias("row")).alias("first"))
    marked = found.join(first, "id").select("n_shingles", "component_id", "first")
    kept = marked.where("n_shingles > 0").groupBy("component_id").agg(F.min("first").alias("first")).select("first.row")
    wordless = marked.where("n_shingles = 0").groupBy("first.key", "first.text").agg(F.min("first.row").alias("row")).select("row")
    kept = kept.unionByName(wordless).toDF(row)
    return docs.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in columns])
