"""SimHash near-duplicates through pivot distance tables.

Fingerprints are compared once per distinct value. A pivot table holds each fingerprint's Hamming distances to many
reference fingerprints. By the triangle inequality a pair within ``bits`` of each other differs by at most ``bits`` in
every coordinate, so a pair whose greatest coordinate difference is larger is discarded unseen; survivors are verified
exactly. The table is computed once, beside the distinct fingerprints, and travels with them as one byte per pivot.

Which pairs meet at all is decided by the same coordinates: for the reference 0 and the references with a single bit
set, the difference of two coordinates is that bit, and the bits of a section of the word are the section's coordinates.
With s sections, at most ``bits`` of them hold a differing bit, so a linked pair agrees on all coordinates of at least
s - bits sections: cells keyed by every choice of s - bits sections lose no pair. s grows with the logarithm of the
number of distinct fingerprints (6 sections up to 2 million, 9 up to 34 thousand million), so that cells keep a bounded
expected size while the table grows.

A cell that a group of near copies fills is cut into blocks of bounded size, and each pair of blocks is its own unit of
work, so no task holds an unbounded cell. A unit emits a spanning forest of its links, never all its pairs, which keeps
components exact and the output linear. Fingerprints and roots that many rows share are dealt over several tasks.

Defined results: null text is an empty one (no words: fingerprint zero, linked like any other); documents with equal
fingerprints are linked; a row without doc_id gets the component of its fingerprint (null if nothing else has one).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

BITS, SHINGLE, SEED = 4, 4, 42
BLOCK = 2048


def pivots(n: int = 16, seed: int = 42) -> np.ndarray:
    """n reference fingerprints, drawn once from a fixed seed."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, chunk: int = 1 << 15) -> int:
    """The SimHash of a text: lower-cased A-Z, words, shingles with repeats, XXH64 with seed 42, majority per bit."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    n, digest, counts = len(starts), xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for i in range(0, n, chunk):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + chunk], ends[i : i + chunk])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
                yield pa.record_batch([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def sections(n: int, bits: int = BITS) -> list[int]:
    """Masks of the cell keys for about n distinct fingerprints: each choice of s - bits of s sections."""
    s = bits + 2
    while s < 64 and (1 << (64 * (s - bits) // s)) < n:
        s += 1
    edges = [round(64 * i / s) for i in range(s + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(one, s - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def coordinates(fps: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """The pivot table of fps: a row of Hamming distances to the pivots each."""
    table = pivots() if table is None else table
    return np.bitwise_count(fps[:, None] ^ table[None, :]).astype(np.uint8)


def _coordinates(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        d = coordinates(fp)
        rows = pa.Array.from_buffers(pa.binary(d.shape[1]), len(fp), [None, pa.py_buffer(d.tobytes())]).cast(pa.binary())
        yield pa.record_batch([*batch.columns, rows], names=[*batch.schema.names, "pivots"])


def links(left: np.ndarray, right: np.ndarray | None, bits: int = BITS, a: np.ndarray | None = None, b: np.ndarray | None = None, rows: int = 256):
    """Index pairs (i, j) within bits: within left (i < j), or from left to right. a, b: their pivot tables.

    Pairs are discarded by their greatest coordinate difference, coordinate after coordinate, then verified exactly.
    """
    same = right is None
    right = left if same else right
    a = coordinates(left) if a is None else a
    b = a if same else coordinates(right) if b is None else b
    a, b = a.astype(np.int8), b.astype(np.int8)
    for i in range(0, len(left), rows):
        keep = np.ones((min(rows, len(left) - i), len(right)), dtype=bool)
        for k in range(2):
            keep &= np.abs(a[i : i + rows, k, None] - b[None, :, k]) <= bits
        x, y = np.nonzero(keep)
        x += i
        if same:
            later = y > x
            x, y = x[later], y[later]
        for k in range(2, a.shape[1]):
            near = np.abs(a[x, k] - b[y, k]) <= bits
            if not near.all():
                x, y = x[near], y[near]
        near = np.bitwise_count(left[x] ^ right[y]) <= bits
        yield x[near], y[near]


def _forest(fps: np.ndarray, table: np.ndarray, side: np.ndarray, diagonal: bool, bits: int) -> np.ndarray:
    """A spanning forest (as rows of two fingerprints) of the links of a block or between two blocks."""
    parent = list(range(len(fps)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if diagonal:
        l = r = np.arange(len(fps))
        found = links(fps, None, bits, table)
    else:
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = links(fps[l], fps[r], bits, table[l], table[r])
    root = np.arange(len(fps))
    out = []
    for x, y in found:
        x, y = l[x], r[y]
        new = root[x] != root[y]  # what earlier rows have joined needs no second look
        for i, j in zip(x[new].tolist(), y[new].tolist()):
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
        if new.any():
            root = np.array([find(i) for i in range(len(fps))])
    return fps[np.array(out, dtype=np.int64).reshape(-1, 2)]


def _units(bits: int):
    """Sorted rows (table, key, i, j, side, fp, pivots) as batches: each run of equal (table, key, i, j) is a unit."""

    def run(batches):
        held: list = []

        def flush():
            if held:
                fp = np.concatenate([h[0] for h in held]).view(np.uint64)
                table = np.frombuffer(b"".join(x for h in held for x in h[1]), dtype=np.uint8).reshape(len(fp), -1)
                side = np.concatenate([h[2] for h in held])
                e = _forest(fp, table, side, held[0][3], bits).view(np.int64)
                held.clear()
                if len(e):
                    yield pa.record_batch([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"])

        last = None
        for batch in batches:
            t, key, i, j, side, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:6])
            if not len(t):
                continue
            tables = batch.column(6).to_pylist()
            edge = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for x, y in zip(np.r_[0, edge], np.r_[edge, len(t)]):
                now = (t[x], key[x], i[x], j[x])
                if now != last:
                    yield from flush()
                    last = now
                held.append((fp[x:y], tables[x:y], side[x:y], i[x] == j[x]))
        yield from flush()

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed 64-bit number. docs: doc_id, text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def near_links(nodes: DataFrame, n: int, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints that span the same components as all links. nodes: n rows of fp and
    pivots. Units are dealt over a set number of partitions, so that few bytes are not taken for little work."""
    masks = [_signed(m) for m in sections(n, bits)]
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    cells = nodes.select("fp", "pivots", F.explode(keys).alias("c")).select("c.t", "c.key", "fp", "pivots")
    full = cells.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    member = cells.join(full, ["t", "key"]).select("t", "key", "fp", "pivots", parts.alias("k"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("c"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")
    unit = member.select("t", "key", "fp", "pivots", "c", other).select("t", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).cast("int").alias("side"), "fp", "pivots")
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = unit.repartition(tasks, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return dealt.mapInArrow(_units(bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, fp, component_id (the smallest doc_id that links reach, its own included)."""
    prints = common.cut(fingerprints(docs, shingle))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = common.cut(distinct.mapInArrow(_coordinates, "fp long, least long, copies long, pivots binary"))
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    found = components.roots(near_links(nodes, size["n"], bits))
    rooted = common.cut(nodes.join(found, nodes.fp == found.node, "left").select(F.col("fp").alias("print"), "least", "copies", F.coalesce("root", "fp").alias("root")))
    common.drop(found, nodes)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_size"))
    of_print = common.cut(common.join_dealt(rooted.drop("least"), named, "root", "_size", size["n"]).select(F.col("print").alias("fp"), "component_id", "copies"))
    common.drop(rooted)
    return common.join_dealt(prints, of_print, "fp", "copies", size["rows"]).select("doc_id", "fp", "component_id")


def op3_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_dedup": op3_simhash_dedup}
ORACLES: dict[str, str] = {}
