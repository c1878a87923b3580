"""Approximate nearest neighbours by multiprobe p-stable hashing.

A hash of a table is floor((a.v + b) / w) with Gaussian a; ``hashes`` of them name a bucket. Greatest inner product is
turned into least Euclidean distance first: data vectors get one more component that lifts them to the common norm,
queries are scaled to it. A query visits, besides its own bucket, the perturbed buckets in order of estimated success
(least sum of squared distances to the borders crossed). All rows are indexed; what the buckets of all tables hold is
merged and ranked by the exact inner product of the original vectors in double precision.

A unit of work is a bucket's block of data rows against a block of the queries that visit it; buckets above ``block``
rows or queries are dealt over several units, so no task holds an unbounded bucket. A unit returns at most k rows per
query. A query that finds fewer than k is searched again against all rows, in blocks.

Vectors of different lengths have no inner product: each length has a hash family, buckets and a common norm of its own,
and a query meets vectors of its length only.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; rows without vec_id
neither; rows of one vec_id count once (with their best score) and are not their own
neighbours; ties go to the smaller vec_id.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: For unit vectors without clusters, where near neighbours are hardly nearer than others; see README for the recall.
TABLES, HASHES, WIDTH, PROBES, BLOCK, SEED = 8, 4, 1.2, 28, 2048, 42


def _family(dim: int, norm: float, tables: int, hashes: int, width: float, seed: int):
    """(directions, offsets, width, norm) of the vectors of one length."""
    r = np.random.default_rng(seed)
    return r.standard_normal((tables, dim + 1, hashes)), r.random((tables, hashes)) * width * norm, width * norm, norm


def _by_length(batches, dtype: str, most: int):
    """(length, ids, packed vectors, matrix) of the vectors of one length in at most so many rows at a time."""
    item = np.dtype(dtype).itemsize
    for batch in (part.slice(i, most) for part in batches for i in range(0, part.num_rows, most)):
        packed = batch.column(1).to_pylist()
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // item
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            yield n, batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), np.frombuffer(b"".join(packed[i] for i in at), dtype=dtype).reshape(len(at), n).astype(np.float64)


def _key(h: np.ndarray) -> np.ndarray:
    """Bucket numbers of hash rows: one 64-bit number for the small integers along the last axis."""
    out = np.zeros(h.shape[:-1], dtype=np.int64)
    with np.errstate(over="ignore"):
        for k in range(h.shape[-1]):
            out = out * np.int64(1_000_003) + h[..., k]
    return out


def _index(families: dict, dtype: str):
    def run(batches):
        for n, ids, vectors, x in _by_length(batches, dtype, 8192):
            a, b, w, norm = families[n]
            x = np.concatenate([x, np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(1)))[:, None]], axis=1)
            for t in range(len(a)):
                key = _key(np.floor((x @ a[t] + b[t]) / w).astype(np.int64))
                yield pa.record_batch([pa.array(np.full(len(x), n * len(a) + t)), pa.array(key), ids, vectors], names=["t", "key", "vec_id", "vec"])

    return run


def _probe(families: dict, dtype: str, probes: int):
    def run(batches):
        for n, ids, vectors, x in _by_length(batches, dtype, 1024):
            a, b, w, norm = families[n]
            steps = np.array(list(product((0, -1, 1), repeat=a.shape[2])))
            x = x * (norm / np.sqrt((x * x).sum(1)))[:, None]
            for t in range(len(a)):
                at = (x @ a[t][:-1] + b[t]) / w
                own = np.floor(at)
                f = at - own
                cost = (f * f) @ (steps == -1).T + ((1 - f) ** 2) @ (steps == 1).T
                best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
                key = _key((own[:, None, :] + steps[best]).astype(np.int64)).ravel()
                row = pa.array(np.repeat(np.arange(len(x)), best.shape[1]))
                yield pa.record_batch([pa.array(np.full(len(row), n * len(a) + t)), pa.array(key), ids.take(row), vectors.take(row)], names=["t", "key", "vec_id", "vec"])

    return run


def nearest(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int):
    """(query index, data index, score) of each query's k best rows here, ties to the smaller id."""
    rough = queries @ data.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    n = min(k, len(ids))
    edge = np.partition(rough, len(ids) - n, axis=1)[:, len(ids) - n]
    slack = 1e-9 * (1.0 + np.abs(np.where(np.isfinite(edge), edge, 0.0)))
    q, d = np.nonzero((rough >= (edge - slack)[:, None]) & np.isfinite(rough))
    score = (queries[q] * data[d]).sum(1)  # the same for equal vectors wherever they stand
    order = np.lexsort((ids[d], -score, q))
    q, d, score = q[order], d[order], score[order]
    first = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - first < k
    return q[keep], d[keep], score[keep]


def _units(k: int, dtype: str):
    """Sorted rows (t, key, c, s, side, vec_id, vec): each unit's data rows come first, its queries follow."""

    def run(batches):
        now, ids, data, queries = None, [], [], []

        def flush():
            if not queries or not ids:
                queries.clear()
                return
            x = np.stack([np.frombuffer(v, dtype=dtype) for v in data]).astype(np.float64)
            for i in range(0, len(queries), 512):
                part = queries[i : i + 512]
                y = np.stack([np.frombuffer(v, dtype=dtype) for _, v in part]).astype(np.float64)
                qi = np.array([q for q, _ in part], dtype=np.int64)
                own = np.array(ids, dtype=np.int64)
                q, d, score = nearest(y, qi, x, own, k)
                yield pa.record_batch([pa.array(qi[q]), pa.array(own[d]), pa.array(score)], names=["query_id", "vec_id", "score"])
            queries.clear()

        for batch in batches:
            c = [batch.column(i).to_pylist() for i in range(7)]
            for t, key, a, b, side, vec_id, vec in zip(*c):
                if (t, key, a, b) != now:
                    yield from flush()
                    now, ids, data = (t, key, a, b), [], []
                if side == 0:
                    ids.append(vec_id)
                    data.append(vec)
                else:
                    queries.append((vec_id, vec))
                    if len(queries) >= 4096:
                        yield from flush()
        yield from flush()

    return run


def _search(data: DataFrame, queries: DataFrame, k: int, block: int, dtype: str) -> DataFrame:
    """data, queries: (t, key, vec_id, vec). (query_id, vec_id, score): each unit's best."""
    parts = lambda df, name: df.groupBy("t", "key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name)).where(F.col(name) > 1)
    full, busy = parts(data.select("t", "key"), "kd"), parts(queries.select("t", "key"), "kq")
    sides = []
    for df, own, other in ((data, "kd", "kq"), (queries, "kq", "kd")):
        df = df.join(full, ["t", "key"], "left").join(busy, ["t", "key"], "left").fillna(1, ["kd", "kq"])
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int")
        df = df.select("t", "key", "vec_id", "vec", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs"))
        c, s = ("mine", "theirs") if own == "kd" else ("theirs", "mine")
        sides.append(df.select("t", "key", F.col(c).alias("c"), F.col(s).alias("s"), F.lit(0 if own == "kd" else 1).alias("side"), "vec_id", "vec"))
    rows = sides[0].union(sides[1]).repartition("t", "key", "c", "s").sortWithinPartitions("t", "key", "c", "s", "side")
    return rows.mapInArrow(_units(k, dtype), "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _clean(vectors: DataFrame, vec: str) -> DataFrame:
    kind = vectors.schema[vec].dataType
    small = isinstance(kind.elementType, T.FloatType)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(vec).isNotNull() & finite & F.exists(vec, lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast("array<float>" if small else "array<double>").alias("vec")), "<f4" if small else "<f8"


def _pack(dtype: str):
    def run(batches):
        for batch in batches:
            v = [np.asarray(x, dtype=dtype).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(v, pa.binary())], names=["vec_id", "vec"])

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20, vec: str = "embedding", tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by every."""
    rows, dtype = _clean(vectors, vec)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    lengths = rows.groupBy(F.size("vec").alias("dim")).agg(F.max(norm).alias("norm")).collect()  # one row per length
    families = {r["dim"]: _family(r["dim"], r["norm"], tables, hashes, width, seed) for r in lengths}
    rows = common.cut(rows.mapInArrow(_pack(dtype), "vec_id long, vec binary"))
    kind = "t long, key long, vec_id long, vec binary"
    asked = rows.where(F.col("vec_id") % every == 0)
    found = common.cut(_best(_search(rows.mapInArrow(_index(families, dtype), kind), asked.mapInArrow(_probe(families, dtype, probes), kind), k, block, dtype), k))
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
    short = common.cut(asked.join(enough, asked.vec_id == enough.query_id, "left_anti"))
    if short.isEmpty():
        return found
    everywhere = lambda df: df.select((-F.length("vec")).cast("long").alias("t"), F.lit(0).cast("long").alias("key"), "vec_id", "vec")
    rest = _best(_search(everywhere(rows), everywhere(short), k, block, dtype), k)
    return found.join(enough, "query_id", "left_semi").select("query_id", "rank", "vec_id", "score").union(rest)


def op7_ann(spark, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_ann": op7_ann}
ORACLES: dict[str, str] = {}
