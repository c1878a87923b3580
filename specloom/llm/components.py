"""Connected components over an edge table, by alternating large and small stars.

Every round is two aggregates (min per node, combined on the map side) and two equi-joins; no neighbour list is ever
collected and nothing but two counters reaches the driver. Nodes with many neighbours are dealt over several tasks.
Rounds grow with the logarithm of the longest chain. A round is about sixteen jobs, whose plans and tasks the driver keeps
account of whatever the number of links; so up to BLOCK links, a bounded table, are joined by union-find in one task.
Both ways give the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: So many links at most are joined in one task.
BLOCK = 1 << 18


def _star(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """edges: n rows (u, v) with u > v. Link each node's (large: greater) neighbours to its least neighbour."""
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("_size")).select("u", F.least("u", "m").alias("m"), "_size").where("_size > 0")
        pairs = common.join_dealt(around.where("v > u"), least, "u", "_size", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_size"))
        pairs = common.join_dealt(edges, least, "u", "_size", n).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return pairs.where("u > v").distinct()


def _united(batches):
    """(node, root) of all links (u, v) of a task."""
    held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]] for batch in batches]
    u, v = (np.concatenate([np.empty(0, np.int64), *(h[k] for h in held)]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        i, j = find(i), find(j)
        parent[max(i, j)] = min(i, j)  # nodes are in order, so the least of a component stays its root
    root = np.array([find(i) for i in range(len(nodes))], dtype=np.int64)
    below = root != np.arange(len(nodes))
    yield pa.record_batch([pa.array(nodes[below]), pa.array(nodes[root[below]])], names=["node", "root"])


def roots(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root) for every node of an edge that is not the least of its component. edges: (a, b) long, any direction."""
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    now = common.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    mark = count(now)
    if mark["n"] <= block:
        out = now.coalesce(1).mapInArrow(_united, "node long, root long")
        out._specloom_path = now._specloom_path
        return out
    while True:
        half = common.cut(_star(now, mark["n"], True))
        after = common.cut(_star(half, half.count(), False))
        common.drop(now, half)
        now, before = after, mark
        mark = count(now)
        if mark == before:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._specloom_path = now._specloom_path
    return out
