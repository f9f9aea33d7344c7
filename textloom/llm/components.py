"""Connected components by union-find: first inside each partition, then by alternating stars.

Each round is written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges with the smallest node of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = list(range(len(nodes)))
    x, y = at[: len(a)].tolist(), at[len(a) :].tolist()
    for i, j in zip(x, y, strict=True):
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        if i < j:
            root[j] = i
        else:
            root[i] = j
    for i, r in enumerate(root):  # parents are smaller, so they are final
        root[i] = root[r]
    return nodes, nodes[root] if len(nodes) else nodes


def _local(batches):
    edges = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if edges:
        v, r = union(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
        keep = v != r
        yield pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(r[keep])], ["a", "b"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node that isn't its own root. ``edges``: long columns a, b."""
    shape = "a long, b long"
    now = scratch.table(edges.mapInArrow(_local, shape), "forest")
    seen, k = None, 0
    while True:
        # large star: each node's larger neighbours move to its smallest one
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))
        big = both.select("a", "b", least.alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its smaller neighbours move to the smallest of them
        low = big.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
        small = low.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        k += 1
        now = scratch.table(small, f"round{k}")
        got = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if got == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = got
