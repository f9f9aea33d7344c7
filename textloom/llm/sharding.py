"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

A group's documents stay together. A group of b bytes starts as the partial
partition (b, 0, ..., 0) of k sums; the two of largest spread (largest less smallest
sum) are combined, the one's largest sums with the other's smallest, until one is
left, whose k sums are the shards.

The groups are spread by hash over blocks that one task differences each; a block's
result is a partial partition again, and blocks are combined by the same rule, FAN
at a time, level by level. With more than MOST shards, groups are first split into
parts and each part again; where the shards don't divide evenly, some parts have one
less: they start with a shard's bytes that no group fills. Exactly ``shards`` numbers
from 0 on are used (fewer, if there are fewer groups).

Defined results: null and empty texts count 0 bytes; very long ones count whole, and
their group may outweigh a shard; the group of a null key is a group; null ids keep
their rows; repeated rows count each and stay together if their keys agree; ties go by
group; an empty table gives no rows; only doc_id, text and the group's columns are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

SHARD_BYTES = 64 << 20
BLOCK_GROUPS, FAN, MOST = 20_000, 64, 256


def difference(partial: list[list[int]], k: int) -> tuple[list[list[int]], list[int]]:
    """For each partial partition (at most k sums), the final shard of each of its sums; and the shards' sums."""
    n = len(partial)
    leaf_order, sums, heap = [], [], []
    for i, p in enumerate(partial):
        order = sorted(range(len(p)), key=lambda j: (-p[j], j))
        leaf_order.append(order)
        s = [p[j] for j in order] + [0] * (k - len(p))
        sums.append(s)
        heap.append((s[-1] - s[0], i))
    heapq.heapify(heap)
    joins: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums[a], sums[b]
        if k > 1 and not y[1]:  # a single group joins the smallest sum
            s, order = x[:], list(range(k))
            v = s.pop() + y[0]
            at = _place(s, v)
            s.insert(at, v)
            order.insert(at, order.pop())
        else:
            both = [p + q for p, q in zip(x, reversed(y), strict=True)]
            order = sorted(range(k), key=both.__getitem__, reverse=True)
            s = [both[j] for j in order]
        sums[a] = sums[b] = None
        joins.append((a, b, order))
        sums.append(s)
        heapq.heappush(heap, (s[-1] - s[0], n + len(joins) - 1))
    labels: list[list[int] | None] = [None] * (n + len(joins))
    if n:
        labels[-1] = list(range(k))
    for i in range(len(joins) - 1, -1, -1):
        a, b, order = joins[i]
        mine, labels[n + i] = labels[n + i], None
        la, lb = [0] * k, [0] * k
        for slot, j in enumerate(order):
            la[j] = mine[slot]
            lb[k - 1 - j] = mine[slot]
        labels[a], labels[b] = la, lb
    out = []
    for p, order, label in zip(partial, leaf_order, labels, strict=False):
        got = [0] * len(p)
        for slot, j in enumerate(order):
            got[j] = label[slot]
        out.append(got)
    return out, sums[-1] if n else [0] * k


def _place(s: list[int], v: int) -> int:
    lo, hi = 0, len(s)
    while lo < hi:
        mid = (lo + hi) // 2
        if s[mid] >= v:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _local(k: int, less: int = 0, weight: int = 0):
    def run(table):
        t = table.sort_by([("bytes", "descending"), ("gid", "ascending")])
        part, block, gid, size = (t.column(c).to_pylist() for c in ("part", "block", "gid", "bytes"))
        partial = [[b] for b in size]
        if less and block[0] == 0:
            partial.append([weight] * less)
        got, _ = difference(partial, k)
        label = [g[0] for g in got[: len(gid)]]
        if len(got) > len(gid):  # what stands for the missing shards
            part, block, gid, size, label = part + part[:1] * less, block + [0] * less, gid + [None] * less, size + [weight] * less, label + got[-1]
        return pa.table([pa.array(part, pa.int64()), pa.array(block, pa.int64()), pa.array(gid, pa.int64()), pa.array(size, pa.int64()), pa.array(label, pa.int32())], ["part", "block", "gid", "bytes", "label"])

    return run


def _join(k: int):
    def run(table):
        t = table.sort_by([("block", "ascending"), ("label", "ascending")])
        block, label, size = (t.column(c).to_numpy() for c in ("block", "label", "bytes"))
        e = np.concatenate((np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))), [len(block)]))
        got, _ = difference([size[i:j].tolist() for i, j in zip(e[:-1], e[1:], strict=True)], k)
        return pa.table([t.column("part"), t.column("block"), t.column("label"), t.column("up"), t.column("bytes"), pa.array([x for g in got for x in g], pa.int32())], ["part", "block", "label", "up", "bytes", "new"])

    return run


def _split(groups: DataFrame, k: int, blocks: int, s: Scratch, name: str, less: int = 0, weight: int = 0) -> DataFrame:
    """(part, gid, label): each part's groups in k shards. ``less`` of these get ``weight`` bytes less than the others: rows of a null gid name them."""
    keyed = groups.withColumn("block", F.pmod(F.xxhash64("gid"), F.lit(blocks)))
    if less:  # block 0 is there, if only as the least group's
        first = keyed.agg(F.min("block")).first()[0]
        keyed = keyed.withColumn("block", F.when(F.col("block") == first, 0).otherwise(F.col("block")).cast("long")) if first else keyed
    local = s.table(keyed.groupBy("part", "block").applyInArrow(_local(k, less, weight), "part long, block long, gid long, bytes long, label int"), f"{name}-local")
    now = local.groupBy("part", "block", "label").agg(F.sum("bytes").alias("bytes"))
    at = local.select("part", "gid", "block", "label")
    level = 0
    while blocks > 1:
        up = now.withColumn("up", F.floor(F.col("block") / FAN).cast("long"))
        step = s.table(up.groupBy("part", "up").applyInArrow(_join(k), "part long, block long, label int, up long, bytes long, new int"), f"{name}-{level}")
        at = at.join(step.select("part", "block", "label", "up", "new"), ["part", "block", "label"]).select("part", "gid", F.col("up").alias("block"), F.col("new").alias("label"))
        now = step.groupBy("part", "up", "new").agg(F.sum("bytes").alias("bytes")).select("part", F.col("up").alias("block"), F.col("new").alias("label"), "bytes")
        blocks, level = -(-blocks // FAN), level + 1
    return at.select("part", "gid", "label")


def shard(spark: SparkSession, docs: DataFrame, group: Column, shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, group_id, shard_id, bytes) of each row. ``group``: a long; ``shards``: as many as hold ``shard_bytes`` each, 8 at least."""
    s = Scratch(spark, "sharding")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(group.cast("long"), F.lit(0)).alias("gid"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    rows = s.table(rows, "rows")
    groups = s.table(rows.groupBy("gid").agg(F.sum("bytes").alias("bytes")).select(F.lit(0).cast("long").alias("part"), "gid", "bytes"), "groups")
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    k = shards or max(8, -(-total // shard_bytes))
    blocks = lambda n: max(1, -(-n // BLOCK_GROUPS))
    if k <= MOST:
        at = _split(groups, k, blocks(count), s, "all").select("gid", F.col("label").cast("long").alias("shard_id"))
    else:
        coarse = -(-k // MOST)
        fine = -(-k // coarse)
        less = coarse * fine - k  # so many parts have one shard less, and so many fewer bytes
        first = s.table(_split(groups, coarse, blocks(count), s, "coarse", less, total // k).select("gid", F.col("label").cast("long").alias("part")), "of")
        lighter = {r[0] for r in first.where("gid IS NULL").select("part").collect()}  # coarse rows at most
        offset = np.concatenate(([0], np.cumsum([fine - (p in lighter) for p in range(coarse)]))).tolist()
        again = s.table(groups.drop("part").join(first.where("gid IS NOT NULL"), "gid").select("part", "gid", "bytes"), "parts")
        at = None
        for name, few in (("fine", False), ("fewer", True)):
            mine = [p for p in range(coarse) if (p in lighter) == few]
            if mine:
                got = _split(again.where(F.col("part").isin(mine)), fine - few, blocks(count // coarse), s, name)
                got = got.select("gid", (F.get(F.lit(offset), F.col("part").cast("int")) + F.col("label")).cast("long").alias("shard_id"))
                at = got if at is None else at.unionByName(got)
    return rows.join(at, "gid").select("doc_id", F.col("gid").alias("group_id"), "shard_id", "bytes")


def copies(text: str = "text") -> Column:
    """Group of a document: all of its exact copies."""
    return F.xxhash64(F.col(text))
