"""Exact top-k by inner product: ball-tree branch and bound in shards.

Vectors that lie together share a shard: a tree of half-spaces, fitted to at most
FIT_ROWS vectors (those of the smallest hashed ids), sends each to a cell, and a cell of
more than SHARD vectors is spread by id over several shards, so that copies of one
vector, however many, don't meet in one. Each shard's task builds a ball tree and writes
its arrays to the shared folder. Every vector is a query. A task takes blocks of queries
that lie together in one shard's tree and visits the shards by the upper bound of their
roots, its own first, but for those whose bound reaches no query's k-th score: from the
root, nodes are taken from a heap by their upper bound q.c + |q| r, a node's children
only with those of the block's queries whose bound still reaches their k-th score; that
score goes on to the next node and the next shard. The fit changes the work, not the result.

Scores are worked out in doubles and rounded to 6 digits; ties go to the smaller id.
Defined results: rows whose id or vector is null, whose vector is empty or holds a null,
NaN or infinite number, or has another number of dimensions than the first valid row by
id, are neither queries nor answers; a vector isn't its own answer; rows that repeat an id
are one vector (the least); equal vectors of different ids are answers of each other;
with fewer than k others, all of them are answers; an empty table gives no rows; only
vec_id and embedding are read, whatever other columns there are.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, map_array, put_array, sized

SHARD, LEAF, BLOCK = 8192, 128, 512
#: Most vectors to which cells are fitted.
FIT_ROWS = 50_000


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, ...]:
    """(order, centres, radii, from, to, left child or -1); the right child follows the left's number by one."""
    order = np.arange(len(x))
    nodes: list[list] = []
    nodes.append([0, len(x), -1])
    i = 0
    while i < len(nodes):
        lo, hi, _ = nodes[i]
        if hi - lo > leaf:
            p = x[order[lo:hi]]
            a = p[((p - p.mean(0)) ** 2).sum(1).argmax()]
            b = p[((p - a) ** 2).sum(1).argmax()]
            half = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argsort(p @ (b - a), kind="stable")]
            nodes[i][2] = len(nodes)
            nodes += [[lo, lo + half, -1], [lo + half, hi, -1]]
        i += 1
    centre = np.array([x[order[lo:hi]].mean(0) for lo, hi, _ in nodes])
    radius = np.array([np.sqrt(((x[order[lo:hi]] - c) ** 2).sum(1).max()) for (lo, hi, _), c in zip(nodes, centre, strict=True)])
    n = np.array(nodes)
    return order, centre, radius * (1 + 1e-9) + 1e-12, n[:, 0], n[:, 1], n[:, 2]


class Cells:
    """A tree of half-spaces; each of its leaves is a cell."""

    def __init__(self, direction: np.ndarray, cut: np.ndarray, child: np.ndarray):
        self.direction, self.cut, self.child = direction, cut, child

    @classmethod
    def fit(cls, x: np.ndarray, cells: int) -> Cells:
        direction, cut, child = [], [], []
        todo, leaves = [(np.arange(len(x)), -1, 0)], 1
        while todo and leaves < cells:
            at, parent, side = todo.pop(0)
            p = x[at]
            a = p[((p - p.mean(0)) ** 2).sum(1).argmax()]
            b = p[((p - a) ** 2).sum(1).argmax()]
            y = p @ (b - a)
            t = float(np.median(y))
            low = y <= t
            if low.all():
                continue  # copies of one vector, or nearly so
            if parent >= 0:
                child[parent][side] = len(cut)
            todo += [(at[low], len(cut), 0), (at[~low], len(cut), 1)]
            direction.append(b - a)
            cut.append(t)
            child.append([-1, -1])
            leaves += 1
        return cls(np.array(direction).reshape(-1, x.shape[1]), np.array(cut), np.array(child, np.int64).reshape(-1, 2))

    def of(self, x: np.ndarray) -> np.ndarray:
        """A number for each vector's cell."""
        node, cell = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        live = np.arange(len(x)) if len(self.cut) else node[:0]
        while len(live):
            i = node[live]
            side = ((x[live] * self.direction[i]).sum(1) > self.cut[i]).astype(np.int64)
            cell[live] = 2 * i + side + 1
            node[live] = self.child[i, side]
            live = live[node[live] >= 0]
        return cell


class Shard:
    def __init__(self, where: str, k: int):
        get = lambda name: map_array(f"{where}/{k}-{name}.npy")
        self.ids, self.x, self.centre, self.radius, self.lo, self.hi, self.left = map(get, ("ids", "x", "centre", "radius", "lo", "hi", "left"))

    @staticmethod
    def write(where: str, k: int, ids: np.ndarray, x: np.ndarray) -> None:
        order, centre, radius, lo, hi, left = ball_tree(x)
        for name, a in (("ids", ids[order]), ("x", x[order]), ("centre", centre), ("radius", radius), ("lo", lo), ("hi", hi), ("left", left)):
            put_array(f"{where}/{k}-{name}.npy", a)


class Best:
    """The k best answers so far of each query of a block."""

    def __init__(self, n: int, k: int):
        self.score, self.ids, self.k = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), k

    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score >= self.score[rows, -1][:, None]) & (score > -np.inf)
        some = np.flatnonzero(better.any(1))
        if len(some) == 0:
            return
        most = int(better[some].sum(1).max())
        s = np.where(better[some], score[some], -np.inf)
        if most < s.shape[1] // 2:  # only each row's candidates are sorted
            top = np.argpartition(-s, most - 1, 1)[:, :most]
            s, i = np.take_along_axis(s, top, 1), ids[top]
        else:
            i = np.broadcast_to(ids, s.shape)
        r = rows[some]
        s, i = np.concatenate((self.score[r], s), 1), np.concatenate((self.ids[r], i), 1)
        i = np.where(s == -np.inf, np.iinfo(np.int64).max, i)
        at = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[r], self.ids[r] = np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)


def search(q: np.ndarray, ids: np.ndarray, shard: Shard, best: Best, some: np.ndarray | None = None) -> None:
    """Branch and bound of a block of queries (of the rows ``some``) in one shard."""
    norm = np.sqrt((q * q).sum(1))

    def bound(node: int, rows: np.ndarray) -> tuple[np.ndarray, float]:
        b = q[rows] @ shard.centre[node] + norm[rows] * shard.radius[node]
        b += 1e-9 * np.abs(b) + 1e-6  # rounding never hides a tie
        live = b >= best.kth()[rows]
        return rows[live], float(b[live].max()) if live.any() else -np.inf

    rows, b = bound(0, np.arange(len(q)) if some is None else some)
    heap = [(-b, 0, rows)] if len(rows) else []
    while heap:
        _, node, rows = heapq.heappop(heap)
        rows, _ = bound(node, rows)
        if len(rows) == 0:
            continue
        if shard.left[node] < 0:
            lo, hi = shard.lo[node], shard.hi[node]
            there = shard.ids[lo:hi]
            s = np.round(q[rows] @ shard.x[lo:hi].T, 6)
            s[ids[rows][:, None] == there] = -np.inf
            best.add(rows, s, there)
            continue
        for child in (int(shard.left[node]), int(shard.left[node]) + 1):
            mine, b = bound(child, rows)
            if len(mine):
                heapq.heappush(heap, (-b, child, mine))


def top_k(spark: SparkSession, vectors: DataFrame, k: int = 10, shard_size: int = SHARD) -> DataFrame:
    """(vec_id, rank, neighbour_id, score) of every vector's k best others."""
    s = Scratch(spark, "topk")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = v.where("vec_id IS NOT NULL AND x IS NOT NULL AND size(x) > 0").where(~bad)
    v = s.table(v.groupBy("vec_id").agg(F.min("x").alias("x")), "vectors")
    n, size = v.agg(F.count("*"), F.min_by(F.size("x"), "vec_id")).first()
    if not n:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, score double")
    where = s.uri
    v = v.where(F.size("x") == size)
    fit = np.array([r[0] for r in v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("x").collect()])  # FIT_ROWS at most
    cells = Cells.fit(fit, -(-n // shard_size))
    for name in ("direction", "cut", "child"):
        put_array(f"{where}/cells-{name}.npy", getattr(cells, name))

    def assign(batches):
        tree = Cells(*(map_array(f"{where}/cells-{name}.npy") for name in ("direction", "cut", "child")))
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.of(x))], ["vec_id", "x", "cell"])

    celled = s.table(v.mapInArrow(assign, "vec_id long, x array<double>, cell long"), "cells")
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect()  # a row for each shard_size vectors or so
    first, many = {}, 0
    for cell, rows in sizes:
        first[cell] = (many, -(-rows // shard_size))
        many += first[cell][1]
    plan = spark.createDataFrame([(c, a, m) for c, (a, m) in first.items()], "cell long, a long, m long")

    def build(key, table):
        no = key[0].as_py()
        ids = table.column("vec_id").to_numpy()
        x = np.array(table.column("x").combine_chunks().flatten().to_numpy()).reshape(len(ids), -1)
        order = np.argsort(ids)
        Shard.write(where, no, ids[order], x[order])
        centre = x.mean(0)
        return pa.table([pa.array([no], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([float(np.sqrt(((x - centre) ** 2).sum(1).max()) * (1 + 1e-9) + 1e-12)])], ["shard", "n", "centre", "radius"])

    keyed = celled.join(sized(plan, len(sizes)), "cell").withColumn("shard", F.col("a") + F.pmod(F.xxhash64("vec_id"), F.col("m"))).select("vec_id", "x", "shard")
    built = s.table(keyed.groupBy("shard").applyInArrow(build, "shard long, n long, centre array<double>, radius double"), "shards")
    blocks = built.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))).alias("lo"))
    roots = built.select("shard", "centre", "radius").orderBy("shard").collect()  # a row for each shard
    for name, a in (("number", np.array([r[0] for r in roots])), ("centre", np.array([r[1] for r in roots])), ("radius", np.array([r[2] for r in roots]))):
        put_array(f"{where}/roots-{name}.npy", a)

    def run(batches):
        numbers, centre, radius = (map_array(f"{where}/roots-{name}.npy") for name in ("number", "centre", "radius"))
        trees: dict[int, Shard] = {}

        def tree(i: int) -> Shard:
            if i not in trees:
                if len(trees) >= 4096:
                    trees.clear()
                trees[i] = Shard(where, i)
            return trees[i]

        for batch in batches:
            for no, lo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q, ids = np.asarray(tree(no).x[lo : lo + BLOCK]), np.asarray(tree(no).ids[lo : lo + BLOCK])
                best = Best(len(q), k)
                search(q, ids, tree(no), best)
                bound = q @ centre.T + np.sqrt((q * q).sum(1))[:, None] * radius
                bound += 1e-9 * np.abs(bound) + 1e-6  # rounding never hides a tie
                for i in np.argsort(-bound.max(0), kind="stable").tolist():
                    if numbers[i] != no and (rows := np.flatnonzero(bound[:, i] >= best.kth())).size:
                        search(q, ids, tree(int(numbers[i])), best, rows)
                real = best.score > -np.inf
                r, c = np.nonzero(real)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array((c + 1).astype(np.int32)), pa.array(best.ids[r, c]), pa.array(best.score[r, c])], ["vec_id", "rank", "neighbour_id", "score"])

    tasks = spark.sparkContext.defaultParallelism * 4
    return blocks.repartition(tasks, "shard", "lo").mapInArrow(run, "vec_id long, rank int, neighbour_id long, score double")


ORACLE = """
WITH p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id) AS INTEGER) AS rank FROM p)
SELECT vec_id, rank, neighbour_id, score FROM r WHERE rank <= 10
"""
