"""MinHash near-duplicates: SuperMinHash signatures, banding, verification, union-find.

Each document's distinct runs of three words are its elements. SuperMinHash draws
for every element a permutation of the slots, step by step, with the step's number
as the high part of the rank; an element stops as soon as no later step can lower a
slot of its document. The ranks of one element are correlated, so the estimate of
the Jaccard index varies less than MinHash's.

Documents with equal signatures collapse first. The rest meet in bands of rows; in
each bucket a search from one member to the next compares whole signatures, so that
all members that a chain of verified pairs joins are found, without a cap and
without listing every pair. Buckets with the same members are searched once; those of
more than BUCKET members are compared in pieces, each two blocks of members in one.

Verification compares 16 bits of each slot: unequal slots agree once in 65,536, which
adds 0.002 slots of 128 to a pair's count.

Defined results: a document is what bears one ``doc_id``; repeated rows of it count
as one, with the least of their texts. Rows with a null id, and texts that are null or
hold no word, belong to no group. Texts of one or two words have one element; very long
ones count whole. The smallest id of a group is kept (ids are distinct, so there are no
ties); an empty table has no groups; other columns of whatever names stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, bounds, fresh, one_row, runs, sized
from .textops import grams, mix, pieces, words

SLOTS, ROWS, SHINGLE = 128, 4, 3
#: Least share of equal slots of two documents of a pair.
LEAST = 0.5
#: Most members of a bucket that one task compares.
BUCKET = 16_384
_G = np.uint64(0x9E3779B97F4A7C15)


def superminhash(h: np.ndarray, doc: np.ndarray, n: int, m: int = SLOTS) -> np.ndarray:
    """Signatures (n, m) of the documents whose elements ``h`` are; ``doc``: each element's document. m <= 128."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * m, none, np.uint64)
    live, h, drawn = doc, h, []
    for j in range(m):
        if len(h) == 0:
            break
        x = mix(h + np.uint64((int(_G) * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        k = (((mix(x ^ _G) >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.uint8) + np.uint8(j)
        slot = k.copy()  # p[k]: follow the swaps of the earlier steps back
        for i in range(j - 1, -1, -1):
            slot[slot == drawn[i]] = i
        np.minimum.at(sig, live * m + slot, (np.uint64(j) << np.uint64(57)) | (x >> np.uint64(7)))
        worst = (sig.reshape(n, m).max(1) >> np.uint64(57)) > j
        go = worst[live]
        drawn = [d[go] for d in drawn] + [k[go]]
        h, live = h[go], live[go]
    return sig.reshape(n, m)


def elements(texts: list[str | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words, and each one's document; a shorter text is one run."""
    w = words(texts)
    g, at = grams(w, k)
    doc = w.doc()
    d = doc[at]
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        extra = np.array([int(mix(np.array([int.from_bytes(w.hash[w.first[i] : w.first[i + 1]].tobytes(), "little") % 0xFFFFFFFFFFFFFFC5], np.uint64))[0]) for i in short], np.uint64)
        g, d = np.concatenate((g, extra)), np.concatenate((d, short))
    return g, d


def _sketch(batches):
    for batch in batches:
        for part, texts in pieces(batch, "text"):
            g, d = elements(texts)
            have, d = np.unique(d, return_inverse=True)
            if len(have) == 0:
                continue
            sig = superminhash(g, d, len(have))
            bands = np.zeros((len(have), SLOTS // ROWS), np.uint64)
            for r in range(ROWS):
                bands = mix(bands * _G + sig[:, r::ROWS])
            bands = mix(bands + np.arange(1, SLOTS // ROWS + 1, dtype=np.uint64) * _G)
            whole = mix(bands.sum(1, dtype=np.uint64))
            low = (mix(sig) & np.uint64(0xFFFF)).astype(np.uint16)
            off = np.arange(len(have) + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(have)), pa.array(whole.view(np.int64)), pa.Array.from_buffers(pa.binary(), len(have), [None, pa.py_buffer(off * (2 * SLOTS)), pa.py_buffer(low.tobytes())]), pa.ListArray.from_arrays(pa.array(off * (SLOTS // ROWS)), pa.array(bands.ravel().view(np.int64)))],
                ["doc_id", "whole", "sig", "bands"],
            )


def joined(sig: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges that join all rows which chains of pairs with enough equal slots join: search from row to row."""
    need = least * sig.shape[1]
    left, edges = np.arange(len(sig)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            same = (sig[left] == sig[at]).sum(1) >= need
            if same.any():
                new = left[same]
                edges += [(int(at), int(x)) for x in new]
                queue += new.tolist()
                left = left[~same]
    return edges


def _verify(least: float):
    def run(batches):
        for t in runs(batches, "key"):
            key, ids = t.column("key").to_numpy(), t.column("doc_id").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(ids), SLOTS)
            e, a, b = bounds(key), [], []
            for lo, hi in zip(e[:-1], e[1:], strict=True):
                if hi - lo == 2:
                    if (sig[lo] == sig[lo + 1]).sum() >= least * SLOTS:
                        a.append(ids[lo])
                        b.append(ids[lo + 1])
                    continue
                for x, y in joined(sig[lo:hi], least):
                    a.append(ids[lo + x])
                    b.append(ids[lo + y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def split(members: DataFrame, most: int | None = None) -> DataFrame:
    """(key, doc_id) of the members (key, doc_id, n) of buckets; a bucket of more than ``most`` in pieces.

    Such a bucket's members are spread over blocks, and each two blocks meet in a piece of their own:
    every pair still meets, no task holds more than about 2 * ``most`` signatures.
    """
    most = most or BUCKET
    blocks = F.ceil(F.col("n") / most).cast("int")
    mine = F.pmod(F.hash("doc_id", "key"), F.col("_g"))
    small = members.where(F.col("n") <= most).select("key", "doc_id")
    big = members.where(F.col("n") > most).withColumn("_g", blocks).withColumn("_x", mine)
    big = big.select("key", "doc_id", "_x", F.explode(F.filter(F.sequence(F.lit(0), F.col("_g") - 1), lambda y: y != F.col("_x"))).alias("_y"))
    return small.unionByName(big.select(F.xxhash64("key", F.least("_x", "_y"), F.greatest("_x", "_y")).alias("key"), "doc_id"))


def groups(spark: SparkSession, docs: DataFrame, least: float = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, group_id, kept) of every document that has a near copy; group_id is the smallest id of its group."""
    s = scratch or Scratch(spark, "near")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    sketch = s.table(one_row(text, s).mapInArrow(_sketch, "doc_id long, whole long, sig binary, bands array<long>"), "sketch")
    same = s.table(sketch.groupBy("whole").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "same")
    # one document of each signature goes on
    reps = s.table(sketch.groupBy("whole").agg(F.min_by(F.struct("doc_id", "sig", "bands"), "doc_id").alias("r")).select("r.*"), "reps")
    rows = reps.select("doc_id", F.explode("bands").alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.bit_xor(F.xxhash64("doc_id")).alias("who")).where("n > 1")
    # buckets with the same members are one
    full = s.table(full.groupBy("n", "low", "who").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    members = split(rows.join(full, "key"))
    paired = members.join(reps.select("doc_id", "sig"), "doc_id").select("key", "doc_id", "sig")
    edges = paired.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_verify(least), "a long, b long")
    root = components(edges, s)
    of = same.join(root, same.rep == root.node, "left").select("whole", F.coalesce("root", "rep").alias("group_id"), "n")
    named = sketch.select("doc_id", "whole").join(of, "whole").select("doc_id", "group_id")
    size = F.count("*").over(Window.partitionBy("group_id"))
    low = F.min("doc_id").over(Window.partitionBy("group_id"))
    return named.select("doc_id", low.alias("group_id"), size.alias("size")).where("size > 1").select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, least: float = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with one document of each group. Of rows that repeat a doc_id one stays: the one of the smallest text, null last."""
    s = scratch or Scratch(spark, "dedup")
    bad, again, nth = (fresh(x, docs) for x in ("_gone", "_twice", "_nth"))
    gone = s.table(groups(spark, docs, least, s).where("NOT kept").select(F.col("doc_id").alias(bad)), "gone")
    kept = docs.join(sized(gone, gone.count()), docs["doc_id"].cast("long") == gone[bad], "left_anti")
    twice = s.table(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again)), "twice")
    n = twice.count()
    if n == 0:
        return kept
    once = kept.join(sized(twice, n), kept["doc_id"] == twice[again], "left_anti")
    more = kept.join(sized(twice, n), kept["doc_id"] == twice[again], "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *[F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")])
    return once.unionByName(more.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth))
