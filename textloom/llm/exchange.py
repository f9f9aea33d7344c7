"""Shuffles of sorted arrays: one binary row for each (task, part) instead of a row for each record."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "part int, payload binary"


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def part_of(h: np.ndarray, n: int) -> np.ndarray:
    """Part of a 64-bit hash by its high bits: parts are ranges of the hash."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def pack(part: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each part; ``part`` must be sorted."""
    which, lo = np.unique(part, return_index=True)
    hi = np.append(lo[1:], len(part))
    rows = [b"".join(np.ascontiguousarray(a[i:j]).tobytes() for a in arrays) for i, j in zip(lo, hi, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(rows, pa.binary())], ["part", "payload"])


def unpack(payload: bytes, kinds: tuple[type, ...]) -> list[np.ndarray]:
    size = [np.dtype(k).itemsize for k in kinds]
    n = len(payload) // sum(size)
    out, at = [], 0
    for k, s in zip(kinds, size, strict=True):
        out.append(np.frombuffer(payload, k, n, at))
        at += s * n
    return out


#: Most tasks of one exchange; beyond it a task takes several parts, one after the other.
MOST_TASKS = 50_000


def parts_for(spark: SparkSession, records: int, each: int) -> int:
    """Parts of about ``each`` records, as many as the session has shuffle partitions at least."""
    return max(parts(spark), -(-records // each))


def exchange(df: DataFrame, n: int) -> DataFrame:
    """Bring the rows of each of ``n`` parts together, in order of their parts.

    Up to MOST_TASKS parts have a task each; beyond, Spark's external sort brings a task's parts one by one.
    """
    if n <= MOST_TASKS:
        return df.repartitionById(n, "part")
    task = F.floor(F.col("part").cast("long") * MOST_TASKS / n).cast("int")
    return df.withColumn("_task", task).repartitionById(MOST_TASKS, "_task").drop("_task").sortWithinPartitions("part")


def gathered(batches, kinds: tuple[type, ...]):
    """(part, arrays) of each part whose rows are in this partition."""
    for part, got in by_part(batches):
        got = [unpack(payload, kinds) for payload in got]
        yield part, [np.concatenate([g[i] for g in got]) for i in range(len(kinds))]


def by_part(batches):
    """(part, payloads) of each part; no more than one part is held, as an exchange brings them in order."""
    now, held = -1, []
    for b in batches:
        for part, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if part != now and held:
                yield now, held
                held = []
            now = part
            held.append(payload)
    if held:
        yield now, held
