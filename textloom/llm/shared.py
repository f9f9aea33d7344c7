"""Scratch tables and files in the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where
that setting is missing (tests, notebooks) a temporary one is made and set.
Lineage is cut by writing a table there and reading it back, so a lost executor
costs a re-read and never a recomputation that cannot be done.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; one is made only if none is set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textloom-")
        sc.setCheckpointDir(base)
        atexit.register(shutil.rmtree, urlparse(base).path, True)
    return base


class Scratch:
    """One operator call's own folder under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.uri = f"{shared_dir(spark).rstrip('/')}/textloom/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: the lineage ends here."""
        self._n += 1
        where = self.path(f"{self._n:02d}-{name}")
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str = "") -> None:
        """Remove one table (or everything) that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.uri)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop_table(self, name: str) -> None:
        for n in range(self._n + 1):
            self.drop(f"{n:02d}-{name}")


def is_local(uri: str) -> bool:
    return urlparse(uri).scheme in ("", "file")


def put_bytes(uri: str, data) -> None:
    """Write a file atomically: a retried or speculative task only repeats it."""
    if is_local(uri):
        path = urlparse(uri).path
        os.makedirs(os.path.dirname(path), exist_ok=True)
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(tmp) as f:
        f.write(data)
    store.move(tmp, path)


def put_array(uri: str, a: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(a))
    put_bytes(uri, out.getbuffer())


def map_array(uri: str) -> np.ndarray:
    """Memory-map an array where the shared folder is mounted, else read it."""
    if is_local(uri):
        return np.load(urlparse(uri).path, mmap_mode="r")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.load(io.BytesIO(f.read()))


#: Rows of 8-byte keys that may be broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 2_000_000


def sized(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` (narrow, of ``rows`` counted rows) only while it is small."""
    return F.broadcast(df) if rows <= most else df


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of the frames has it."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def one_row(text: DataFrame, s: Scratch) -> DataFrame:
    """One row for each doc_id of (doc_id, text), with the least of its texts; only rows of repeated ids are moved."""
    ids = s.table(text.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    n = ids.count()
    if n == 0:
        return text
    least = text.join(sized(ids, n), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return text.join(sized(ids, n), "doc_id", "left_anti").unionByName(s.table(least, "least"))


def runs(batches, key: str):
    """Whole groups of consecutive equal ``key`` from sorted Arrow batches.

    Yields a table per batch that ends at a group's end, so that groups which
    cross batches arrive unbroken.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        other = np.flatnonzero(k != k[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def bounds(k: np.ndarray) -> np.ndarray:
    """Start of each run of equal values, and the end of the last."""
    if len(k) == 0:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
