"""Quality classifier by importance resampling.

Two hashed n-gram models (words, signs and their pairs, in BUCKETS buckets): of the
target text (documents labelled good and not toxic) and of the raw text (every document). A
document's log weight is the sum over its n-grams of log target - log raw, where
PRIOR occurrences at the raw rate are added to each bucket, so that n-grams too rare
to tell say nothing; the k documents of the largest log weight + Gumbel noise are the sample: drawing without
replacement in proportion to the weights. The noise is keyed by the document, so
that a lost task, a rerun and another partitioning draw the same.

k is the number of documents, among all, whose log weight is at least a threshold;
the threshold separates good from bad among labelled rows best, where losing good
documents counts KEEP times. At most FIT_ROWS labelled rows are used (those of the
smallest hashed ids): target text comes from one half of them and the threshold
from the other, whose texts the target model hasn't seen, as it hasn't most of the
corpus. Raw counts, weights, k and the sample cover every document.

Defined results: null and empty texts have weight 0, noise of an empty text, and take
part, as null ids do; very long texts are read whole; rows that agree in id and text draw
the same noise, so repeated rows stay or go together, and ties at the k-th key all stay;
of several labels of a document the least quality counts, and toxic in any row; without
labelled good rows all documents stay; without labelled bad rows the threshold is
the least weight of a good one; where one half lacks a kind, all labelled rows serve;
an empty table gives an empty sample; other columns of whatever names stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, map_array, put_array, sized
from .textops import mix, pieces, words

BUCKETS = 1 << 16
FIT_ROWS = 200_000
KEEP = 20.0
PRIOR = 50.0
SEED = 20240229
_G = np.uint64(0x9E3779B97F4A7C15)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of single words and their documents, of pairs and theirs."""
    w = words(texts, fold=False, marks=True)
    doc = w.doc()
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    one = (w.hash >> shift).astype(np.int64)
    h = w.hash
    two = (mix(h[:-1] * _G + h[1:]) >> shift).astype(np.int64)
    inside = doc[1:] == doc[:-1]
    return one, doc, two[inside], doc[1:][inside]


def _counts(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, texts in pieces(batch, "text"):
            one, _, two, _ = features(texts)
            total += np.bincount(one, minlength=BUCKETS)
            total += np.bincount(two, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def _model(df: DataFrame) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for r in df.mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows at most
        out[r[0]] = r[1]
    return out


_loaded: dict[str, np.ndarray] = {}


def _ratio(where: str) -> np.ndarray:
    if where not in _loaded:
        _loaded.clear()
        _loaded[where] = np.asarray(map_array(where))
    return _loaded[where]


def _half() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("half")), F.lit(2))


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the target's rate to the raw text's in each bucket."""
    share = target.sum() / raw.sum()
    return np.log((target + PRIOR) / (share * raw + PRIOR))


def log_weights(texts: list[str | None], ratio: np.ndarray) -> np.ndarray:
    one, d1, two, d2 = features(texts)
    total = np.bincount(d1, ratio[one], len(texts)) + np.bincount(d2, ratio[two], len(texts))
    return total.astype(np.float64)  # counts of nothing come as integers


def gumbel(ids: list[int | None], texts: list[str | None], seed: int = SEED) -> np.ndarray:
    """Noise of each document, from its id and its whole text."""
    h = np.array([(0 if i is None else i + 1) & 0xFFFFFFFFFFFFFFFF for i in ids], np.uint64)
    s = np.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.uint64)
    u = mix(mix(h + np.uint64(seed)) ^ s) >> np.uint64(11)
    return -np.log(-np.log((u.astype(np.float64) + 0.5) / 2.0**53))


def _keyed(where: str):
    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                w = log_weights(texts, _ratio(where))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w), pa.array(w + gumbel(part.column(0).to_pylist(), texts))], ["doc_id", "log_weight", "draw"])

    return run


def threshold(good: np.ndarray, bad: np.ndarray, keep: float = KEEP) -> float:
    """Least weight to count as good: the cut that loses least, a good one's loss counting ``keep`` times."""
    if len(good) == 0:
        return float("-inf")
    if len(bad) == 0:
        return float(good.min())
    x = np.concatenate((good, bad))
    y = np.concatenate((np.full(len(good), keep / len(good)), np.full(len(bad), -1 / len(bad))))
    order = np.argsort(x, kind="stable")
    x, loss = x[order], np.concatenate(([0.0], np.cumsum(y[order])))
    new = np.concatenate(([True], x[1:] != x[:-1]))
    at = np.flatnonzero(new)
    k = at[np.argmin(loss[at])]
    return float(x[k]) if k == 0 else float((x[k] + x[k - 1]) / 2)


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly: by histograms of ever narrower ranges."""
    d = df.select(F.col(column).alias("x"))
    lo, hi = d.agg(F.min("x"), F.max("x")).first()
    while lo < hi:
        step = (hi - lo) / 4096
        cell = F.least(F.lit(4095), F.floor((F.col("x") - F.lit(lo)) / F.lit(step))) if step > 0 else F.lit(0)
        rows = d.where((F.col("x") >= lo) & (F.col("x") <= hi)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()  # 4096 rows at most
        for r in sorted(rows, key=lambda r: -r["c"]):
            if k <= r["n"]:
                if (r["a"], r["b"]) == (lo, hi):
                    return _among(d, lo, hi, k)
                lo, hi = r["a"], r["b"]
                break
            k -= r["n"]
    return lo


def _among(d: DataFrame, lo: float, hi: float, k: int) -> float:
    """In a range too narrow for 4096 cells, which holds 4096 different doubles at most."""
    for r in sorted(d.where((F.col("x") >= lo) & (F.col("x") <= hi)).groupBy("x").count().collect(), reverse=True):
        if k <= r[1]:
            return r[0]
        k -= r[1]
    return lo


def _fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, s: Scratch) -> tuple[str, float, float] | None:
    """(path of the log ratios, k-th key, threshold), or None without good rows."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("toxic").cast("int") == 1, 0).otherwise(F.col("quality").cast("int")).alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    known = s.table(known, "known")
    n = known.count()
    sample = text.join(sized(known, n), "doc_id")
    good = sample.where("quality > 0")
    target = _model(good.where(_half() == 0).select("doc_id", "text"))
    if not target.any():
        target = _model(good.select("doc_id", "text"))
    if not target.any():
        return None
    raw = _model(text)
    where = s.path("ratio.npy")
    put_array(where, log_ratio(target, raw))
    keys = s.table(text.mapInArrow(_keyed(where), "doc_id long, log_weight double, draw double"), "keys")
    rows = keys.join(sized(known, n), "doc_id").select("log_weight", "quality", _half().alias("half")).toPandas()  # FIT_ROWS at most, times repeated rows
    other = rows[rows.half == 1]
    if set(other.quality > 0) == {True, False}:
        rows = other
    cut = threshold(rows.log_weight[rows.quality > 0].to_numpy(), rows.log_weight[rows.quality <= 0].to_numpy())
    k = keys.where(F.col("log_weight") >= cut).count()
    least = kth_largest(keys, "draw", k) if k else float("inf")
    return where, least, cut


def sample(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, log_weight, draw) of every document in the sample."""
    s = Scratch(spark, "resample")
    got = _fit(spark, docs, labels, s)
    if got is None:
        zero = F.lit(0.0)
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), zero.alias("log_weight"), zero.alias("draw"))
    keys = spark.read.schema("doc_id long, log_weight double, draw double").parquet(s.path("02-keys"))
    return keys.where(F.col("draw") >= got[1])


def select(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` in the sample, as they are. Each row's key is worked out again in place of a join."""
    s = scratch or Scratch(spark, "resample")
    got = _fit(spark, docs, labels, s)
    if got is None:
        return docs
    where, least, _ = got
    i = docs.columns.index("doc_id")

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                key = log_weights(texts, _ratio(where)) + gumbel(part.column(i).to_pylist(), texts)
                yield part.filter(pa.array(key >= least))

    return docs.mapInArrow(run, docs.schema)
