"""Benchmark decontamination with an FM-index per training shard.

A test phrase is any run of ``n`` words of a benchmark item (case folded,
punctuation ignored). Each shard of training documents gets an FM-index over its
words; all phrases are searched backwards through wavelet-matrix ranks, their
occurrences are located by sampled suffix positions, and the spans of each
document are merged.

The index's alphabet is the benchmark's vocabulary. A word outside it can be part
of no phrase, so it separates segments, as a document's end does; a segment of
fewer than ``n`` words holds no phrase. Both reductions are exact.

Defined results: null and empty texts hold nothing and stay as they are; very long
texts are searched whole; null items and items with fewer than ``n`` words give no
phrase, and repeated items are one; a null item_id is reported as -1; of phrases at the
same place all items are reported; a document that occurs twice is reported twice; an
empty table gives no rows, and with an empty benchmark nothing is removed. Of a document
that is all benchmark text nothing stays, and ``remove`` drops it; its other columns and
rows stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, map_array, put_array
from .textops import grams, pieces, words

N_WORDS = 8
#: Benchmark items per pass over the training data: bounds what a worker maps.
ITEMS_PER_PASS = 200_000
SAMPLE = 16
#: Bytes of text in a shard.
SHARD_BYTES = 2_000_000


class Ranks:
    """Wavelet matrix: access and rank over a sequence of small integers."""

    def __init__(self, s: np.ndarray, bits: int):
        self.n, self.bits, self.level, self.zeros = len(s), bits, [], []
        s = s.astype(np.uint32)
        for b in range(bits - 1, -1, -1):
            bit = ((s >> np.uint32(b)) & np.uint32(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(8 - len(packed) % 8, np.uint8))).view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.level.append((packed, np.concatenate(([0], np.cumsum(ones)))))
            self.zeros.append(self.n - int(ones.sum()))
            s = np.concatenate((s[~bit], s[bit]))

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        packed, before = self.level[k]
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(packed[block] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before place i."""
        lo, hi = np.zeros_like(i), i
        for k in range(self.bits):
            up = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo = np.where(up, self.zeros[k] + a, lo - a)
            hi = np.where(up, self.zeros[k] + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i and its rank there."""
        lo, at, c = np.zeros_like(i), i, np.zeros_like(i)
        for k in range(self.bits):
            packed, _ = self.level[k]
            up = ((packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            a, b = self._ones(k, lo), self._ones(k, at)
            lo = np.where(up, self.zeros[k] + a, lo - a)
            at = np.where(up, self.zeros[k] + b, at - b)
            c = (c << 1) | up
        return c, at - lo


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes; each 0 is a separator of its own, ordered by place, and ends its suffix."""
    n = len(s)
    stop = np.flatnonzero(s == 0)
    here = np.arange(n)
    left = stop[np.searchsorted(stop, here)] - here
    step = 64 // bits
    key = np.zeros(n, np.uint64)
    for j in range(step):
        v = s[np.minimum(here + j, n - 1)].astype(np.uint64)
        key = (key << np.uint64(bits)) | np.where(left >= j, v, np.uint64(0))
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    slots = here
    sorted_key = key[sa]
    while True:
        new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        head = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        rank[sa[slots]] = head
        last = np.concatenate((new[1:], [True]))
        slots = slots[~(new & last)]
        if len(slots) == 0:
            return sa
        at = sa[slots]
        second = np.where(left[at] < step, at, rank[np.minimum(at + step, n - 1)])
        sub = rank[at].astype(np.uint64) * np.uint64(n + 1) + second.astype(np.uint64)
        order = np.argsort(sub, kind="stable")
        sa[slots] = at[order]
        sorted_key = sub[order]
        step *= 2


class FMIndex:
    """Symbols 1.. in segments, each ended by a 0."""

    def __init__(self, s: np.ndarray, size: int):
        bits = max(1, int(size).bit_length())
        sa = suffix_array(s, bits)
        before = s[sa - 1]
        self.ranks = Ranks(before, bits)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=size + 1))))
        sampled = (sa % SAMPLE == 0) | (before == 0)
        self.sampled, self.at = Ranks(sampled, 1), sa[sampled]
        self.n = len(s)

    def count(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each phrase (one a row)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j].astype(np.int64)
            lo[live] = self.first[c] + self.ranks.rank(c, lo[live])
            hi[live] = self.first[c] + self.ranks.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Place of each suffix: step back to a sampled one. Segment starts are sampled, so no step crosses a separator."""
        place, back, todo = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        row = row.copy()
        while len(todo):
            hit, nth = self.sampled.access(row[todo])
            done = todo[hit == 1]
            place[done] = self.at[nth[hit == 1]] + back
            todo = todo[hit == 0]
            if len(todo) == 0:
                break
            c, r = self.ranks.access(row[todo])
            row[todo] = self.first[c] + r
            back += 1
        return place


class Phrases:
    """Test phrases as rows of vocabulary numbers, with their items."""

    def __init__(self, where: str, k: int):
        get = lambda name: map_array(f"{where}/bench-{k}-{name}.npy")
        self.vocabulary, self.rows, self.item_from, self.items = map(np.asarray, map(get, ("vocabulary", "rows", "from", "items")))

    @staticmethod
    def write(where: str, k: int, items: list[tuple[int | None, str | None]], n: int) -> None:
        w = words([t for _, t in items])
        vocabulary, number = np.unique(w.hash, return_inverse=True)
        g, at = grams(w, n)
        doc = w.doc()
        _, first, same = np.unique(g, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack((same, doc[at]), 1), axis=0) if len(g) else np.zeros((0, 2), np.int64)
        ids = np.array([-1 if i is None else i for i, _ in items], np.int64)
        rows = number[at[first][:, None] + np.arange(n)] + 1 if len(g) else np.zeros((0, n), np.int64)
        for name, a in (("vocabulary", vocabulary), ("rows", rows.astype(np.int32)), ("from", np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))), ("items", ids[pairs[:, 1]])):
            put_array(f"{where}/bench-{k}-{name}.npy", a)


_kept: dict[str, Phrases] = {}


def _phrases(where: str, k: int) -> Phrases:
    if (key := f"{where}/{k}") not in _kept:
        if any(not x.startswith(f"{where}/") for x in _kept) or len(_kept) >= 256:
            _kept.clear()
        _kept[key] = Phrases(where, k)
    return _kept[key]


def find(texts: list[str | None], p: Phrases, n: int) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """Merged spans and items of each text of a shard."""
    out: list[tuple[list[tuple[int, int]], list[int]]] = [([], []) for _ in texts]
    if len(p.rows) == 0:
        return out
    symbols, places = [], []
    w = words(texts)
    v = np.minimum(np.searchsorted(p.vocabulary, w.hash), len(p.vocabulary) - 1)
    known = p.vocabulary[v] == w.hash
    doc = w.doc()
    # segments: runs of known words of one document
    cut = np.ones(len(known) + 1, bool)
    cut[1:-1] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
    edge = np.flatnonzero(cut)
    a, b = edge[:-1], edge[1:]
    keep = known[a] & (b - a >= n) if len(a) else np.zeros(0, bool)
    a, b = a[keep], b[keep]
    if len(a) == 0:
        return out
    size = b - a + 1
    ends = np.cumsum(size)
    places = np.arange(ends[-1]) - np.repeat(ends - size - a, size)
    symbols = np.zeros(ends[-1], np.int64)
    real = np.ones(ends[-1], bool)
    real[ends - 1] = False
    symbols[real] = v[places[real]] + 1
    index = FMIndex(symbols, len(p.vocabulary))
    # a phrase whose last two words never stand together here needs no search
    pair = lambda x, y: x.astype(np.int64) * (len(p.vocabulary) + 1) + y
    some = np.flatnonzero(np.isin(pair(p.rows[:, -2], p.rows[:, -1]), pair(symbols[:-1], symbols[1:]))) if n > 1 else np.arange(len(p.rows))
    lo, hi = index.count(p.rows[some])
    many = hi - lo
    if not many.any():
        return out
    phrase = some[np.repeat(np.arange(len(many)), many)]
    rows = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    at = places[index.locate(rows)]
    d, s, e = doc[at], w.start[at], w.end[at + n - 1]
    order = np.lexsort((s, d))
    for i in order:
        spans, items = out[d[i]]
        x, y = int(s[i] - w.base[d[i]]), int(e[i] - w.base[d[i]])
        if spans and x <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], y))
        else:
            spans.append((x, y))
        items += p.items[p.item_from[phrase[i]] : p.item_from[phrase[i] + 1]].tolist()
    return [(x, sorted(set(y))) for x, y in out]


def _prepare(spark: SparkSession, benchmark: DataFrame, n: int, scratch: Scratch | None = None) -> tuple[str, int]:
    """Phrases of the benchmark, written by executors in passes of about ITEMS_PER_PASS items."""
    s = scratch or Scratch(spark, "decontaminate")
    where = s.uri
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    passes = -(-items.count() // ITEMS_PER_PASS)

    def build(key, table):
        Phrases.write(where, key[0].as_py(), list(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True)), n)
        return pa.table([pa.array([key[0].as_py()], pa.int64())], ["pass"])

    if passes == 0:
        return where, 0
    keyed = items.withColumn("_pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    built = s.table(keyed.groupBy("_pass").applyInArrow(build, "pass long"), "passes").collect()  # a row for each pass
    for k in sorted({*range(passes)} - {r[0] for r in built}):  # no item's hash falls here
        Phrases.write(where, k, [], n)
    return where, passes


def _shards(batch: pa.RecordBatch, column: str):
    return pieces(batch, column, SHARD_BYTES)


_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))), T.StructField("item_ids", T.ArrayType(T.LongType())), T.StructField("removed_chars", T.IntegerType())])


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """A row for each document that holds test phrases: merged spans (in characters) and the items they come from."""
    where, count = _prepare(spark, benchmark, n)

    def run(batches):
        for batch in batches:
            for part, texts in _shards(batch, "text"):
                ids = part.column(0).to_pylist()
                found = [([], []) for _ in texts]
                for k in range(count):
                    for f, (spans, items) in zip(found, find(texts, _phrases(where, k), n), strict=True):
                        f[0].extend(spans)
                        f[1].extend(items)
                hit = [(i, merge(s), sorted(set(x))) for i, (s, x) in zip(ids, found, strict=True) if s]
                if hit:
                    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                    yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hit], pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in h[1]] for h in hit], span), pa.array([h[2] for h in hit], pa.list_(pa.int64())), pa.array([sum(b - a for a, b in h[1]) for h in hit], pa.int32())], ["doc_id", "spans", "item_ids", "removed_chars"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _FOUND)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join(out) + text[at:]


def remove(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with the spans cut out of ``text`` (and ``n_chars`` set anew, where there is one); a document left without a word is dropped. Other columns and rows stay."""
    where, count = _prepare(spark, benchmark, n, scratch)
    schema, names = docs.schema, docs.columns
    t, c = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches):
        for batch in batches:
            for part, texts in _shards(batch, "text"):
                cuts: dict[int, list[tuple[int, int]]] = {}
                for k in range(count):
                    for i, (spans, _) in enumerate(find(texts, _phrases(where, k), n)):
                        if spans:
                            cuts.setdefault(i, []).extend(spans)
                if not cuts:
                    yield part
                    continue
                keep = np.ones(len(texts), bool)
                for i, spans in cuts.items():
                    texts[i] = cut(texts[i], merge(spans))
                    keep[i] = any(ch.isalnum() for ch in texts[i])
                columns = list(part.columns)
                columns[t] = pa.array(texts, part.schema.field(t).type)
                if c >= 0:
                    n_chars = part.column(c).to_pylist()
                    for i in cuts:
                        n_chars[i] = len(texts[i])
                    columns[c] = pa.array(n_chars, part.schema.field(c).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


#: DuckDB SQL for ``contamination``: runs of words joined on their texts; overlapping spans merged by islands.
ORACLE = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, text, regexp_extract_all(text, '[\pL\pN_]+') AS w, regexp_split_to_array(text, '[\pL\pN_]+') AS gap FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, row, i, lower(w[i]) AS word, sum(length(gap[i]) + CASE WHEN i > 1 THEN length(w[i - 1]) ELSE 0 END) OVER (PARTITION BY row ORDER BY i) AS a, length(w[i]) AS n
      FROM (SELECT doc_id, row, w, gap, unnest(range(1, len(w) + 1)) AS i FROM t)),
g AS (SELECT doc_id, row, a, string_agg(word, ' ') OVER x AS phrase, last_value(a + n) OVER x AS b, count(*) OVER x AS many FROM p WINDOW x AS (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
bw AS (SELECT item_id, row_number() OVER () AS row, regexp_extract_all(lower(text), '[\pL\pN_]+') AS w FROM benchmark WHERE text IS NOT NULL),
bench AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS phrase FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM bw)),
hit AS (SELECT doc_id, row, a, b, item_id FROM g JOIN bench USING (phrase) WHERE many = 8),
items AS (SELECT row, list_sort(list(DISTINCT item_id)) AS item_ids FROM hit GROUP BY row),
m AS (SELECT DISTINCT doc_id, row, a, b FROM hit),
s AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY row ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM m),
k AS (SELECT *, sum(new) OVER (PARTITION BY row ORDER BY a, b) AS span FROM s),
e AS (SELECT doc_id, row, span, min(a) AS a, max(b) AS b FROM k GROUP BY doc_id, row, span)
SELECT doc_id, list({'start': CAST(a AS INTEGER), 'stop': CAST(b AS INTEGER)} ORDER BY a) AS spans, any_value(item_ids) AS item_ids, CAST(sum(b - a) AS INTEGER) AS removed_chars
FROM e JOIN items USING (row) GROUP BY doc_id, row
"""
