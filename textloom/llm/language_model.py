"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

1. Vocabulary: every distinct word, by its 64-bit hash, gets a number of 32 bits;
   frequent words get small ones. Sorted arrays of hashes and numbers are written.
2. Counting: each task turns its documents into runs of ``order`` numbers, sorts and
   sums them, and sends one compressed block of them to each range of hashed contexts
   (the runs without their last word). A range's task merges its blocks and writes
   sorted arrays: contexts, each one's words and their counts.
3. Each distinct run counts once for its suffix, which is one word shorter: these
   continuation counts travel on in blocks to the ranges of their own contexts, level
   by level, down to single words.

Documents begin with order - 1 begin marks and end with an end mark. Contexts of one
and two words are exact keys, longer ones 64-bit hashes. Every document counts;
nothing is sampled. Parts hold about EACH tokens, however many there are.

Scoring, for each order: p(w|u) = max(c - D(c), 0) / c(u) + (D1 n1(u) + D2 n2(u) + D3 n3(u)) / c(u) * p(w|u'),
where u' is u without its first word; single words over the uniform distribution. D from
the numbers of n-grams seen 1 to 4 times; where one of these is zero (tiny inputs),
D = 0.5, 0.75, 0.9. An unknown context leaves p(w|u').

Defined results: null and empty texts (and those without a word) aren't counted, and
their perplexity is null; very long texts are counted and scored whole; a repeated row
counts each time, and gets the same score each time; there are no ties; an empty table
gives no rows; only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import SCHEMA, by_part, exchange, gathered, pack, part_of, parts, parts_for
from .shared import Scratch, bounds, map_array, put_array
from .textops import mix, pieces, words

ORDER = 3
#: Numbers of the marks, and of a word that the vocabulary lacks.
BEGIN, END, UNKNOWN = 0, 1, 0xFFFFFFFF
#: N-grams that a task sums before it sends them on; tokens in a part.
HELD, EACH = 4_000_000, 8_000_000
#: Contexts with more words than this have their sums written.
FEW = 16
_S32 = np.uint64(32)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    e = bounds(keys)
    return keys[e[:-1]], np.add.reduceat(counts[order].astype(np.int64), e[:-1]) if len(keys) else counts[:0].astype(np.int64)


def by_two(keys: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An order by keys, then by last (of 32 bits): two plain sorts, which are faster than stable ones where nothing is sorted yet."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.zeros(len(k), np.uint64)
    new[1:] = k[1:] != k[:-1]
    return order[np.argsort((np.cumsum(new) << _S32) | last[order])]


# vocabulary


def _distinct(n: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, texts in pieces(batch, "text"):
                w = words(texts)
                h, c = np.unique(w.hash, return_counts=True)
                held.append((h, c, int((np.diff(w.first) > 0).sum())))
                size += len(h)
                if size >= HELD // 4:
                    yield _counted(held, n)
                    held, size = [], 0
        if size:
            yield _counted(held, n)

    return run


def _counted(held: list, n: int) -> pa.RecordBatch:
    h, c = summed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
    return pack(part_of(h, n), [h, c])


def _number(where: str, n: int):
    def run(batches):
        for part, (h, c) in gathered(batches, (np.uint64, np.int64)):
            h, c = summed(h, c)
            rank = np.empty(len(h), np.int64)
            rank[np.lexsort((h, -c))] = np.arange(len(h))
            number = rank * n + part + 2
            if len(h) and int(number.max()) >= UNKNOWN:
                raise ValueError("more words than 32 bits number")
            put_array(f"{where}/vocabulary-{part}.npy", bundle(h, number.astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([int(c.sum())], pa.int64())], ["part", "words", "tokens"])

    return run


# files of several arrays


def bundle(*arrays: np.ndarray) -> np.ndarray:
    """Arrays in one: a head (number, then type and length of each), and each at a multiple of 8 bytes."""
    head = np.array([len(arrays), *(v for a in arrays for v in (ord(a.dtype.char), len(a)))], np.int64)
    rows = [head.tobytes()]
    for a in arrays:
        b = np.ascontiguousarray(a).tobytes()
        rows.append(b + b"\0" * (-len(b) % 8))
    return np.frombuffer(b"".join(rows), np.uint8)


def unbundle(a: np.ndarray) -> list[np.ndarray]:
    k = int(a[:8].view(np.int64)[0])
    head = a[8 : 8 + 16 * k].view(np.int64)
    out, at = [], 8 + 16 * k
    for kind, n in head.reshape(-1, 2).tolist():
        t = np.dtype(chr(kind))
        size = n * t.itemsize
        out.append(a[at : at + size].view(t))
        at += size + -size % 8
    return out


class Files:
    """Mapped files of a model, by name and part; a missing part holds nothing."""

    MOST = 8192

    def __init__(self, where: str):
        self.where, self.open = where, {}

    def get(self, name: str, part: int) -> list[np.ndarray] | None:
        key = (name, part)
        if key not in self.open:
            if len(self.open) >= self.MOST:
                self.open.clear()
            try:
                self.open[key] = unbundle(map_array(f"{self.where}/{name}-{part}.npy").view(np.ndarray))  # a plain array over the map is indexed faster
            except FileNotFoundError:  # only after the count of parts is known to be complete: see Model
                self.open[key] = None
        return self.open[key]

    def each(self, name: str, part: np.ndarray):
        """(arrays, index of the rows) for the parts of some rows."""
        order = np.argsort(part.astype(np.uint16) if len(part) and int(part.max()) < 1 << 16 else part, kind="stable")
        e = bounds(part[order])
        for i, j in zip(e[:-1].tolist(), e[1:].tolist(), strict=True):
            if got := self.get(name, int(part[order[i]])):
                yield got, order[i:j]


def numbered(h: np.ndarray, files: Files, n: int) -> np.ndarray:
    """The numbers of words, by their hashes."""
    u, back = np.unique(h, return_inverse=True)
    out = np.full(len(u), UNKNOWN, np.uint32)
    for (known, number), rows in files.each("vocabulary", part_of(u, n)):
        at = np.minimum(np.searchsorted(known, u[rows]), len(known) - 1)
        out[rows] = np.where(known[at] == u[rows], number[at], np.uint32(UNKNOWN))
    return out[back]


# counting


def ngrams(texts: list[str | None], files: Files, n: int, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A column of numbers for each place of the n-grams of the texts, in order; and the number of each text's n-grams."""
    w = words(texts)
    size = np.diff(w.first)
    have = size[size > 0]
    total = have + order
    stop = np.cumsum(total)
    seq = np.full(int(total.sum()), BEGIN, np.uint32)
    real = np.zeros(len(seq), bool)
    at = np.arange(len(w.hash)) + np.repeat(np.arange(1, len(have) + 1) * (order - 1) + np.arange(len(have)), have)
    seq[at] = numbered(w.hash, files, n)
    real[at] = True
    seq[stop - 1] = END
    real[stop - 1] = True
    target = np.flatnonzero(real)
    return [seq[target - i] for i in range(order - 1, -1, -1)], np.where(size > 0, size + 1, 0)


def context_key(columns: list[np.ndarray]) -> np.ndarray:
    """Key of the contexts whose words are in ``columns``: exact for one and two words, else a hash."""
    k = columns[0].astype(np.uint64)
    if len(columns) == 2:
        return (k << _S32) | columns[1]
    for c in columns[1:]:
        k = mix(k * np.uint64(0x9E3779B97F4A7C15) + c)
    return k


def parts_of(columns: list[np.ndarray], n: int, key: np.ndarray | None = None) -> np.ndarray:
    """Part of n-grams: by their context; of single words by the word."""
    if len(columns) == 1:
        return part_of(mix(columns[0].astype(np.uint64)), n)
    return part_of(mix(context_key(columns[:-1]) if key is None else key), n)


def aggregated(columns: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams in order of context key and word, with the sums of their counts."""
    if len(columns[0]) == 0:
        return columns, np.zeros(0, np.int64)
    if len(columns) == 1:
        w, c = summed(columns[0], np.ones(len(columns[0]), np.int64) if counts is None else counts)
        return [w], c
    key = context_key(columns[:-1])
    if len(columns) == 2:
        order = np.argsort((key << _S32) | columns[1], kind="stable")
    else:
        order = by_two(key, columns[-1]) if counts is None else np.lexsort((columns[-1], key))  # sorted blocks merge faster
    key, last = key[order], columns[-1][order]
    head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (last[1:] != last[:-1]))))
    c = np.diff(np.append(head, len(key))) if counts is None else np.add.reduceat(counts[order].astype(np.int64), head)
    first = order[head]
    return [x[first] for x in columns], c


def _planes(a: np.ndarray) -> bytes:
    """Bytes of like rank together: they compress well."""
    return np.ascontiguousarray(a.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(b: bytes, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, 4 * n, at).reshape(4, n).T).view(np.uint32).ravel()


def encoded(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """N-grams in order: each context once, a mark where one begins, the last words, and small counts as bytes."""
    n, context = len(counts), columns[:-1]
    new = np.zeros(n, bool)
    new[:1] = True
    for c in context:
        new[1:] |= c[1:] != c[:-1]
    big = np.flatnonzero(counts > 254)
    rows = [np.packbits(new).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), _planes(columns[-1]), big.astype(np.uint32).tobytes(), counts[big].astype(np.int64).tobytes()]
    for i, c in enumerate(context):
        c = c[new]
        rows.append(_planes(np.diff(c, prepend=np.uint32(0)) if i == 0 else c))
    body = b"".join(rows)
    head = np.array([n, int(new.sum()), len(big), len(body)], np.int64)
    return head.tobytes() + pa.compress(body, "zstd", asbytes=True)


def decoded(payload: bytes, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    n, m, b, size = np.frombuffer(payload, np.int64, 4).tolist()
    body = pa.decompress(memoryview(payload)[32:], size, "zstd", asbytes=True)
    at = (n + 7) // 8
    of = np.cumsum(np.unpackbits(np.frombuffer(body, np.uint8, at), count=n)) - 1
    counts = np.frombuffer(body, np.uint8, n, at).astype(np.int64)
    last = _unplanes(body, at + n, n)
    at += 5 * n
    big = np.frombuffer(body[at : at + 4 * b], np.uint32)
    counts[big] = np.frombuffer(body[at + 4 * b : at + 12 * b], np.int64)
    at += 12 * b
    context = []
    for i in range(width - 1):
        c = _unplanes(body, at, m)
        context.append((np.cumsum(c, dtype=np.uint32) if i == 0 else c)[of])
        at += 4 * m
    return [*context, last], counts


def _blocks(columns: list[np.ndarray], counts: np.ndarray | None, n: int) -> pa.RecordBatch:
    columns, counts = aggregated(columns, counts)
    part = parts_of(columns, n)
    order = np.argsort(part.astype(np.uint16) if n < 1 << 16 else part, kind="stable")
    columns, counts, part = [c[order] for c in columns], counts[order], part[order]
    e = bounds(part)
    rows = [encoded([c[i:j] for c in columns], counts[i:j]) for i, j in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[e[:-1]].astype(np.int32)), pa.array(rows, pa.binary())], ["part", "payload"])


def _count(where: str, n_words: int, n: int, order: int):
    def run(batches):
        files, held, size = Files(where), [], 0
        for batch in batches:
            for _, texts in pieces(batch, "text"):
                columns, _ = ngrams(texts, files, n_words, order)
                if len(columns[0]) == 0:
                    continue
                held.append(columns)
                size += len(columns[0])
                if size >= HELD:
                    yield _blocks([np.concatenate(c) for c in zip(*held, strict=True)], None, n)
                    held, size = [], 0
        if size:
            yield _blocks([np.concatenate(c) for c in zip(*held, strict=True)], None, n)

    return run


def _of(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def _small(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    big = np.flatnonzero(counts > 254)
    return np.minimum(counts, 255).astype(np.uint8), big.astype(np.uint32), counts[big].astype(np.int64)


def _merge(where: str, width: int, n: int):
    """Write one part's arrays of the n-grams of ``width`` words; send their suffixes' continuation counts on."""

    def run(batches):
        for part, payloads in by_part(batches):
            got = [decoded(p, width) for p in payloads]
            columns, counts = aggregated([np.concatenate([g[0][i] for g in got]) for i in range(width)], np.concatenate([g[1] for g in got]))
            del got
            key = context_key(columns[:-1])
            e = bounds(key)
            start, size = e[:-1], np.diff(e)
            hot = np.flatnonzero(size > FEW)
            sums = np.stack([np.add.reduceat(x.astype(np.int64), start)[hot] for x in (counts, counts == 1, counts == 2, counts > 2)], 1)
            put_array(f"{where}/level{width}-{part}.npy", bundle(key[start], e.astype(np.uint32), columns[-1], *_small(counts), hot.astype(np.uint32), sums.ravel()))
            put_array(f"{where}/stats{width}-{part}.npy", np.array(_of(counts), np.int64))
            yield _blocks(columns[1:], None, n)

    return run


def _words(where: str):
    def run(batches):
        for part, payloads in by_part(batches):
            got = [decoded(p, 1) for p in payloads]
            (w,), c = aggregated([np.concatenate([g[0][0] for g in got])], np.concatenate([g[1] for g in got]))
            put_array(f"{where}/level1-{part}.npy", bundle(w, c))
            put_array(f"{where}/stats1-{part}.npy", np.array([*_of(c), len(w), int(c.sum()), int((c > 2).sum())], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(w)], pa.int64())], ["part", "words"])

    return run


def _stats(spark: SparkSession, where: str, n: int, level: int) -> list[int]:
    """Sums of the parts' statistics of one level."""

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                try:
                    yield pa.RecordBatch.from_arrays([pa.array([map_array(f"{where}/stats{level}-{p}.npy").tolist()], pa.list_(pa.int64()))], ["s"])
                except FileNotFoundError:
                    continue  # a part without n-grams

    df = spark.range(0, n, 1, min(n, spark.sparkContext.defaultParallelism)).mapInArrow(run, "s array<long>")
    return [int(x or 0) for x in df.agg(*[F.sum(F.get("s", F.lit(i))) for i in range(7)]).first()]


def discounts(n: list[int]) -> list[float]:
    """Of counts 0, 1, 2 and more, from the numbers of n-grams seen 1 to 4 times."""
    if min(n) <= 0:
        return [0.0, 0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0, *(i + 1 - (i + 2) * y * n[i + 1] / n[i] for i in range(3))]
    return d if all(0 < d[i] <= i for i in (1, 2, 3)) else [0.0, 0.5, 0.75, 0.9]


def train(spark: SparkSession, docs: DataFrame, order: int = ORDER, scratch: Scratch | None = None) -> str:
    """Count the model over all texts and write it; returns its folder."""
    if order < 2:
        raise ValueError("order must be 2 at least")
    s, n_words = scratch or Scratch(spark, "lm"), parts(spark)
    where = s.path("model")
    text = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    known = exchange(text.mapInArrow(_distinct(n_words), SCHEMA), n_words).mapInArrow(_number(where, n_words), "part int, words long, tokens long")
    tokens = s.table(known, "vocabulary").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    n = parts_for(spark, tokens, EACH)
    now = text.mapInArrow(_count(where, n_words, n, order), SCHEMA)
    for width in range(order, 1, -1):
        now = exchange(now, n).mapInArrow(_merge(where, width, n), SCHEMA)
    s.table(exchange(now, n).mapInArrow(_words(where), "part int, words long"), "unigrams")
    *c, v, total, more = _stats(spark, where, n, 1)
    d = discounts(c)
    rest = d[1] * c[0] + d[2] * c[1] + d[3] * more
    higher = [discounts(_stats(spark, where, n, level)[:4]) for level in range(2, order + 1)]
    put_array(f"{where}/meta.npy", np.array([order, n_words, n, v, total, rest, *d, *(x for h in higher for x in h)], np.float64))
    return where


class Model:
    """The arrays of a model, mapped; looked up with distinct n-grams."""

    def __init__(self, where: str):
        m = map_array(f"{where}/meta.npy")  # written last: all parts are there
        self.order, self.n_words, self.n = (int(x) for x in m[:3])
        self.v, self.total, self.rest = (float(x) for x in m[3:6])
        self.d = np.asarray(m[6:]).reshape(self.order, 4)
        self.files = Files(where)

    def _counts(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of distinct n-grams, in order of their contexts' keys; total and numbers of words seen once, twice and more of their contexts."""
        key, last = context_key(columns[:-1]), columns[-1]
        count, sums = np.zeros(len(key), np.int64), np.zeros((len(key), 4), np.int64)
        for (keys, e, follow, c, big, more, hot, hot_sums), rows in self.files.each(f"level{len(columns)}", parts_of(columns, self.n, key)):
            mine = key[rows]
            e_ = bounds(mine)  # distinct n-grams come in order of their contexts
            u, back = mine[e_[:-1]], np.repeat(np.arange(len(e_) - 1), np.diff(e_))
            at = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
            known = keys[at] == u
            lo, hi = e[at].astype(np.int64), np.where(known, e[at + 1], e[at]).astype(np.int64)
            # sums of the contexts: written for those of many words, else from their few counts
            mine = np.zeros((len(u), 4), np.int64)
            many = hi - lo > FEW
            if many.any():
                mine[many] = hot_sums.reshape(-1, 4)[np.searchsorted(hot, at[many])]
            some = np.flatnonzero(~many & (hi > lo))
            if len(some):
                size = hi[some] - lo[some]
                head = np.cumsum(size) - size
                x = _wide(c, big, more, np.arange(int(size.sum())) + np.repeat(lo[some] - head, size))
                mine[some, 0] = np.add.reduceat(x, head)
                for i in (1, 2):
                    mine[some, i] = np.add.reduceat(x == i, head, dtype=np.int64)
                mine[some, 3] = size - mine[some, 1] - mine[some, 2]
            sums[rows] = mine[back]
            # the word among the context's: one search for each context of many words and rows, one binary search of all other rows at once
            a, end, w = lo[back], hi[back], last[rows]
            alone = (hi - lo > 4 * FEW) & (np.diff(e_) > 2)
            for i, j, f, t in np.stack((e_[:-1], e_[1:], lo, hi), 1)[alone].tolist():
                a[i:j] = f + np.searchsorted(follow[f:t], w[i:j])
            left = np.flatnonzero((a < end) & ~alone[back])
            x, y, v = a[left], end[left], w[left]
            while len(left):
                mid = (x + y) >> 1
                less = follow[mid] < v
                x, y = np.where(less, mid + 1, x), np.where(less, y, mid)
                a[left] = x
                on = x < y
                left, x, y, v = left[on], x[on], y[on], v[on]
            hit = np.flatnonzero(a < end)
            hit = hit[follow[a[hit]] == w[hit]]
            found = np.zeros(len(rows), np.int64)
            found[hit] = _wide(c, big, more, a[hit])
            count[rows] = found
        return count, sums

    def p(self, columns: list[np.ndarray]) -> np.ndarray:
        """p(last word | those before it)."""
        if len(columns) == 1:
            u, back = np.unique(columns[0], return_inverse=True)
            base = 1 / (self.v + 1)  # one share for all that is unknown
            if not self.total:
                return np.full(len(back), base)
            before = np.zeros(len(u), np.int64)
            for (w, c), rows in self.files.each("level1", parts_of([u], self.n)):
                at = np.minimum(np.searchsorted(w, u[rows]), len(w) - 1)
                before[rows] = np.where(w[at] == u[rows], c[at], 0)
            return ((np.maximum(before - self.d[0][np.minimum(before, 3)], 0) + self.rest * base) / self.total)[back]
        key, last = context_key(columns[:-1]), columns[-1]
        order = by_two(key, last)
        k, w = key[order], last[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])))[: len(k)]
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        mine = [c[order[new]] for c in columns]
        lower = self.p(mine[1:])
        c, t = self._counts(mine)
        d = self.d[len(columns) - 1]
        total = np.maximum(t[:, 0], 1)
        return np.where(t[:, 0] > 0, (np.maximum(c - d[np.minimum(c, 3)], 0) + (t[:, 1] * d[1] + t[:, 2] * d[2] + t[:, 3] * d[3]) * lower) / total, lower)[back]


def _wide(c: np.ndarray, big: np.ndarray, more: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts at some places, from bytes and the list of those that a byte doesn't hold."""
    x = c[at].astype(np.int64)
    over = np.flatnonzero(x == 255)
    if len(over):
        x[over] = more[np.searchsorted(big, at[over])]
    return x


@lru_cache(1)
def model(where: str) -> Model:
    return Model(where)


def score(docs: DataFrame, where: str) -> DataFrame:
    """(doc_id, n_words, bits, perplexity) of each row: over its words and its end."""

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                m = model(where)
                columns, n = ngrams(texts, m.files, m.n_words, m.order)
                p = np.concatenate(([0.0], np.cumsum(np.log2(m.p(columns)))))
                end = np.cumsum(n)
                bits = p[end - n] - p[end]
                none = n == 0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.maximum(n - 1, 0).astype(np.int32)), pa.array(bits, mask=none), pa.array(2 ** (bits / np.maximum(n, 1)), mask=none)], ["doc_id", "n_words", "bits", "perplexity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words int, bits double, perplexity double")


def perplexity(spark: SparkSession, docs: DataFrame, corpus: DataFrame | None = None, order: int = ORDER) -> DataFrame:
    """Count the model over ``corpus`` (the documents themselves, if none is given) and score every document."""
    return score(docs, train(spark, docs if corpus is None else corpus, order))
