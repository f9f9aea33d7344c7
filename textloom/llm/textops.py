"""Vectorised word handling for Arrow batches: code points, words, hashes.

A word is a run of letters, digits and underscores (Unicode); case is folded
code point by code point, so every offset is an offset into the original text.
Whole texts are handled; batches are only cut between documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text per piece of work: keeps a worker's arrays near 60 MB. One longer document is a piece of its own.
PIECE = 1_200_000

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BI = np.uint64(pow(int(_B), -1, 1 << 64))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _classes(top: int) -> tuple[np.ndarray, np.ndarray]:
    size = 0x10000 if top < 0x10000 else 0x110000
    if size not in _tables:
        word, low = np.zeros(size, bool), np.arange(size, dtype=np.uint32)
        for i in range(size):
            c = chr(i)
            word[i] = c.isalnum() or c == "_"
            if len(s := c.lower()) == 1:
                low[i] = ord(s)
        _tables[size] = word, low
    return _tables[size]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, PIECE + PIECE // 2)
        for i, b in enumerate((_B, _BI)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[i] = p
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_word(word: str) -> int:
    """The hash that ``words`` gives this (already lower-case) word."""
    w = words([word])
    assert len(w.hash) == 1, word
    return int(w.hash[0])


@dataclass
class Words:
    """Words of some documents: offsets in characters of each one's own text."""

    hash: np.ndarray  # uint64
    start: np.ndarray  # int64, in the joined text
    end: np.ndarray
    base: np.ndarray  # where each document starts in the joined text
    first: np.ndarray  # index of each document's first word; the last entry is the number of words
    cp: np.ndarray  # code points of the joined text

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.base)), np.diff(self.first))


def words(texts: list[str | None], fold: bool = True, marks: bool = False) -> Words:
    """Words of each text. ``marks``: runs of other non-blank signs count as words too."""
    texts = [t or "" for t in texts]
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    base = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))[:-1] if texts else np.zeros(0, np.int64)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z.astype(np.uint64), z, z, base, np.zeros(len(texts) + 1, np.int64), cp)
    word, low = _classes(int(cp.max()))
    kind = word[cp].view(np.int8)
    if marks:
        kind = kind + 2 * ((kind == 0) & (cp > 32) & (cp != 160)).astype(np.int8)
        edge = np.flatnonzero(np.diff(kind, prepend=np.int8(0), append=np.int8(0)))
        start, end = edge[:-1], edge[1:]
        real = kind[start] != 0
        start, end = start[real], end[real]
    else:
        edge = np.flatnonzero(np.diff(kind, prepend=np.int8(0), append=np.int8(0)))
        start, end = edge[0::2], edge[1::2]
    power, inverse = _powers_to(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    v = (low[cp] if fold else cp).astype(np.uint64)
    v += np.uint64(1)
    v *= power[:n]
    np.cumsum(v, out=total[1:])
    del v
    h = total[end]
    h -= total[start]
    del total
    h *= inverse[start]
    return Words(mix(h), start, end, base, np.searchsorted(start, np.append(base, n + 1)), cp)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words inside one document, and the index of its first word."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w.hash[:m].copy()
    for i in range(1, n):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += w.hash[i : i + m]
    d = w.doc()
    at = np.flatnonzero(d[:m] == d[n - 1 :])
    return mix(h[at]), at


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE):
    """Consecutive slices of a batch with at most ``most`` bytes of text, one document at least, and their texts."""
    c = batch.column(batch.schema.get_field_index(column))
    total = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        part = batch.slice(at, to - at)
        yield part, c.slice(at, to - at).to_pylist()
        at = to
