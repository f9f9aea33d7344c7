"""Best-fit packing of documents into training sequences under three capacities.

Each bin takes at most WINDOW tokens, DOCS documents and ATTENTION attention cost
(the sum of squared lengths, as documents don't attend to each other). Pieces, the
longest first, go to the open bin that best fits under every constraint: by the
least weighted norm of what would be left (``norm``), or by the largest weighted
dot product of demand and residual (``dot``); a capacity's weight is the shard's
mean demand for it. A document of more than PIECE_TOKENS tokens is cut into pieces.

Documents are spread by their ids' hash over shards of about SHARD_PIECES pieces,
each packed by one task: a shard wastes less than one window.

Tokens are words and single signs, counted without a tokenizer; with ``tokenizer``
(a path of a tokenizers file) its tokens count instead.

Defined results: null and empty texts need no place and give no row; very long ones
are cut into pieces and packed whole; rows with a null id are packed and keep it;
repeated rows are packed each; ties go by id, piece and the bin opened first; an empty
table gives no bins; only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch
from .textops import _classes, pieces

WINDOW, DOCS, PIECE_TOKENS = 4096, 32, 2048
ATTENTION = 6_700_000
SHARD_PIECES = 20_000


def count_tokens(texts: list[str | None]) -> np.ndarray:
    """Words and single other signs of each text."""
    joined = "\n".join(t or "" for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    base = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
    if len(cp) == 0:
        return np.zeros(len(texts), np.int64)
    word = _classes(int(cp.max()))[0][cp]
    begins = ~word & (cp > 32) & (cp != 160)
    begins[0] |= word[0]
    begins[1:] |= word[1:] & ~word[:-1]
    total = np.concatenate(([0], np.cumsum(begins)))
    return np.diff(total[np.minimum(base, len(cp))])


def _sizes(tokenizer: str | None):
    def run(batches):
        known = None
        if tokenizer:
            from tokenizers import Tokenizer

            known = Tokenizer.from_file(tokenizer)
            known.encode_special_tokens = True
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                n = np.array([len(e.ids) for e in known.encode_batch([t or "" for t in texts], add_special_tokens=False)]) if known else count_tokens(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return run


def best_fit(tokens: np.ndarray, window: int = WINDOW, docs: int = DOCS, attention: int = ATTENTION, rule: str = "norm") -> np.ndarray:
    """Bin of each piece; pieces in the order in which they come. Every piece fits an empty bin."""
    demand = np.stack((tokens / window, np.full(len(tokens), 1 / docs), tokens.astype(np.float64) ** 2 / attention))
    weight = demand.mean(1) if len(tokens) else np.ones(3)
    least = demand.min(1) if len(tokens) else weight
    left, number, used, bins = np.empty((3, 1024)), np.empty(1024, np.int64), 0, 0
    out = np.empty(len(tokens), np.int64)
    eps = 1e-9
    for i in range(len(tokens)):
        v = demand[:, i]
        room = left[:, :used]
        after = room - v[:, None]
        fits = after.min(0) >= -eps if used else np.zeros(0, bool)
        if fits.any():
            if rule == "norm":
                s = weight @ (after * after)
                s[~fits] = np.inf
                j = int(s.argmin())
            else:
                s = (weight * v) @ room
                s[~fits] = -np.inf
                j = int(s.argmax())
            left[:, j] = after[:, j]
        else:
            if used == left.shape[1]:
                left = np.concatenate((left, np.empty_like(left)), 1)
                number = np.concatenate((number, np.empty_like(number)))
            j, used = used, used + 1
            left[:, j], number[j] = 1 - v, bins
            bins += 1
        out[i] = number[j]
        if (left[:, j] < least - eps).any():  # full for all that can still come; the order of the others stays
            left[:, j : used - 1] = left[:, j + 1 : used].copy()
            number[j : used - 1] = number[j + 1 : used].copy()
            used -= 1
    return out


_ROW = "bin_id long, slot int, doc_id long, piece int, first_token long, n_tokens int"


def _pack(window: int, docs: int, attention: int, piece: int, rule: str):
    def run(key, table):
        ids = table.column("doc_id").to_pylist()
        n = table.column("tokens").to_numpy()
        count = -(-n // piece)
        of = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(piece, n[of] - nth * piece)
        rank = np.empty(len(ids), np.int64)
        rank[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, n[i]))] = np.arange(len(ids))
        order = np.lexsort((nth, rank[of], -size))
        of, nth, size = of[order], nth[order], size[order]
        bins = best_fit(size, window, docs, attention, rule)
        order = np.argsort(bins, kind="stable")
        b = bins[order]
        slot = np.arange(len(b)) - np.searchsorted(b, b)
        of, nth, size = of[order], nth[order], size[order]
        return pa.table([pa.array((key[0].as_py() << 32) + b, pa.int64()), pa.array(slot.astype(np.int32)), pa.array([ids[i] for i in of], pa.int64()), pa.array(nth.astype(np.int32)), pa.array(nth * piece, pa.int64()), pa.array(size.astype(np.int32))], ["bin_id", "slot", "doc_id", "piece", "first_token", "n_tokens"])

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, most_docs: int = DOCS, attention: int = ATTENTION, piece: int = PIECE_TOKENS, rule: str = "norm", scratch: Scratch | None = None) -> DataFrame:
    """A row for each piece: its bin, its place there, its document, and which of the document's tokens it holds."""
    if piece > window or piece * piece > attention:
        raise ValueError("a piece must fit an empty bin")
    s = scratch or Scratch(spark, "packing")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = s.table(text.mapInArrow(_sizes(tokenizer), "doc_id long, tokens long").where("tokens > 0"), "sizes")
    total = sizes.agg(F.coalesce(F.sum(F.ceil(F.col("tokens") / piece)), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_PIECES))
    keyed = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(shards)))
    # as many tasks as shards, which are small and slow: nothing coalesces them
    return keyed.repartition(int(shards), "shard").groupBy("shard").applyInArrow(_pack(window, most_docs, attention, piece, rule), _ROW)
