"""Packing documents along a space-filling curve.

A document's words are hashed into a vector of HASH_DIMS signed counts, which is scaled to unit length and projected by a
fixed Gaussian matrix to DIMS numbers; the Hilbert index of their quantiles is its key. Documents in the order of (key,
doc_id) are laid end to end and cut into packs of ``pack_tokens`` tokens, so that each pack but the last is full and holds
neighbours on the curve. A document's place is a running total over range partitions of narrow rows; from those totals come
the cuts, balanced in tokens, by which the texts are then shuffled once, straight to the task that packs them.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, col, ordered_sums, whole_id
from .kernels import safe_cuts, spans, tidy, utf8, word_hashes

PACK_TOKENS, DIMS, BITS, HASH_DIMS = 2048, 4, 10, 256
PROJECTION = np.random.Generator(np.random.PCG64(20240229)).standard_normal((HASH_DIMS, DIMS))
SPACE = np.array([chr(b) in " \t\n\r\f" for b in range(256)])


def vectors(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Projected unit vectors of hashed words, in lower case ASCII; zeros where there is no word."""
    n = len(off) - 1
    out = np.zeros((n, DIMS))
    for i, j in spans(off):
        lo, hi, total = off[i], off[j], np.zeros((j - i) * HASH_DIMS)
        cuts = safe_cuts(data[lo:hi]) if j == i + 1 else [0, hi - lo]
        for a, b in zip(cuts, cuts[1:]):
            part = data[lo + a : lo + b]
            part = part + np.uint8(32) * ((part >= 65) & (part <= 90))
            h, row = word_hashes(part, np.array([0, b - a]) if j == i + 1 else off[i : j + 1] - lo)
            sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(np.float64)
            total += np.bincount(row * HASH_DIMS + (h & np.uint64(HASH_DIMS - 1)).astype(np.int64), sign, len(total))
        total = total.reshape(-1, HASH_DIMS)
        # Products and sums are rounded so that the key can't hang on the order of additions.
        out[i:j] = np.round(total @ PROJECTION / np.maximum(np.sqrt((total * total).sum(1)), 1)[:, None], 9)
    return out


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of integer points (n, dims), each coordinate of ``bits`` bits; Skilling's transform."""
    x = [c.astype(np.int64).copy() for c in points.T]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for k in range(n):
            flip = (x[k] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[k]) & (q - 1))
            x[0] = np.where(flip, x[0] ^ (q - 1), x[0] ^ swap)
            x[k] = x[k] ^ swap
        q >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            key = key << 1 | ((x[k] ^ t) >> b & 1)
    return key


def curve_keys(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    # A projection of a random unit vector is about normal: the logistic curve spreads it over the grid.
    unit = 1 / (1 + np.exp(-1.702 * vectors(data, off)))
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def token_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens start, and their rows. A token is a word with the white space after it; what leads a text goes with its first."""
    begin = ~SPACE[data]
    begin[1:] &= SPACE[data[:-1]]
    edge = off[:-1][off[:-1] < off[1:]]
    begin[edge] = ~SPACE[data[edge]]
    at = np.flatnonzero(begin)
    row = np.searchsorted(off, at, "right") - 1
    # The first token of a text starts where the text does, and a text of white space alone is one token.
    first = np.ones(len(at), bool)
    first[1:] = row[1:] != row[:-1]
    at[first] = off[row[first]]
    blank = np.setdiff1d(np.searchsorted(off, edge, "right") - 1, row[first])
    if len(blank):
        at, row = np.append(at, off[blank]), np.append(row, blank)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
    return at, row


@tidy
def _measure(batches):
    for batch in batches:
        data, off = utf8(batch.column(1))
        n = len(off) - 1
        tokens = np.zeros(n, np.int64)
        for i, j in spans(off, 4 << 20):
            tokens[i:j] = np.bincount(token_starts(data[off[i] : off[j]], off[i : j + 1] - off[i])[1], minlength=j - i)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(curve_keys(data, off)), pa.array(tokens)], names=["doc_id", "tie", "curve", "n_tokens"])


NO_ID = -(1 << 63)


def _route(cuts: list[tuple[int, int, int]]):
    """Adds the partition of each row: the last cut (curve, doc_id, tie) that isn't above it."""
    firsts = np.array([c[0] for c in cuts], np.int64)

    def route(batches):
        for batch in batches:
            curve = curve_keys(*utf8(batch.column(1)))
            low, high = np.searchsorted(firsts, curve, "left"), np.searchsorted(firsts, curve, "right")
            part = np.maximum(high - 1, 0)
            for r in np.flatnonzero(high > low):
                own = (int(curve[r]), batch.column(0)[r].as_py(), batch.column(2)[r].as_py())
                own = (own[0], NO_ID if own[1] is None else own[1], own[2])
                part[r] = max(bisect_right(cuts, own, int(low[r]), int(high[r])) - 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(curve), batch.column(0), batch.column(2), batch.column(1)], names=["part", "curve", "doc_id", "tie", "text"])

    return tidy(route)


def _cut(bases: list[int], pack_tokens: int):
    def cut(batches):
        part, done = None, 0
        for whole in batches:
            if not whole.num_rows:
                continue
            parts = whole.column(0).to_numpy(zero_copy_only=False)
            data_all, off_all = utf8(whole.column(4))
            edges = set(np.flatnonzero(np.append(True, parts[1:] != parts[:-1])))
            for i, j in ((a, b) for p, q in zip(sorted(edges), [*sorted(edges)[1:], len(parts)]) for a, b in ((p + x, p + y) for x, y in spans(off_all[p : q + 1], 8 << 20))):
                if parts[i] != part:
                    part, done = parts[i], bases[parts[i]]
                data, off = data_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
                at, row = token_starts(data, off)
                if not len(at):
                    continue
                place = done + np.arange(len(at))
                done += len(at)
                fresh_row = np.append(True, row[1:] != row[:-1])
                begin = np.flatnonzero(fresh_row | (place % pack_tokens == 0))
                first = np.flatnonzero(fresh_row)
                start = begin - first[np.searchsorted(first, begin, "right") - 1]
                offsets = np.append(at[begin], len(data)).astype(np.int64)
                text = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[begin] // pack_tokens), pa.array(place[begin] % pack_tokens), whole.column(2).take(pa.array(i + row[begin])), pa.array(start), pa.array(np.diff(np.append(begin, len(at)))), text],
                    names=["pack_id", "position", "doc_id", "start", "n_tokens", "text"],
                )

    return tidy(cut)


def pack(docs: DataFrame, pack_tokens: int = PACK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pack_id, position, doc_id, start, n_tokens, text): the pieces of documents that fill each pack.

    position is the piece's first token in its pack and start in its document; a document's pieces, by start, make up its
    text exactly. A token is a word between ASCII white space with the white space after it. Packs are numbered along the
    curve and all but the last hold pack_tokens tokens. Null and empty texts have no pieces; a document without words has the
    key of the zero vector. Documents that tie on the curve follow by doc_id (null first), then by a hash of the text;
    repeated rows are packed each time they occur. Other columns are ignored; an empty table gives no packs.
    """
    if pack_tokens < 1:
        raise ValueError("pack_tokens must be positive")
    rows = docs.select(whole_id(docs, id_col).alias("doc_id"), col(text_col).alias("text")).where("text <> ''").withColumn("tie", F.xxhash64("text")).select("doc_id", "text", "tie")
    measured = rows.mapInArrow(_measure, "doc_id long, tie long, curve long, n_tokens long")
    order = ["curve", "id", "tie"]
    measured = measured.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).groupBy(*order).agg(F.sum("n_tokens").alias("n_tokens"))
    placed = ordered_sums(checkpoint(measured), order, "n_tokens", "upto").withColumn("before", F.col("upto") - F.col("n_tokens"))
    placed = checkpoint(placed)
    total = placed.agg(F.max("upto")).first()[0] or 0
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # One row for each partition of the shuffle below: where it begins on the curve, and how many tokens come before it.
    cuts = placed.groupBy(F.expr(f"before div {max(1, -(-total // parts))}").alias("p")).agg(F.min(F.struct(*order)).alias("first"), F.min("before").alias("base")).orderBy("p").collect()
    keys, bases = [tuple(c["first"]) for c in cuts] or [(0, NO_ID, 0)], [c["base"] for c in cuts] or [0]
    routed = rows.mapInArrow(_route(keys), "part int, curve long, doc_id long, tie long, text string")
    sorted_rows = routed.repartitionById(len(keys), F.col("part")).sortWithinPartitions("part", "curve", "doc_id", "tie")
    return sorted_rows.mapInArrow(_cut(bases, pack_tokens), "pack_id long, position long, doc_id long, start long, n_tokens long, text string")
