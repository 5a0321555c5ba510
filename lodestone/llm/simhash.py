"""Near-duplicate documents by SimHash and deletion-variant signatures.

A document's signature of segments * width bits is the sign of the sum of the hashes of its distinct words, each with one vote. It
is cut into fewer segments than bits may differ: two that differ in at most 2 * segments - 1 bits have a segment that differs by
one bit at most, so that they share a variant of it with one bit taken out. Pairs further apart are still found with a
probability that falls with the distance; :func:`layout` chooses the number of segments for the recall of pairs at NEAR and the
width for the size of the corpus. Measured recall is in the README.

Two segments that differ by one bit agree in one of their halves. So the index is laid out by segment and half: a document goes twice
for each segment to the rows that share that half, and there its one-wildcard variants of the other half meet their equals. That
moves 2 rows for each segment in place of ``width``. A cell of more than HOT rows is split into blocks, and each pair of blocks is
a cell of its own: nothing is left out, and no task holds more than two blocks.

Candidates that an independent signature of 128 bits doesn't rule out are verified by the exact Jaccard similarity of their three-word
shingles. A document goes only for a kept one that is similar to it (not for one that it reaches by a chain): documents with more
links are decided first, ties by a hash, so that the copies around an original go for it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import greedy_survivors
from .common import checkpoint, col, fresh, join_small, whole_id
from .kernels import GOLDEN, bit_sums, mix64, ordered_words, spans, tidy, utf8

#: Shingle similarity from which documents are near copies, words of a shingle.
THRESHOLD, SHINGLE = 0.5, 3
#: Share of bits in which pairs that must be found differ, and the share of them that may be missed; least width of a segment.
NEAR, MISS, WIDTH = 0.11, 0.0012, 28
#: Bits of 128 by which a candidate may differ in the second signature; unrelated texts differ in 64, those at the threshold in 20.
APART = 44
#: Rows of a cell that one task handles at most, candidates at a time, documents that are verified together.
HOT, PAIR_ROWS, UNIT_DOCS = 1 << 17, 1 << 18, 1024
POSTS = "k long, part int, own int, other long, id long, c0 long, c1 long"


def layout(n: int, width: int | None = None) -> tuple[int, int]:
    """(segments, width) for n documents: chance candidates stay a few for each document, recall at NEAR stays 1 - MISS."""
    if width is None:
        width = max(WIDTH, math.ceil(math.log2(max(n, 2))) + 8)
        width += width % 2
    if width % 2 or not 4 <= width <= 60:
        raise ValueError("width is an even number from 4 to 60")
    seen = (1 - NEAR) ** width * (1 + width * NEAR / (1 - NEAR))
    return math.ceil(math.log(MISS) / math.log(1 - seen)), width


# -- what each text is reduced to


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word of a row once, rows in order."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
    return h[new], row[new]


def content(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """128 bits for each row that stand for its words in their order."""
    out = np.zeros((n, 2), np.uint64)
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
    if len(begin):
        place = (np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))).astype(np.uint64) * GOLDEN
        for k in range(2):
            out[row[begin], k] = np.add.reduceat(mix64((h ^ np.uint64(k * 0x5DEECE66D)) + place), begin)
    return out.view(np.int64)


def signatures(data: np.ndarray, off: np.ndarray, segments: int, width: int) -> tuple[np.ndarray, ...]:
    """(packed bits, check words, content, number of words) of each row."""
    n, size = len(off) - 1, segments * width
    words = -(-size // 64)
    bits, check = np.zeros((n, (size + 7) // 8), np.uint8), np.zeros((n, 2), np.int64)
    same, count = np.zeros((n, 2), np.int64), np.zeros(n, np.int64)
    for i, j in spans(off):
        h, row = ordered_words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        same[i:j], count[i:j] = content(h, row, j - i), np.bincount(row, minlength=j - i)
        h, row = distinct(h, row)
        total = np.bincount(row, minlength=j - i)
        sums = bit_sums(h, row, j - i, words + 2, 0)
        bits[i:j] = np.packbits(2 * sums[:, :size] > total[:, None], axis=1)
        check[i:j] = np.packbits(2 * sums[:, 64 * words :] > total[:, None], axis=1).view(">i8").astype(np.int64)
    return bits, check, same, count


def shingles(h: np.ndarray) -> np.ndarray:
    """The distinct hashes of the runs of SHINGLE words; of all words, if there are fewer."""
    if not len(h):
        return h
    k = min(SHINGLE, len(h))
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = mix64(out) + h[j : len(h) - k + 1 + j]
    return np.unique(mix64(out))


def _sign(segments: int, width: int):
    def sign(batches):
        for batch in batches:
            bits, check, same, count = signatures(*utf8(batch.column(1)), segments, width)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits.shape[1]), len(bits), [None, pa.py_buffer(np.ascontiguousarray(bits))]).cast(pa.binary())
            cols = [batch.column(0), *(pa.array(np.ascontiguousarray(x[:, k])) for x in (same, check) for k in range(2)), packed]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "d0", "d1", "c0", "c1", "bits"]).filter(pa.array(count > 0))

    return tidy(sign)


@tidy
def _shingle_sets(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            h, row = ordered_words(*utf8(part.column(1)))
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            sets = [shingles(h[x:y]).tobytes() for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "s"])


# -- candidates


def _post(segments: int, width: int):
    """Two rows for each segment: under each of its halves, with the other."""
    half = width // 2
    low, power = np.int64((1 << half) - 1), np.int64(1) << np.arange(width - 1, -1, -1, dtype=np.int64)

    def post(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                n = batch.num_rows
                raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, -1)
                segs = np.unpackbits(raw, axis=1)[:, : segments * width].reshape(n, segments, width) @ power
                number = np.arange(segments, dtype=np.int64)[None, :]
                k = np.concatenate([(2 * number << half) | (segs >> half), (2 * number + 1 << half) | (segs & low)], 1)
                other = np.concatenate([segs & low, segs >> half], 1)
                each = lambda c: np.repeat(batch.column(c).to_numpy(), 2 * segments)  # noqa: E731, B023
                none = np.zeros(k.size, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k.ravel(), none, none, other.ravel(), each(0), each(1), each(2))], names=["k", "part", "own", "other", "id", "c0", "c1"])

    return tidy(post)


def whole_keys(batches, least: int = 1 << 16):
    """Arrays of rows sorted by the first two columns, such that no such key is in two of them."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held.append(now)
        rows += len(now[0])
        if rows < least:
            continue
        now = [np.concatenate(x) for x in zip(*held)]
        before = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = int(before[-1]) + 1 if len(before) else 0
        if cut:
            yield [c[:cut] for c in now]
        held = [[c[cut:] for c in now]]
        rows = len(now[0]) - cut
        least = max(least, 2 * rows) if not cut else 1 << 16
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _meet(width: int):
    """The pairs of a cell whose other halves are equal (in cells of first halves) or share a one-wildcard variant."""
    half = width // 2

    def expand(at, lo, hi, cell):
        k, part, own, ids, c0, c1 = cell
        keep = hi > lo
        at, lo, count = at[keep], lo[keep], (hi - lo)[keep]
        ends = np.cumsum(count)
        a = 0
        while a < len(at):
            done = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + PAIR_ROWS, "right")))
            c = count[a:b]
            left = np.repeat(at[a:b], c)
            right = np.repeat(lo[a:b] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            ok = (ids[left] != ids[right]) & ((part[left] == 0) | (part[left] >> 15 == part[left] & 0x7FFF) | (own[left] != own[right]))
            left, right = left[ok], right[ok]
            far = np.bitwise_count(c0[left] ^ c0[right]).astype(np.int16) + np.bitwise_count(c1[left] ^ c1[right])
            left, right = ids[left[far <= APART]], ids[right[far <= APART]]
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], names=["a", "b"])
            a = b

    def meet(batches):
        for k, part, own, other, ids, c0, c1 in whole_keys(batches):
            number = np.cumsum(np.append(False, (k[1:] != k[:-1]) | (part[1:] != part[:-1])))
            base = number << half | other
            order = np.argsort(base, kind="stable")
            base = base[order]
            cell = [x[order] for x in (k, part, own, ids, c0.view(np.uint64), c1.view(np.uint64))]
            start = np.flatnonzero(np.append(True, base[1:] != base[:-1]))
            end = np.append(start[1:], len(base))
            values = base[start]
            rows = np.arange(len(base))
            equal = np.flatnonzero(cell[0] >> half & 1 == 0)
            yield from expand(equal, rows[equal] + 1, np.repeat(end, end - start)[equal], cell)
            for j in range(half):
                at = rows[base >> j & 1 == 0]
                target = base[at] | np.int64(1 << j)
                to = np.minimum(np.searchsorted(values, target), len(values) - 1)
                hit = values[to] == target
                yield from expand(at[hit], start[to[hit]], end[to[hit]], cell)

    return tidy(meet)


def candidate_pairs(reps: DataFrame, segments: int, width: int, hot: int = HOT) -> DataFrame:
    """Distinct pairs a < b of (doc_id, c0, c1, bits) that share a variant of a segment and that the second signature allows."""
    posts = reps.select("doc_id", "c0", "c1", "bits").mapInArrow(_post(segments, width), POSTS)
    if reps.count() > hot:
        # At most 2 * segments * 2^(width/2) keys, summed before the shuffle; hot ones are few: each holds over ``hot`` rows.
        crowded = posts.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
        crowded = checkpoint(crowded.select(F.col("k").alias("hot_k"), F.ceil(F.col("n") / hot).cast("int").alias("parts")))
        if not crowded.isEmpty():
            split = join_small(posts, crowded, F.col("k") == F.col("hot_k"), "left")
            own = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
            split = split.withColumn("own", own).withColumn("x", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
            part = (F.least("own", "x") * F.lit(1 << 15) + F.greatest("own", "x")).cast("int")
            posts = split.select("k", part.alias("part"), "own", "other", "id", "c0", "c1")
    ordered = posts.repartition("k", "part").sortWithinPartitions("k", "part")
    return ordered.mapInArrow(_meet(width), "a long, b long").distinct()


# -- verification


def _judge(threshold: float):
    """Over rows (unit, part, kind, a, b, s) sorted so that a unit's sets (kind 0) come before its pairs: (a, b, similarity)."""

    def judge(batches):
        now, sets = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, part, kind, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            found = []
            edge = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1]) | (a[1:] != a[:-1])))
            for i, j in zip(edge, [*edge[1:], len(unit)]):
                if (unit[i], part[i]) != now:
                    now, sets = (unit[i], part[i]), {}
                if kind[i] == 0:
                    # Rows that repeat a doc_id with other texts give it several sets.
                    sets[a[i]] = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(5).slice(i, j - i)]
                    continue
                others = [(y, s) for y in b[i:j] for s in sets[y]]
                sizes = np.array([len(s) for _, s in others])
                every, first = np.concatenate([s for _, s in others]), np.cumsum(sizes) - sizes
                for own in sets[a[i]]:
                    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
                    shared = np.add.reduceat((own[at] == every).astype(np.int64), first)
                    found += [(a[i], y, x) for (y, _), x in zip(others, shared / (len(own) + sizes - shared)) if x >= threshold]
            if found:
                x, y, s = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    return tidy(judge)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, unit_docs: int = UNIT_DOCS) -> DataFrame:
    """(a, b) of the pairs whose shingles have at least that Jaccard similarity; texts are (doc_id, text).

    Pairs are brought together by the least document near their first one, so that each document's set goes once to all its pairs
    there; a gathering of more than unit_docs documents is cut into blocks, and each two blocks meet apart.
    """
    both = pairs.select(F.col("a").alias("d"), F.col("b").alias("o")).union(pairs.select(F.col("b").alias("d"), F.col("a").alias("o")))
    label = both.groupBy("d").agg(F.least(F.min("o"), F.first("d")).alias("unit"))
    placed = pairs.join(label, F.col("a") == F.col("d")).select("unit", "a", "b")
    docs = placed.select("unit", F.explode(F.array("a", "b")).alias("d")).distinct().groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / unit_docs).cast("int").alias("parts"))
    place = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    placed = checkpoint(placed.join(docs, "unit").select("unit", (place("a") * F.col("parts") + place("b")).cast("int").alias("part"), "a", "b"))
    needed = placed.select("unit", "part", F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = checkpoint(needed.select(F.col("id").alias("doc_id")).distinct())
    sets = join_small(texts, ids, "doc_id", "left_semi").mapInArrow(_shingle_sets, "id long, s binary").distinct()
    rows = needed.join(sets, "id").select("unit", "part", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "s")
    rows = rows.union(placed.select("unit", "part", F.lit(1), "a", "b", F.lit(None).cast("binary")))
    ordered = rows.repartition("unit", "part").sortWithinPartitions("unit", "part", "kind", "a", "b")
    return ordered.mapInArrow(_judge(threshold), "a long, b long, similarity double").select("a", "b").distinct()


def _shuffled(doc_id: Column) -> Column:
    return F.md5(doc_id.cast("string").cast("binary"))


def classes_and_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int | None = None, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id) of every document, and the near pairs a < b of classes; see :func:`near_duplicates`."""
    narrow = docs.select(whole_id(docs, id_col).alias("doc_id"), F.lower(col(text_col)).alias("text")).where("doc_id is not null")
    texts = narrow.where(F.length("text") > 0)
    n = docs.count()
    segments, width = layout(n, width)
    signed = checkpoint(texts.mapInArrow(_sign(segments, width), "doc_id long, d0 long, d1 long, c0 long, c1 long, bits binary"))
    classes = signed.groupBy("d0", "d1").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    # A document's class, where that isn't named after it. Only classes of several rows can have such.
    several = checkpoint(classes.where("n > 1").drop("n"))
    copies = join_small(signed.select("doc_id", "d0", "d1"), several, ["d0", "d1"], "inner").where("doc_id <> class_id")
    copies = copies.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_anti")
    copies = checkpoint(copies.groupBy("doc_id").agg(F.min("class_id").alias("class_id")))
    reps = checkpoint(signed.join(copies.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id", "d0", "d1"]))
    near = checkpoint(verified(checkpoint(candidate_pairs(reps, segments, width, hot)), texts, threshold))
    ids = narrow.select("doc_id").distinct().join(copies, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return ids, near


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, class_id, n_links, group_id, keep) for every document.

    class_id is the least doc_id of those with the same words in the same order (case and punctuation aside); n_links is the number of
    classes that are near to this one, that is of shingle similarity ``threshold`` or more; group_id is the document that is kept for
    this one: itself, or the least kept one of those near it. keep: group_id is its own doc_id.

    Whole texts count, at any length. A null, empty or wordless text is like no other and is a class of its own. Rows that
    repeat a doc_id are one document: one output row; if their texts differ, a link of one is a link of the document. Rows
    without doc_id can't be named and are left out (``drop_near_duplicates`` keeps them). Of documents with as many links a
    hash says which is kept. Ids are whole numbers. Other columns are ignored. An empty table gives an empty result.
    """
    ids, near = classes_and_links(docs, id_col, text_col, threshold, width, hot)
    both = near.union(near.select("b", "a"))
    links = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_links")).withColumn("turn", F.struct(-F.col("n_links"), _shuffled(F.col("id")), F.col("id"))))
    turn = lambda c: links.select(F.col("id").alias(c), F.col("turn").alias(f"{c}_turn"))
    after = F.col("a_turn") < F.col("b_turn")
    ordered = near.join(turn("a"), "a").join(turn("b"), "b").select(F.when(after, F.col("a")).otherwise(F.col("b")).alias("i"), F.when(after, F.col("b")).otherwise(F.col("a")).alias("j"))
    ordered = checkpoint(ordered)
    kept = checkpoint(greedy_survivors(links.select(F.col("id").alias("doc_id")), ordered)).select(F.col("doc_id").alias("i"))
    lost = ordered.join(kept, "i", "left_semi").groupBy(F.col("j").alias("id")).agg(F.min("i").alias("kept_id"))
    told = checkpoint(links.select("id", "n_links").join(lost, "id", "left"))
    out = join_small(ids, told, F.col("class_id") == F.col("id"), "left").withColumn("group_id", F.coalesce("kept_id", "class_id"))
    return out.select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "group_id", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns as they were, with one document of each near-duplicate group.

    Rows that share a kept doc_id all stay (ties are decided as in ``near_duplicates``), and so do rows without doc_id and without words.
    An empty table stays empty.
    """
    (gone,) = fresh(docs, "gone")
    losers = checkpoint(near_duplicates(docs, id_col, text_col, threshold).where("not keep").select(F.col("doc_id").alias(gone)))
    return join_small(docs, losers, whole_id(docs, id_col) == F.col(gone), "left_anti", 48)
