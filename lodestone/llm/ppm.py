"""Language-model scoring by prediction by partial matching.

The model is a trie of byte contexts of up to ORDER bytes, with the count of every byte that followed each. It is
gathered from all documents, and kept as the counts of its longest paths, (ORDER + 1)-grams of nine-bit symbols in which
256 stands before a text's first byte; every shorter context is a suffix sum of those. A byte is coded in its longest
context; a context that hasn't seen it is left by an escape (method C: as likely as the number of distinct bytes seen), and
the bytes it has seen are excluded from the next shorter one; last comes the uniform distribution over bytes never seen.

Every document is scored by a model that hasn't seen its text: texts fall by their hash into two folds, and each fold is
coded by the counts of the other. (So copies of a text can't vouch for it.) Because the set of bytes excluded depends on
the context alone, the code length of each (ORDER + 1)-gram can be tabulated once, by tasks that each take some two-byte
contexts with everything above them (at most 257 * 257 * 256 grams each, however much text there is); a document's score is
then a sum of table entries, in exact fixed-point bits.

Neither grams nor table pass through the driver. Texts are shuffled once into blocks of about block_bytes. Each block sends its
distinct grams with their counts, by gram; there they are summed, tabulated by context, and joined with the code lengths; and
these go back to the block, where a hash table of its own grams codes its texts. What moves is the texts once and the distinct
grams of each block twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, whole_id
from .kernels import release, tidy, utf8

ORDER, SYMBOL = 4, 9
#: Bytes of text in a block: its distinct grams are held by one task.
BLOCK_BYTES = 16 << 20
UNIT = 1 << 20  # fixed-point units in a bit
BLOCK = 1 << 20
FLUSH_ROWS = 1 << 21
ROOTS = 257 * 256


def grams(data: np.ndarray, off: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The grams that end at bytes begin..end-1."""
    at = np.arange(begin, end)
    starts = off[:-1]
    depth = at - starts[np.searchsorted(off, at, "right") - 1] if len(starts) > 1 else at - starts[0]
    key = data[begin:end].astype(np.int64)
    for k in range(1, ORDER + 1):
        before = np.full(end - begin, 256, np.int64)
        lo = min(max(begin, k), end)
        before[lo - begin :] = data[lo - k : end - k]
        before[depth < k] = 256
        key |= before << (SYMBOL * k)
    return key


def blocks(off: np.ndarray):
    """Ranges of bytes, whatever the texts they cut: context reaches back across a cut."""
    for a in range(0, int(off[-1]), BLOCK):
        yield a, min(a + BLOCK, int(off[-1]))


def rows_of(off: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The row of each byte in begin..end-1."""
    first, last = np.searchsorted(off, [begin, end - 1], "right") - 1
    inner = np.clip(off[first : last + 2], begin, end)
    return np.repeat(np.arange(first, last + 1), np.diff(inner))


def _sum_by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values, first)


@tidy
def _count_pairs(batches):
    """(pair, n0, n1) over rows (fold, text): how often each byte follows each (256: the start) in texts of either fold."""
    total = np.zeros(2 * ROOTS, np.int64)
    for batch in batches:
        data, off = utf8(batch.column(1))
        fold = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.empty(len(data), np.int64)
        before[1:] = data[:-1]
        before[off[:-1][off[:-1] < len(data)]] = 256
        for a, b in blocks(off):
            total += np.bincount(fold[rows_of(off, a, b)] * ROOTS + before[a:b] * 256 + data[a:b], minlength=2 * ROOTS)
    at = np.flatnonzero(total.reshape(2, ROOTS).any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(total[ROOTS + at])], names=["pair", "n0", "n1"])


def _count(weight: int):
    """Counts (block, gram, n0, n1) over rows (block, doc_id, fold, tie, text) sorted by block: n0 in fold 0, n1 in fold 1, times weight (0: the grams alone)."""
    fold_bit = SYMBOL * (ORDER + 1)

    def emit(block, keys, counts):
        gram, fold = keys & ((1 << fold_bit) - 1), keys >> fold_bit
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        n = [np.add.reduceat(np.where(fold == f, counts * weight, 0), first).astype(np.int32) for f in range(2)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), block, np.int32)), pa.array(gram[first]), pa.array(n[0]), pa.array(n[1])], names=["block", "gram", "n0", "n1"])

    def summed(held):
        keys, counts = _sum_by_key(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        order = np.argsort(keys & ((1 << fold_bit) - 1), kind="stable")
        return keys[order], counts[order]

    def count(batches):
        now, held, size = None, [], 0
        for whole in batches:
            number = whole.column(0).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(number)])
            for i, j in zip(edge, [*edge[1:], len(number)]):
                if number[i] != now and held:
                    yield emit(now, *summed(held))
                    held, size = [], 0
                now, batch = number[i], whole.slice(i, j - i)
                data, off = utf8(batch.column(4))
                fold = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                for a, b in blocks(off):
                    key = grams(data, off, a, b) | fold[rows_of(off, a, b)] << fold_bit
                    key.sort()
                    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    held.append((key[first], np.diff(np.append(first, len(key)))))
                    size += len(first)
                    if size > FLUSH_ROWS:
                        held = [summed(held)]
                        size = len(held[0][0])
                        if size > FLUSH_ROWS // 2:
                            yield emit(now, *held[0])
                            held, size = [], 0
        if held:
            yield emit(now, *summed(held))

    return tidy(count)


def code_lengths(gram: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Bits of each gram's last byte in its context, under the counts n.

    gram is sorted and distinct and holds every gram that ends in the two-byte contexts it has; pairs[b, s] counts byte s
    after byte b (256: at the start), over everything.
    """
    levels = {}
    for k in range(ORDER, 1, -1):
        mask = (1 << SYMBOL * (k + 1)) - 1
        keys, inverse = np.unique(gram & mask, return_inverse=True)
        c = np.bincount(inverse, n, len(keys))
        contexts, of = np.unique(keys >> SYMBOL, return_inverse=True)
        levels[k] = dict(keys=keys, own=inverse, c=c, of=of, n=np.bincount(of, c, len(contexts)), d=np.bincount(of, c > 0, len(contexts)))
    levels[1] = dict(c=pairs, n=pairs.sum(1), d=(pairs > 0).sum(1).astype(float))
    root = pairs.sum(0)
    byte, symbol = gram >> SYMBOL & 511, gram & 511
    # What a context excludes from the next shorter one: the counts there of the bytes seen here.
    for k in range(ORDER, 0, -1):
        if k > 2:
            below = levels[k - 1]["c"][np.searchsorted(levels[k - 1]["keys"], levels[k]["keys"] & ((1 << SYMBOL * k) - 1))]
        elif k == 2:
            below = pairs[levels[2]["keys"] >> SYMBOL & 511, levels[2]["keys"] & 511]
        if k > 1:
            levels[k]["x"] = np.bincount(levels[k]["of"], np.where(levels[k]["c"] > 0, below, 0), len(levels[k]["n"]))
        else:
            levels[1]["x"] = ((pairs > 0) * root[None, :]).sum(1)
    bits, active = np.zeros(len(gram)), np.ones(len(gram), bool)
    x = d_seen = np.zeros(len(gram))
    for k in range(ORDER, -1, -1):
        if k > 1:
            at = levels[k]["own"]
            c, ctx = levels[k]["c"][at], levels[k]["of"][at]
            total, distinct, x_next = levels[k]["n"][ctx], levels[k]["d"][ctx], levels[k]["x"][ctx]
        elif k == 1:
            c, total, distinct, x_next = pairs[byte, symbol], levels[1]["n"][byte], levels[1]["d"][byte], levels[1]["x"][byte]
        else:
            c, total, distinct, x_next = root[symbol], np.full(len(gram), root.sum()), np.full(len(gram), float((root > 0).sum())), x
        left, fresh = total - x, distinct - d_seen
        hit, escape = active & (c > 0), active & (c <= 0) & (fresh > 0)
        bits[hit] += np.log2((left[hit] + fresh[hit]) / c[hit])
        bits[escape] += np.log2((left[escape] + fresh[escape]) / fresh[escape])
        active &= ~hit
        x, d_seen = x_next, distinct
    bits[active] += np.log2(256 - (root > 0).sum())
    return bits


def _tabulate(tables: list[np.ndarray]):
    """The table's rows (gram, u0, u1) of a partition: fixed-point bits for a text of fold 0, coded by fold 1, and the reverse."""

    def tabulate(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        gram, n0, n1 = (whole.column(k).to_numpy() for k in range(3))
        order = np.argsort(gram)
        gram, n0, n1 = gram[order], n0[order].astype(float), n1[order].astype(float)
        u0 = np.rint(code_lengths(gram, n1, tables[1]) * UNIT).astype(np.int32)
        u1 = np.rint(code_lengths(gram, n0, tables[0]) * UNIT).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(u0), pa.array(u1)], names=["gram", "u0", "u1"])

    return tidy(tabulate)


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def hash_table(keys: np.ndarray, v0: np.ndarray, v1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing with linear probing, at most half full: keys (-1: free) and the values of both folds, side by side."""
    bits = max(4, int(2 * len(keys) - 1).bit_length())
    slots, values = np.full(1 << bits, -1, np.int64), np.zeros((1 << bits, 2), np.int32)
    at, todo = ((keys.astype(np.uint64) * MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64), np.arange(len(keys))
    while len(todo):
        free = slots[at[todo]] == -1
        slots[at[todo[free]]] = keys[todo[free]]
        won = slots[at[todo]] == keys[todo]
        values[at[todo[won]], 0], values[at[todo[won]], 1] = v0[todo[won]], v1[todo[won]]
        todo = todo[~won]
        at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
    return slots, values


def look_up(slots: np.ndarray, values: np.ndarray, keys: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The value of each key for its fold; 0 for a key that the table lacks."""
    bits = int(len(slots) - 1).bit_length()
    at = ((keys.astype(np.uint64) * MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)
    got = slots[at]
    todo = np.flatnonzero((got != keys) & (got != -1))
    lacking = got == -1
    while len(todo):
        at[todo] = (at[todo] + 1) & (len(slots) - 1)
        got = slots[at[todo]]
        lacking[todo[got == -1]] = True
        todo = todo[(got != keys[todo]) & (got != -1)]
    out = values.reshape(-1)[2 * at + fold].astype(np.int64)
    out[lacking] = 0
    return out


def _score(texts: pa.Table, table: pa.Table) -> pa.Table:
    """The scores of a block's texts (block, doc_id, fold, tie, text) by its table (block, gram, u0, u1, ...)."""
    slots, values = hash_table(*(table.column(k).to_numpy() for k in range(1, 4)))
    data, off = utf8(texts.column(4))
    fold = texts.column(2).to_numpy().astype(np.int64)
    units = np.zeros(len(off) - 1, np.int64)
    for a, b in blocks(off):
        row = rows_of(off, a, b)
        got = look_up(slots, values, grams(data, off, a, b), fold[row])
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        units[row[first]] += np.add.reduceat(got, first)
    del slots, values
    release()
    return pa.table({"doc_id": texts.column(1), "n_bytes": pa.array(np.diff(off)), "units": pa.array(units)})


def score(docs: DataFrame, reference: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) for every row: its code length under the model.

    The model is made of docs' other fold, or of all of ``reference`` (a table with the same two columns) if given. Texts
    are coded whole, as UTF-8. Null and empty texts have no bytes, 0 bits and null bits_per_byte. Equal texts always have
    equal scores; repeated rows and rows without doc_id are scored each. With nothing to learn from, a byte takes 8 bits. Ids
    are whole numbers. Other columns are ignored; an empty table gives an empty result.
    """
    fold = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")

    def texts(df):
        return df.select(whole_id(df, id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))

    own = texts(docs)
    if reference is None:
        learned = own.where("text <> ''").select(fold.alias("fold"), "text")
    else:
        learned = texts(reference).where("text <> ''").select(F.lit(0).alias("fold"), "text")
    # At most 257 * 256 rows, however much text there is.
    tables = [np.zeros((257, 256)), np.zeros((257, 256))]
    for pair, a, b in learned.mapInArrow(_count_pairs, "pair long, n0 long, n1 long").groupBy("pair").agg(F.sum("n0"), F.sum("n1")).collect():
        tables[0].flat[pair], tables[1].flat[pair] = (a, b) if reference is None else (a, a)
    size = sum(t.sum() for t in tables) if reference is None else own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # The blocks of one text's copies, and of repeated rows, differ: a hot text is spread.
    parts = max(-(-int(size) // block_bytes), min(docs.sparkSession.sparkContext.defaultParallelism, int(size) >> 20), 1)
    block = F.pmod(F.xxhash64("doc_id", "tie", F.spark_partition_id()), F.lit(parts)).cast("int")
    placed = own.withColumn("fold", fold).withColumn("tie", F.xxhash64("text")).select(block.alias("block"), "doc_id", "fold", "tie", "text").repartition("block")
    kind = "block int, gram long, n0 int, n1 int"
    counts = placed.sortWithinPartitions("block").mapInArrow(_count(1 if reference is None else 0), kind)
    if reference is not None:
        other = learned.select(F.lit(-1).alias("block"), F.lit(0).cast("long").alias("doc_id"), "fold", F.lit(0).cast("long").alias("tie"), "text").mapInArrow(_count(1), kind)
        counts = counts.union(other.select("block", "gram", "n0", F.col("n0").alias("n1")))
    # Both of what follows read this one shuffle. For that they must use the same columns, and have the filter that a join implies.
    by_gram = counts.where("gram is not null").repartition("gram")
    context = F.expr(f"shiftright(gram, {SYMBOL}) & {(1 << 2 * SYMBOL) - 1}")
    summed = by_gram.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max("block").alias("block"))
    table = summed.repartition(context).mapInArrow(_tabulate(tables), "gram long, u0 int, u1 int")
    needed = by_gram if reference is None else by_gram.where("block >= 0")
    needed = needed.join(table.hint("shuffle_hash"), "gram").select("block", "gram", "u0", "u1", "n0", "n1")
    scored = placed.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(_score, "doc_id long, n_bytes long, units long")
    bits = F.col("units") / F.lit(float(UNIT))
    return scored.select("doc_id", "n_bytes", bits.alias("bits"), F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).alias("bits_per_byte"))
