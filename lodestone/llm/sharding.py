"""Sharding by extendible hashing.

A document's bucket is a prefix of its key's hash. One bucket of no bits holds everything; a bucket over the byte limit
splits on the next bit, and only that bucket, until every bucket fits. The directory has an entry for each prefix of as many
bits as the deepest bucket. Histograms of byte sums by prefix, taken a few bits at a time and only below buckets that are
still too large, tell the driver where to split: it sees sums of prefixes, about as many as there will be shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, col, fresh, whole_id

SHARD_BYTES = 64 << 20
HASH_BITS, STEP = 60, 4


def _hash(key):
    """60 bits of MD5, which any SQL engine can compute too."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def split(sizes: DataFrame, shard_bytes: int) -> list[tuple[int, int, int, int]]:
    """Leaves (prefix, depth, bytes, rows) over (h, bytes, rows), all of which fit shard_bytes unless they can't be split."""
    total, rows = sizes.agg(F.sum("bytes"), F.sum("rows")).first()
    if rows is None:
        return []
    if total <= shard_bytes:
        return [(0, 0, total, rows)]
    leaves, depth, large = [], 0, [0]
    # The first histogram reaches the depth at which an even spread would fit; later ones go STEP bits on.
    step = min(HASH_BITS, (total // shard_bytes).bit_length() + 1)
    spark = sizes.sparkSession
    while large:
        below = depth + step
        part = sizes
        if depth:
            over = spark.createDataFrame([(p,) for p in large], "prefix long")
            part = sizes.withColumn("prefix", F.shiftright("h", HASH_BITS - depth)).join(over, "prefix", "left_semi")
        level = {p: (b, n) for p, b, n in part.groupBy(F.shiftright("h", HASH_BITS - below).alias("prefix")).agg(F.sum("bytes"), F.sum("rows")).collect()}
        sums = {below: level}
        for d in range(below - 1, depth, -1):
            up: dict[int, tuple[int, int]] = {}
            for p, (b, n) in sums[d + 1].items():
                ob, on = up.get(p >> 1, (0, 0))
                up[p >> 1] = (ob + b, on + n)
            sums[d] = up
        front = large
        for d in range(depth + 1, below + 1):
            front, before = [], front
            for p in (c for q in before for c in (2 * q, 2 * q + 1)):
                b, n = sums[d].get(p, (0, 0))
                if b > shard_bytes and d < HASH_BITS:
                    front.append(p)
                else:
                    leaves.append((p, d, b, n))
        large, depth, step = front, below, min(STEP, HASH_BITS - below)
    return leaves


def look_up(rows: DataFrame, h: str, leaves: list[tuple[int, int, int, int]], shard: str, depth: str, total: str) -> DataFrame:
    """rows with their shard, its depth and its bytes in columns of those names. ``h`` is the column of the hash, and goes.

    The directory has an entry for each prefix of as many bits as the deepest bucket has. A few deep buckets would blow it up: then the
    hashes at which buckets begin are searched instead. Either is a few numbers a shard, and travels with the tasks; rows stay where they are.
    """
    kept = [col(c) for c in rows.columns if c != h]
    if not leaves:
        return rows.select(*kept, F.lit("").alias(shard), F.lit(0).alias(depth), F.lit(0).cast("long").alias(total))
    made = sorted((p << (HASH_BITS - d), d, b) for p, d, b, _ in leaves)
    begins, depths, sizes = (np.array(x, np.int64) for x in zip(*made))
    deepest = int(depths.max())
    directory = np.searchsorted(begins, np.arange(1 << deepest, dtype=np.int64) << (HASH_BITS - deepest), "right") - 1 if 1 << deepest <= 4 * len(leaves) else None

    def find(hashes: pa.Array) -> pa.Array:
        own = hashes.to_numpy(zero_copy_only=False)
        leaf = np.searchsorted(begins, own, "right") - 1 if directory is None else directory[own >> (HASH_BITS - deepest)]
        return pa.StructArray.from_arrays([pa.array(depths[leaf].astype(np.int32)), pa.array(sizes[leaf])], ["depth", "bytes"])

    (found,) = fresh(rows, "found")
    placed = rows.withColumn(found, F.arrow_udf(find, "depth int, bytes long")(col(h)))
    d = col(found)["depth"]
    prefix = F.expr(f"shiftright(`{h}`, {HASH_BITS} - `{found}`.depth)")
    name = F.when(d == 0, F.lit("")).otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), d, F.lit("0")))
    return placed.select(*kept, name.alias(shard), d.alias(depth), col(found)["bytes"].alias(total))


def _measured(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """A row's key as it is hashed, and its size."""
    return _hash(whole_id(docs, id_col)), F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long")


def _leaves(rows: DataFrame, h: Column, size: Column, shard_bytes: int) -> list[tuple[int, int, int, int]]:
    if shard_bytes < 1:
        raise ValueError("shard_bytes must be positive")
    sizes = rows.groupBy(h.alias("h")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return [x for x in split(checkpoint(sizes), shard_bytes) if x[3]]


def shard(docs: DataFrame, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes) for every row: shard is the hash prefix, as a string of depth bits.

    n_bytes is the text's UTF-8 length, 0 if null. Rows with the same doc_id, or with none, always share a shard. A
    bucket that no bit divides (one document over the limit, or rows repeated under one doc_id) ends at 60 bits, over the
    limit, and shard_bytes shows it. A bucket left empty by a split has no rows. Ids are whole numbers. Other columns are
    ignored; an empty table gives an empty result.
    """
    h, size = _measured(docs, id_col, text_col)
    rows = checkpoint(docs.select(whole_id(docs, id_col).alias("doc_id"), size.alias("n_bytes"), h.alias("h")))
    return look_up(rows, "h", _leaves(rows, F.col("h"), F.col("n_bytes"), shard_bytes), "shard", "depth", "shard_bytes")


def write_shards(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> None:
    """Write docs under ``path``, all rows and columns as they are, in a folder shard_col=PREFIX for each shard (of no bits: the default name).

    Null, empty and long texts, nulls in ids and repeated rows go as in :func:`shard`. A column of docs called shard_col raises
    ValueError, as the folders need the name. An empty table writes no shard. The texts are shuffled once, straight to
    their shard.
    """
    if shard_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {shard_col} already: choose another shard_col")
    key, depth, total = fresh(docs, "hash", "depth", "total")
    h, size = _measured(docs, id_col, text_col)
    leaves = _leaves(docs, h, size, shard_bytes)
    placed = look_up(docs.withColumn(key, h), key, leaves, shard_col, depth, total).drop(depth, total)
    # Shards are of one size at most: as many tasks as there are shards get about one each.
    parts = max(len(leaves), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed.repartition(parts, col(shard_col)).write.partitionBy(shard_col).parquet(path)
