"""Exact deduplication against a persistent digest index, bucketed and sorted by digest.

The index is a Parquet table of (digest, doc_id), clustered into buckets by digest and sorted within each. New
data is reduced to its own digests (with map-side combining, so a thousand copies leave a task as one row), anti-joined
by sort-merge with the index, whose bucketing saves it the shuffle, and what is left is appended. Texts never move:
only 32-byte digests and ids are shuffled.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, col, fresh, join_small, run_path, whole_id

#: Buckets to begin with, and digests in a bucket beyond which they double.
BUCKETS, BUCKET_ROWS = 64, 20_000_000


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes. Null texts are copies of one another, unlike any text: their digest is empty."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


class DigestIndex:
    """The table at ``path``, in any file system that Spark reads. It outlives the session; open it again by its path.

    Appends add sorted files to the buckets. ``compact`` makes one sorted file of each again. Buckets double, and double again, before
    one would hold more than bucket_rows digests.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.bucket_rows = spark, path.rstrip("/"), bucket_rows
        self._open(self._versions()[-1] if self._versions() else (0, buckets))

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[tuple[int, int]]:
        """(version, buckets) of the complete tables under the path. The first may still be empty."""
        fs, p = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        found = sorted(tuple(map(int, n[1:].split("x"))) for n in names if re.fullmatch(r"v[0-9]+x[0-9]+", n))
        has = lambda v, b: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}x{b}/_SUCCESS"))
        return [x for x in found if x[0] == 0 or has(*x)]

    def _open(self, version: tuple[int, int]) -> None:
        self.version, self.buckets = version
        self.place = f"{self.path}/v{self.version}x{self.buckets}"
        self.name = "digest_index_" + hashlib.md5(self.place.encode()).hexdigest()
        if not self.spark.catalog.tableExists(self.name):
            self.spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, doc_id BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.place}'"
            )

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def novel(self, digests: DataFrame) -> DataFrame:
        """The rows of ``digests`` whose digest isn't in the index."""
        return digests.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def _add(self, rows: DataFrame) -> None:
        rows = rows.select("digest", "doc_id").repartition(self.buckets, "digest")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def append(self, digests: DataFrame, novel: bool = False) -> None:
        """Add (digest, doc_id) rows. Appending rows again adds nothing: they are anti-joined first, unless they are known to be novel.

        ``digests``, if novel, should be materialised: they are counted, and more than the buckets are for makes more buckets first.
        """
        rows = digests if novel else checkpoint(self.novel(digests))
        n = rows.count()
        if self.table().count() + n > self.buckets * self.bucket_rows:
            self.compact(n)
        self._add(rows)

    def compact(self, coming: int = 0) -> None:
        """Rewrite the index with one sorted file a bucket, in buckets enough for ``coming`` rows more; the old version goes once the new one is complete."""
        rows, buckets, old = self.table(), self.buckets, (self.name, self.place)
        n = rows.count() + coming
        while n > buckets * self.bucket_rows:
            buckets *= 2
        kept = checkpoint(rows)
        self._open((self.version + 1, buckets))
        self._add(kept)
        self._drop(*old)

    def _drop(self, name: str, place: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        fs, p = self._fs(place)
        fs.delete(p, True)

    def delete(self) -> None:
        """Remove the index."""
        self._drop(self.name, self.path)


def firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, doc_id, n_copies): each distinct text, its least doc_id (null if none has one) and how many rows hold it."""
    rows = docs.select(digest(col(text_col)).alias("digest"), whole_id(docs, id_col).alias("doc_id"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))


def ingest(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate docs among themselves and against the index, append what is new, and return it.

    Result: (doc_id, digest in hex, n_copies), a row for each new distinct text. Empty texts are copies of one another, so
    are null texts (digest ''). Ties and repeated rows are one text. Other columns are ignored; an empty table adds nothing.
    """
    new = checkpoint(index.novel(firsts(docs, id_col, text_col)))
    index.append(new, novel=True)
    return new.select("doc_id", F.lower(F.hex("digest")).alias("digest"), "n_copies")


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns as they were, without texts in the index and with one row of each text; the index takes the new texts.

    Of equal texts the row with the least doc_id stays (rows without doc_id come last; of rows alike in that, the one
    whose other columns hash least, any one if they are equal throughout). Only rows of texts that occur twice, or that the
    index has, are shuffled: the others are kept where they lie.
    """
    d, n, rank = fresh(docs, "digest", "copies", "rank")
    counts = firsts(docs, id_col, text_col)
    known = index.table().select("digest", F.lit(True).alias("known"))
    counts = checkpoint(counts.join(known.hint("merge"), "digest", "left").select("digest", "doc_id", "n_copies", F.coalesce("known", F.lit(False)).alias("known")))
    index.append(counts.where("not known"), novel=True)
    # Digests of which some row goes.
    touched = checkpoint(counts.where("known or n_copies > 1").select(F.col("digest").alias(d), F.col("known").alias(n)))
    rows = docs.withColumn(d, digest(col(text_col)))
    single = join_small(rows, touched.select(d), d, "left_anti", 96).drop(d)
    twice = join_small(rows, touched.where(~F.col(n)).select(d), d, "left_semi", 96)
    order = F.struct(col(id_col).isNull(), col(id_col), F.xxhash64(*[col(c) for c in docs.columns]))
    # Fields go by number: a column's name may have dots.
    whole = F.struct(*[col(c).alias(f"f{k}") for k, c in enumerate(docs.columns)])
    best = twice.groupBy(d).agg(F.min_by(whole, order).alias(rank))
    return single.unionByName(best.select(*[F.col(rank)[f"f{k}"].alias(c) for k, c in enumerate(docs.columns)]))


def fresh_index(spark: SparkSession) -> DigestIndex:
    """A new, empty index in the shared folder."""
    return DigestIndex(spark, run_path(spark, "digests"))
