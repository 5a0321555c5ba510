"""Token counts in rollups that are maintained by deltas.

A store is a folder. Each committed batch leaves there ledger/batch=ID, the signed rows by document (an insert is +1
document and +n tokens, a delete the same with minus signs, a revision one of each), and rollup/batch=ID, their sums by
source, language and tokenizer version. Totals are sums over the rollups, so a commit never reads the totals; what a
delete or revision takes back is looked up in the ledger, which lies in folders by a hash of doc_id: a batch reads those of its
own documents. A batch counts once its rollup has a _SUCCESS file, the last thing written: committing an ID again does
nothing if it has, and overwrites what a failed attempt left if it hasn't. ``compact`` sums all batches into one snapshot.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, col, join_small, whole_id

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 64
DIMS = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, bytes long"


def _count_all(vocabulary: bytes):
    """Counts by the vocabulary, whose bytes travel with the task: no executor opens its path."""

    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, zlib.decompress(vocabulary).splitlines())}
        bpe = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(bpe.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "bytes", "tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, tokenizer: str = "byte_bpe_50k/1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens, bytes) of every row, whole texts at any length; null and empty ones have 0 of both.

    Repeated rows are counted each; null ids, sources and languages stay null. Ids are whole numbers. Other columns are ignored; an
    empty table gives an empty result. ``vocabulary`` is read by the driver.
    """
    with open(vocabulary, "rb") as f:
        packed = zlib.compress(f.read())
    rows = docs.select(
        whole_id(docs, id_col).alias("doc_id"), col(source_col).alias("source"), col(lang_col).alias("lang"),
        F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long").alias("bytes"), col(text_col).alias("text"),
    )
    counted = rows.mapInArrow(_count_all(packed), "doc_id long, source string, lang string, bytes long, tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), "tokens", "bytes")


class Rollups:
    """A store at ``path``, in any file system that Spark writes. It outlives the session; one writer at a time.

    buckets: folders by hash of doc_id that each batch's ledger lies in. Keep it the same for the life of a store.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _complete(self, kind: str) -> list[str]:
        """The folders kind/batch=ID that have a _SUCCESS file, by ID."""
        fs, p = self._fs(f"{self.path}/{kind}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        has = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(n[6:] for n in names if n.startswith("batch=") and fs.exists(has(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _snapshot(self) -> tuple[str | None, list[str]]:
        """The last snapshot and the IDs that it holds."""
        done = self._complete("snapshot")
        if not done:
            return None, []
        return done[-1], [r[0] for r in self.spark.read.text(f"{self.path}/snapshot/batch={done[-1]}").collect()]

    def _batches(self) -> tuple[list[str], list[str]]:
        """Folders to read, and IDs that count."""
        last, held = self._snapshot()
        later = [b for b in self._complete("rollup") if b not in held and not b.startswith("~")]
        return ([f"~{last}"] if last else []) + later, sorted([*held, *later])

    def committed(self) -> list[str]:
        """The IDs of the batches that count, in alphabetical order."""
        return self._batches()[1]

    def _read(self, kind: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/batch={b}" for b in self._batches()[0]]
        schema = f"{LEDGER}, bucket int" if kind == "ledger" else LEDGER.removeprefix("doc_id long, ")
        if not paths:
            return self.spark.createDataFrame([], schema)
        each = [self.spark.read.schema(schema).parquet(p) for p in paths]
        return functools.reduce(DataFrame.union, each)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def current(self, docs: DataFrame | None = None) -> DataFrame:
        """What the ledger says of each (doc_id, source, lang, tokenizer) still there; of docs' (doc_id, tokenizer) only, if given."""
        ledger = self._read("ledger")
        if docs is not None:
            keys = checkpoint(docs.select("doc_id", "tokenizer").distinct())
            touched = [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # no more than there are buckets
            keys = keys.select(F.col("doc_id").alias("d"), F.col("tokenizer").alias("t"))
            ledger = join_small(ledger.where(F.col("bucket").isin(touched)), keys, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("tokenizer").eqNullSafe(F.col("t")), "left_semi", 160)
        sums = ledger.groupBy("doc_id", *DIMS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))
        return sums.where("docs <> 0")

    def _write(self, name: str, ledger: DataFrame) -> None:
        placed = ledger.withColumn("bucket", self._bucket())
        # A bucket is the work of several tasks if it is large, and rows without doc_id aren't all in one.
        part = F.pmod(F.xxhash64("doc_id", *DIMS, "tokens", "bytes"), F.lit(1024))
        placed.repartition("bucket", part).sortWithinPartitions("bucket", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/ledger/batch={name}")
        signed = self.spark.read.schema(f"{LEDGER}, bucket int").parquet(f"{self.path}/ledger/batch={name}")
        sums = signed.groupBy(*DIMS).agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "bytes")])
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/rollup/batch={name}")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of (op, doc_id, source, lang, tokenizer, tokens, bytes); False if that ID was committed before.

        Deletes and revisions first take back all that the ledger has of their doc_id under their tokenizer, as of before the batch:
        once, however often the batch repeats them. Then op "insert" adds its row's document (repeated rows each time), and "revise"
        adds one: of several revisions of a document the one with the greatest (tokens, bytes, source, lang), none if the
        batch deletes it too. A revision of what isn't there adds it; a delete of it changes nothing. Nulls in the
        dimensions and doc_id are values like others; null tokens and bytes are 0. Any other op, null included, raises ValueError
        and nothing is committed. An empty batch counts as committed. Other columns are ignored.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
            raise ValueError("a batch ID holds letters, digits and _ . - only")
        if batch_id in self.committed():
            return False
        known = F.col("op").isin("insert", "delete", "revise")
        if not changes.where(~F.coalesce(known, F.lit(False))).isEmpty():
            raise ValueError("an op is insert, delete or revise")
        n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
        rows = changes.select("op", "doc_id", *DIMS, n("tokens"), n("bytes"))
        added = rows.where("op = 'insert'").select("doc_id", *DIMS, "tokens", "bytes")
        changed = rows.where("op <> 'insert'").groupBy("doc_id", "tokenizer").agg(
            F.bool_or(F.col("op") == "delete").alias("gone"), F.max(F.struct("tokens", "bytes", "source", "lang")).alias("r"),
        )
        added = added.unionByName(changed.where("not gone").select("doc_id", "r.source", "r.lang", "tokenizer", "r.tokens", "r.bytes"))
        added = added.withColumn("docs", F.lit(1).cast("long"))
        if self.committed():
            before = self.current(changed)
            added = added.unionByName(before.select("doc_id", *DIMS, *[(-F.col(c)).alias(c) for c in ("docs", "tokens", "bytes")]))
        self._write(batch_id, added.select("doc_id", *DIMS, "docs", "tokens", "bytes"))
        return True

    def compact(self) -> None:
        """Sum all batches into one snapshot, and delete what it replaces once the snapshot counts. IDs stay committed."""
        folders, ids = self._batches()
        if len(folders) < 2:
            return
        last, _ = self._snapshot()
        name = f"{int(last or 0) + 1:010d}"
        self._write(f"~{name}", self.current().select("doc_id", *DIMS, "docs", "tokens", "bytes"))
        self.spark.createDataFrame([(i,) for i in ids], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/snapshot/batch={name}")
        for old in folders:
            for kind in ("ledger", "rollup"):
                fs, p = self._fs(f"{self.path}/{kind}/batch={old}")
                fs.delete(p, True)

    def delete(self) -> None:
        """Remove the store."""
        fs, p = self._fs(self.path)
        fs.delete(p, True)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens, bytes) over all committed batches; groups with no documents left are out."""
        sums = self._read("rollup").groupBy(*DIMS).agg(*[F.sum(c).cast("long").alias(c) for c in ("docs", "tokens", "bytes")])
        return sums.where("docs <> 0")


def inserts(counted: DataFrame, op: str = "insert") -> DataFrame:
    """Counted rows as changes, all of one op."""
    return counted.select(F.lit(op).alias("op"), "doc_id", *DIMS, "tokens", "bytes")
