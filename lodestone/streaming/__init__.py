"""The same operators over unbounded input.

Cleaning, filtering and encoding are stateless and apply to a streaming DataFrame as they are. Exact duplicates go by a watermark;
near duplicates by batches against the shingles of what was kept so far, in a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PreprocessingConfig
from ..operators import clean, dedup, quality
from ..operators.bpe import BpeModel
from ..runtime import checkpoint, col, fresh


def prepare_stream(stream: DataFrame, config: PreprocessingConfig | None = None, text_col: str = "text") -> DataFrame:
    """The stream with cleaned texts, without those that are empty or not of high quality."""
    c = config or PreprocessingConfig(remove_duplicates=False)
    cleaned = stream.where(F.col(text_col) != "").withColumn(text_col, clean.clean(F.col(text_col), c))
    (good,) = fresh(cleaned, "good")
    return quality.judged(cleaned.where(F.col(text_col) != ""), good, c, text_col).where(F.col(good)).drop(good)


def encode_stream(stream: DataFrame, model: BpeModel, text_col: str = "text", out: str = "ids") -> DataFrame:
    return stream.withColumn(out, model.encode(F.col(text_col)))


def deduplicate_stream(stream: DataFrame, time_col: str, delay: str, text_col: str = "text") -> DataFrame:
    """Without rows whose normal form came before, within the watermark's delay."""
    (h,) = fresh(stream, "hash")
    hashed = stream.withColumn(h, dedup.text_hash(F.col(text_col)))
    return hashed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([h]).drop(h)


def windowed_counts(stream: DataFrame, time_col: str, window: str, delay: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """(window_start, keys, n) over time windows, closed by the watermark."""
    w = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return stream.withWatermark(time_col, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


class NearDedupSink:
    """For foreachBatch: keeps the rows of each batch that are like none kept before, under ``path``.

    kept/batch=N has a batch's rows, sets/batch=N their shingles, and index/batch=N those of them by which similar documents are found:
    a batch is shingled once, and meets only the index of what came before. What counts is batches 0 to N in order; a batch that is
    tried again after a failure overwrites its own folders and ignores them while it compares, so the result is the same. Ids must
    differ, and grow from batch to batch; null texts are dropped. The threshold is above 0 and 1 at most.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text"):
        if not 0 < threshold <= 1:
            raise ValueError("a stream is compared by a threshold above 0 and of 1 at most")
        self.spark, self.path, self.threshold, self.id_col, self.text_col = spark, path.rstrip("/"), threshold, id_col, text_col

    def _part(self, kind: str, before: int | None = None) -> DataFrame | None:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return None
        numbers = [int(s.getPath().getName()[6:]) for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("batch=")]
        paths = [f"{self.path}/{kind}/batch={n}" for n in sorted(numbers) if before is None or n < before]
        return self.spark.read.parquet(*paths) if paths else None

    def kept(self, before: int | None = None) -> DataFrame | None:
        return self._part("kept", before)

    def __call__(self, batch: DataFrame, number: int) -> None:
        text, t = col(self.text_col), self.threshold
        new = checkpoint(batch.where(text.isNotNull()))
        firsts = checkpoint(dedup.first_of_each(new, dedup.text_hash(text), self.id_col))
        sets = checkpoint(dedup.shingle_sets(firsts, self.id_col, self.text_col))
        # Any order does, if it is the same for all documents for ever: that of the hashes.
        posts = sets.select("doc_id", "n", F.explode(F.slice(F.array_sort("s"), F.lit(1), dedup.prefix_length(F.col("n"), t).cast("int"))).alias("x"))
        index, before = self._part("index", number), self._part("sets", number)
        (own,) = fresh(firsts, "own")
        if index is not None and before is not None:
            old = index.select(F.col("doc_id").alias("i"), F.col("n").alias("ni"), "x")
            pairs = posts.select(F.col("doc_id").alias("j"), "n", "x").join(old, "x").where(F.least("n", "ni") >= (t - 1e-9) * F.greatest("n", "ni")).select("i", "j").distinct()
            both = pairs.join(before.select(F.col("doc_id").alias("i"), F.col("s").alias("si")), "i").join(sets.select(F.col("doc_id").alias("j"), "s"), "j")
            like = checkpoint(both.where(dedup.jaccard(F.col("si"), F.col("s")) >= t).select(F.col("j").alias(own)).distinct())
            firsts = checkpoint(firsts.join(like, col(self.id_col) == F.col(own), "left_anti"))
        dropped = dedup.greedy_dropped(dedup.similar_pairs(firsts, t, self.id_col, self.text_col))
        if dropped is not None:
            firsts = firsts.join(dropped.select(F.col("doc_id").alias(own)), col(self.id_col) == F.col(own), "left_anti")
        kept = checkpoint(firsts)
        ids = kept.select(col(self.id_col).alias("doc_id"))
        for kind, rows in (("sets", sets.select("doc_id", "s").join(ids, "doc_id", "left_semi")), ("index", posts.join(ids, "doc_id", "left_semi")), ("kept", kept)):
            rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={number}")
