"""A corpus pipeline: documents through five of the operators, each stage's result written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import exactdedup, langid, mixing, packing, simhash
from lodestone.llm.common import run_path
from lodestone.llm.queries import WEIGHTS
from lodestone.runtime import remove, spread


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is in doubt: ties and narrow margins, null and empty texts, texts without letters.

    A null language is filled in. Repeated rows stay or go alike; of an empty table nothing is left.
    """
    return langid.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the least doc_id, rows without one being last, ties by a hash of the row.

    Null texts are one text, empty ones another. Of an empty table nothing is left.
    """
    index = exactdedup.fresh_index(spark)
    kept = exactdedup.drop_exact_duplicates(docs, index)
    index.delete()
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the most links, ties by a hash of doc_id.

    Documents without words are like no other, and rows without doc_id stay. Rows of one doc_id stay or go together. Of an empty
    table nothing is left.
    """
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a mix to the target weights takes; a null source is a source.

    Rows of one document and source stay or go together, as do rows without doc_id. Texts without words go with the document before
    them. Of an empty table nothing is left.
    """
    return mixing.take_mix(docs, weights=WEIGHTS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents, by pack. Null and empty texts have none, repeated rows have theirs each; ties on the curve go by doc_id."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("packing", pack_documents)]

#: Compression, SimHash and the Hilbert curve are beyond SQL: tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    folder = run_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
