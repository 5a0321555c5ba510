"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash. A document's virtual finish time is the running total of its
source's tokens up to it, divided by the source's weight. All documents are sorted by finish time and taken until the
token budget is spent, so every prefix of the order holds the sources in proportion to their weights while they last.
Both running totals are taken over range partitions (``ordered_sums``), so that no source is one task's work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, col, fresh, join_small, ordered_sums, whole_id

#: Share of all tokens that a mix takes.
BUDGET_FRACTION = 0.8


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def _place(doc_id: Column, seed: str) -> Column:
    """A document's place in its source's shuffle: 60 bits of MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 15), 16, 10).cast("long")


def fair_order(docs: DataFrame, weights: dict[str, float], seed: str, id_col: str, source_col: str, tokens: Column) -> DataFrame:
    """(source, place, doc_id, n_rows, n_tokens, finish, mixed_tokens) of every document, mixed_tokens being the running total."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    narrow = docs.select(col(source_col).alias("source"), whole_id(docs, id_col).alias("doc_id"), tokens.alias("n_tokens"))
    narrow = narrow.withColumn("place", _place(F.col("doc_id"), seed)).groupBy("source", "place", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"))
    queued = ordered_sums(checkpoint(narrow), ["source", "place"], "n_tokens", "own", "source")
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    timed = checkpoint(queued.withColumn("finish", F.col("own").cast("double") / weight).drop("own"))
    return ordered_sums(timed, ["finish", "source", "place"], "n_tokens", "mixed_tokens")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget_fraction: float = BUDGET_FRACTION, budget_tokens: int | None = None, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, finish, mixed_tokens) of the documents taken, in no particular row order; sort by mixed_tokens for the mix.

    weights: of sources; one that isn't named has weight 1. The budget is budget_tokens, or that fraction of all tokens. The taking stops at the first document that would pass it.
    A null source is a source of its own with weight 1. Rows that share source and doc_id are one document, with their
    tokens added up, and are taken or left together; so are documents without doc_id in a source. Empty and null texts
    have no tokens, and are taken with the document before them. tokens: an integer column to use in place of the count of
    words. Other columns are ignored. An empty table gives an empty result.
    """
    order = checkpoint(fair_order(docs, weights or {}, seed, id_col, source_col, word_count(col(text_col)) if tokens is None else tokens))
    if budget_tokens is None:
        budget_tokens = math.floor((order.agg(F.sum("n_tokens")).first()[0] or 0) * budget_fraction)
    return order.where(F.col("mixed_tokens") <= budget_tokens).select("doc_id", "source", "n_tokens", "finish", "mixed_tokens", "place")


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns as they were, reduced to the mix.

    Within a source the mix is a prefix of the shuffle, so one last place for each source decides, and no text is shuffled. Nulls,
    repeated rows and ties go as in :func:`mix`: rows of one document stay or go together. An empty table stays empty.
    """
    id_col, source_col, seed = options.get("id_col", "doc_id"), options.get("source_col", "source"), options.get("seed", "mix")
    source, place, last = fresh(docs, "source", "place", "last")
    cuts = checkpoint(mix(docs, **options).groupBy(F.col("source").alias(source)).agg(F.max("place").alias(last)))
    placed = docs.withColumn(place, _place(whole_id(docs, id_col), seed))
    return join_small(placed, cuts, col(source_col).eqNullSafe(F.col(source)) & (F.col(place) <= F.col(last)), "left_semi").drop(place)
