"""Corpus statistics under a tokenizer.

Whatever hangs on token counts alone is computed from the distinct pre-tokens: they are counted first, encoded once each, and their
tokens weighted by how often they occur. Every function returns a DataFrame; those named *_table have one row.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import UNK, special
from ..runtime import checkpoint, col, fresh
from .bpe import BpeModel, train
from .pretokenize import word_counts

FIXTURE_TEXTS = ("Hello, world!", "Numbers 123 and symbols @#$ in a sentence.", "Accents and more: héllo wörld \U0001f30d", "", "a")


def _ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def token_usage(df: DataFrame, model: BpeModel, text_col: str = "text", order_col: str = "doc_id") -> DataFrame:
    """(id, n, first_doc, first_pos): how often each token id occurs in all texts, and the pre-token that has it first."""
    words = word_counts(df, model.config, text_col, order_col, min_frequency=1)
    ids = words.select("freq", "first_doc", "first_pos", F.posexplode(model.encode_words(F.array("word"))).alias("k", "id"))
    first = F.min(F.struct("first_doc", "first_pos", "k"))
    return ids.groupBy("id").agg(F.sum("freq").alias("n"), first.alias("f")).select("id", "n", "f.first_doc", "f.first_pos", F.col("f.k").alias("first_place"))


def named(usage: DataFrame, model: BpeModel) -> DataFrame:
    """usage with the token of each id; null for an unknown one."""
    return usage.withColumn("token", F.get(model.tokens(F.array("id")), 0))


def _usage_sums(df: DataFrame, model: BpeModel, text_col: str) -> DataFrame:
    texts = df.select(col(text_col).alias("text"), F.lit(0).alias("o"))
    usage = named(token_usage(texts, model, "text", "o"), model)
    unk = model.vocab.get(UNK, -1)
    return usage.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_tokens"),
        F.count(F.lit(1)).alias("unique_tokens"),
        F.coalesce(F.sum(F.when(F.col("id") == unk, F.col("n"))), F.lit(0)).cast("long").alias("unknown"),
        F.coalesce(F.sum(F.col("n") * F.coalesce(F.length("token"), F.lit(0))), F.lit(0)).cast("long").alias("token_chars"),
    )


def _text_sums(df: DataFrame, text_col: str) -> DataFrame:
    t = F.col(text_col)
    return df.where(t.isNotNull()).agg(F.count(F.lit(1)).alias("total_texts"), F.coalesce(F.sum(F.length(t)), F.lit(0)).cast("long").alias("total_characters"))


def token_stats_table(df: DataFrame, model: BpeModel, text_col: str = "text") -> DataFrame:
    """Totals and averages over all texts that aren't null."""
    s = _text_sums(df, text_col).crossJoin(_usage_sums(df, model, text_col))
    texts, chars, tokens, unique = (F.col(c) for c in ("total_texts", "total_characters", "total_tokens", "unique_tokens"))
    return s.select(
        texts, chars, tokens, unique,
        _ratio(chars, texts).alias("avg_chars_per_text"), _ratio(tokens, texts).alias("avg_tokens_per_text"), _ratio(chars, tokens).alias("compression_ratio"),
        (unique / F.lit(max(1, model.vocab_size()))).alias("vocab_utilization"), _ratio(F.col("token_chars"), tokens).alias("avg_token_length"),
    )


def coverage_table(df: DataFrame, model: BpeModel, text_col: str = "text") -> DataFrame:
    """How much of the vocabulary the texts use, and how much of them it covers."""
    s, total, unknown = _usage_sums(df, model, text_col), F.col("total_tokens"), F.col("unknown")
    return s.select(
        total, F.col("unique_tokens").alias("unique_tokens_used"), (F.col("unique_tokens") / F.lit(max(1, model.vocab_size()))).alias("vocab_utilization"),
        _ratio(unknown, total).alias("unknown_rate"), F.when(total > 0, 1 - unknown / total).otherwise(F.lit(1.0)).alias("coverage_rate"),
    )


def rare_tokens(df: DataFrame, model: BpeModel, threshold: int = 5, text_col: str = "text", order_col: str = "doc_id") -> DataFrame:
    """(token, n) of tokens in use that occur fewer than threshold times; rarest first, of equal ones the first met."""
    usage = named(token_usage(df, model, text_col, order_col).where(F.col("n") < threshold), model)
    return usage.where(F.col("token").isNotNull()).orderBy("n", "first_doc", "first_pos", "first_place").select("token", "n")


def analyze_texts(df: DataFrame, model: BpeModel, id_col: str = "doc_id", text_col: str = "text", first: int = 100, top: int = 10) -> DataFrame:
    """For each text: (id, text_length, num_tokens, compression_ratio, unique_tokens, token_ids, most_common_tokens).

    token_ids are the first hundred; most_common_tokens the ten commonest, of equal ones the first to appear. Ids must differ.
    """
    ids = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.length(text_col).alias("text_length"), model.encode(F.col(text_col)).alias("ids"))
    size = F.size("ids")
    flat = ids.select(id_col, F.posexplode("ids").alias("pos", "id")).groupBy(id_col, "id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    ranked = flat.withColumn("r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "pos"))).where(F.col("r") <= top)
    token = F.get(model.tokens(F.array("id")), 0).alias("token")
    best = ranked.select(id_col, "r", token, "n").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("r", "token", "n"))).alias("b"))
    best = best.select(F.col(id_col).alias("own_id"), F.transform("b", lambda x: F.struct(x["token"].alias("token"), x["n"].alias("n"))).alias("most_common_tokens"))
    out = ids.join(best, F.col(id_col) == F.col("own_id"), "left")
    return out.select(
        id_col, "text_length", size.alias("num_tokens"), _ratio(F.col("text_length"), size).alias("compression_ratio"), F.size(F.array_distinct("ids")).alias("unique_tokens"),
        F.slice("ids", 1, first).alias("token_ids"), F.coalesce("most_common_tokens", F.array().cast("array<struct<token:string,n:bigint>>")).alias("most_common_tokens"),
    )


def compression(df: DataFrame, models: dict[str, BpeModel], text_col: str = "text") -> DataFrame:
    """(tokenizer, compression_ratio, tokens_per_char, avg_token_length), a row for each tokenizer that made any token."""
    spark, out = df.sparkSession, None
    for name, model in models.items():
        if not model.trained:
            continue
        s = token_stats_table(df, model, text_col).where("total_tokens > 0")
        one = s.select(F.lit(name).alias("tokenizer"), "compression_ratio", (F.col("total_tokens") / F.col("total_characters")).alias("tokens_per_char"), F.col("compression_ratio").alias("avg_token_length"))
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "tokenizer string, compression_ratio double, tokens_per_char double, avg_token_length double") if out is None else out


def timed(action: Callable[[], object]) -> float:
    """Seconds that action takes."""
    began = time.perf_counter()
    action()
    return time.perf_counter() - began


def _drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


#: The names on the command line and those in results.
METRICS = {"compression": "compression_ratio", "coverage": "vocab_utilization", "speed": "encoding_time"}


def benchmark(df: DataFrame, models: dict[str, BpeModel], metrics: list[str] | None = None, text_col: str = "text") -> dict[str, dict[str, float]]:
    """By tokenizer: compression_ratio, vocab_utilization, and encoding_time in seconds a text."""
    wanted = [METRICS.get(m, m) for m in metrics or METRICS.values()]
    if unknown := set(wanted) - set(METRICS.values()):
        raise ValueError(f"unknown metrics: {', '.join(sorted(unknown))}")
    results: dict[str, dict[str, float]] = {}
    for name, model in models.items():
        found = token_stats_table(df, model, text_col).first() if set(wanted) & {"compression_ratio", "vocab_utilization"} else None
        row = {m: float(found[m]) for m in wanted if m != "encoding_time"}
        if "encoding_time" in wanted:
            n = df.where(F.col(text_col).isNotNull()).count()
            row["encoding_time"] = timed(lambda m=model: _drain(df.select(m.encode(F.col(text_col)).alias("ids")))) / max(1, n)
        results[name] = row
    return results


def benchmark_encoding(df: DataFrame, model: BpeModel, text_col: str = "text") -> dict[str, float]:
    s = _text_sums(df, text_col).first()
    total = timed(lambda: _drain(df.select(model.encode(F.col(text_col)).alias("ids"))))
    return {"total_time": total, "texts_per_second": s["total_texts"] / total, "chars_per_second": s["total_characters"] / total, "avg_time_per_text": total / max(1, s["total_texts"])}


def benchmark_training(df: DataFrame, config=None, text_col: str = "text", order_col: str = "doc_id") -> dict[str, float]:
    made: list[BpeModel] = []
    total = timed(lambda: made.append(train(df, config, text_col, order_col)))
    return {"training_time": total, "vocab_size": made[0].vocab_size()}


def round_trips(df: DataFrame, model: BpeModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, decoded, ok): whether each text comes back, but for white space at its ends."""
    from ..functions.text import strip

    t = F.col(text_col)
    back = df.where(t.isNotNull()).select(F.col(id_col), t.alias("text"), model.decode(model.encode(t)).alias("decoded"))
    return back.select(id_col, "decoded", ((F.col("decoded") == F.col("text")) | (strip(F.col("decoded")) == strip(F.col("text")))).alias("ok"))


def validate(model: BpeModel, df: DataFrame | None = None, spark=None, text_col: str = "text") -> dict[str, bool]:
    """Six checks of a tokenizer. The round trip is tried on df's texts, or on a few built-in ones, through spark if it is given."""
    out = {"has_vocab": bool(model.vocab), "has_inverse_vocab": bool(model.inverse), "has_merges": bool(model.merges)}
    out["vocab_consistency"] = bool(model.vocab) and len(model.vocab) == len(model.inverse) and all(model.inverse.get(i) == t for t, i in model.vocab.items())
    out["special_tokens_present"] = all(special(n) in model.vocab for n in ("endoftext", "startoftext", "pad", "unk"))
    if not model.trained:
        return out | {"encode_decode_consistency": False}
    if df is None and spark is None:
        ok = all(model.decode_ids(model.encode_text(t)).strip() == t.strip() for t in FIXTURE_TEXTS)
    else:
        texts = spark.createDataFrame(list(enumerate(FIXTURE_TEXTS)), "doc_id long, text string") if df is None else df.withColumn("doc_id", F.lit(0)) if "doc_id" not in df.columns else df
        ok = round_trips(texts, model, "doc_id", text_col).where("not coalesce(ok, false)").isEmpty()
    return out | {"encode_decode_consistency": ok}


def tokenization_quality(df: DataFrame, model: BpeModel, detailed: bool = False, text_col: str = "text", order_col: str = "doc_id", samples: int = 5) -> dict:
    """Seven figures over all texts; the round trip is tried on the first few. With detailed, what they come from."""
    stats, coverage = (f(df, model, text_col).first().asDict() for f in (token_stats_table, coverage_table))
    checks = validate(model, df.where(F.col(text_col).isNotNull()).orderBy(order_col).limit(samples), text_col=text_col)
    out = {
        "compression_ratio": stats["compression_ratio"], "vocab_utilization": coverage["vocab_utilization"], "coverage_rate": coverage["coverage_rate"], "unknown_rate": coverage["unknown_rate"],
        "passes_validation": all(checks.values()), "vocab_size": model.vocab_size(), "avg_tokens_per_text": stats["avg_tokens_per_text"],
    }
    return out | ({"detailed_stats": stats, "detailed_coverage": coverage, "validation_results": checks} if detailed else {})


def batches(df: DataFrame, batch_size: int, order_col: str = "doc_id") -> DataFrame:
    """df with batch_id: rows in the order of order_col, batch_size to a batch.

    Numbers come from counts of range partitions, not from one sort of everything.
    """
    part, rows, base, place = fresh(df, "part", "rows", "base", "place")
    ranged = checkpoint(df.repartitionByRange(col(order_col)).sortWithinPartitions(col(order_col)).withColumn(part, F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy(part)
    bases = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(rows)).withColumn(base, F.sum(rows).over(before) - F.col(rows))
    placed = ranged.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(col(order_col)))).join(bases.select(part, base), part)
    return placed.select(*[col(c) for c in df.columns if c != "batch_id"], F.expr(f"({base} + {place} - 1) div {batch_size}").alias("batch_id"))


def map_texts(df: DataFrame, function: Callable[[str], object], result: str = "string", text_col: str = "text", out: str = "result") -> DataFrame:
    """df with a column of function(text), for any Python function of one text; null for null."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(result))

    def apply(texts: pa.Array) -> pa.Array:
        return pa.array([None if (t := x.as_py()) is None else function(t) for x in texts], kind)

    return df.withColumn(out, F.arrow_udf(apply, result)(F.col(text_col)))
