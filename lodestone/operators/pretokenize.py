"""Pre-tokens, and the counts that byte-pair training starts from.

Patterns run in the JVM. The code pattern is cut by arrays in Arrow functions where whole texts are counted or encoded (see :mod:`cutting`).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CODE_PATTERN, TokenizerConfig
from ..functions import cutting
from ..functions import text as T

_WHOLE = ("byte", "short", "integer", "long")


def captures(pattern: str) -> bool:
    """Whether a regular expression has a capturing group."""
    inside, k = False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            k += pattern[k + 1 : k + 2] in ("]", "^")
        elif c == "(" and (pattern[k + 1 : k + 2] != "?" or pattern[k + 1 : k + 3] == "?P" or (pattern[k + 1 : k + 3] == "?<" and pattern[k + 3 : k + 4] not in ("=", "!"))):
            return True
        k += 1
    return False


def pretokens(text: Column, config: TokenizerConfig | None = None) -> Column:
    """All matches of the configuration's pattern, in order; what it doesn't match is dropped. Null stays null."""
    c = config or TokenizerConfig()
    return cut(whole(text, c), c)


def whole(text: Column, config: TokenizerConfig) -> Column:
    """The text in the Unicode form that the configuration wants."""
    text = text.cast("string")
    return T.unicode_form(text, "NFC") if config.normalize_unicode else text


def cut(text: Column, config: TokenizerConfig) -> Column:
    """The pre-tokens of a text that has the form."""
    if captures(config.regex_pattern):
        raise ValueError("the pattern must not have capturing groups")
    return F.regexp_extract_all(text, F.lit("(?U)" + config.regex_pattern), F.lit(0))


def by_arrays(config: TokenizerConfig) -> bool:
    """Whether texts are cut by arrays."""
    return config.regex_pattern == CODE_PATTERN


def to_cut(text: Column, config: TokenizerConfig) -> tuple[Column, Column]:
    """A text in its form, to be cut by arrays; and the pre-tokens if it has characters that those don't know, else null."""
    own = whole(text, config)
    return own, F.when(T.beyond_latin(text.cast("string")) & own.rlike(cutting.UNKNOWN), cut(own, config))


def word_counts(df: DataFrame, config: TokenizerConfig | None = None, text_col: str = "text", order_col: str = "doc_id", min_frequency: int | None = None) -> DataFrame:
    """(word, freq, first_doc, first_pos) of the pre-tokens that occur min_frequency times (the configuration's by default).

    first_doc, first_pos is where a reading of the documents in order_col meets the word first. Null texts have no words.
    """
    c = config or TokenizerConfig()
    least = c.min_frequency if min_frequency is None else min_frequency
    if by_arrays(c) and (kind := df.select(order_col).schema[0].dataType).typeName() in _WHOLE:
        text, words = to_cut(F.col(text_col), c)
        each = df.select(F.col(order_col).alias("doc"), text.alias("text"), words.alias("words")).mapInArrow(_counted, f"doc {kind.simpleString()}, pos int, word string, n long")
        counted = _first_places(each, F.coalesce(F.sum("n"), F.lit(0)))
    else:
        each = df.select(F.col(order_col).alias("doc"), F.posexplode(pretokens(F.col(text_col), c)).alias("pos", "word"))
        counted = _first_places(each, F.count(F.lit(1)))
    counted = counted.where(F.col("freq") >= least)
    return counted.select("word", "freq", "first_doc", "first_pos")


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, pos, word, n) of a batch's different words: how many there are of each, and where the first is."""
    for b in batches:
        order = pc.sort_indices(b.column(0), null_placement="at_start")
        if not np.array_equal(order.to_numpy(), np.arange(len(order))):
            b = b.take(order)
        words, ends = cutting.cut_all(b.column(1), b.column(2))
        if not len(words):
            continue
        coded = words.dictionary_encode().combine_chunks()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.chunk(0)
        codes = coded.indices.to_numpy()
        # Of places assigned to one code the last one stays.
        first = np.empty(len(coded.dictionary), np.int32)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1, dtype=np.int32)
        row = np.searchsorted(ends, first, "right") - 1
        yield pa.record_batch(
            [b.column(0).take(pa.array(row)), pa.array((first - ends[row]).astype(np.int32)), coded.dictionary, pa.array(np.bincount(codes))], ["doc", "pos", "word", "n"]
        )
        del words, coded, codes, first, row
        cutting.release()


def _first_places(each: DataFrame, freq: Column) -> DataFrame:
    """(word, freq, first_doc, first_pos) of (doc, pos, word), null documents being first.

    The minimum of a struct would make Spark sort every occurrence. Numbers are aggregated in a hash table: whole documents' numbers
    below 2^32 with the place in one long, others in a decimal, of which there is none as a rule. Ids of other types are sorted.
    """
    kind = each.schema["doc"].dataType.typeName()
    if kind not in _WHOLE:
        counted = each.groupBy("word").agg(freq.alias("freq"), F.min(F.struct("doc", "pos")).alias("first"))
        return counted.select("word", "freq", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"))
    doc, pos, near, far = F.col("doc").cast("long"), F.col("pos"), F.col("near"), F.col("far")
    usual = F.coalesce((doc >= 0) & (doc < F.lit(1 << 32)), F.lit(False))
    place = F.lit(1 << 31).cast("decimal(10,0)")
    # Null is below every long.
    wide = F.coalesce(doc.cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")) * place + pos.cast("decimal(10,0)")
    counted = each.groupBy("word").agg(
        freq.alias("freq"), F.min(F.when(usual, F.shiftleft(doc, 31) + pos)).alias("near"), F.min(F.when(~usual, wide).cast("decimal(38,0)")).alias("far")
    )
    by_far = far.isNotNull() & (near.isNull() | (far < 0))
    far_pos = F.pmod(far, place)
    far_doc = ((far - far_pos) / place).cast("decimal(20,0)")
    return counted.select(
        "word", "freq",
        F.when(by_far, F.when(far_doc >= F.lit(str(-(1 << 63))).cast("decimal(20,0)"), far_doc.cast("long"))).otherwise(F.shiftright(near, 31)).cast(kind).alias("first_doc"),
        F.when(by_far, far_pos.cast("int")).otherwise(F.col("near").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("first_pos"),
    )


def chars(words: DataFrame) -> DataFrame:
    """(token) of the words' different characters."""
    return words.select(F.explode(F.split("word", "")).alias("token")).where("token <> ''").distinct()


def char_vocab(words: DataFrame, start: int) -> DataFrame:
    """(token, id) of the words' characters in code-point order, from id ``start`` on. There are at most as many as Unicode has."""
    return chars(words).select("token", (F.row_number().over(Window.orderBy("token")) + F.lit(start - 1)).alias("id"))


def pair_stats(words: DataFrame) -> DataFrame:
    """(left, right, n, first_doc, first_pos, place) of adjacent characters, overlaps counted, weighted by the words' frequency."""
    def adjacent(s):
        return F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda k: F.struct(F.get(s, k).alias("left"), F.get(s, k + 1).alias("right")))

    pairs = T.bound(F.filter(F.split("word", ""), lambda c: c != ""), adjacent)
    each = words.where(F.length("word") > 1).select("freq", "first_doc", "first_pos", F.posexplode(pairs).alias("place", "p"))
    first = F.min(F.struct("first_doc", "first_pos", "place"))
    return each.groupBy("p").agg(F.sum("freq").alias("n"), first.alias("f")).select("p.left", "p.right", "n", "f.first_doc", "f.first_pos", "f.place")


def top_pair(pairs: DataFrame) -> DataFrame:
    """The pair with the largest count; of equal counts, the one met first."""
    return pairs.orderBy(F.desc("n"), "first_doc", "first_pos", "place").limit(1)
