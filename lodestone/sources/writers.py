"""Texts, ids and vocabularies to files."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bpe import BpeModel


#: Ids that are written at once, and the range of those that are looked up.
_AT_ONCE, _TABLE = 1 << 17, 1 << 16


def _joined(ids: pa.Array) -> pa.Array:
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)))
    parts, k = [pa.array([], pa.string())], 0
    while k < len(ids):
        j = max(k + 1, int(np.searchsorted(ends, ends[k] + _AT_ONCE, "right")) - 1)
        own = ids.slice(k, j - k)
        values, off = own.flatten(), ends[k : j + 1] - ends[k]
        if values.null_count:
            valid = values.is_valid()
            off, values = np.append(0, np.cumsum(valid.to_numpy(zero_copy_only=False)))[off], values.filter(valid)
        low, high = pc.min_max(values).as_py().values() if len(values) else (0, 0)
        if high - low < min(_TABLE, len(values)):
            named = pa.array(list(map(str, range(low, high + 1))), pa.string()).take(pc.subtract(values, low))
        else:
            named = values.cast(pa.string())
        parts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(off, pa.int32()), named, mask=own.is_null() if own.null_count else None), " "))
        k = j
    return pa.concat_arrays(parts)


def write_texts(df: DataFrame, path: str, text_col: str = "text") -> None:
    """A folder of text files, an empty line after each text."""
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def as_ids(ids: Column) -> Column:
    """Ids between blanks; null ones are left out."""
    return F.arrow_udf(_joined, "string")(ids)


def as_tokens(ids: Column, model: BpeModel) -> Column:
    """Tokens in double quotes between blanks; an unknown id as <id>."""
    named = F.zip_with(model.tokens(ids), ids, lambda t, i: F.concat(F.lit('"'), F.coalesce(t, F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), F.lit('"')))
    return F.array_join(named, " ")


def as_json(text: Column, ids: Column, model: BpeModel) -> Column:
    """An object of text, token_ids and tokens."""
    return F.to_json(F.struct(text.alias("text"), ids.alias("token_ids"), model.tokens(ids).alias("tokens")), {"ignoreNullFields": "false"})


def decoded_json(ids: Column, model: BpeModel) -> Column:
    return F.to_json(F.struct(ids.alias("token_ids"), model.decode(ids).alias("decoded_text")))


def save_vocab(model: BpeModel, path: str, format: str = "json") -> None:
    """The vocabulary as a JSON object, or as lines of id, tab and the token's Python literal by id."""
    if format not in ("json", "txt"):
        raise ValueError(f"unknown format: {format}")
    with open(path, "w", encoding="utf-8") as f:
        if format == "json":
            json.dump(model.vocab, f, ensure_ascii=False, indent=2)
        else:
            f.writelines(f"{i}\t{t!r}\n" for t, i in sorted(model.vocab.items(), key=lambda x: x[1]))


def convert(source: str, target: str, spark=None) -> str:
    """A model from JSON to a folder of Parquet tables, or back. A target without extension is a folder."""
    if source.endswith(".json"):
        model = BpeModel.load(source)
        if target.endswith(".json"):
            return model.save(target)
        model.save_tables(spark, target)
        return target
    return BpeModel.load_tables(spark, source).save(target if target.endswith(".json") else target + ".json")
