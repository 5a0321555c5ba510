"""Chat formatting by columnar byte assembly.

The turns of a conversation are brought together and sorted by Spark. In each Arrow batch the lengths of all segments
(header, content, footer) give their places in one output buffer, allocated once; gather indices computed in numpy then
copy every header and content into it. No string is built in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, whole_id
from .kernels import utf8

START, END = "<|im_start|>", "<|im_end|>"
ROLES = ("system", "user", "assistant", "tool")
OUT_BYTES = 32 << 20


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The formatted turns end to end in one buffer, and the offset of each. ``role`` must have no nulls."""
    codes = role.dictionary_encode()
    headers = [f"{START}{r}\n".encode() for r in codes.dictionary.to_pylist()]
    footer = np.frombuffer(f"{END}\n".encode(), np.uint8)
    head_len = np.array([len(h) for h in headers], np.int64)
    head_at = np.cumsum(head_len) - head_len
    data, off = utf8(text)
    source = np.concatenate([np.frombuffer(b"".join(headers), np.uint8), footer, data])
    foot_at = int(head_len.sum())
    code = codes.indices.to_numpy()
    n = len(code)
    # Segments 3k, 3k+1, 3k+2 are the header, content and footer of turn k.
    begin, length = np.empty(3 * n, np.int64), np.empty(3 * n, np.int64)
    begin[0::3], length[0::3] = head_at[code], head_len[code]
    begin[1::3], length[1::3] = foot_at + len(footer) + off[:-1], np.diff(off)
    begin[2::3], length[2::3] = foot_at, len(footer)
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    # Copied a few megabytes at a time, so that the indices stay small beside the text.
    k = 0
    while k < 3 * n:
        base = int(ends[k - 1]) if k else 0
        j = max(k + 1, int(np.searchsorted(ends, base + (4 << 20), "right")))
        if j == k + 1:
            out[base : int(ends[k])] = source[begin[k] : begin[k] + length[k]]
        else:
            shift = begin[k:j] - (ends[k:j] - length[k:j])
            out[base : int(ends[j - 1])] = source[np.arange(base, int(ends[j - 1])) + np.repeat(shift, length[k:j])]
        k = j
    return out, np.append(0, ends[2::3])


def _format(batches):
    def emit(rows: pa.RecordBatch):
        n = rows.num_rows
        conv, null = rows.column(0).fill_null(0).to_numpy(), rows.column(0).is_null().to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])))
        data, off = assemble(rows.column(1), rows.column(2))
        offsets = np.append(off[first], off[-1])
        a = 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + OUT_BYTES, "right")) - 1)
            part = np.ascontiguousarray(data[offsets[a] : offsets[b]])
            own = (offsets[a : b + 1] - offsets[a]).astype(np.int32)
            text = pa.StringArray.from_buffers(b - a, pa.py_buffer(own), pa.py_buffer(part))
            turns = np.diff(np.append(first, n))[a:b]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(first[a:b])), text, pa.array(turns)], names=["conv_id", "text", "n_turns"])
            a = b

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0)
        last = conv[batch.num_rows - 1]
        # The last conversation of a batch may go on in the next one.
        equal = conv.is_null() if not last.is_valid else pc.fill_null(pc.equal(conv, last), False)
        cut = int(np.flatnonzero(~equal.to_numpy(zero_copy_only=False))[-1]) + 1 if not pc.all(equal).as_py() else 0
        if cut or (held and not held[-1].column(0)[0].equals(conv[0])):
            head = [*held, batch.slice(0, cut)] if cut else held
            yield from emit(pa.Table.from_batches(head).combine_chunks().to_batches()[0])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from emit(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, text, n_turns): each conversation's turns in order, as <|im_start|>role, newline, text, <|im_end|>, newline.

    Roles are put in lower case and trimmed; a null or unknown one is the user's. A null text is an empty turn. A text can't forge a marker: in
    it, "<|im_" becomes "<|_im_". Turns without number come last; of turns with one number, the lesser role, then the
    lesser text is first, and repeated rows are repeated turns. Rows without conv_id are one conversation, as in
    GROUP BY. Other columns are ignored; an empty table gives an empty result. A conversation can't exceed 2 GB.
    """
    role = F.lower(F.trim(col(role_col)))
    rows = turns.select(
        whole_id(turns, conv_col).alias("conv_id"), col(turn_col).cast("long").alias("turn"),
        F.when(role.isin(*ROLES), role).otherwise(F.lit("user")).alias("role"),
        F.replace(F.coalesce(col(text_col), F.lit("")), F.lit("<|im_"), F.lit("<|_im_")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format, "conv_id long, text string, n_turns long")
