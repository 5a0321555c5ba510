"""The pre-tokens of the code pattern by arrays over the bytes of many texts, instead of by a regular expression for each.

White space, letters and digits are Java's with (?U), as they are where the regular expression runs. Texts with characters outside
``KNOWN`` aren't cut here, since there the versions of Unicode may differ, or decimal digits that aren't ASCII may occur.
"""

from __future__ import annotations

import ctypes
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points whose classes no version of Unicode since 13 changed, none of them a decimal digit beyond ASCII.
KNOWN = ((0x0, 0x52F), (0x2000, 0x2BFF), (0x3000, 0x30FF), (0x4E00, 0x9FEF), (0xAC00, 0xD7A3), (0xFE00, 0xFE0F), (0x1F000, 0x1FAFF))
#: A Java pattern for what isn't known.
UNKNOWN = "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in KNOWN) + "]"
#: Bytes of texts that are cut at once, or one text.
BYTES = 1 << 18
_NONE, _BLANK, _LETTER, _DIGIT, _SINGLE, _MORE = range(6)
_SPACES = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
# Alphabetic though they are symbols, and the joiners.
_WORDLY = {0x200C, 0x200D, *range(0x24B6, 0x24EA), *range(0x1F130, 0x1F14A), *range(0x1F150, 0x1F16A), *range(0x1F170, 0x1F18A)}


def release() -> None:
    """Give back what arrays left, as workers stay for the next task."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", int)(0)  # glibc has it


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and whether a code point is neither white space nor part of a word."""
    single = np.zeros(KNOWN[-1][1] + 1, bool)
    for first, last in KNOWN:
        for c in range(first, last + 1):
            kind = unicodedata.category(chr(c))
            single[c] = not (c in _SPACES or c in _WORDLY or kind[0] in "LM" or kind in ("Nd", "Nl", "Pc"))
    table = np.where(np.arange(256) < 128, np.where(single[:256], _SINGLE, _NONE), _NONE).astype(np.uint8)
    table[[9, 32]], table[10], table[48:58] = _BLANK, _SINGLE, _DIGIT
    table[[95, *range(65, 91), *range(97, 123)]] = _LETTER
    return table, single


# Made here, so that they travel to the workers with this module.
_TABLE, _ALONE = _classes()


def _kinds(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The class of each byte of texts end to end, which begin where ``begins`` holds; digits of names count as letters, points of numbers as digits."""
    kinds = _TABLE[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        a = data[lead].astype(np.int32)
        width = 2 + (a >= 0xE0) + (a >= 0xF0)
        code = a & (0x7F >> width)
        for k in range(1, 4):
            own = width > k
            code[own] = code[own] << 6 | data[lead[own] + k] & 0x3F
        alone = _ALONE[code]
        for k in range(1, 4):
            kinds[lead[alone & (width > k)] + k] = _MORE
        kinds[lead[alone]] = _SINGLE
    at = np.flatnonzero(kinds == _DIGIT)
    if not len(at):
        return kinds
    new = np.append(True, (np.diff(at) != 1) | begins[at[1:]])
    first, runs = at[new], np.cumsum(new) - 1
    # A run of digits after a letter belongs to the name.
    named = (kinds[first - 1] == _LETTER) & ~begins[first]
    kinds[at[named[runs]]] = _LETTER
    last = np.append(at[:-1][new[1:]], at[-1])
    first, last = first[~named], last[~named]
    if not len(first):
        return kinds
    end = np.minimum(last + 1, len(data) - 1)
    point = (data[end] == 46) & (end > last) & ~begins[end]
    linked = np.append(point[:-1] & (first[1:] == end[:-1] + 1) & ~begins[first[1:]], False)
    # Of numbers with a point between each two, every second one is the fraction of the one before, and takes no point.
    head = np.append(True, ~linked[:-1])
    start = np.flatnonzero(head)
    place = np.arange(len(first)) - start[np.cumsum(head) - 1]
    kinds[end[point & (place % 2 == 0)]] = _DIGIT
    return kinds


def cut_all(texts: pa.Array, words: pa.Array) -> tuple[pa.ChunkedArray, np.ndarray]:
    """The pre-tokens of texts, those of unknown texts being given; and where each text's begin, as of :func:`cut_code`."""
    texts = texts.cast(pa.string())
    if words.null_count == len(words):
        parts, ends = cut_code(texts)
        return pa.chunked_array(parts, pa.string()), ends
    parts, ends = cut_code(pc.if_else(words.is_null(), texts, ""))
    own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([pa.array([], pa.string()), *parts]))
    rows = np.arange(len(words)) + np.where(words.is_valid().to_numpy(zero_copy_only=False), len(words), 0)
    own = pa.concat_arrays([own, words.cast(own.type)]).take(pa.array(rows))
    return pa.chunked_array([own.flatten()]), np.append(0, np.cumsum(pc.list_value_length(own).to_numpy()))


def cut_code(texts: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
    """The code pattern's matches in known texts, end to end in a few arrays, and where each text's begin, the last one's end included. Null has none."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    words, ends, total, k = [], np.zeros(len(texts) + 1, np.int64), 0, 0
    while k < len(texts):
        j = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BYTES, "right")) - 1)
        own, off = data[offsets[k] : offsets[j]], offsets[k : j + 1] - offsets[k]
        if len(own):
            begins = np.zeros(len(own), bool)
            begins[off[:-1][off[:-1] < len(own)]] = True
            kinds = _kinds(own, begins)
            change = np.append(True, kinds[1:] != kinds[:-1])
            change |= begins
            change |= kinds == _SINGLE
            change &= kinds != _MORE
            bounds = np.flatnonzero(change)
            taken = kinds[bounds] != _NONE
            first = bounds[taken]
            sizes = np.diff(np.append(bounds, len(own)))[taken]
            kept = own if taken.all() else own[kinds != _NONE]
            places = np.append(np.int32(0), np.cumsum(sizes, dtype=np.int32))
            words.append(pa.StringArray.from_buffers(len(first), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(kept))))
            ends[k + 1 : j + 1] = total + np.searchsorted(first, off[1:])
            total += len(first)
        else:
            ends[k + 1 : j + 1] = total
        k = j
    return words, ends
