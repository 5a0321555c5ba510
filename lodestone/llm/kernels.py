"""Vectorised byte kernels over Arrow string buffers."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPAN_BYTES = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Give back what a worker, which lives on, no longer uses."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", int)(0)  # glibc has it


def tidy(function):
    """A function from batches to batches that gives its memory back at its end."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets; nulls become empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n, buffers = len(arr), arr.buffers()
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def spans(off: np.ndarray, limit: int = SPAN_BYTES):
    """Ranges of rows that hold about ``limit`` bytes; a longer row is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
POWERS = np.cumprod(np.full(1024, GOLDEN))
#: Words of one character: those of scripts without blanks between words.
UNSEGMENTED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
#: White space and punctuation beyond ASCII.
BETWEEN = [(0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x1680, 0x1680), (0x2000, 0x206F), (0x3000, 0x303F), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]


def _within(points: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    low, high = np.array(ranges).T
    at = np.searchsorted(low, points, "right") - 1
    return (at >= 0) & (points <= high[np.maximum(at, 0)])


def word_bytes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are in words, which begin one, and which of those begin a character of a script without blanks. ``edges`` begin texts."""
    is_word = WORD[data]
    lone = np.zeros(len(data), bool)
    # Lead bytes of characters that aren't letters of a word with blanks around it: U+0080-00FF (C2, C3) and all from U+0E00 on.
    lead = np.flatnonzero((data == 0xC2) | (data == 0xC3) | (data >= 0xE0))
    if len(lead):
        padded = np.append(data, np.zeros(4, np.uint8)).astype(np.int64)
        size = np.where(data[lead] >= 0xF0, 4, np.where(data[lead] >= 0xE0, 3, 2))
        point = padded[lead] & np.where(size == 4, 7, np.where(size == 3, 15, 31))
        for k in range(1, 4):
            point = np.where(size > k, point << 6 | padded[lead + k] & 63, point)
        gap, single = _within(point, BETWEEN), _within(point, UNSEGMENTED)
        for k in range(4):
            at = lead[gap & (size > k)] + k
            is_word[at[at < len(data)]] = False
        lone[lead[single]] = True
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    if lone.any():
        first |= lone
        at = lead[single] + size[single]
        first[at[at < len(data)]] |= is_word[at[at < len(data)]]
    first[edges] = is_word[edges]
    return is_word, first, lone


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and its row.

    A word is a run of letters and digits (of any bytes above 127 but white space and punctuation). In scripts without blanks a word is a
    character together with the one after it.
    """
    edge = off[:-1]
    is_word, first, lone = word_bytes(data, edge[edge < len(data)])
    start, place = np.flatnonzero(first), np.flatnonzero(is_word)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.cumsum(is_word, dtype=np.int64)[start] - 1
    length = np.diff(np.append(at, len(place)))
    power = POWERS[(np.arange(len(place)) - np.repeat(at, length)) & 1023]
    h = np.add.reduceat((data[place].astype(np.uint64) + np.uint64(1)) * power, at)
    h = mix64(h ^ (length.astype(np.uint64) * GOLDEN))
    row = np.searchsorted(off, start, "right") - 1
    if (single := lone[start]).any():
        k = np.flatnonzero(single[:-1] & single[1:] & (start[1:] == start[:-1] + length[:-1]) & (row[1:] == row[:-1]))
        h[k] = mix64(h[k] + GOLDEN * h[k + 1])
    return h, row


# LANES[b] holds the eight bits of b in eight lanes of eight bits, the highest bit in the lowest lane.
LANES = np.zeros(256, np.uint64)
for _b in range(256):
    LANES[_b] = sum(1 << (8 * k) for k in range(8) if _b >> (7 - k) & 1)


def bit_sums(h: np.ndarray, row: np.ndarray, n: int, words: int, seed: int) -> np.ndarray:
    """For rows 0..n-1, how many of their hashes have each of 64*words derived bits set. ``row`` is sorted."""
    out = np.zeros((n, 64 * words), np.int64)
    if not len(h):
        return out
    # A lane counts to 255: no run within a row is longer than that.
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    length = np.diff(np.append(begin, len(row)))
    pieces = (length + 254) // 255
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cut = np.repeat(begin, pieces) + 255 * k
    owner = row[cut]
    firsts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for w in range(words):
        derived = mix64(h + np.uint64((seed + w + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            lanes = np.add.reduceat(LANES[derived[:, b]], cut).view(np.uint8).reshape(-1, 8).astype(np.int64)
            out[owner[firsts], 64 * w + 8 * b : 64 * w + 8 * b + 8] += np.add.reduceat(lanes, firsts, axis=0)
    return out


def ordered_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`word_hashes`, a long text being read in pieces."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for i, j in spans(off):
        lo, hi = off[i], off[j]
        if j == i + 1 and hi - lo > 2 << 20:
            cuts = safe_cuts(data[lo:hi])
            for a, b in zip(cuts, cuts[1:]):
                h = word_hashes(data[lo + a : lo + b], np.array([0, b - a]))[0]
                found.append((h, np.full(len(h), i)))
        else:
            h, row = word_hashes(data[lo:hi], off[i : j + 1] - lo)
            found.append((h, row + i))
    return np.concatenate([h for h, _ in found]), np.concatenate([r for _, r in found])


def safe_cuts(data: np.ndarray, limit: int = SPAN_BYTES) -> list[int]:
    """Places to cut one long text into blocks of about ``limit`` bytes, at a byte outside words if there is one."""
    cuts = [0]
    while len(data) - cuts[-1] > limit:
        gap = np.flatnonzero(~WORD[data[cuts[-1] + limit // 2 : cuts[-1] + limit]])
        cuts.append(cuts[-1] + (limit // 2 + int(gap[-1]) + 1 if len(gap) else limit))
    return [*cuts, len(data)]
