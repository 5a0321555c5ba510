"""Learning merges from more words than the driver should hold.

The words stay in Spark, as strings in which a free code point stands for each symbol merged so far. A phase looks for the merges whose
count is some threshold or more. A pair of neighbours that is rarer can't get there, and nothing learned in the phase can reach across
it: words are cut between such neighbours, and equal pieces become one. The threshold is such that the pieces fit the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import merging
from ..runtime import checkpoint

#: Letters of words or pieces that the driver takes at once, at about 120 bytes each.
LETTERS = 2_000_000
#: Thresholds tried: that of all neighbours, of a share STEP of their places, of STEP of those, and so on.
STEP, STEPS = 0.7, 24
_ROW = (1 << 33) - 1


def learn(words: DataFrame, alphabet: Iterable[str], limit: int, min_frequency: int, letters: int = LETTERS) -> list[merging.Pair]:
    """What merging.learn finds in (word, freq, first_doc, first_pos), whose characters are alphabet. words is read several times."""
    size = words.agg(F.sum(F.length("word"))).first()[0] or 0
    if size <= letters:
        return merging.learn(_rows(words.orderBy("first_doc", "first_pos").select("word", "freq")), limit, min_frequency)
    codes = {c: c for c in alphabet}
    taken = set(codes)
    free = (chr(c) for c in range(0x10FFFF, 0, -1) if not 0xD800 <= c <= 0xDFFF and chr(c) not in taken)
    between = next(free)
    state, merges = _placed(words), []
    while len(merges) < limit:
        keys, counts, places = _pairs(state)
        top = int(counts.max(initial=0))
        if top < max(1, min_frequency):
            break
        least, pieces = _fitting(state, keys, counts, places, min_frequency, letters)
        found = merging.learn(_rows(pieces.orderBy("place").select("piece", "freq")), limit - len(merges), least, {c: s for s, c in codes.items()})
        again = False
        for k, (a, b) in enumerate(found):
            if again := a + b in codes:
                # A symbol that is made in another way too may count more than its neighbours at the cuts let see.
                found = found[: k + 1]
                break
            codes[a + b] = next(free)
        merges += found
        if least <= min_frequency and not again:
            break
        state = _merged(state, [(codes[a] + codes[b], codes[a + b]) for a, b in found], between)
    return merges


def _rows(df: DataFrame) -> Iterator[tuple[str, int]]:
    table = df.toArrow()
    return zip(table.column(0).to_pylist(), table.column(1).to_pylist())


def _placed(words: DataFrame) -> DataFrame:
    """(word, freq, place): place grows with the word's first appearance, with room for the places in the word."""
    tasks = 2 * words.sparkSession.sparkContext.defaultParallelism
    ordered = checkpoint(words.repartitionByRange(tasks, "first_doc", "first_pos").sortWithinPartitions("first_doc", "first_pos").select("word", "freq", F.monotonically_increasing_id().alias("o")))
    part, row = F.shiftright("o", 33), F.col("o").bitwiseAND(F.lit(_ROW))
    parts, rows, longest = (n + 1 for n in ordered.agg(F.max(part), F.max(row), F.max(F.length("word"))).first())
    if parts * rows * longest >= 1 << 63:
        raise OverflowError("the words' places don't fit 64 bits")
    return ordered.select("word", "freq", ((part * rows + row) * longest).alias("place"))


def _laid(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """A batch's words, whose each letter is, the key of each letter with the next one, and whether those are in one word."""
    words = batch.column(0).to_pylist()
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return words, owner, letters[:-1] << 32 | letters[1:], owner[:-1] == owner[1:]


def _pairs(state: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of neighbours: its key, how often it occurs, and in how many places of different words."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, owner, keys, inside = _laid(b)
            own, n, _, first = merging._sums(keys[inside], b.column(1).to_numpy()[owner[:-1]][inside])
            yield pa.record_batch([own, n, np.diff(np.append(first, inside.sum()))], ["key", "n", "places"])

    found = state.mapInArrow(count, "key long, n long, places long").groupBy("key").agg(F.sum("n"), F.sum("places")).toArrow()
    return tuple(c.to_numpy() for c in found.columns)


def _fitting(state: DataFrame, keys: np.ndarray, counts: np.ndarray, places: np.ndarray, min_frequency: int, letters: int) -> tuple[int, DataFrame]:
    """The least threshold tried whose pieces have so few letters, and the pieces. What they will have is estimated for all thresholds at once.

    If the commonest pair alone has more, its pieces are taken: they differ only where one symbol repeats.
    """
    order = np.argsort(-counts, kind="stable")
    ranked, before = counts[order], np.cumsum(places[order])
    # All pairs as common as the threshold count, so it is one above the first that doesn't fit.
    fit = np.searchsorted(before, before[-1] * STEP ** np.arange(STEPS), "right")
    tries = np.where(fit < len(ranked), ranked[np.minimum(fit, len(ranked) - 1)] + 1, 1)
    tries = np.unique(np.clip(tries, max(min_frequency, 1), ranked[0]))
    if 2 * before[-1] > letters:
        tries = np.append(tries[_sizes(state, keys, counts, tries, max(1, letters >> 16)) <= letters], ranked[0])
    for least in tries.tolist():
        pieces = checkpoint(_pieces(state, np.sort(keys[counts >= least])))
        if least >= ranked[0] or (pieces.agg(F.sum(F.length("piece"))).first()[0] or 0) <= letters:
            return least, pieces
    raise AssertionError("the last threshold is that of the commonest pair")


def _runs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last letter of each run of letters that are joined to the next one."""
    step = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _sizes(state: DataFrame, keys: np.ndarray, counts: np.ndarray, thresholds: np.ndarray, share: int) -> np.ndarray:
    """About how many letters the different pieces of each threshold have: those of one piece in ``share``, chosen by a hash, times that."""
    order = np.argsort(keys)
    known, common = keys[order], counts[order]
    odd = 0x9E3779B97F4A7C15

    def sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, owner, own, inside = _laid(b)
            if not len(own):
                continue
            count = np.where(inside, common[np.minimum(np.searchsorted(known, own), len(known) - 1)], 0)
            # A polynomial of the letters modulo 2^64, as a difference of running sums brought to the power 0.
            letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            up, down = (np.cumprod(np.full(len(letters), f, np.uint64)) for f in (odd, pow(odd, -1, 1 << 64)))
            sums = np.append(np.zeros(1, np.uint64), np.cumsum(letters * up))
            for k, least in enumerate(thresholds.tolist()):
                first, last = _runs(count >= least)
                value = (sums[last + 1] - sums[first]) * down[first]
                value = (value ^ value >> np.uint64(32)) * np.uint64(odd)
                taken = (value >> np.uint64(40)) % np.uint64(share) == 0
                value, n = value[taken].view(np.int64), (last - first + 1)[taken]
                yield pa.record_batch([np.full(len(n), k), value, n], ["k", "value", "n"])

    found = state.mapInArrow(sample, "k long, value long, n long").groupBy("k", "value").agg(F.max("n").alias("n")).groupBy("k").agg(F.sum("n")).collect()
    sizes = np.zeros(len(thresholds), np.int64)
    for k, n in found:
        sizes[k] = n * share
    return sizes


def _pieces(state: DataFrame, common: np.ndarray) -> DataFrame:
    """(piece, freq, place): the longest runs of two symbols or more whose neighbours are all among the common pairs, and where each is first."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, owner, keys, inside = _laid(b)
            at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
            first, last = _runs(inside & (common[at] == keys))
            text, own = "".join(words), owner[first]
            begin = np.searchsorted(owner, own)
            pieces = [text[i : j + 1] for i, j in zip(first.tolist(), last.tolist())]
            yield pa.record_batch([pa.array(pieces, pa.string()), b.column(1).to_numpy()[own], b.column(2).to_numpy()[own] + first - begin], ["piece", "freq", "place"])

    each = state.mapInArrow(cut, "piece string, freq long, place long")
    return each.groupBy("piece").agg(F.sum("freq").alias("freq"), F.min("place").alias("place"))


def _merged(state: DataFrame, merges: list[tuple[str, str]], between: str) -> DataFrame:
    """The words after the merges, one after the other; those of one symbol go."""

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                text = between.join(b.column(0).to_pylist())
                for pair, symbol in merges:
                    text = text.replace(pair, symbol)
                yield pa.record_batch([pa.array(text.split(between), pa.string()), b.column(1), b.column(2)], ["word", "freq", "place"])

    return checkpoint(state.mapInArrow(apply, "word string, freq long, place long").where(F.length("word") > 1))
