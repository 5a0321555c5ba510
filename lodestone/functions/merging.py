"""The sequential parts of byte-pair encoding: learning merges from counted words, and merging one word."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np

Pair = tuple[str, str]
#: Entries that a table to look up symbols or pairs may have.
TABLE = 1 << 20


def merge(symbols: list[str], pair: Pair) -> list[str]:
    """Every occurrence of the pair joined, from left to right, none overlapping."""
    out, i, last = [], 0, len(symbols) - 1
    a, b = pair
    while i <= last:
        if i < last and symbols[i] == a and symbols[i + 1] == b:
            out.append(a + b)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each key: itself, the sum of its values; the order that brings keys together, and where each begins in it."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])[: len(keys)])
    return keys[order][first], np.add.reduceat(values[order], first) if len(first) else values[:0], order, first


def learn(words: Iterable[tuple[str, int]], limit: int, min_frequency: int, names_of: dict[str, str] | None = None) -> list[Pair]:
    """At most ``limit`` merges over (word, frequency), words in the order of their first appearance.

    Each merge joins the pair of adjacent symbols with the largest count; of equal counts, the one that a reading of all words
    meets first. It ends when no pair is left or the best is rarer than min_frequency.

    All words lie end to end in arrays: a symbol is at the place of its first letter, with links to those beside it in its word. For each
    pair there are the places where it was put, of which some may be stale. A heap holds, for each pair, a key (count, first place)
    that is never worse than the true one: places don't move when symbols merge, counts that grow are pushed anew, and
    an entry that turns out too good is put back where it belongs. A merge updates all its places at once.

    names_of: what those letters stand for that stand for a symbol merged before.
    """
    if limit <= 0:
        return []
    words = list(words)
    sizes = np.fromiter((len(w) for w, _ in words), np.int64, len(words))
    n = int(sizes.sum())
    if not n:
        return []
    letters = np.frombuffer("".join(w for w, _ in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    weight = np.repeat(np.fromiter((f for _, f in words), np.int64, len(words)), sizes)
    names = [(names_of or {}).get(chr(c), chr(c)) for c in np.unique(letters).tolist()]
    numbers = {name: k for k, name in enumerate(names)}
    symbol = np.searchsorted(np.unique(letters), letters).astype(np.int64)
    ends = np.cumsum(sizes)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends[sizes > 0] - 1] = -1
    before[(ends - sizes)[sizes > 0]] = -1

    def pairs(at: np.ndarray) -> np.ndarray:
        return symbol[at] << 32 | symbol[after[at]]

    counts: dict[int, int] = {}
    places: dict[int, list[np.ndarray]] = {}
    bound: dict[int, int] = {}
    queue: list[tuple[int, int, int]] = []

    def add(at: np.ndarray) -> None:
        keys, sums, order, first = _sums(pairs(at), weight[at])
        for key, total, own in zip(keys.tolist(), sums.tolist(), np.split(at[order], first[1:])):
            low = int(own.min())
            if key in counts:
                counts[key] += total
                places[key].append(own)
                bound[key] = min(bound[key], low)
            else:
                counts[key], places[key], bound[key] = total, [own], low
            heapq.heappush(queue, (-counts[key], bound[key], key))

    add(np.flatnonzero(after >= 0))
    merges: list[Pair] = []
    while len(merges) < limit and queue:
        count, low, key = heapq.heappop(queue)
        if key not in counts:
            continue
        if -count != counts[key]:
            heapq.heappush(queue, (-counts[key], bound[key], key))
            # Entries of one key pile up: those below its best are dropped as they come.
            while queue and queue[0][2] == key and queue[0] != (-counts[key], bound[key], key):
                heapq.heappop(queue)
            continue
        a, b = key >> 32, key & 0xFFFFFFFF
        at = np.unique(np.concatenate(places[key]))
        at = at[(symbol[at] == a) & (after[at] >= 0)]
        at = at[symbol[after[at]] == b]
        places[key] = [at]
        if not len(at):
            del counts[key], places[key], bound[key]
            continue
        if int(at[0]) != low:
            bound[key] = int(at[0])
            heapq.heappush(queue, (count, bound[key], key))
            continue
        if counts[key] < min_frequency:
            break
        merges.append((names[a], names[b]))
        if a == b:
            # In a run of equal symbols every second pair is joined, from the left.
            new = np.append(True, after[at[:-1]] != at[1:])
            begin = np.flatnonzero(new)
            at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0]
        right = after[at]
        left, far = before[at], after[right]
        gone = np.unique(np.concatenate([at, right[far >= 0], left[left >= 0]]))
        keys, sums, _, _ = _sums(pairs(gone), weight[gone])
        for k, total in zip(keys.tolist(), sums.tolist()):
            counts[k] -= total
            if not counts[k]:
                del counts[k], places[k], bound[k]
        name = names[a] + names[b]
        if name not in numbers:
            numbers[name] = len(names)
            names.append(name)
        symbol[at], symbol[right], after[at] = numbers[name], -1, far
        before[far[far >= 0]] = at[far >= 0]
        left = before[at]
        now = np.unique(np.concatenate([at[after[at] >= 0], left[left >= 0]]))
        if len(now):
            add(now)
        if key in counts:
            heapq.heappush(queue, (-counts[key], bound[key], key))
    return merges


class Pairs:
    """The pairs of a tokenizer as arrays, to split many words at once as :func:`split_canonical` does.

    Symbols are numbers: their places in ``names``. ``other`` is the number of every letter that isn't among them.
    """

    def __init__(self, ranks: dict[Pair, int], letters: Iterable[str] = ()):
        self.names = sorted({c for c in letters if len(c) == 1} | {s for a, b in ranks for s in (a, b, a + b)})
        self.other, self.none = len(self.names), max(ranks.values(), default=-1) + 1
        at = {name: k for k, name in enumerate(self.names)}
        single = np.array(sorted((ord(name), k) for name, k in at.items() if len(name) == 1), np.int64).reshape(-1, 2)
        self._points, self._symbols = single[:, 0].copy(), single[:, 1].copy()
        pairs = np.array(sorted((at[a] * (self.other + 1) + at[b], k, at[a + b]) for (a, b), k in ranks.items()), np.int64).reshape(-1, 3)
        self._keys, self._ranks = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32)
        # Few symbols have tables of all letters and of all pairs.
        self._letter_table = self._table(self._points, self._symbols, self.other)
        self._pair_table = self._table(self._keys, self._ranks, self.none, (self.other + 1) ** 2)
        self._joined = np.zeros(self.none, np.int64)
        self._joined[pairs[:, 1]] = pairs[:, 2]

    @staticmethod
    def _table(sorted_keys: np.ndarray, values: np.ndarray, otherwise: int, size: int = 0) -> np.ndarray | None:
        """The value of each key below size, or up to the last one; none if those are many."""
        if (size := size or int(sorted_keys[-1] if len(sorted_keys) else 0) + 1) > TABLE:
            return None
        table = np.full(size, otherwise, values.dtype)
        table[sorted_keys] = values
        return table

    @staticmethod
    def _find(sorted_keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: int, table: np.ndarray | None) -> np.ndarray:
        if table is not None:
            found = table[np.minimum(wanted, len(table) - 1)]
            found[wanted >= len(table)] = otherwise
            return found
        if not len(sorted_keys):
            return np.full(len(wanted), otherwise, values.dtype)
        at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == wanted, values[at], values.dtype.type(otherwise))

    def split(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words that lie end to end in text, sizes being their lengths, none of which is 0; and how many each word has.

        In a round, each word's best pair is joined wherever it occurs in the word. Words without one are put aside.
        """
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self._find(self._points, self._symbols, points.astype(np.int64), self.other, self._letter_table)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rank = np.full(len(symbol), self.none, np.int32)

        def look(at: np.ndarray) -> None:
            """The rank of the pairs that begin at these places, where a word doesn't end."""
            rank[at] = self._find(self._keys, self._ranks, symbol[at] * (self.other + 1) + symbol[at + 1], self.none, self._pair_table)

        look(np.flatnonzero(owner[:-1] == owner[1:]))
        owners, symbols = [], []
        while len(owner):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(owner))))
            busy = best < self.none
            if not busy.all():
                owners.append(owner[~busy])
                symbols.append(symbol[~busy])
                owner, symbol, rank, best = owner[busy], symbol[busy], rank[busy], best[busy]
                if not len(owner):
                    break
            at = np.flatnonzero(rank == best)
            # In a run of equal symbols every second pair is joined, from the left.
            begin = np.flatnonzero(np.append(True, np.diff(at) != 1))
            at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0]
            symbol[at] = self._joined[rank[at]]
            stays = np.ones(len(owner), bool)
            stays[at + 1] = False
            now = at - np.arange(1, len(at) + 1) + 1
            owner, symbol, rank = owner[stays], symbol[stays], rank[stays]
            last = np.append(owner[1:] != owner[:-1], True)
            rank[now] = self.none
            near = np.concatenate([now, now[now > 0] - 1])
            look(near[~last[near]])
        owner = np.concatenate([*owners, np.zeros(0, np.int32)])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([*symbols, np.zeros(0, np.int64)])[order], np.bincount(owner, minlength=len(sizes))


def split_canonical(word: str, ranks: dict[Pair, int]) -> list[str]:
    """The word's symbols after the merges in the order they were learned."""
    symbols = list(word)
    while len(symbols) > 1:
        best = min(set(zip(symbols, symbols[1:])), key=lambda p: ranks.get(p, len(ranks)))
        if best not in ranks:
            break
        symbols = merge(symbols, best)
    return symbols


def split_compat(word: str, ranks: dict[Pair, int]) -> list[str]:
    """The same with the known quirk of a queue of merges whose places are never moved.

    A queued merge applies only if its place lies within the first ``live`` symbols and the pair is still there; each merge takes
    one symbol away and makes one more dead, unless it was the last of the live ones.
    """
    symbols = list(word)
    live = len(symbols)
    queue = [(ranks[p], k, p) for k, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    heapq.heapify(queue)

    def offer(k: int) -> None:
        p = (symbols[k], symbols[k + 1])
        if p in ranks:
            heapq.heappush(queue, (ranks[p], k, p))

    while queue:
        _, k, (a, b) = heapq.heappop(queue)
        if k + 1 >= min(live, len(symbols)) or symbols[k] != a or symbols[k + 1] != b:
            continue
        symbols[k : k + 2] = [a + b]
        live -= 2 if k + 2 < live else 1
        if k:
            offer(k - 1)
        if k + 1 < min(live, len(symbols)):
            offer(k)
    return symbols
