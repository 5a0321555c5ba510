"""Byte-pair kernels against plain recounting."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.config import TokenizerConfig, numbered
from lodestone.functions import merging
from lodestone.operators import bpe
from lodestone.operators.bpe import BpeModel, build, merge_models
from lodestone.operators.pretokenize import captures


def recounted(words, limit, least):
    """Every merge from a full recount; Counter keeps the order in which pairs are met."""
    now, out = [(list(w), f) for w, f in words], []
    while len(out) < limit:
        counts = Counter()
        for s, f in now:
            for p in zip(s, s[1:]):
                counts[p] += f
        if not counts or max(counts.values()) < least:
            break
        out.append(counts.most_common(1)[0][0])
        now = [(merging.merge(s, out[-1]), f) for s, f in now]
    return out


word_lists = st.dictionaries(st.text("abc", min_size=1, max_size=9), st.integers(1, 4), min_size=1, max_size=12)


@settings(max_examples=300, deadline=None)
@given(word_lists, st.integers(0, 30), st.integers(1, 3))
def test_learning_is_recounting(words, limit, least):
    assert merging.learn(words.items(), limit, least) == recounted(words.items(), limit, least)


@settings(max_examples=200, deadline=None)
@given(word_lists)
def test_a_training_word_ends_as_training_left_it(words):
    merges = merging.learn(words.items(), 20, 1)
    ranks = {p: k for k, p in reversed(list(enumerate(merges)))}
    for w in words:
        symbols = list(w)
        for p in merges:
            symbols = merging.merge(symbols, p)
        assert merging.split_canonical(w, ranks) == symbols
        assert "".join(merging.split_compat(w, ranks)) == w


def test_merge_traces():
    ab = {("a", "b"): 0}
    assert merging.split_canonical("abab", ab) == ["ab", "ab"]
    assert merging.split_compat("abab", ab) == ["ab", "a", "b"]
    low = {("l", "o"): 0, ("lo", "w"): 1, ("low", "x"): 2}
    assert merging.split_canonical("lowxy", low) == ["lowx", "y"]
    assert merging.split_compat("lowxy", low) == ["low", "x", "y"]


def stale_queue(word, ranks):
    """The quirk as a simulation of the set of valid places, shifted twice by each merge."""
    import heapq

    t = list(word)
    heap = [(ranks[p], i, p) for i, p in enumerate(zip(t, t[1:])) if p in ranks]
    heapq.heapify(heap)
    valid = set(range(len(t)))
    while heap:
        _, pos, pair = heapq.heappop(heap)
        if not {pos, pos + 1} <= valid or pos >= len(t) - 1 or (t[pos], t[pos + 1]) != pair:
            continue
        size = len(t)
        t[pos : pos + 2] = [t[pos] + t[pos + 1]]
        valid -= {pos + 1}
        for i in range(pos + 1, size - 1):
            if i + 1 in valid:
                valid = valid - {i + 1} | {i}
        valid = {p if p <= pos else p - 1 for p in valid if p != pos + 1}
        for q in (pos - 1, pos):
            if 0 <= q < len(t) - 1 and (q if q < pos else q + 1) in valid and (t[q], t[q + 1]) in ranks:
                heapq.heappush(heap, (ranks[t[q], t[q + 1]], q, (t[q], t[q + 1])))
    return t


@settings(max_examples=300, deadline=None)
@given(word_lists, st.text("abc", min_size=2, max_size=14))
def test_compat_follows_the_stale_queue(words, word):
    ranks = {p: k for k, p in enumerate(merging.learn(words.items(), 20, 1))}
    assert merging.split_compat(word, ranks) == stale_queue(word, ranks)


def test_ids():
    m = build([("low", 5), ("lower", 2), ("zz", 1)], TokenizerConfig(vocab_size=12, min_frequency=2))
    assert [m.vocab[c] for c in "elorwz"] == [4, 5, 6, 7, 8, 9]
    assert m.merges == (("l", "o"), ("lo", "w")) and m.vocab["lo"] == 10 and m.vocab["low"] == 11
    high = TokenizerConfig(vocab_size=9, special_tokens=numbered(("endoftext", "startoftext", "pad", "unk"), 6, -1))
    canonical, compat = build([("ababc", 3)], high), build([("ababc", 3)], high, "compat")
    assert len(set(canonical.vocab.values())) == len(canonical.vocab)
    # The older numbering runs from the size of the vocabulary, into ids in use.
    assert compat.vocab["ab"] == 7 == compat.vocab["a"]
    assert canonical.merges == compat.merges


def test_equal_results_of_two_merges_leave_an_alias():
    m = build([("ab", 9), ("abc", 1), ("bc", 8), ("abcx", 7), ("abcy", 7)], TokenizerConfig(vocab_size=60, min_frequency=1))
    assert all(m.decode_ids([i]) == t for t, i in m.vocab.items())
    assert all(m.id_to_token(i) == t for i, t in m.aliases.items())


def test_merging_models():
    a, b = build([("ab", 2)], TokenizerConfig(vocab_size=9)), build([("bc", 2)], TokenizerConfig(vocab_size=9))
    m = merge_models([a, b])
    assert m.vocab["b"] == 4 and m.vocab["a"] == 4 and m.merges == (("a", "b"), ("b", "c"))
    r = merge_models([a, b], reindex=True)
    assert len(set(r.vocab.values())) == len(r.vocab) and r.decode_ids(r.encode_text("abbc")) == "abbc"


def test_files(tmp_path):
    import pytest

    m = build([("low", 5), ("lower", 2)], TokenizerConfig(vocab_size=20))
    p = m.save(str(tmp_path / "m.json"))
    again = BpeModel.load(p)
    assert again.vocab == m.vocab and again.merges == m.merges and again.config == m.config
    old = m.to_dict() | {"version": "1.0"}
    old["config"] = {k: old["config"][k] for k in ("vocab_size", "min_frequency", "special_tokens", "regex_pattern")} | {"something": 1}
    assert BpeModel.from_dict(old).vocab == m.vocab
    with pytest.raises(ValueError):
        m.save(str(tmp_path / "m.pkl"))
    with pytest.raises(RuntimeError):
        BpeModel().encode_text("x")


def test_unknown_characters_and_ids():
    m = build([("low", 5)], TokenizerConfig(vocab_size=20))
    unk = m.vocab["<|unk|>"]
    assert m.encode_text("q") == [unk] and m.decode_ids([10_000]) == "<|unk|>"
    assert m.longest_match("lowest") == ("low", m.vocab["low"], 3) and m.longest_match("xyz") is None


def test_captures():
    assert captures("(a)b") and captures("(?<n>a)") and captures("(?P<n>a)")
    assert not any(map(captures, ("[(]a", "(?:a)", "(?<=a)b", r"\(a", "[]()]")))


def test_words_split_together_are_split_as_one_by_one():
    rng = random.Random(11)
    for alphabet, texts, limit in (("ab", 40, 12), ("aab é\U0001f600", 60, 40), ("abcdefgh", 200, 150)):
        words = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 5, 9, 40]))) for _ in range(texts)]
        pairs = merging.learn([(w, 1) for w in words], limit, 1)
        # Ranks in any order too: a later merge may then make what an earlier one takes, or what another one makes.
        for ranks in ({p: k for k, p in enumerate(pairs)}, {p: k for k, p in enumerate(rng.sample(pairs, len(pairs)))}, {}):
            own = words + ["a" * 31, "zaz", "ab" * 3000]
            symbols, sizes = (table := merging.Pairs(ranks, alphabet[1:])).split("".join(own), np.array([len(w) for w in own]))
            names, ends = [*table.names, None], np.cumsum(sizes).tolist()
            for w, end, n in zip(own, ends, sizes.tolist()):
                want = merging.split_canonical(w, ranks)
                assert [names[k] for k in symbols[end - n : end].tolist()] == [t if t in table.names else None for t in want]
    assert [len(a) for a in merging.Pairs({}).split("", np.zeros(0, np.int64))] == [0, 0]


@pytest.mark.parametrize("use_trie", [True, False])
def test_encoding_at_once_is_encoding_by_word(use_trie):
    config = TokenizerConfig(vocab_size=40, min_frequency=1, use_trie=use_trie)
    model = build([("abab", 3), ("aab", 2), ("aaaa", 1), ("c", 1)], config)
    words = ["abab", "", "a", "x", "axb", "aaaaa", "abcx", "<|unk|>", "ab"]
    assert bpe._encoder(model)(pa.array([words])).to_pylist() == [[i for w in words for i in model.word_ids(w)]]
    bare = BpeModel(config.with_(special_tokens={"<|pad|>": 9}), {"a": 0, "b": 1}, ())
    with pytest.raises(ValueError, match="'x' isn't in the vocabulary"):
        bpe._encoder(bare)(pa.array([["ab", "axb"]]))


def test_encoding_many_different_words_is_fast():
    rng = random.Random(2)
    words = list({"".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(60_000)})
    model = build([(w, 1) for w in words[:2000]], TokenizerConfig(vocab_size=400, min_frequency=1))
    one, all_at_once = time.process_time(), bpe._encoder(model)
    for w in words[:6000]:
        model.word_ids(w)
    one = time.process_time() - one
    began = time.process_time()
    all_at_once(pa.array([words]))
    assert time.process_time() - began < 4 * one  # ten times as many words
