"""Byte-pair tokenizers: training, encoding, decoding, and the model itself.

Training counts pre-tokens in Spark and learns merges on the driver, as each merge depends on the one before: from the distinct
pre-tokens if those are few, else from the pieces of them that matter (see :mod:`phases`). Encoding cuts texts by a native regular expression; an Arrow function then looks only at the
distinct pre-tokens of a batch and keeps what it found for the next. A model holds as many tokens as its vocabulary has, however much
text there is.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import UNK, TokenizerConfig
from ..functions import cutting, merging
from . import phases, pretokenize

#: Distinct pre-tokens that a worker remembers, and that training admits to the driver.
MEMO, MAX_TYPES = 1 << 18, 20_000_000
#: Pre-tokens of a batch that are encoded at once.
CHUNK = 1 << 17
#: Bytes of texts whose pre-tokens are held at once.
BYTES = 1 << 22
MODES = ("canonical", "compat")


class UntrainedError(RuntimeError):
    """The tokenizer has a configuration and nothing learned."""


@dataclass(frozen=True)
class BpeModel:
    """An immutable tokenizer: ids by token, merges in the order learned.

    ``aliases`` are ids that a later merge with the same result left behind: they decode, and are never produced. mode says how words
    are merged: "canonical" as in training, "compat" with the stale queue places of older encoders.
    """

    config: TokenizerConfig = field(default_factory=TokenizerConfig)
    vocab: dict[str, int] = field(default_factory=dict)
    merges: tuple[tuple[str, str], ...] = ()
    mode: str = "canonical"
    aliases: dict[int, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")

    # -- lookups

    @cached_property
    def inverse(self) -> dict[int, str]:
        return self.aliases | {i: t for t, i in self.vocab.items()}

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        return {p: k for k, p in enumerate(self.merges)}

    @property
    def trained(self) -> bool:
        return bool(self.vocab)

    @property
    def unk_id(self) -> int | None:
        return self.config.special_tokens.get(UNK, self.vocab.get(UNK))

    def vocab_size(self) -> int:
        return len(self.vocab)

    def token_to_id(self, token: str) -> int | None:
        return self.vocab.get(token)

    def id_to_token(self, token_id: int) -> str | None:
        return self.inverse.get(token_id)

    def with_mode(self, mode: str) -> BpeModel:
        return BpeModel(self.config, self.vocab, self.merges, mode, self.aliases)

    def longest_match(self, text: str, start: int = 0) -> tuple[str, int, int] | None:
        """The longest token that text has at start: (token, id, length)."""
        for end in range(min(len(text), start + self._longest), start, -1):
            if (t := text[start:end]) in self.vocab:
                return t, self.vocab[t], end - start
        return None

    @cached_property
    def _longest(self) -> int:
        return max(map(len, self.vocab), default=0)

    # -- one word, one text

    def split_word(self, word: str) -> list[str]:
        """The tokens of a pre-token. One that is a token itself is left whole."""
        if self.config.use_trie and word in self.vocab:
            return [word]
        if len(word) <= 1:
            return [word] if word in self.vocab else [UNK]
        return (merging.split_canonical if self.mode == "canonical" else merging.split_compat)(word, self.ranks)

    @cached_property
    def _memo(self) -> dict[str, list[int]]:
        return {}

    def clear_cache(self) -> None:
        """Forget the pre-tokens that :meth:`encode_text` remembers. Workers keep theirs for a task only."""
        self._memo.clear()

    def get_cache_stats(self) -> dict[str, int]:
        """How many pre-tokens are remembered. Decoding is a lookup and remembers nothing."""
        return {"encode_cache_size": len(self._memo), "decode_cache_size": 0}

    def word_ids(self, word: str) -> list[int]:
        ids = []
        for t in self.split_word(word):
            i = self.vocab.get(t, self.unk_id)
            if i is None:
                raise ValueError(f"{t!r} isn't in the vocabulary, and there is no {UNK}")
            ids.append(i)
        return ids

    def encode_text(self, text: str) -> list[int]:
        """The ids of one text, on the driver. Needs the third-party regex module, as patterns use Unicode classes."""
        import regex

        self._need_training()
        whole = unicodedata.normalize("NFC", text) if self.config.normalize_unicode else text
        out: list[int] = []
        for w in regex.findall(self.config.regex_pattern, whole):
            if (ids := self._memo.get(w)) is None:
                ids = self.word_ids(w)
                if self.config.enable_caching and len(self._memo) < MEMO:
                    self._memo[w] = ids
            out += ids
        return out

    def decode_ids(self, ids: Iterable[int]) -> str:
        """The tokens end to end; an unknown id shows as the unknown token."""
        self._need_training()
        return "".join(self.inverse.get(i, UNK) for i in ids)

    def _need_training(self) -> None:
        if not self.trained:
            raise UntrainedError("the tokenizer must be trained first")

    # -- columns

    def encode(self, text: Column) -> Column:
        """array<int> of ids; null for null."""
        self._need_training()
        if not pretokenize.by_arrays(self.config):
            return self.encode_words(pretokenize.pretokens(text, self.config))
        return F.arrow_udf(_text_encoder(self), "array<int>")(*pretokenize.to_cut(text, self.config))

    def encode_words(self, words: Column) -> Column:
        """array<int> of the ids of an array of pre-tokens."""
        self._need_training()
        return F.arrow_udf(_encoder(self), "array<int>")(words)

    def encode_lists(self, texts: Column) -> Column:
        """array<array<int>> of the ids of an array of texts' arrays of pre-tokens."""
        self._need_training()
        encode = _encoder(self)

        def each(column: pa.Array) -> pa.Array:
            own, off, null = _lists(column)
            return _rebuilt(off, encode(own), null)

        return F.arrow_udf(each, "array<array<int>>")(texts)

    def decode(self, ids: Column) -> Column:
        self._need_training()
        return F.arrow_udf(_decoder(self), "string")(ids)

    def tokens(self, ids: Column) -> Column:
        """array<string>: the token of each id, null for an unknown one."""
        return F.arrow_udf(_namer(self), "array<string>")(ids)

    # -- tables

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        """(token, id), with a row for every id that decodes."""
        rows = list(self.vocab.items()) + [(t, i) for i, t in self.aliases.items()]
        return spark.createDataFrame(rows, "token string, id int")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        """(rank, left, right)."""
        return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(self.merges)], "rank int, left string, right string")

    # -- files

    def to_dict(self) -> dict:
        return {"config": self.config.to_dict(), "vocab": self.vocab, "merges": [list(p) for p in self.merges], "version": "2.0"}

    @classmethod
    def from_dict(cls, data: dict) -> BpeModel:
        """A model of the current format, or of the old one, whose configuration has four keys that count."""
        c = data["config"]
        if data.get("version") != "2.0":
            c = {k: c[k] for k in ("vocab_size", "min_frequency", "special_tokens", "regex_pattern")}
        return cls(TokenizerConfig.from_dict(c), dict(data["vocab"]), tuple((a, b) for a, b in data["merges"]))

    def save(self, path: str) -> str:
        """Write the model as JSON. Pickle is refused: loading it runs code."""
        self._need_training()
        if not path.endswith(".json"):
            raise ValueError("models are saved as .json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, ensure_ascii=False, indent=2)
        return path

    @classmethod
    def load(cls, path: str) -> BpeModel:
        if not path.endswith(".json"):
            raise ValueError("only .json models are loaded; pickle is refused, as loading it runs code")
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    def save_tables(self, spark: SparkSession, folder: str) -> None:
        """Write the model as Parquet tables, ``vocab`` and ``merges``, and its configuration as text, in any file system."""
        self._need_training()
        self.vocab_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/vocab")
        self.merge_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/merges")
        spark.createDataFrame([(json.dumps(self.config.to_dict()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")

    @classmethod
    def load_tables(cls, spark: SparkSession, folder: str) -> BpeModel:
        config = TokenizerConfig.from_dict(json.loads(spark.read.text(f"{folder}/config").first()[0]))
        vocab = {t: i for t, i in spark.read.parquet(f"{folder}/vocab").orderBy("id").collect()}
        merges = spark.read.parquet(f"{folder}/merges").orderBy("rank").collect()
        return cls(config, vocab, tuple((m["left"], m["right"]) for m in merges))


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array | None]:
    """The values of a list array, the offsets of its lists (nulls empty), and which are null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.append(0, np.cumsum(lengths)), column.is_null() if column.null_count else None


def _text(words: pa.Array) -> str:
    """Strings end to end, of which none is null."""
    if not len(words):
        return ""
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    return words.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes().decode() if ends[0] < ends[-1] else ""


def _rebuilt(offsets: np.ndarray, values: pa.Array, null: pa.Array | None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=null)


def _encoder(model: BpeModel):
    """Encodes lists of words."""
    lay = _laid(model)
    return lambda column: lay(*_lists(column))


def _coder(model: BpeModel):
    return _split_at_once(model) if model.mode == "canonical" else _split_by_word(model)


def _text_encoder(model: BpeModel):
    """Cuts and encodes texts, BYTES of them at a time, so that a batch's pre-tokens are never all there. What differs is split once for a batch."""
    coder = _coder(model)

    def encode(texts: pa.Array, words: pa.Array) -> pa.Array:
        if isinstance(texts, pa.ChunkedArray):
            texts, words = texts.combine_chunks(), words.combine_chunks()
        upto = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
        split = pa.array([], pa.string())
        codes, first, sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts, k = [pa.array([], pa.list_(pa.int32()))], 0
        while k < len(texts):
            j = max(k + 1, int(np.searchsorted(upto, upto[k] + BYTES, "right")) - 1)
            own, ends = cutting.cut_all(texts.slice(k, j - k), words.slice(k, j - k))
            coded = own.dictionary_encode().combine_chunks()
            if isinstance(coded, pa.ChunkedArray):
                coded = pa.concat_arrays(coded.chunks) if coded.num_chunks else pa.array([], pa.string()).dictionary_encode()
            different = coded.dictionary
            at = pc.index_in(different, split)
            new = different.filter(at.is_null())
            numbers = pc.fill_null(at, 0).to_numpy().astype(np.int64)
            numbers[at.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(split), len(split) + len(new))
            if len(new):
                more = [coder(new.slice(i, CHUNK)) for i in range(0, len(new), CHUNK)]
                split = pa.concat_arrays([split, new])
                codes, sizes = np.concatenate([codes, *(c for c, _ in more)]), np.concatenate([sizes, *(n for _, n in more)])
                first = np.cumsum(sizes) - sizes
            ids, places = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
            mine = n = stop = None
            for i in range(0, len(own), CHUNK):
                mine = numbers[coded.indices.slice(i, CHUNK).to_numpy()]
                n = sizes[mine]
                stop = np.cumsum(n)
                ids.append(codes[np.repeat(first[mine] - stop + n, n) + np.arange(stop[-1])])
                places.append(places[-1][-1] + stop)
            null = texts.slice(k, j - k).is_null() if texts.null_count else None
            parts.append(_rebuilt(np.concatenate(places)[ends], pa.array(np.concatenate(ids)), null))
            k = j
            del own, coded, ids, places, mine, n, stop
            cutting.release()
        return pa.concat_arrays(parts)

    return encode


def _laid(model: BpeModel):
    """Encodes the distinct words of a batch, and lays out the ids of CHUNK words at a time, so that little is held beside the batch's ids."""
    coder = _coder(model)

    def encode(words: pa.Array | pa.ChunkedArray, off: np.ndarray, null: pa.Array | None) -> pa.Array:
        coded = words.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        different = coded.dictionary.cast(pa.string())
        found = [coder(different.slice(k, CHUNK)) for k in range(0, len(different), CHUNK)]
        codes = np.concatenate([np.zeros(0, np.int32), *(c for c, _ in found)])
        sizes = np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])
        first = np.cumsum(sizes) - sizes
        ends, parts, total = np.zeros(len(off), np.int64), [], 0
        for k in range(0, len(words), CHUNK):
            at = coded.indices.slice(k, CHUNK).to_numpy(zero_copy_only=False).astype(np.int64)
            n = sizes[at]
            upto = np.append(0, np.cumsum(n))
            parts.append(codes[np.repeat(first[at] - upto[:-1], n) + np.arange(upto[-1])])
            # Lists that begin in this chunk.
            i, j = np.searchsorted(off, [k, k + len(at)])
            ends[i:j] = total + upto[off[i:j] - k]
            total += int(upto[-1])
        ends[off == len(words)] = total
        return _rebuilt(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *parts])), null)

    return encode


def _split_at_once(model: BpeModel):
    """A function from different words to their ids end to end, and how many each has; all words are split together."""
    pairs = merging.Pairs(model.ranks, model.vocab)
    absent = np.iinfo(np.int64).min
    ids = np.array([absent if (i := model.vocab.get(t, model.unk_id)) is None else i for t in [*pairs.names, ""]], np.int64)
    ids[pairs.other] = absent if model.unk_id is None else model.unk_id
    unk = absent if (i := model.vocab.get(UNK, model.unk_id)) is None else i
    # Arrow has no words with lone surrogates.
    known = {t: i for t, i in model.vocab.items() if not any("\ud800" <= c <= "\udfff" for c in t)}
    names, own = pa.array(list(known), pa.string()), np.array(list(known.values()), np.int64)

    def split(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        length = pc.utf8_length(words).to_numpy()
        at = pc.fill_null(pc.index_in(words, names), -1).to_numpy()
        cut = length > 1 if not model.config.use_trie else (length > 1) & (at < 0)
        rest = words.filter(pa.array(cut))
        symbols, n = pairs.split(_text(rest), length[cut].astype(np.int64))
        sizes = np.ones(len(words), np.int64)
        sizes[cut] = n
        flat = np.empty(int(sizes.sum()), np.int64)
        many = np.repeat(cut, sizes)
        flat[many] = ids[symbols]
        flat[~many] = np.where(at >= 0, own[at] if len(own) else unk, unk)[~cut]
        if len(flat) and flat.min() == absent:
            for w in words.to_pylist():
                model.word_ids(w)  # raises
        return flat.astype(np.int32), sizes

    return split


def _split_by_word(model: BpeModel):
    """The same, word by word; words met before are remembered."""
    memo: dict[str, bytes] = {}

    def split(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for w in words.to_pylist():
            if (ids := memo.get(w)) is None:
                ids = array("i", model.word_ids(w)).tobytes()
                if len(memo) < MEMO:
                    memo[w] = ids
            found.append(ids)
        return np.frombuffer(b"".join(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    return split


def _names(model: BpeModel) -> tuple[np.ndarray, list[str]]:
    ids = np.array(sorted(model.inverse), np.int64)
    return ids, [model.inverse[i] for i in ids.tolist()]


def _places(values: pa.Array, ids: np.ndarray) -> np.ndarray:
    """Where each value is among ids; len(ids) if it isn't, or is null."""
    v = pc.fill_null(values.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    at = np.searchsorted(ids, v)
    known = at < len(ids)
    known[known] = ids[at[known]] == v[known]
    return np.where(known, at, len(ids))


def _decoder(model: BpeModel):
    ids, names = _names(model)

    def decode(column: pa.Array) -> pa.Array:
        values, off, null = _lists(column)
        pieces = pa.array([*names, UNK]).take(pa.array(_places(values, ids)))
        return pc.binary_join(_rebuilt(off, pieces, null), "")

    return decode


def _namer(model: BpeModel):
    ids, names = _names(model)

    def name(column: pa.Array) -> pa.Array:
        values, off, null = _lists(column)
        return _rebuilt(off, pa.array([*names, None], pa.string()).take(pa.array(_places(values, ids))), null)

    return name


def build(words: Iterable[tuple[str, int]], config: TokenizerConfig, mode: str = "canonical") -> BpeModel:
    """The model of counted words in the order of their first appearance.

    Special tokens have their own ids, characters follow in code-point order, merges after them. "compat" numbers merges from the
    size of the vocabulary on, even over ids in use; "canonical" from the next free id.
    """
    words = list(words)
    vocab = _alphabet({c for w, _ in words for c in w}, config)
    return _numbered(vocab, merging.learn(words, config.vocab_size - len(vocab), config.min_frequency), config, mode)


def _alphabet(chars: Iterable[str], config: TokenizerConfig) -> dict[str, int]:
    vocab = dict(config.special_tokens)
    next_id = max(vocab.values(), default=-1) + 1
    for c in sorted(chars):
        if c not in vocab:
            vocab[c], next_id = next_id, next_id + 1
    return vocab


def _numbered(vocab: dict[str, int], merges: list[tuple[str, str]], config: TokenizerConfig, mode: str) -> BpeModel:
    next_id = len(vocab) if mode == "compat" else max(vocab.values(), default=-1) + 1
    inverse = {i: t for t, i in vocab.items()}
    for k, (a, b) in enumerate(merges, next_id):
        vocab[a + b] = k
        inverse[k] = a + b
    aliases = {i: t for i, t in inverse.items() if vocab[t] != i}
    return BpeModel(config, vocab, tuple(merges), mode, aliases)


def train(df: DataFrame, config: TokenizerConfig | None = None, text_col: str = "text", order_col: str = "doc_id", mode: str = "canonical", max_types: int = MAX_TYPES) -> BpeModel:
    """Learn a tokenizer from df's texts, read in the order of order_col.

    The distinct pre-tokens that occur min_frequency times are counted. More than max_types of them raise ValueError (nothing is
    left out silently): raise min_frequency. Only their characters go to the driver if the vocabulary has no room for merges.
    """
    from ..runtime import checkpoint

    c = config or TokenizerConfig()
    words = pretokenize.word_counts(df, c, text_col, order_col)
    # The characters fill a vocabulary of that size whatever they are.
    if c.vocab_size > len(c.special_tokens):
        words = checkpoint(words)
        if (n := words.count()) > max_types:
            raise ValueError(f"{n} distinct words occur {c.min_frequency} times, more than {max_types}: raise min_frequency")
    vocab = _alphabet((r[0] for r in pretokenize.chars(words).collect()), c)
    if (limit := c.vocab_size - len(vocab)) <= 0:
        return _numbered(vocab, [], c, mode)
    return _numbered(vocab, phases.learn(words, [t for t in vocab if len(t) == 1], limit, c.min_frequency), c, mode)


def merge_models(models: list[BpeModel], vocab_size: int | None = None, reindex: bool = False) -> BpeModel:
    """One tokenizer with all vocabularies and merges. Of a token's ids the last model's holds, of equal merges the last.

    Ids of different tokens may collide, as they were given by different models; reindex gives new ones, special tokens first.
    """
    if not models:
        raise ValueError("there are no tokenizers to merge")
    vocab: dict[str, int] = {}
    for m in models:
        vocab.update(m.vocab)
    config = TokenizerConfig(vocab_size=vocab_size or len(vocab), use_trie=reindex)
    if reindex:
        names = [t for t in config.special_tokens] + [t for t in vocab if t not in config.special_tokens]
        vocab = {t: k for k, t in enumerate(names)}
    return BpeModel(config, vocab, tuple(p for m in models for p in m.merges))
