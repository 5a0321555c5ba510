"""Configurations of tokenizers and of text preparation. All are immutable and reject unknown names."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any


def special(name: str) -> str:
    return f"<|{name}|>"


BASE_SPECIALS = ("endoftext", "startoftext", "pad", "unk")
CHAT_SPECIALS = BASE_SPECIALS + ("user", "assistant", "system", "human", "ai", "bot", "prompter", "turn", "context", "instruction", "response")
UNK = special("unk")

# The pieces of the usual pattern, tried in this order: contractions, a word with one mark before it, up to three digits,
# marks, line ends, white space but for the last blank before a word, other white space. Java takes it as it is, with (?U).
WORD_PATTERN = "|".join((r"'(?i:s|d|m|t|ll|ve|re)", r"[^\p{L}\p{N}\n\r]?+\p{L}+", r"\p{N}{1,3}", r" ?[^\p{N}\p{L}\s]++[\n\r]*", r"\s*[\n\r]", r"\s+(?!\S)", r"\s+"))
CODE_PATTERN = "|".join((r"[\t ]+", r"[_a-zA-Z][_a-zA-Z0-9]*", r"\d+\.?\d*", r"[^\s\w]", r"\n"))


def numbered(names: tuple[str, ...], start: int = 0, step: int = 1) -> dict[str, int]:
    """Ids for special tokens, in the order of their names."""
    return {special(n): start + step * k for k, n in enumerate(names)}


class _Config:
    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict[str, Any]):
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)

    def with_(self, **changes):
        return type(self).from_dict(self.to_dict() | changes)


@dataclass(frozen=True)
class TokenizerConfig(_Config):
    """Settings of a tokenizer. The last five are accepted for old configuration files and change no result."""

    vocab_size: int = 50_000
    min_frequency: int = 2
    special_tokens: dict[str, int] = field(default_factory=lambda: numbered(BASE_SPECIALS))
    regex_pattern: str = WORD_PATTERN
    normalize_unicode: bool = True
    use_trie: bool = True
    preserve_spaces: bool = True
    chunk_size: int = 10_000
    max_workers: int = 4
    enable_caching: bool = True

    def __post_init__(self):
        if self.special_tokens is None:
            object.__setattr__(self, "special_tokens", numbered(BASE_SPECIALS))
        if len(set(self.special_tokens.values())) != len(self.special_tokens):
            raise ValueError("special tokens must have different ids")


def chat_config(vocab_size: int = 50_000) -> TokenizerConfig:
    """For conversations: with tokens for roles and turns."""
    return TokenizerConfig(vocab_size=vocab_size, special_tokens=numbered(CHAT_SPECIALS))


@dataclass(frozen=True)
class PreprocessingConfig(_Config):
    """Settings of cleaning, quality filtering and deduplication. The last four are accepted and change no result."""

    fix_encoding: bool = True
    fix_html_entities: bool = True
    normalize_unicode: str | bool | None = "NFC"
    remove_control_chars: bool = True
    remove_zero_width_chars: bool = True
    remove_urls: bool = False
    remove_emails: bool = False
    remove_phone_numbers: bool = False
    normalize_whitespace: bool = True
    preserve_paragraph_breaks: bool = True
    min_line_length: int = 10
    min_text_length: int = 50
    max_text_length: int = 1_000_000
    min_word_count: int = 10
    max_repetition_ratio: float = 0.3
    min_unique_words_ratio: float = 0.3
    max_special_char_ratio: float = 0.2
    quality_threshold: float = 0.5
    remove_duplicates: bool = True
    duplicate_threshold: float = 0.85
    split_sentences: bool = False
    min_sentence_length: int = 20
    max_sentence_length: int = 1000
    detect_language: bool = False
    allowed_languages: tuple[str, ...] | None = None
    preserve_case: bool = True
    title_case_threshold: float = 0.8

    def __post_init__(self):
        form = {True: "NFC", False: None}.get(self.normalize_unicode, self.normalize_unicode)
        if form not in (None, "NFC", "NFD", "NFKC", "NFKD"):
            raise ValueError(f"no such Unicode form: {form}")
        object.__setattr__(self, "normalize_unicode", form)


__all__ = ["CHAT_SPECIALS", "CODE_PATTERN", "PreprocessingConfig", "TokenizerConfig", "UNK", "WORD_PATTERN", "chat_config", "numbered", "special"]
