"""Text cleaning, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PreprocessingConfig
from ..functions import text as T

CONTROLS, ALL_CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", r"[\x00-\x1f\x7f-\x9f]"
ZERO_WIDTH = r"[​-‍⁠﻿]"


def remove_controls(text: Column, keep_lines: bool = True) -> Column:
    """Without control characters; line ends and tabs stay if keep_lines."""
    return T.replaced(text, CONTROLS if keep_lines else ALL_CONTROLS, "")


def remove_zero_width(text: Column) -> Column:
    return T.replaced(text, ZERO_WIDTH, "")


def mask_urls(text: Column) -> Column:
    return T.replaced(text, T.URL, " [URL] ")


def mask_emails(text: Column) -> Column:
    return T.replaced(text, T.EMAIL, " [EMAIL] ")


def mask_phones(text: Column) -> Column:
    return T.replaced(text, T.PHONE, " [PHONE] ")


def paragraphs(text: Column, min_length: int = 10) -> Column:
    """Paragraphs parted by one empty line, the white space in each collapsed; shorter ones are dropped."""
    parts = F.transform(F.split(text, rf"\n[{T.WS}]*\n"), T.collapse)
    return F.array_join(F.filter(parts, lambda p: F.length(p) >= min_length), "\n\n")


def clean(text: Column, config: PreprocessingConfig | None = None) -> Column:
    """The steps that the configuration turns on, in their fixed order. What isn't a string is cast; null stays null."""
    c = config or PreprocessingConfig()
    out = text.cast("string")
    if c.fix_encoding:
        out = T.fix_encoding(out)
    if c.fix_html_entities:
        out = T.html_unescape(out)
    if c.normalize_unicode:
        out = T.unicode_form(out, c.normalize_unicode)
    if c.remove_control_chars:
        out = remove_controls(out, c.preserve_paragraph_breaks)
    if c.remove_zero_width_chars:
        out = remove_zero_width(out)
    if c.remove_urls:
        out = mask_urls(out)
    if c.remove_emails:
        out = mask_emails(out)
    if c.remove_phone_numbers:
        out = mask_phones(out)
    if c.normalize_whitespace:
        out = paragraphs(out, c.min_line_length) if c.preserve_paragraph_breaks else T.collapse(out)
    return out


def normalise(text: Column, normalize_unicode: bool = True, strip_accents: bool = False, lowercase: bool = False, remove_control_chars: bool = True) -> Column:
    """The simpler cleaner: NFC, controls, accents, case, then white space."""
    out = text.cast("string")
    if normalize_unicode:
        out = T.unicode_form(out, "NFC")
    if remove_control_chars:
        out = remove_controls(out)
    if strip_accents:
        out = T.strip_accents(out)
    if lowercase:
        out = F.lower(out)
    return T.collapse(out)


def sentences(text: Column) -> Column:
    """Sentences, parted where marks of ending and white space meet; all but the last lose those marks."""
    parts = F.transform(F.split(text, rf"[.!?]+[{T.WS}]+"), T.strip)
    return F.filter(parts, lambda s: s != "")


def keep_sentences(text: Column, min_length: int = 20, max_length: int = 1000) -> Column:
    """The sentences of admissible length, joined by blanks; null if there is none."""
    kept = F.filter(sentences(text), lambda s: F.length(s).between(min_length, max_length))
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def explode_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, sentence)."""
    return df.select(F.col(id_col), F.posexplode(sentences(F.col(text_col))).alias("pos", "sentence"))


def filter_by_length(df: DataFrame, min_length: int = 10, max_length: int = 10_000, text_col: str = "text") -> DataFrame:
    """Rows whose text has min_length to max_length characters."""
    return df.where(F.length(text_col).between(min_length, max_length))
