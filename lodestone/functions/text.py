"""Column functions over text that agree with Python's notions of white space, letters, digits and case.

Python functions are used only where Spark has no built-in, and rows that can't be changed by one never carry their text to
it: they send a null, and keep what they have.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.isspace holds for, as the inside of a Java character class.
WS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same for RE2.
WS_RE2 = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Digits to str.isdigit that aren't decimal (category Nd): superscripts, circled digits and the like.
_ODD = [i for i in range(0x20000) if chr(i).isdigit() and unicodedata.category(chr(i)) != "Nd"]
ODD_DIGITS = "".join(f"\\x{{{i:x}}}-\\x{{{next(j for j in range(i, 0x20001) if j + 1 not in _ODD):x}}}" for i in _ODD if i - 1 not in _ODD)
URL = r"(?iU)https?://[.\w-]+(?::[0-9]+)?(?:/[/.\w]*)?(?:\?[%&=.\w]*)?(?:#[.\w]*)?"
EMAIL = r"(?U)\b[a-zA-Z0-9%+._-]+@[a-zA-Z0-9.-]+\.[a-z|A-Z]{2,}\b"
PHONE = rf"(?U)(?:\+?1[.{WS}-]?)?\(?\d{{3}}\)?[.{WS}-]?\d{{3}}[.{WS}-]?\d{{4}}"


def replaced(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """function(value), value being computed once: what a lambda refers to from outside would be computed for each element."""
    return F.get(F.transform(F.array(value), function), 0)


def strip(text: Column) -> Column:
    """str.strip()."""
    return replaced(text, f"^[{WS}]+|[{WS}]+$", "")


def collapse(text: Column) -> Column:
    """Every run of white space becomes one blank; none is left at the ends."""
    return strip(replaced(text, f"[{WS}]+", " "))


def words(text: Column) -> Column:
    """str.split()."""
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def word_numbers(text: Column) -> Column:
    """A struct of how many words a text has (n) and how many different ones (different), without a function for each word.

    A split at white space gives the words, and an empty string at an end where the text has white space.
    """

    def numbers(s: Column) -> Column:
        first, last = F.get(s, F.lit(0)) == "", F.get(s, F.size(s) - 1) == ""
        n = F.size(s) - first.cast("int") - ((F.size(s) > 1) & last).cast("int")
        return F.struct(n.alias("n"), (F.size(F.array_distinct(s)) - (first | last).cast("int")).alias("different"))

    return bound(F.split(text, f"[{WS}]+"), numbers)


#: Rows whose strings a Python function holds at once.
_ROWS = 64


def arrow_text(function: Callable[[str], str]):
    """A column function that applies a Python function to the strings that aren't null."""

    def some(texts: pa.Array) -> pa.Array:
        return pa.array([None if (t := x.as_py()) is None else function(t) for x in texts], pa.string())

    def apply(texts: pa.Array) -> pa.Array:
        # Python's strings take up to four bytes a character: only those of a few rows are held at once.
        return pa.concat_arrays([some(texts.slice(k, _ROWS)) for k in range(0, max(1, len(texts)), _ROWS)])

    return F.arrow_udf(apply, "string")


def only_where(needed: Column, function, text: Column) -> Column:
    """function(text) where it is needed, and text elsewhere."""
    return F.coalesce(function(F.when(needed, text)), text)


def non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7f]")


def beyond_latin(text: Column) -> Column:
    """Whether there are combining marks, or characters after those."""
    return text.rlike(r"[^\x00-\u02ff]")


def unicode_form(text: Column, form: str = "NFC") -> Column:
    """Unicode normalisation; ASCII texts are in every form already, those of characters before the combining marks in NFC."""

    def normalise(t: str) -> str:
        return unicodedata.normalize(form, t)

    return only_where(beyond_latin(text) if form == "NFC" else non_ascii(text), arrow_text(normalise), text)


def html_unescape(text: Column) -> Column:
    return only_where(F.contains(text, F.lit("&")), arrow_text(html.unescape), text)


def strip_accents(text: Column) -> Column:
    """Without nonspacing marks; what is left stays decomposed."""

    def bare(t: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")

    return only_where(non_ascii(text), arrow_text(bare), text)


_TAIL = "[\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2020\u2021\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]"
_MOJIBAKE = re.compile(f"(?:[\u00c2-\u00df]{_TAIL}|[\u00e0-\u00ef]{_TAIL}{{2}}|[\u00f0-\u00f4]{_TAIL}{{3}})+")
_QUOTES = str.maketrans({**dict.fromkeys("\u02bc\u2018\u2019\u201a\u201b", "'"), **dict.fromkeys("\u201c\u201d\u201e\u201f", '"')})
_LIGATURES = str.maketrans({"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"})
_LINES = re.compile("\r\n|[\r\u0085\u2028\u2029]")
_CONTROLS = re.compile("\x1b\\[[0-9;]*[a-zA-Z]|[\x00-\x08\x0b\x0e-\x1f\x7f\ufeff\ufff9-\ufffc\u206a-\u206f]")
_WIDE = re.compile("[\uff01-\uffef\u3000]")


def _byte(c: str) -> bytes:
    """The byte that Windows-1252, or Latin-1 where that has a gap, shows as c."""
    try:
        return c.encode("cp1252")
    except UnicodeEncodeError:
        return c.encode("latin-1")


def _reread(m: re.Match) -> str:
    try:
        return b"".join(map(_byte, m[0])).decode("utf-8")
    except UnicodeError:
        return m[0]


def repair_encoding(t: str) -> str:
    """ftfy.fix_text, if that is installed; otherwise its documented main steps.

    UTF-8 that was read as Windows-1252 is read again; HTML entities go if there is no tag; ligatures, wide letters, curly quotes,
    line ends and control characters get their plain forms; the result is in NFC. Parity with ftfy isn't complete.
    """
    try:
        import ftfy
    except ModuleNotFoundError:
        pass
    else:
        return ftfy.fix_text(t)
    if "&" in t and "<" not in t:
        t = html.unescape(t)
    for _ in range(3):
        better = _MOJIBAKE.sub(_reread, t)
        if better == t:
            break
        t = better
    t = t.translate(_LIGATURES).translate(_QUOTES)
    t = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), t)
    return unicodedata.normalize("NFC", _CONTROLS.sub("", _LINES.sub("\n", t)))


def fix_encoding(text: Column) -> Column:
    return only_where(text.rlike(r"[^\x09\x0a\x20-\x7e]|&"), arrow_text(repair_encoding), text)


#: Steps below it are compared for all places at once, longer ones where that many characters come again; the factor of their hash.
_SEED, _MIX = 8, np.uint64(0x9E3779B97F4A7C15)


def repeats(t: str) -> int:
    """How many matches (.{3,}?)\\1+ has: from each place, the shortest piece of three characters or more that follows itself
    within the line, taken as often as it does. Only places are tried where a short piece does, or where the next eight characters
    come again."""
    n = len(t)
    if n < 6:
        return 0
    a = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    breaks = np.flatnonzero(a == 10)
    # No two line ends are equal, so that nothing matches across one.
    a[breaks] = np.arange(len(breaks), dtype=np.uint64) + np.uint64(0x110000)
    short = np.zeros(n, np.int64)
    for step in range(min(_SEED - 1, n // 2), 2, -1):
        same = np.append(0, np.cumsum(a[:-step] == a[step:]))
        short[np.flatnonzero(same[step:] - same[:-step] == step)] = step
    following = np.full(n, -1, np.int64)
    if n >= 2 * _SEED:
        h = a[: n - _SEED + 1].copy()
        for k in range(1, _SEED):
            h *= _MIX
            h += a[k : n - _SEED + 1 + k]
        order = np.argsort(h, kind="stable")
        again = h[order][1:] == h[order][:-1]
        following[order[:-1][again]] = order[1:][again]
    places = np.flatnonzero((short > 0) | (following >= 0))
    stops = np.append(breaks, n)[np.searchsorted(breaks, places)]
    found = end = 0
    for i, step, stop in zip(places.tolist(), short[places].tolist(), stops.tolist()):
        if i < end:
            continue
        j = int(following[i]) if not step else -1
        while j >= 0 and 2 * j - i <= stop:
            if j - i >= _SEED and t[i:j] == t[j : 2 * j - i]:
                step = j - i
                break
            j = int(following[j])
        if step:
            end, piece = i + 2 * step, t[i : i + step]
            while t.startswith(piece, end):
                end += step
            found += 1
    return found


def repeat_count(text: Column) -> Column:
    """The number of immediate repetitions, by a search that is about linear in the text."""

    def count(texts: pa.Array) -> pa.Array:
        return pa.array([None if (t := x.as_py()) is None else repeats(t) for x in texts], pa.int32())

    return F.arrow_udf(count, "int")(text)
