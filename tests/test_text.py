"""Cleaning and quality against Python's own string methods."""

import html
import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.config import PreprocessingConfig, TokenizerConfig
from lodestone.functions import text as T
from lodestone.operators import clean, quality

TEXTS = [
    "", " ", "plain words here", "Tom &amp; Jerry &lt;3 &eacute;", "zero​width﻿⁠", "bell\x07 next\x85line\x7f", "école naïve ﬁn", "see https://x.org/a_b?c=1#d and HTTP://Y.ORG:80/z",
    "mail bob.smith+x@mail.example.com now", "call +1 (555) 123-4567 or 555.123.4567", "first paragraph is long\n \nshort\n\nsecond paragraph is long too", "a\r\nb\rc", "cafÃ© “quoted”",
    "你好　世界 x\x1cy", "Stop. Go! Why? Yes", "xyzxyzxyz abcabc", "²½ Ⅰ Ⓐ 1234", "ALL UPPER CASE TEXT THAT SHOUTS LOUD", "aaaaaaaaaaaaaaaaaaaaaaaa", "w " * 3000,
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "doc_id long, text string")


def results(df, expression):
    return dict(df.select("doc_id", expression.alias("x")).collect())


def each(df, expression, function):
    got = results(df, expression)
    assert got.pop(99) is None
    assert got == {k: function(t) for k, t in enumerate(TEXTS)}


def paragraphs(t):
    parts = (re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n\s*\n", t))
    return "\n\n".join(p for p in parts if len(p) >= 10)


def test_steps(texts):
    t = F.col("text")
    each(texts, T.collapse(t), lambda s: re.sub(r"\s+", " ", s).strip())
    each(texts, T.words(t), str.split)
    each(texts, T.strip(t), str.strip)
    each(texts, T.html_unescape(t), html.unescape)
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        each(texts, T.unicode_form(t, form), lambda s, form=form: unicodedata.normalize(form, s))
    each(texts, T.strip_accents(t), lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))
    each(texts, clean.remove_controls(t), lambda s: re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", s))
    each(texts, clean.remove_controls(t, False), lambda s: re.sub("[\x00-\x1f\x7f-\x9f]", "", s))
    each(texts, clean.remove_zero_width(t), lambda s: re.sub("[​-‍⁠﻿]", "", s))
    each(texts, clean.paragraphs(t), paragraphs)
    each(texts, clean.sentences(t), lambda s: [x.strip() for x in re.split(r"[.!?]+\s+", s) if x.strip()])
    each(texts, T.fix_encoding(t), lambda s: s if re.fullmatch("[\t\n -~]*", s) and "&" not in s else T.repair_encoding(s))


def test_masks(texts):
    t = F.col("text")
    assert results(texts, clean.mask_urls(t))[7] == "see  [URL]  and  [URL] "
    assert results(texts, clean.mask_emails(t))[8] == "mail  [EMAIL]  now"
    assert "555" not in results(texts, clean.mask_phones(t))[9]
    assert T.repair_encoding("cafÃ© “x”") == "café \"x\""


def test_whole_cleaning(texts):
    got = results(texts, clean.clean(F.col("text"), PreprocessingConfig(remove_urls=True, remove_emails=True, preserve_paragraph_breaks=False)))
    assert got[3] == "Tom & Jerry <3 é" and got[99] is None and got[11] == "abc" and got[4] == "zerowidth"
    assert results(texts, clean.keep_sentences(F.col("text"), 3, 10))[14] == "Stop Why Yes"
    assert results(texts, clean.keep_sentences(F.col("text"), 500, 900))[14] is None
    with pytest.raises(ValueError):
        PreprocessingConfig.from_dict({"chunk_size": 3})
    with pytest.raises(ValueError):
        PreprocessingConfig(normalize_unicode="XYZ")
    assert PreprocessingConfig(normalize_unicode=True).normalize_unicode == "NFC"
    with pytest.raises(ValueError):
        TokenizerConfig(special_tokens={"<|a|>": 0, "<|b|>": 0})


def measured(t):
    w, n = t.split(), len(t)
    rep = 2 * len(re.findall(r"(.{3,}?)\1{1,}", t)) / n
    lines = t.split("\n")
    m = {
        "length": n, "word_count": len(w), "avg_word_length": sum(map(len, w)) / len(w) if w else 0.0, "unique_words_ratio": len(set(w)) / len(w) if w else 0.0,
        "special_char_ratio": sum(not c.isalnum() and not c.isspace() for c in t) / n, "repetition_ratio": rep, "digit_ratio": sum(map(str.isdigit, t)) / n,
        "uppercase_ratio": sum(map(str.isupper, t)) / n, "line_count": len(lines), "avg_line_length": sum(map(len, lines)) / len(lines),
    }
    s = 1.0
    for bad, f in ((rep > 0.3, 0.5), (m["unique_words_ratio"] < 0.3, 0.7), (m["special_char_ratio"] > 0.2, 0.8), (m["uppercase_ratio"] > 0.5, 0.6), (3 <= m["avg_word_length"] <= 8, 1.1)):
        s *= f if bad else 1.0
    return m | {"quality_score": min(s, 1.0)}


def test_metrics(texts):
    rows = {r["doc_id"]: r.asDict() for r in quality.metrics(texts.where("text is not null")).collect()}
    for k, t in enumerate(TEXTS):
        if not t:
            assert rows[k]["quality_score"] == 0 and rows[k]["length"] == 0 and rows[k]["digit_ratio"] is None
            continue
        for name, want in measured(t).items():
            assert math.isclose(rows[k][name], want, abs_tol=1e-12), (t[:40], name)
    scores = results(texts.where("text is not null"), quality.score(F.col("text")))
    assert all(math.isclose(scores[k], rows[k]["quality_score"]) for k in scores)


def test_repetition_guard(spark):
    """The cheap necessary condition never changes a score."""
    import random

    random.seed(5)
    rows = [(k, "".join(random.choice("ab c") for _ in range(random.randint(1, 60))) if k % 2 else "".join(random.choice(("abcabc", "xyzxyz", "q")) for _ in range(9))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = results(df, quality.too_repetitive(F.col("text"), 0.3))
    assert got == {k: measured(t)["repetition_ratio"] > 0.3 for k, t in rows} and any(got.values())
    assert [T.repeats(t) for _, t in rows] == [len(re.findall(r"(.{3,}?)\1{1,}", t)) for _, t in rows]


def test_boundaries(spark):
    words = "word " * 9
    rows = [(0, "x" * 49), (1, words + "end of it all here"), (2, words.strip()), (3, None), (4, "")]
    good = results(spark.createDataFrame(rows, "doc_id long, text string"), quality.is_high_quality(F.col("text"), PreprocessingConfig(min_unique_words_ratio=0.0)))
    assert good == {0: False, 1: True, 2: False, 3: False, 4: False}
