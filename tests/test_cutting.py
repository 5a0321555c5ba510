"""Texts cut by arrays are cut as the pattern cuts them."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.config import CODE_PATTERN, TokenizerConfig
from lodestone.functions import cutting
from lodestone.operators import bpe, pretokenize
from lodestone.operators.bpe import build
from lodestone.sources import writers

CODE = TokenizerConfig(regex_pattern=CODE_PATTERN, vocab_size=20, min_frequency=1)


def cut_by_arrays(texts):
    words, ends = cutting.cut_code(texts)
    flat = [w for part in words for w in part.to_pylist()]
    return [flat[i:j] for i, j in zip(ends, ends[1:])]


def cut_by_pattern(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r[0] or [] for r in df.orderBy("k").select(pretokenize.cut(F.col("t"), CODE)).collect()]


@pytest.mark.parametrize("size", [1, 12, 1 << 18])
def test_cutting_by_arrays_is_cutting_by_the_pattern(spark, monkeypatch, size):
    monkeypatch.setattr(cutting, "BYTES", size)
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab_1 2..\t\né…\U0001f600-\x1c\ŕ中") for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(1500)]
    texts += ["1.2.3.4.", "1..2", "a1.2b", "12ab", ".5", "", "1."]
    texts[7] = texts[70] = None
    assert cut_by_arrays(pa.array(texts, pa.string())) == (want := cut_by_pattern(spark, texts))
    assert cut_by_arrays(pa.array(texts, pa.string()).slice(5, 90)) == want[5:95]
    assert cut_by_arrays(pa.array([], pa.string())) == []


def test_known_characters_have_the_classes_of_the_pattern(spark):
    known = [chr(c) for a, b in cutting.KNOWN for c in range(a, b + 1)]
    texts = [f"a{c}b{c}1{c}2." for c in known]
    assert cut_by_arrays(pa.array(texts)) == cut_by_pattern(spark, texts)
    assert not spark.createDataFrame([(t,) for t in texts], "t string").where(F.col("t").rlike(cutting.UNKNOWN)).count()


def test_unknown_characters_go_by_the_pattern(spark):
    texts = ["a b 1", "x١٢2 y", None, "\U0001fbf5 é", "", "١"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert [r[0] for r in df.orderBy("doc_id").select(F.col("text").rlike(cutting.UNKNOWN)).collect()] == [False, True, None, True, False, True]
    seen = {}
    for r in df.select("doc_id", F.posexplode(pretokenize.pretokens(F.col("text"), CODE))).collect():
        seen.setdefault(r["col"], []).append((r["doc_id"], r["pos"]))
    got = {tuple(r) for r in pretokenize.word_counts(df.orderBy(F.desc("doc_id")), CODE).collect()}
    assert got == {(w, len(at), *min(at)) for w, at in seen.items()}
    model = build([(w, len(at)) for w, at in seen.items()], CODE)
    both = df.select("text", model.encode(F.col("text")).alias("a"), model.encode_words(pretokenize.pretokens(F.col("text"), CODE)).alias("b")).collect()
    assert all(r["a"] == r["b"] and (r["a"] is None) == (r["text"] is None) for r in both)


def test_cutting_is_faster_than_a_pattern():
    rng = random.Random(4)
    texts = pa.array([" ".join("".join(rng.choice("abcdefg1é") for _ in range(rng.randrange(1, 9))) for _ in range(500)) for _ in range(200)])
    from re import findall

    began = time.process_time()
    for t in texts.to_pylist():
        findall(r"[\t ]+|[_a-zA-Z][_a-zA-Z0-9]*|[0-9]+\.?[0-9]*|[^\s\w]|\n", t)
    pattern = time.process_time() - began
    began = time.process_time()
    cutting.cut_code(texts)
    assert time.process_time() - began < pattern / 2


def test_texts_of_latin_letters_have_their_form(spark):
    letters = "".join(map(chr, range(0x300)))
    df = spark.createDataFrame([(letters,), ("é",), (None,)], "text string").select(pretokenize.whole(F.col("text"), CODE).alias("t"))
    assert [r["t"] for r in df.collect()] == [letters, "é", None]


def test_ids_are_joined(spark, monkeypatch):
    monkeypatch.setattr(writers, "_AT_ONCE", 4)
    rows = [[1, 22, 3], None, [], [7, None, -5], [None], [1 << 40, 2, 3, 4, 5, 6]]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, ids array<long>")
    want = [r[0] for r in df.orderBy("k").select(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")).collect()]
    assert [r[0] for r in df.orderBy("k").select(writers.as_ids(F.col("ids"))).collect()] == want
    assert writers._joined(pa.array([], pa.list_(pa.int32()))).to_pylist() == []
    assert writers._joined(pa.array(rows, pa.list_(pa.int64())).slice(1, 4)).to_pylist() == want[1:5]


def test_a_batch_is_cut_and_encoded_in_parts(monkeypatch):
    rng = random.Random(8)
    texts = [None if k % 9 == 4 else " ".join(rng.choice(["ab", "abc", "1.5", "é", "x"]) for _ in range(rng.randrange(6))) for k in range(60)]
    given = pa.array([["ab", "x"] if k == 30 else None for k in range(60)], pa.list_(pa.string()))
    model, cut, most = build([("ab", 5), ("abc", 3), ("1.5", 2), ("x", 1), (" ", 9)], CODE), cutting.cut_all, []
    monkeypatch.setattr(cutting, "cut_all", lambda t, w: most.append(len(t)) or cut(t, w))
    monkeypatch.setattr(bpe, "BYTES", 40)
    flat, ends = cut(pa.array(texts), given)
    words = [flat.to_pylist()[i:j] for i, j in zip(ends, ends[1:])]
    got = bpe._text_encoder(model)(pa.array(texts), given).to_pylist()
    assert got == [None if t is None else [i for w in ws for i in model.word_ids(w)] for t, ws in zip(texts, words)]
    assert len(most) > 10 and max(most) < 40
