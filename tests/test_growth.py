"""What a table that grows must not do, and the same results where a step takes another way for large tables."""

import random
import re
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.config import CODE_PATTERN, TokenizerConfig, chat_config
from lodestone.functions import merging
from lodestone.functions import text as T
from lodestone.functions.text import repeats
from lodestone.operators import conversation, dedup, phases, pretokenize, quality
from lodestone.operators.bpe import _encoder, build, train

CODE = TokenizerConfig(regex_pattern=CODE_PATTERN, vocab_size=0, min_frequency=1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_without_sorting_each_occurrence(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "SortAggregate" not in plan(pretokenize.word_counts(docs, CODE))


def test_first_places_of_any_id(spark):
    rng = random.Random(1)
    ids = [None, -(1 << 63), -5, -1, 0, 1, (1 << 32) - 1, 1 << 32, (1 << 63) - 1]
    rows = [(rng.choice(ids), " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 4)))) for _ in range(60)] + [((1 << 63) - 1, "y z"), (None, "x y"), (1 << 32, "x w")]
    got = {tuple(r) for r in pretokenize.word_counts(spark.createDataFrame(rows, "doc_id long, text string"), CODE).collect()}
    seen = {}
    for doc, text in rows:
        for pos, word in enumerate(w for part in text.split(" ") for w in (part, " ")):
            if pos < 2 * text.count(" ") + 1:
                seen.setdefault(word, []).append((-(1 << 64) if doc is None else doc, pos))
    assert got == {(w, len(at), None if min(at)[0] == -(1 << 64) else min(at)[0], min(at)[1]) for w, at in seen.items()}
    small = spark.createDataFrame([(2, "b a"), (1, "a")], "doc_id int, text string")
    assert pretokenize.word_counts(small, CODE).schema["first_doc"].dataType.typeName() == "integer"
    named = spark.createDataFrame([("k", "b a"), ("j", "a")], "doc_id string, text string")
    assert {(r["word"], r["first_doc"], r["first_pos"]) for r in pretokenize.word_counts(named, CODE).collect()} == {("a", "j", 0), ("b", "k", 0), (" ", "k", 1)}


def test_a_tokenizer_of_characters_takes_no_words_to_the_driver(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = pretokenize.word_counts(docs, CODE)
    want = build([(r["word"], r["freq"]) for r in words.collect()], CODE)
    monkeypatch.setattr(merging, "learn", lambda *a: pytest.fail("there is nothing to learn"))
    got = train(docs, CODE)
    assert got.vocab == want.vocab and got.merges == () and got.aliases == want.aliases


def test_merges_learned_in_phases(spark, sf_dir):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("aab") for _ in range(rng.randrange(1, 12))) for _ in range(30)) for _ in range(20)]
    runs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    for docs, limit, least, letters in ((runs, 60, 1, 80), (runs, 1000, 2, 300), (real, 300, 1, 4000)):
        words = pretokenize.word_counts(docs, CODE).where(f"freq >= {least}").cache()
        listed = [(r["word"], r["freq"]) for r in words.orderBy("first_doc", "first_pos").collect()]
        assert sum(len(w) for w, _ in listed) > letters
        taken = []
        plain = merging.learn

        def watched(own, *more):
            own = list(own)
            taken.append(sum(len(w) for w, _ in own))
            return plain(own, *more)

        with pytest.MonkeyPatch.context() as m:
            m.setattr(merging, "learn", watched)
            got = phases.learn(words, {c for w, _ in listed for c in w}, limit, least, letters)
        assert got == plain(listed, limit, least)
        assert len(taken) > 1 and max(taken) <= letters


def test_repetitions_are_found_as_the_pattern_finds_them_and_fast():
    rng, pattern = random.Random(5), re.compile(r"(.{3,}?)\1+")
    for _ in range(4000):
        letters = rng.choice(["ab", "abc", "ab\n", "a\n", "abcd ", "a\U0001f600b"])
        pieces = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 20))) for _ in range(rng.choice([1, 3, 40]))]
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12)))
        assert repeats(t) == sum(1 for _ in pattern.finditer(t))
    t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(400_000))
    began = time.process_time()
    repeats(t)
    assert time.process_time() - began < 2


def test_a_judgement_splits_and_searches_a_text_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = plan(quality.judged(docs, "good").where("good").select("doc_id"))
    assert own.count("split(text") == 1 and own.count("regexp_extract_all(text") == 4


def test_normal_forms_are_made_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "md5(" not in plan(dedup.first_by_hash(docs))


def test_few_python_strings_are_held_at_once(spark):
    column = T.arrow_text(lambda t: t + "!").func
    texts = pa.array([None if k == 70 else f"{k}\U0001f600" + "x" * 10_000 for k in range(1000)])
    tracemalloc.start()
    got = column(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000
    assert got.to_pylist() == [None if t is None else t + "!" for t in texts.to_pylist()]
    assert column(texts.slice(0, 0)).to_pylist() == [] and column(texts.slice(0, 0)).type == pa.string()


@pytest.mark.parametrize("mode", ["canonical", "compat"])
def test_encoding_holds_little_more_than_the_ids_of_a_batch(mode):
    config = TokenizerConfig(regex_pattern=CODE_PATTERN, vocab_size=9, min_frequency=1)
    model = build([("ab", 5), ("abab", 3), ("c", 1)], config, mode)
    words = ["ab", "abab", "bac", "?"] * 600_000
    cuts = [0, 0, 1, 100_000, 524_287, 524_288, 524_289, 1_048_576, 1_048_576, 2_000_000, len(words)]
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(words), mask=pa.array([k == 7 for k in range(len(cuts) - 1)]))
    code = _encoder(model)
    tracemalloc.start()
    got = code(lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 4 * len(got.values)
    for own, k in zip(got.slice(0, 9), range(9)):
        assert own.as_py() == (None if k == 7 else [i for w in words[cuts[k] : cuts[k + 1]] for i in model.word_ids(w)])
    assert len(got.values) == sum(len(model.word_ids(w)) for w in words[:4]) * 600_000
    assert code(lists.slice(2, 3)).to_pylist() == got.slice(2, 3).to_pylist() and code(lists.slice(0, 0)).to_pylist() == []


def test_few_phases_are_enough_and_each_tries_few_thresholds(spark, sf_dir, monkeypatch):
    words = pretokenize.word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), CODE).cache()
    listed = [(r["word"], r["freq"]) for r in words.orderBy("first_doc", "first_pos").collect()]
    letters = sum(len(w) for w, _ in listed) // 7
    phase, cuts, learn, cut = [], [], merging.learn, phases._pieces
    monkeypatch.setattr(merging, "learn", lambda *a: phase.append(1) or learn(*a))
    monkeypatch.setattr(phases, "_pieces", lambda *a: cuts.append(1) or cut(*a))
    assert phases.learn(words, {c for w, _ in listed for c in w}, 600, 2, letters) == learn(listed, 600, 2)
    assert len(phase) <= 4 and len(cuts) <= len(phase) + 1


def test_conversations_are_brought_together_as_texts(spark):
    rows = [(1, 1, "user", "b a"), (1, 1, "user", "a"), (1, 0, "bot", None), (2, 0, None, ""), (2, 1, "assistant", "cab ab")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    model = build([("ab", 3), ("c", 1)], chat_config(40).with_(regex_pattern=CODE_PATTERN, min_frequency=1))
    coded = conversation.encode_conversations(turns, model)
    assert "ArrowEvalPython" in (made := plan(coded)) and made.rindex("array<array<int>>" if "array<array<int>>" in made else "each(") < made.index("collect_list")
    ids = {t: i for t, i in model.vocab.items()}
    own = lambda r, text: [ids[f"<|{r}|>"], *model.encode_text(text), ids["<|turn|>"]]
    start = [ids["<|startoftext|>"]]
    want = {1: start + own("bot", "") + sum(sorted([own("user", "b a"), own("user", "a")]), []), 2: start + own("user", "") + own("assistant", "cab ab")}
    assert {r["conv_id"]: r["ids"] for r in coded.collect()} == want
