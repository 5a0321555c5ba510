"""Columns against the driver's own encode and decode, and statistics against counting in Python."""

from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.config import CODE_PATTERN, TokenizerConfig, chat_config, special
from lodestone.operators import analyze, conversation, pretokenize
from lodestone.operators.bpe import BpeModel, build, train


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return dict(docs.collect())


@pytest.fixture(scope="module")
def model(docs):
    return train(docs, TokenizerConfig(vocab_size=600))


def counted(texts, pattern):
    words = Counter()
    for i in sorted(texts):
        words.update(regex.findall(pattern, texts[i]))
    return words


def test_training_is_counting(docs, texts, model):
    c = TokenizerConfig(vocab_size=600)
    words = [(w, n) for w, n in counted(texts, c.regex_pattern).items() if n >= 2]
    want = build(words, c)
    assert model.merges == want.merges and model.vocab == want.vocab
    again = train(docs.repartition(7), c)
    assert again.merges == model.merges
    with pytest.raises(ValueError):
        train(docs, c, max_types=10)


def test_word_counts(docs, texts):
    c = TokenizerConfig(regex_pattern=CODE_PATTERN, min_frequency=1)
    got = {r["word"]: r["freq"] for r in pretokenize.word_counts(docs, c).collect()}
    assert got == dict(counted(texts, CODE_PATTERN))


@pytest.mark.parametrize("mode", ["canonical", "compat"])
def test_encode_decode(docs, texts, model, mode):
    m = model.with_mode(mode)
    rows = docs.select("doc_id", m.encode(F.col("text")).alias("ids")).withColumn("back", m.decode(F.col("ids"))).collect()
    for r in rows:
        assert list(r["ids"]) == m.encode_text(texts[r["doc_id"]])
        assert r["back"] == m.decode_ids(r["ids"])


def test_nulls_and_unknowns(spark, model):
    df = spark.createDataFrame([(0, None, None), (1, "", []), (2, "你好", [10_000, model.vocab["e"], None])], "k int, text string, ids array<int>")
    rows = df.select("k", model.encode(F.col("text")).alias("e"), model.decode(F.col("ids")).alias("d"), model.tokens(F.col("ids")).alias("t")).orderBy("k").collect()
    assert rows[0][1:] == (None, None, None) and rows[1][1:] == ([], "", [])
    assert rows[2]["e"] == [model.unk_id] * 2 and rows[2]["d"] == "<|unk|>e<|unk|>" and rows[2]["t"] == [None, "e", None]
    with pytest.raises(RuntimeError):
        BpeModel().encode(F.col("text"))


def test_statistics(docs, texts, model):
    ids = {i: model.encode_text(t) for i, t in texts.items()}
    every = Counter(x for i in sorted(ids) for x in ids[i])
    s = analyze.token_stats_table(docs, model).first()
    total = sum(every.values())
    assert (s["total_texts"], s["total_characters"], s["total_tokens"], s["unique_tokens"]) == (len(texts), sum(map(len, texts.values())), total, len(every))
    assert abs(s["avg_token_length"] - sum(len(model.inverse[i]) * n for i, n in every.items()) / total) < 1e-9
    c = analyze.coverage_table(docs, model).first()
    assert abs(c["unknown_rate"] - every[model.unk_id] / total) < 1e-12 and abs(c["coverage_rate"] + c["unknown_rate"] - 1) < 1e-12
    rare = [(r["token"], r["n"]) for r in analyze.rare_tokens(docs, model, 4).collect()]
    assert rare == sorted(((model.inverse[i], n) for i, n in every.items() if n < 4), key=lambda x: x[1])
    for r in analyze.analyze_texts(docs, model).collect():
        own = ids[r["doc_id"]]
        assert (r["text_length"], r["num_tokens"], r["unique_tokens"], list(r["token_ids"])) == (len(texts[r["doc_id"]]), len(own), len(set(own)), own[:100])
        assert [tuple(x) for x in r["most_common_tokens"]] == [(model.inverse[i], n) for i, n in Counter(own).most_common(10)]


def test_empty_input(docs, model):
    none = docs.where("false")
    s, c = analyze.token_stats_table(none, model).first(), analyze.coverage_table(none, model).first()
    assert s["total_texts"] == s["total_tokens"] == 0 and s["compression_ratio"] == 0
    assert c["unknown_rate"] == 0 and c["coverage_rate"] == 1
    empty = train(none, TokenizerConfig(vocab_size=50))
    assert empty.merges == () and empty.vocab_size() == 4


def test_validation(spark, docs, model):
    full = train(docs, TokenizerConfig(vocab_size=400, min_frequency=1))
    checks = analyze.validate(full, docs)
    assert all(checks.values()), checks
    assert set(analyze.validate(full, spark=spark)) == set(analyze.validate(full)) == set(checks)
    assert not analyze.validate(BpeModel())["has_vocab"]
    q = analyze.tokenization_quality(docs, full, detailed=True)
    assert q["passes_validation"] and q["detailed_stats"]["total_texts"] == docs.count()


def test_comparison(docs, model):
    small = train(docs, TokenizerConfig(vocab_size=0, min_frequency=1))
    c = catalog.Collection(catalog=catalog.Catalog("/nonexistent"))
    c.add("small", small)
    c.add("large", model)
    c.add("bare", BpeModel())
    got = {(r["doc_id"], r["tokenizer"]): r["ids"] for r in c.compare(docs).collect()}
    assert len(got) == 3 * docs.count() and all(v == [] for (_, n), v in got.items() if n == "bare")
    ratios = {r["tokenizer"]: r["compression_ratio"] for r in c.compression(docs).collect()}
    assert set(ratios) == {"small", "large"} and ratios["large"] > ratios["small"]
    b = c.benchmark(docs, ["compression", "speed", "coverage"])
    assert set(b["large"]) == {"compression_ratio", "encoding_time", "vocab_utilization"} and b["large"]["encoding_time"] > 0
    assert analyze.benchmark_encoding(docs, model)["texts_per_second"] > 0
    assert analyze.benchmark_training(docs, TokenizerConfig(vocab_size=100))["vocab_size"] >= 100


def test_batches(docs):
    rows = analyze.batches(docs, 7).select("doc_id", "batch_id").collect()
    order = sorted(r["doc_id"] for r in rows)
    assert {r["doc_id"]: r["batch_id"] for r in rows} == {d: k // 7 for k, d in enumerate(order)}


def test_map_texts(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    assert [r["result"] for r in analyze.map_texts(df, len, "int").orderBy("doc_id").collect()] == [2, None]


def test_conversations(spark):
    rows = [(1, 1, "USER", "hello there"), (1, 0, "system", "be kind"), (1, 2, "nobody", None), (2, 0, None, "hello")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    m = build([("hello", 3), ("be", 2), (" there", 2), (" kind", 2)], chat_config(60))
    got = {r["conv_id"]: list(r["ids"]) for r in conversation.encode_conversations(turns, m).collect()}
    i = {n: m.vocab[special(n)] for n in ("startoftext", "user", "system", "turn")}
    first = [i["startoftext"], i["system"], *m.encode_text("be kind"), i["turn"], i["user"], *m.encode_text("hello there"), i["turn"], i["user"], i["turn"]]
    assert got == {1: first, 2: [i["startoftext"], i["user"], *m.encode_text("hello"), i["turn"]]}
    bare = build([("hello", 3)], TokenizerConfig(vocab_size=30))
    got = {r["conv_id"]: list(r["ids"]) for r in conversation.encode_conversations(turns.where("conv_id = 2"), bare).collect()}
    assert got == {2: [bare.vocab["<|startoftext|>"], *bare.encode_text("hello")]}
    df = spark.createDataFrame([("hello",)], "text string").select(conversation.encode_light(F.col("text"), m).alias("ids"))
    r = df.select("ids", conversation.decode_light(F.col("ids"), m).alias("t")).first()
    assert r["ids"][0] == i["startoftext"] and r["t"] == "hello"
