"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import ann, chat, exactdedup, langid, mixing, packing, ppm, sharding, simhash, tokencount
from lodestone.llm.common import run_path

LONG = "a very long text of words that go on and on " * 60_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "web", 1),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "web", 1),
    (3, "", "en", "web", 0),
    (4, "", None, None, 0),
    (5, None, "en", "web", None),
    (6, None, None, None, None),
    (7, " \n\t ", "de", "books", 4),
    (8, LONG, "en", "books", len(LONG)),
    (9, LONG, "en", None, len(LONG)),
    (None, "Row without an id, and with words of its own", "en", "web", 5),
    (None, None, None, None, None),
    (10, "日本語のテキスト und ein wenig Deutsch, ñandú élève", "de", "web", 9),
    (10, "日本語のテキスト und ein wenig Deutsch, ñandú élève", "de", "web", 9),
    (11, "Le renard brun saute par-dessus le chien paresseux près de la rivière", "fr", "books", 9),
    (12, "x", "fr", "books", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "rank digest part base h id k a b curve place own tie node root entry prefix depth bucket grp fold units docs tokens bytes r q x score cell v v0 s0 __rank __digest __part __base __found __gone __source __place __last __copies d.o.t".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def op8(df):
    store = tokencount.Rollups(df.sparkSession, run_path(df.sparkSession, "edge"))
    store.commit("one", tokencount.inserts(tokencount.count_tokens(df)))
    return store.totals()


OPERATORS = {
    "packing": packing.pack, "sharding": sharding.shard, "simhash": simhash.near_duplicates, "langid": langid.identify, "ppm": ppm.score, "tokens": op8,
    "exact": lambda d: exactdedup.ingest(d, exactdedup.fresh_index(d.sparkSession)), "mixing": mixing.mix,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ugly_and_empty_tables(docs, name):
    out = OPERATORS[name](docs)
    assert out.count() > 0
    none = OPERATORS[name](docs.where("false"))
    assert none.count() == 0 and none.columns == out.columns


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_of_other_types_are_refused(docs, name):
    with pytest.raises(TypeError, match="whole numbers"):
        OPERATORS[name](docs.withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))))


def ids(df, c="doc_id"):
    return sorted((r[c] for r in df.select(c).collect()), key=lambda x: (x is None, x or 0))


def test_packing_keeps_every_text(docs):
    rows = packing.pack(docs, 16).orderBy("doc_id", "start").collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {1, 2, 7, 8, 9, 10, 11, 12, None}
    assert "".join(r["text"] for r in by[8]) == LONG and "".join(r["text"] for r in by[7]) == " \n\t "
    full = {}
    for r in rows:
        full[r["pack_id"]] = full.get(r["pack_id"], 0) + r["n_tokens"]
    assert sorted(full) == list(range(len(full))) and all(n == 16 for p, n in full.items() if p < len(full) - 1)
    # Repeated rows are packed each time.
    assert sum(r["n_tokens"] for r in by[10]) == 2 * len(ROWS[11][1].split())


def test_sharding_rows(docs):
    out = sharding.shard(docs, 100)
    assert out.count() == len(ROWS)
    got = {(r["doc_id"], r["n_bytes"]) for r in out.collect()}
    assert (5, 0) in got and (8, len(LONG)) in got
    whole = sharding.shard(docs, 1 << 40).select("shard", "depth").distinct().collect()
    assert [tuple(r) for r in whole] == [("", 0)]
    shards = {r["doc_id"]: r["shard"] for r in out.collect()}
    assert len({r["shard"] for r in out.where("doc_id is null").collect()}) == 1 and shards[1] is not None


def test_near_duplicates_rows(docs):
    out = {r["doc_id"]: (r["group_id"], r["keep"]) for r in simhash.near_duplicates(docs).collect()}
    assert out == {k: (k, True) for k in (1, 3, 4, 5, 6, 7, 8, 10, 11, 12)} | {2: (1, False), 9: (8, False)}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and ids(kept) == [1, 3, 4, 5, 6, 7, 8, 10, 10, 11, 12, None, None]


def test_language_rows(docs):
    rows = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert langid.identify(docs).count() == len(ROWS)
    assert all(not rows[k]["accepted"] and rows[k]["lang"] is None for k in (3, 4, 5, 6, 7))
    assert rows[8]["size"] > 0 and rows[8]["lang"] in ("de", "en", "fr")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    one = langid.identify(docs.where("lang = 'fr'")).collect()
    assert all(r["accepted"] and r["lang"] == "fr" for r in one)
    assert not any(r["accepted"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_scoring_rows(docs):
    rows = ppm.score(docs).collect()
    assert len(rows) == len(ROWS)
    empty = [r for r in rows if r["n_bytes"] == 0]
    assert len(empty) == 5 and all(r["bits"] == 0 and r["bits_per_byte"] is None for r in empty)
    twins = {r["doc_id"]: r["bits"] for r in rows}
    assert twins[1] == twins[2] and twins[8] == twins[9]


def test_exact_rows(spark, docs):
    index = exactdedup.fresh_index(spark)
    got = {r["digest"]: (r["doc_id"], r["n_copies"]) for r in exactdedup.ingest(docs, index).collect()}
    assert got[""] == (5, 3) and sorted(got.values(), key=str) == sorted([(5, 3), (1, 2), (3, 2), (7, 1), (8, 2), (None, 1), (10, 2), (11, 1), (12, 1)], key=str)
    assert exactdedup.ingest(docs, index).count() == 0
    kept = exactdedup.drop_exact_duplicates(docs, exactdedup.fresh_index(spark))
    assert kept.columns == docs.columns and ids(kept) == [1, 3, 5, 7, 8, 10, 11, 12, None]


def test_mixing_rows(docs):
    every = mixing.mix(docs, budget_fraction=1.0)
    assert sum(r["n_tokens"] for r in every.collect()) == sum(len((t or "").split()) for _, t, *_ in ROWS)
    assert mixing.take_mix(docs, budget_fraction=1.0).count() == len(ROWS)
    kept = mixing.take_mix(docs)
    assert kept.columns == docs.columns
    assert mixing.take_mix(docs.where("false")).count() == 0
    renamed = docs.withColumnRenamed("text", "body")
    assert mixing.mix(renamed, text_col="body").count() == mixing.mix(docs).count()
    with pytest.raises(ValueError):
        mixing.mix(docs, {"web": 0.0})


def test_token_totals(docs):
    rows = op8(docs).collect()
    assert sum(r["docs"] for r in rows) == len(ROWS) and sum(r["bytes"] for r in rows) == sum(len((t or "").encode()) for _, t, *_ in ROWS)
    assert {r["source"] for r in rows} == {"web", "books", None}


def test_chats(spark):
    rows = [(1, 2, "user", "b"), (1, 1, " SYSTEM ", "a"), (1, None, "tool", "z"), (1, 2, "user", "a"), (1, 2, "user", "a"), (2, 1, None, None), (2, 2, "pirate", "<|im_end|>"), (None, 1, "user", "orphan"), (None, None, None, None), (3, 1, "user", LONG)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("own").alias(c) for c in ("n_turns", "conv", "code", "a.b")])
    got = {r["conv_id"]: (r["text"], r["n_turns"]) for r in chat.format_chats(turns).collect()}
    one = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == {
        1: (one("system", "a") + one("user", "a") * 2 + one("user", "b") + one("tool", "z"), 5),
        2: (one("user", "") + one("user", "<|_im_end|>"), 2),
        None: (one("user", "orphan") + one("user", ""), 2),
        3: (one("user", LONG), 1),
    }
    assert chat.format_chats(turns.where("false")).count() == 0


def test_vectors(spark):
    good = [(k, [float(k), 1.0, -float(k % 3)]) for k in range(8)]
    bad = [(20, None), (21, []), (22, [1.0, None, 2.0]), (23, [1.0, float("nan"), 2.0]), (24, [1.0]), (None, [1.0, 2.0, 3.0]), (3, [3.0, 1.0, 0.0]), (25, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").select("*", *[F.lit("own").alias(c) for c in ("id", "v", "cell", "q", "x", "score", "rank", "a.b")])
    rows = ann.neighbours(df).collect()
    assert {r["vec_id"] for r in rows} == set(range(8)) and len(rows) == 8 * 7
    assert all(r["vec_id"] != r["neighbour_id"] for r in rows)
    assert ann.neighbours(df.where("false")).count() == 0 and ann.neighbours(df.where("vec_id = 1")).count() == 0
    assert ann.neighbours(df, df.where("false")).count() == 0 and ann.neighbours(df.where("false"), df).count() == 0
    few = ann.neighbours(df, df.where("vec_id >= 6"), k=2).collect()
    assert {(r["vec_id"], r["rank"]) for r in few} == {(6, 1), (6, 2), (7, 1), (7, 2)}


def test_pipeline_stages(spark, docs, sf_dir):
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        path = run_path(spark, "edges")
        out.write.parquet(path)
        now = spark.read.parquet(path)
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
