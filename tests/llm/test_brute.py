"""Operators and pipeline against plain Python, exact round trips and held-out accuracy."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import ann, exactdedup, langid, mixing, packing, ppm, queries, sharding, simhash, tokencount
from lodestone.llm.common import run_path

from . import brute


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def near_copies(rows):
    """The documents, and edited ones: every twentieth word is another."""
    import random

    random.seed(6)
    out, words = [(r["doc_id"], r["text"]) for r in rows], " ".join(r["text"] for r in rows).split()
    for r in rows[::4]:
        w = r["text"].split()
        for k in range(7, len(w), 20):
            w[k] = random.choice(words)
        out.append((r["doc_id"] + 1_000_000, " ".join(w)))
    return out


def found(spark, texts, **options):
    out = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), **options).collect()
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["group_id"]) for r in out}


def test_near_duplicates(spark, rows):
    texts = near_copies(rows)
    cls, want = brute.classes(texts), brute.near_pairs(texts)
    for hot in (simhash.HOT, 40):  # 40: cells in blocks
        ids, near = simhash.classes_and_links(spark.createDataFrame(texts, "doc_id long, text string"), hot=hot)
        pairs = {tuple(r) for r in near.collect()}
        assert {r["doc_id"]: r["class_id"] for r in ids.collect()} == cls
        assert pairs <= set(want) and pairs >= {p for p, v in want.items() if v >= 0.7} and len(pairs) > 0.95 * len(want)
        assert found(spark, texts, hot=hot) == brute.decided(cls, pairs)


def test_verification_in_blocks(spark, rows):
    texts = near_copies(rows)
    df = spark.createDataFrame([(i, t.lower()) for i, t in texts], "doc_id long, text string")
    pairs = brute.near_pairs(texts)
    given = spark.createDataFrame([*pairs, (1, 2), (3, 1_000_004)], "a long, b long")
    for size in (3, 1024):
        assert {tuple(r) for r in simhash.verified(given, df, 0.5, size).collect()} >= set(pairs)
        assert {tuple(r) for r in simhash.verified(given, df, 0.8, size).collect()} == {p for p, v in pairs.items() if v >= 0.8}


def test_recall_by_similarity(spark):
    """Copies with more and more words replaced, against their exact similarity."""
    import random

    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    texts, n = [], 600
    for k in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(60, 300))]
        share = r.uniform(0.005, 0.12)
        texts += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(r.choice(vocabulary) if r.random() < share else x for x in w))]
    alike = [brute.jaccard(brute.shingle_set(texts[2 * k][1]), brute.shingle_set(texts[2 * k + 1][1])) for k in range(n)]
    got = found(spark, texts)
    hit = np.array([got[2 * k][2] == got[2 * k + 1][2] for k in range(n)])
    alike = np.array(alike)
    assert hit[alike >= 0.7].mean() >= 0.97 and hit[alike >= 0.5].mean() >= 0.9 and not hit[alike < 0.5].any()


def test_near_duplicates_with_short_words(spark):
    """Mostly short words, numbers, and short texts."""
    import random

    r = random.Random(3)
    word = lambda a, b: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(a, b)))
    cases = {"inserted": [], "replaced": [], "numbers": [], "short": []}
    for _ in range(60):
        w = [word(2, 4) for _ in range(300)]
        cases["inserted"].append((w, [*w[:150], word(9, 9), *w[150:]]))
        cases["replaced"].append(([*w[:298], word(8, 8), word(9, 9)], [*w[:298], word(8, 8), word(9, 9)]))
        w = [str(r.randint(0, 9999)) for _ in range(1000)] + [word(7, 7) for _ in range(3)]
        cases["numbers"].append((w, [*w[:-1], word(8, 8)]))
        w = [word(2, 8) for _ in range(18)]
        cases["short"].append((w, [*w[:17], word(6, 6)]))
    for name, pairs in cases.items():
        texts = [(2 * k + side, " ".join(w)) for k, pair in enumerate(pairs) for side, w in enumerate(pair)]
        got = found(spark, texts)
        assert np.mean([got[2 * k][2] == got[2 * k + 1][2] for k in range(len(pairs))]) >= 0.95, name


def test_texts_of_one_template_stay(spark):
    """Twelve words are the same in all documents and six their own: alike, but no copies."""
    import random

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    head = [word() for _ in range(12)]
    texts = [(k, " ".join([*head, *(word() for _ in range(6))])) for k in range(1500)]
    assert all(v == (k, 0, k) for k, v in found(spark, texts).items())


def test_scripts_without_blanks(spark):
    import random

    r = random.Random(4)
    texts = []
    for k in range(40):
        t = [chr(r.randint(0x4E00, 0x5E00)) for _ in range(120)]
        t[30] = t[70] = "。"
        u = list(t)
        u[50], u[100] = "新", "字"
        texts += [(2 * k, "".join(t)), (2 * k + 1, "".join(u))]
    got = found(spark, texts)
    assert all(got[2 * k][2] == got[2 * k + 1][2] for k in range(40)) and len({g for _, _, g in got.values()}) == 40


def test_segments_and_width_grow(spark):
    assert simhash.layout(1000)[1] == simhash.layout(1 << 20)[1] == simhash.WIDTH
    assert [simhash.layout(n)[1] for n in (10**8, 10**10)] == [36, 42]
    with pytest.raises(ValueError):
        simhash.layout(10, 27)


def test_a_long_text_is_read_in_pieces():
    words = [f"word{k % 40_000}" for k in range(400_000)]
    a, b = " ".join(words), " ".join(reversed(words))
    assert len(a) > 2 << 20
    x, y = (simhash.signatures(*brute.text_bytes(t), 10, 20) for t in (a, b))
    assert (x[0] == y[0]).all() and (x[1] == y[1]).all() and (x[2] != y[2]).any() and x[3] == y[3] == 400_000
    assert (packing.curve_keys(*brute.text_bytes(a)) == packing.curve_keys(*brute.text_bytes(b))).all()


def test_hilbert_is_a_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        points = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert(points, bits)
        walk = points[np.argsort(keys)]
        assert sorted(keys) == list(range(side**dims)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_running_sums(spark):
    """Groups, nulls among them, and ties, over more partitions and batches than one."""
    import random

    from lodestone.llm.common import ordered_sums

    r = random.Random(1)
    data = [(r.choice(["a", "b", None]), r.randint(0, 90), r.randint(0, 9)) for _ in range(900)]
    df = spark.createDataFrame(data, "g string, k long, v long").repartition(5)
    got = sorted(map(tuple, ordered_sums(df, ["g", "k"], "v", "s", "g").select("g", "k", "v", "s").collect()), key=str)
    assert got == sorted(((g, k, v, sum(z for x, y, z in data if x == g and y <= k)) for g, k, v in data), key=str)
    got = sorted(map(tuple, ordered_sums(df, ["k"], "v", "s").select("g", "k", "v", "s").collect()), key=str)
    assert got == sorted(((g, k, v, sum(z for _, y, z in data if y <= k)) for g, k, v in data), key=str)


def test_packing(docs, rows):
    got = sorted(map(tuple, packing.pack(docs, 100).collect()))
    assert got == brute.packed([(r["doc_id"], r["text"]) for r in rows], 100)


def test_packs_hold_neighbours(docs, rows):
    """Documents next to each other on the curve are more alike than documents at random."""
    order, seen = [], set()
    for r in packing.pack(docs).orderBy("pack_id", "position").collect():
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            order.append(r["doc_id"])
    words = {r["doc_id"]: set(r["text"].lower().split()) for r in rows}
    alike = lambda a, b: len(words[a] & words[b]) / len(words[a] | words[b])
    beside = np.mean([alike(a, b) for a, b in zip(order, order[1:])])
    apart = np.mean([alike(a, b) for a, b in zip(order, order[len(order) // 2 :])])
    assert beside > apart


def test_mixing(docs, rows):
    got = sorted(tuple(r[c] for c in ("doc_id", "source", "n_tokens", "finish", "mixed_tokens")) for r in mixing.mix(docs, queries.WEIGHTS).collect())
    assert got == sorted(brute.mix_documents([(r["doc_id"], r["source"], r["text"]) for r in rows]))
    kept = {r["doc_id"] for r in mixing.take_mix(docs, weights=queries.WEIGHTS).collect()}
    assert kept == {g[0] for g in got}


def test_sharding_splits_only_what_is_too_large(docs):
    limit = 20_000
    leaves = docs.transform(lambda d: sharding.shard(d, limit)).groupBy("shard", "depth", "shard_bytes").agg(F.sum("n_bytes").alias("b"), F.countDistinct("doc_id").alias("n")).collect()
    by = {r["shard"]: r for r in leaves}
    for s, r in by.items():
        assert r["b"] == r["shard_bytes"] and (r["b"] <= limit or r["n"] == 1) and len(s) == r["depth"]
        assert not any(o != s and o.startswith(s) for o in by)
    for s in {x[:k] for x in by for k in range(len(x))}:
        assert sum(r["b"] for o, r in by.items() if o.startswith(s)) > limit
    assert max(r["depth"] for r in leaves) > min(r["depth"] for r in leaves)


def test_few_deep_buckets(spark):
    """One document over the limit: its bucket ends at 60 bits, and the others stay shallow."""
    df = spark.createDataFrame([(k, "x" * (5000 if k == 7 else 10)) for k in range(200)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in sharding.shard(df, 1000).collect()}
    assert len(out) == 200 and out[7]["depth"] == 60 and out[7]["shard_bytes"] == 5000
    for i, r in out.items():
        h = int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
        assert r["shard"] == (format(h, "060b")[: r["depth"]]) and (r["shard_bytes"] <= 1000 or i == 7)


def test_shards_are_written(spark, docs, rows):
    path = run_path(spark, "shards")
    ugly = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in ("__id", "__hash", "depth", "__entry", "a.b", "shard_bytes")])
    ugly = ugly.union(ugly.limit(2)).union(ugly.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    sharding.write_shards(ugly, path, 50_000, shard_col="piece")
    back = spark.read.parquet(path)
    assert back.count() == len(rows) + 3 and back.columns == [*ugly.columns, "piece"] and back.select("piece").distinct().count() > 1
    want = {r["doc_id"]: r["shard"] for r in sharding.shard(ugly, 50_000).collect()}
    schema = ", ".join(f"`{c}` {t}" for c, t in ugly.dtypes) + ", piece string"
    assert {r["doc_id"]: r["piece"] for r in spark.read.schema(schema).parquet(path).select("doc_id", "piece").collect()} == want
    assert not any(r["own"] != "own a.b" for r in back.select(F.col("`a.b`").alias("own")).collect())
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("Shard", F.lit(1)), path + "x")
    sharding.write_shards(ugly.where("false"), path + "empty", shard_col="piece")


def recall(got, ids, x, asked):
    """Share of the true neighbours of the vectors ``asked`` that got (rows) holds; its ranks and scores must be right."""
    by, place, hits = {}, {i: k for k, i in enumerate(ids.tolist())}, 0
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour_id"], r["score"]))
    assert set(by) == set(asked)
    for i in asked:
        scores = x @ x[place[i]]
        scores[place[i]] = -np.inf
        mine = sorted(by[i])
        assert [m[0] for m in mine] == list(range(1, ann.K + 1)) and [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        assert all(abs(s - scores[place[j]]) < 1e-9 for _, j, s in mine)
        hits += sum(s >= np.sort(scores)[-ann.K] - 1e-12 for _, _, s in mine)
    return hits / (len(asked) * ann.K)


def test_neighbours(spark, sf_dir):
    """All rows as queries and some; in one group, and in many parts and chunks."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    data = table.collect()
    ids, x = np.array([r["vec_id"] for r in data]), np.array([r["embedding"] for r in data], np.float32).astype(float)
    assert recall(ann.neighbours(table).collect(), ids, x, ids.tolist()) >= 0.95
    few = table.where("vec_id % 100 = 0")
    assert recall(ann.neighbours(table, few, recall=1.0, group_rows=7, query_rows=2).collect(), ids, x, [i for i in ids.tolist() if i % 100 == 0]) >= 0.95
    assert recall(ann.neighbours(table, group_rows=7, query_rows=20).collect(), ids, x, ids.tolist()) >= 0.95


def test_neighbours_of_every_hundredth(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = table.toArrow()
    ids, x = data["vec_id"].to_numpy(), np.array(data["embedding"].to_pylist(), np.float32).astype(float)
    got = ann.neighbours(table, table.where("vec_id % 100 = 0")).collect()
    assert recall(got, ids, x, [i for i in ids.tolist() if i % 100 == 0]) >= 0.95


def test_neighbours_among_copies(spark):
    """Groups of several hundred near copies and exact ones, which codes can't tell apart, in a cell of many parts."""
    g = np.random.default_rng(8)
    far, seeds = g.normal(size=(1200, 16)), g.normal(size=(2, 16))
    x = np.concatenate([far, seeds[0] + g.normal(size=(600, 16)) * 0.003, np.repeat(seeds[1:], 300, 0)])
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[-300:] = x[-1]
    ids = g.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    for rows in (ann.GROUP_ROWS, 100):
        got = ann.neighbours(df, group_rows=rows, query_rows=rows).collect()
        assert recall(got, ids, x, ids.tolist()) >= 0.95
        copies, by = sorted(ids[-300:].tolist()), {}
        for r in got:
            by.setdefault(r["vec_id"], {})[r["rank"]] = r["neighbour_id"]
        for i in copies:
            assert [by[i][n] for n in sorted(by[i])] == [c for c in copies if c != i][: ann.K]


def test_cells_and_their_sample_grow_with_the_vectors():
    for n in (1, 9, 500, 51_282, 6_250_000, 25_000_000, 1_000_000_000):
        sample, cells = ann.training_size(n)
        assert sample <= n and cells >= 1 and (n < 64 or (cells == round(n**0.5) and sample >= 8 * cells)), n
    assert ann.training_size(51_282) == (ann.TRAIN_ROWS, 226)


def test_language_sizes(docs, rows):
    dicts = langid.train(docs)
    folds = {r["doc_id"]: r["f"] for r in docs.select("doc_id", langid.fold_of(F.col("text")).alias("f")).collect()}
    got = {r["doc_id"]: (r["lang"], r["accepted"]) for r in langid.identify(docs).collect()}
    for r in rows[::3]:
        assert got[r["doc_id"]] == brute.language(r["text"], dicts[1 - folds[r["doc_id"]]])


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text") >= 40)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    dicts = langid.train(docs.where(half == 0))
    r = langid.with_language(docs.where(half == 1), "r", dicts).agg(F.avg((F.col("r.lang") == F.col("lang")).cast("int")).alias("right"), F.avg(F.col("r.accepted").cast("int")).alias("kept")).first()
    assert r["right"] >= 0.98 and r["kept"] >= 0.95


def test_wrong_labels_do_not_vouch_for_themselves(spark):
    """One label in ten is another language's: those documents come back under their own, as others do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text") >= 40).where("lang in ('en', 'de')")
    flip = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10)) == 0
    other = F.when(F.col("lang") == "en", "de").otherwise("en")
    wrong = docs.select("doc_id", "text", F.when(flip, other).otherwise(F.col("lang")).alias("lang"))
    truth = docs.select("doc_id", F.col("lang").alias("true"), flip.alias("flipped"))
    out = langid.identify(wrong).join(truth, "doc_id").groupBy("flipped").agg(F.avg((F.col("lang") == F.col("true")).cast("int")).alias("right"))
    right = {r["flipped"]: r["right"] for r in out.collect()}
    assert right[True] >= 0.97 and right[False] >= 0.97


def test_a_language_of_long_texts_and_one_of_few(spark):
    words = {"a": "lorem ipsum dolor sit amet ", "b": "ein zwei drei vier fuenf "}
    rows = [(k, words["a"] * 40_000, "a") for k in range(2)] + [(k, words["b"] * 30, "b") for k in range(2, 6)] + [(6, "ok", "c"), (7, "...", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.warns(UserWarning, match="no letters to learn from: d"):
        dicts = langid.train(docs)
    assert set(dicts[0]) == set(dicts[1]) == {"a", "b", "c"}
    with pytest.warns(UserWarning):
        got = {r["doc_id"]: r["lang"] for r in langid.identify(docs).collect()}
    assert [got[k] for k in range(6)] == ["a"] * 2 + ["b"] * 4
    with pytest.raises(ValueError):
        langid.train(docs, max_languages=3)
    small = langid.train(docs.where("lang <> 'd'"), sample_docs=1, dict_bytes=1024)
    assert all(len(d) <= 1024 for s in small for d in s.values())


def test_scores(spark):
    texts = ["abracadabra abracadabra", "the cat sat on the mat", "the bat sat on the cat", "ünïcode çédille", "a", "", "zzzz", "the cat sat on the hat and the cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folds = {r["doc_id"]: r["f"] for r in df.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("f")).collect()}
    for size in (1 << 22, 40):  # one block, and several
        for r in ppm.score(df, block_bytes=size).collect():
            t = texts[r["doc_id"]].encode()
            want = brute.ppm_bits(t, [x.encode() for k, x in enumerate(texts) if folds[k] != folds[r["doc_id"]]])
            assert r["n_bytes"] == len(t) and abs(r["bits"] - want) < 1e-4 * max(1, len(t)), (t, size)
    given = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "abc")], "doc_id long, text string")
    for r in ppm.score(df, given).collect():
        t = texts[r["doc_id"]].encode()
        assert abs(r["bits"] - brute.ppm_bits(t, [b"the cat sat on the mat", b"abc"])) < 1e-4 * max(1, len(t))


def test_token_rollups(spark, docs, rows):
    """Inserts, deletes, revisions, repeats and a compaction, by group, against sums over the documents that are left."""
    import tiktoken

    with open(tokencount.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("test", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={})
    now = {r["doc_id"]: (r["source"], r["lang"], len(bpe.encode_ordinary(r["text"])), len(r["text"].encode())) for r in rows}
    counted = tokencount.count_tokens(docs)
    assert {r["doc_id"]: (r["source"], r["lang"], r["tokens"], r["bytes"]) for r in counted.collect()} == now
    path = run_path(spark, "rollups")
    store = tokencount.Rollups(spark, path, 8)

    def right():
        want = {}
        for s, g, t, b in now.values():
            n, x, y = want.get((s, g), (0, 0, 0))
            want[s, g] = n + 1, x + t, y + b
        got = {(r["source"], r["lang"]): (r["docs"], r["tokens"], r["bytes"]) for r in tokencount.Rollups(spark, path, 8).totals().collect()}
        assert got == want

    assert store.commit("b1", tokencount.inserts(counted))
    right()
    assert not store.commit("b1", tokencount.inserts(counted))
    gone = [r["doc_id"] for r in rows[:5]]
    drop = tokencount.inserts(counted.where(F.col("doc_id").isin(gone)), "delete")
    revised, both = rows[9]["doc_id"], rows[10]["doc_id"]
    of = lambda i, n: counted.where(F.col("doc_id") == i).withColumn("tokens", F.lit(n).cast("long"))
    change = drop.union(drop)
    for n in (3, 7, 7, 5):  # several revisions of one document: the greatest counts, once
        change = change.union(tokencount.inserts(of(revised, n), "revise"))
    change = change.union(tokencount.inserts(of(both, 4), "revise")).union(tokencount.inserts(of(both, 4), "delete"))
    change = change.union(tokencount.inserts(of(gone[0], 9).withColumn("source", F.lit(None).cast("string"))))  # deleted and inserted anew
    change = change.union(tokencount.inserts(of(revised, 2).withColumn("doc_id", F.lit(10**9)), "revise"))  # of what wasn't there
    assert store.commit("b2", change)
    new = now[revised]
    for i in [*gone, both]:
        old = now.pop(i)
        if i == gone[0]:
            now[i] = (None, old[1], 9, old[3])
    now[revised], now[10**9] = (new[0], new[1], 7, new[3]), (new[0], new[1], 2, new[3])
    right()
    store.commit("b3", drop.where(F.col("doc_id") != gone[0]))  # gone already
    store.commit("b4", drop.where("false"))
    right()
    store.compact()
    right()
    assert store.committed() == ["b1", "b2", "b3", "b4"] and not store.commit("b2", change)
    store.commit("b5", tokencount.inserts(of(10**9, 0).select("*").limit(0).union(of(revised, 1)), "delete"))
    del now[revised]
    right()
    store.compact()
    right()
    for op in ("INSERT", None):
        with pytest.raises(ValueError):
            store.commit("b6", drop.withColumn("op", F.lit(op).cast("string")))
    with pytest.raises(ValueError):
        store.commit("../x", drop)
    assert store.committed() == ["b1", "b2", "b3", "b4", "b5"]
    store.delete()
    assert store.committed() == []


def test_the_query_of_token_counts(spark, sf_dir, docs):
    """Its revisions, deletions and repeats leave the sums over all documents."""
    want = tokencount.count_tokens(docs).groupBy(*tokencount.DIMS).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))
    got = queries.op8_token_counts(spark, sf_dir)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_an_unfinished_batch_does_not_count(spark, docs):
    import os

    path = run_path(spark, "rollups")
    store = tokencount.Rollups(spark, path)
    counted = tokencount.inserts(tokencount.count_tokens(docs))
    store.commit("b1", counted)
    want = sorted(map(tuple, store.totals().collect()), key=str)
    os.remove(path.removeprefix("file://") + "/rollup/batch=b1/_SUCCESS")
    assert store.committed() == [] and store.totals().count() == 0
    assert store.commit("b1", counted) and sorted(map(tuple, store.totals().collect()), key=str) == want


def test_the_digest_index_persists(spark, docs, rows):
    path = run_path(spark, "index")
    first, second = docs.where("doc_id % 2 = 0"), docs
    a = exactdedup.ingest(first, exactdedup.DigestIndex(spark, path, 8)).collect()
    b = exactdedup.ingest(second, exactdedup.DigestIndex(spark, path)).collect()
    texts = {r["text"] for r in rows}
    even = {r["text"] for r in rows if r["doc_id"] % 2 == 0}
    assert len(a) == len(even) and len(b) == len(texts - even)
    again = exactdedup.drop_exact_duplicates(docs, exactdedup.DigestIndex(spark, path))
    assert again.count() == 0
    plan = exactdedup.DigestIndex(spark, path).novel(exactdedup.firsts(docs))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    index = exactdedup.DigestIndex(spark, path, 4)
    assert index.buckets == 8  # those of the index that is there
    index.bucket_rows = 1
    index.compact()
    index = exactdedup.DigestIndex(spark, path)
    assert index.version == 1 and index.buckets == 256 and index.table().count() == len(texts)
    assert exactdedup.ingest(docs, index).count() == 0
    index.append(spark.createDataFrame([(bytearray(b"new"), 1)], "digest binary, doc_id long"))
    index.append(spark.createDataFrame([(bytearray(b"new"), 1)], "digest binary, doc_id long"))
    assert index.table().count() == len(texts) + 1
    index.delete()
    index = exactdedup.DigestIndex(spark, path, 2, 60)
    assert exactdedup.ingest(first, index).count() == len(even) and index.buckets == 2
    assert exactdedup.ingest(docs, index).count() == len(texts - even) and index.buckets == 4
    assert exactdedup.DigestIndex(spark, path).table().count() == len(texts)


def test_pipeline(spark, sf_dir, docs, rows):
    now = [r.asDict() for r in rows]
    dicts = langid.train(docs)
    folds = {r["doc_id"]: r["f"] for r in docs.select("doc_id", langid.fold_of(F.col("text")).alias("f")).collect()}
    now = [r for r in now if brute.language(r["text"], dicts[1 - folds[r["doc_id"]]])[1]]
    first = {}
    for r in sorted(now, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r)
    now = list(first.values())
    texts = [(r["doc_id"], r["text"]) for r in now]
    _, links = simhash.classes_and_links(spark.createDataFrame(texts, "doc_id long, text string"))
    pairs, every = {tuple(r) for r in links.collect()}, brute.near_pairs(texts)
    assert pairs <= set(every) and pairs >= {p for p, v in every.items() if v >= 0.7}
    group = brute.decided(brute.classes(texts), pairs)
    now = [r for r in now if group[r["doc_id"]][2] == r["doc_id"]]
    taken = {x[0] for x in brute.mix_documents([(r["doc_id"], r["source"], r["text"]) for r in now])}
    now = [r for r in now if r["doc_id"] in taken]
    want = brute.packed([(r["doc_id"], r["text"]) for r in now], packing.PACK_TOKENS)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == want
