from itertools import combinations

from pyspark.sql import functions as F

from lodestone.config import PreprocessingConfig
from lodestone.operators import dedup
from lodestone.plans import pipeline


def shingle_set(t, k=5):
    w = " ".join(t.lower().split()).split(" ")
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {" ".join(w)}


def in_order(rows, threshold):
    kept, seen = [], set()
    for i, t in sorted(rows):
        if t is None:
            continue
        form, s = " ".join(t.lower().split()), shingle_set(t)
        if form in seen or any(len(s & o) / len(s | o) >= threshold for _, o in kept):
            continue
        seen.add(form)
        kept.append((i, s))
    return [i for i, _ in kept]


BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
CHAIN = [BASE, BASE + " a b", BASE + " a b c d", "ONE  two " + BASE[8:], "short text", "Short\ttext ", "", " ", "other words that are not like the ones before at all in any way"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)) + [(900, None)], "doc_id long, text string")


def test_chain_is_not_a_component(spark):
    rows = list(enumerate(CHAIN))
    a, b, c = (shingle_set(t) for t in CHAIN[:3])
    t = 0.85
    assert len(a & b) / len(a | b) >= t <= len(b & c) / len(b | c) and len(a & c) / len(a | c) < t
    got = sorted(r[0] for r in dedup.near_deduplicate(frame(spark, CHAIN), t).select("doc_id").collect())
    assert got == in_order(rows, t) and {0, 2} <= set(got) and 1 not in got


def test_against_brute_force(spark):
    import random

    random.seed(2)
    words = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(25):
        t = [random.choice(words) for _ in range(random.randint(1, 60))]
        for _ in range(random.randint(1, 4)):
            u = list(t)
            for _ in range(random.randint(0, 2)):
                u[random.randrange(len(u))] = random.choice(words)
            texts.append(" ".join(u))
    for t in (0.5, 0.85, 1.0):
        got = sorted(r[0] for r in dedup.near_deduplicate(frame(spark, texts), t).select("doc_id").collect())
        assert got == in_order(list(enumerate(texts)), t)
    pairs = {(r["i"], r["j"]) for r in dedup.similar_pairs(frame(spark, texts).where("doc_id < 900"), 0.6).collect()}
    sets = [shingle_set(t) for t in texts]
    assert pairs == {(i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6}


def test_thresholds_at_the_ends(spark):
    df = frame(spark, CHAIN)
    assert [r[0] for r in dedup.near_deduplicate(df, 0).select("doc_id").collect()] == [0]
    above = sorted(r[0] for r in dedup.near_deduplicate(df, 1.1).select("doc_id").collect())
    assert above == [0, 1, 2, 4, 6, 8]


def test_exact(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (5, None), (4, None)], "doc_id long, text string")
    assert sorted(r[0] for r in dedup.deduplicate(df).collect()) == [1, 2, 4]


def test_rows_without_id_and_repeated_rows(spark):
    """No text is lost for want of an id, and of equal rows one stays; a column's name is nobody's business."""
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c"), (2, "d"), (3, None), (None, None), (None, BASE), (7, BASE + " a b"), (8, "C  ")]
    names = ("__key", "__rows", "__best", "__gone", "__row", "__words", "__d", "__first", "__kept", "__s", "stage2", "a.b")
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in names])
    of = lambda d: sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=str)
    out = dedup.deduplicate(df)
    assert out.columns == df.columns
    assert of(out) == sorted([(1, "a"), (None, "b"), (2, "c"), (2, "d"), (3, None), (None, BASE), (7, BASE + " a b"), (8, "C  ")], key=str)
    assert of(dedup.first_by_hash(df)) == sorted([(1, "a"), (None, "b"), (2, "c"), (2, "d"), (3, None), (None, BASE), (7, BASE + " a b")], key=str)
    near = dedup.near_deduplicate(df)
    assert near.columns == df.columns
    # The text without id comes last and is compared by its normal form only.
    assert of(near) == sorted([(1, "a"), (None, "b"), (2, "c"), (2, "d"), (None, BASE), (7, BASE + " a b")], key=str)
    empty = df.where("false")
    assert dedup.deduplicate(empty).count() == dedup.near_deduplicate(empty).count() == 0
    good = "This sentence has quite enough different words to pass every test of quality. And here comes another one!"
    docs = spark.createDataFrame([(None, good), (1, good), (1, good), (None, good[::-1]), (2, "short"), (None, None)], "doc_id long, text string").withColumn("__row", F.lit(1))
    assert sorted(((r["doc_id"], r["stage"]) for r in pipeline.flagged(docs).collect()), key=str) == sorted([(None, 3), (1, 5), (1, 3), (None, 5), (2, 1), (None, 0)], key=str)


def test_pipeline_counts(spark):
    good = "This sentence has quite enough different words to pass every test of quality. And here comes another one!"
    rows = [(0, None), (1, ""), (2, "\x07\x07"), (3, "too short"), (4, good), (5, good.upper().lower()), (6, good + " Something else follows that makes this one rather different from the others before it.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = pipeline.statistics(pipeline.flagged(df)).first().asDict()
    assert (s["total_processed"], s["after_cleaning"], s["after_quality_filter"], s["after_deduplication"], s["final_count"]) == (5, 3, 3, 2, 2)
    assert s["overall_retention_rate"] == 2 / 5
    assert sorted(r[0] for r in pipeline.prepare(df).collect()) == [4, 6]
    split = PreprocessingConfig(split_sentences=True, min_sentence_length=30, max_sentence_length=90)
    kept = dict(pipeline.prepare(df, split).collect())
    assert kept[4].startswith("This sentence") and "another" not in kept[4]
    none = pipeline.statistics(pipeline.flagged(df.where("false"))).first()
    assert none["total_processed"] == 0 and none["overall_retention_rate"] is None
