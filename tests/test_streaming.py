from pyspark.sql import functions as F

from lodestone import streaming
from lodestone.config import PreprocessingConfig, TokenizerConfig
from lodestone.operators import dedup
from lodestone.operators.bpe import train
from lodestone.plans import pipeline


def test_stateless_stream_equals_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    model = train(docs, TokenizerConfig(vocab_size=300))
    out = streaming.encode_stream(streaming.prepare_stream(stream), model).select("doc_id", "ids")
    q = out.writeStream.format("memory").queryName("encoded").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    want = pipeline.prepare(docs, PreprocessingConfig(remove_duplicates=False)).select("doc_id", model.encode(F.col("text")).alias("ids"))
    assert {r["doc_id"]: r["ids"] for r in spark.table("encoded").collect()} == {r["doc_id"]: r["ids"] for r in want.collect()}


def test_exact_duplicates_and_windows(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:0{k % 5}:00", "Same  text" if k % 2 else f"text {k}") for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming.deduplicate_stream(stream, "ts", "1 hour").writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert spark.table("once").count() == 5
    counted = streaming.windowed_counts(stream, "ts", "2 minutes", "0 seconds", ["text"])
    q = counted.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert sum(r["n"] for r in spark.table("windows").collect()) == 8


def test_near_duplicates_by_batches(spark, tmp_path):
    base = [f"w{k}" for k in range(40)]
    texts = [" ".join(base), " ".join([*base, "x"]), "something else that is quite short", " ".join([*base, "x", "y"]), " ".join(reversed(base)), "something ELSE that is quite short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sink = streaming.NearDedupSink(spark, f"file://{tmp_path}/near", 0.9)
    for n, (a, b) in enumerate(((0, 2), (2, 4), (4, 6))):
        sink(df.where(f"doc_id >= {a} and doc_id < {b}"), n)
    sink(df.where("doc_id >= 2 and doc_id < 4"), 1)  # tried again
    want = sorted(r[0] for r in dedup.near_deduplicate(df, 0.9).select("doc_id").collect())
    assert sorted(r["doc_id"] for r in sink.kept().collect()) == want
