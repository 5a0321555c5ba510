import gzip
import json

import pytest
from pyspark.sql import functions as F

from lodestone import catalog, cli
from lodestone.config import TokenizerConfig
from lodestone.operators.bpe import BpeModel, build
from lodestone.sources import readers, writers


@pytest.fixture
def files(tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.txt").write_bytes(b"line one\r\nline two\rend")
    (tmp_path / "empty.txt").write_text("")
    with gzip.open(tmp_path / "z.txt.gz", "wt") as f:
        f.write("packed text")
    (tmp_path / "latin.txt").write_bytes("é".encode("latin-1"))
    lines = [json.dumps({"text": "first", "a.b": "x"}), "{not json", json.dumps({"other": 1}), "", json.dumps({"text": "second"}), json.dumps({"text": 7})]
    (tmp_path / "b" / "c.jsonl").write_text("\n".join(lines))
    return tmp_path


def texts(df):
    return [r["text"] for r in df.collect()]


def test_texts(spark, files):
    assert texts(readers.read_texts(spark, str(files / "a.txt"))) == ["line one\nline two\nend"]
    assert texts(readers.read_texts(spark, str(files / "z.txt.gz"))) == ["packed text"]
    assert texts(readers.read_texts(spark, str(files / "latin.txt"), "latin-1")) == texts(readers.read_texts(spark, str(files / "latin.txt"), "cp1252")) == ["é"]
    assert len(texts(readers.read_directory(spark, str(files)))) == 2
    assert texts(readers.read_directory(spark, str(files), "*.jsonl", recursive=False)) == []


def test_json_lines(spark, files):
    path = str(files / "b" / "c.jsonl")
    assert sorted(texts(readers.read_jsonl(spark, path))) == ["7", "first", "second"]
    assert texts(readers.read_jsonl(spark, path, "a.b")) == ["x"]


def test_lines_and_ids(spark, tmp_path):
    p = tmp_path / "l.txt"
    p.write_text("  one  \n\n1 2 3\n4 x\n 5\n")
    assert sorted(texts(readers.read_lines(spark, str(p)))) == ["1 2 3", "4 x", "5", "one"]
    assert sorted(r["ids"] for r in readers.read_token_ids(spark, str(p)).collect()) == [[1, 2, 3], [5]]


def test_input(spark, files):
    got = [tuple(r) for r in readers.read_input(spark, [str(files / "a.txt"), str(files / "b")]).orderBy("doc_id").collect()]
    assert got == [(0, "line one\nline two\nend"), (1, "first"), (2, "second"), (3, "7")]
    assert [k for _, k in readers.resolve([str(files)])] == ["txt"] * 3 + ["jsonl"]
    assert len(readers.resolve([str(files)], max_files=2)) == 2
    assert [k for _, k in readers.resolve([str(files / "*.gz")])] == ["txt"]
    assert readers.read_input(spark, [str(files / "nothing")]).count() == 0


def test_writers(spark, tmp_path):
    m = build([("low", 3)], TokenizerConfig(vocab_size=20))
    df = spark.createDataFrame([("low q", [m.vocab["low"], 77])], "text string, ids array<int>")
    row = df.select(writers.as_ids(F.col("ids")).alias("a"), writers.as_tokens(F.col("ids"), m).alias("b"), writers.as_json(F.col("text"), F.col("ids"), m).alias("c"), writers.decoded_json(F.col("ids"), m).alias("d")).first()
    assert row["a"] == f"{m.vocab['low']} 77" and row["b"] == '"low" "<77>"'
    assert json.loads(row["c"]) == {"text": "low q", "token_ids": [m.vocab["low"], 77], "tokens": ["low", None]}
    assert json.loads(row["d"])["decoded_text"] == "low<|unk|>"
    writers.write_texts(df, str(tmp_path / "out"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part*.txt"))) == "low q\n\n"
    writers.save_vocab(m, str(tmp_path / "v.txt"), "txt")
    assert (tmp_path / "v.txt").read_text().splitlines()[0] == "0\t'<|endoftext|>'"
    writers.save_vocab(m, str(tmp_path / "v.json"))
    assert json.loads((tmp_path / "v.json").read_text()) == m.vocab
    with pytest.raises(ValueError):
        writers.save_vocab(m, "x", "xml")
    p = m.save(str(tmp_path / "m.json"))
    writers.convert(p, str(tmp_path / "tables"), spark)
    back = BpeModel.load(writers.convert(str(tmp_path / "tables"), str(tmp_path / "again"), spark))
    assert back.vocab == m.vocab and back.merges == m.merges


def test_catalog(spark, tmp_path):
    import hashlib

    c = catalog.Catalog(str(tmp_path / "cache"))
    assert c.list() == sorted(c.list()) and len(c.list()) == 5 and c.list(domain="code") == ["code-tokenizer"] and c.list(tags=["gpt", "english"]) == ["gpt2-medium", "gpt2-small"]
    assert c.get("gpt2-small").config["special_tokens"] == {"<|endoftext|>": 50256, "<|startoftext|>": 50255, "<|pad|>": 50254, "<|unk|>": 50253}
    assert c.search("CODE-tokenizer")[0] == ("code-tokenizer", 1.0) and c.search("research") == [("scientific-tokenizer", 0.4)] and c.search("zzz") == []
    assert [n for n, _ in c.search("gpt")] == ["gpt2-small", "gpt2-medium"]
    assert [tuple(r) for r in catalog.searched(c.table(spark), "general").collect()] == c.search("general")
    assert [r["name"] for r in catalog.listed(c.table(spark), language="multilingual").collect()] == ["multilingual-base"]
    assert c.create("gpt2-small", vocab_size=9).config.vocab_size == 9 and not c.load("gpt2-medium").trained
    with pytest.raises(ValueError):
        c.create("nothing")
    path = build([("low", 3)], TokenizerConfig(vocab_size=20)).save(str(tmp_path / "m.json"))
    digest = hashlib.sha256(open(path, "rb").read()).hexdigest()
    c.register(catalog.Entry("mine", "", 20, file_url=f"file://{path}", file_hash=digest))
    assert c.load("mine").merges and c.load("mine", force_download=True).merges
    cached = c._cached(c.get("mine"))
    cached.write_text("broken")
    assert c.load("mine").merges
    c.register(catalog.Entry("bad", "", 20, file_url=f"file://{path}", file_hash="0"))
    with pytest.raises(ValueError):
        c.load("bad")
    c.clear_cache()
    assert not cached.exists()
    c.export(str(tmp_path / "c.json"))
    d = catalog.Catalog(entries=[])
    d.import_(str(tmp_path / "c.json"))
    assert d.list() == c.list()
    d.import_(str(tmp_path / "c.json"), merge=False)
    d.unregister("bad")
    assert "bad" not in d.list()
    messages = []
    assert catalog.Collection(["gpt2-small", "bad", "nothing"], c, messages.append).names() == ["gpt2-small"] and len(messages) == 2
    assert catalog.collection("code", c).names() == ["code-tokenizer"]


def run(capsys, *args, status=0):
    assert cli.main(list(args)) == status
    return capsys.readouterr().out


def test_command_line(spark, tmp_path, capsys):
    text = "the quick brown fox jumps over the lazy dog and the other quick fox\n"
    (tmp_path / "in.txt").write_text(text * 3)
    model, src = str(tmp_path / "m.json"), str(tmp_path / "in.txt")
    run(capsys, "train", "-i", src, "-o", model, "--vocab-size", "60", "--special-tokens", "<|more|>")
    assert BpeModel.load(model).vocab["<|more|>"] == 4
    ids = run(capsys, "encode", "-t", model, "--text", "the fox").strip()
    assert run(capsys, "decode", "-t", model, "--tokens", ids).strip() == "the fox"
    assert json.loads(run(capsys, "encode", "-t", model, "--text", "the fox", "--format", "json"))["text"] == "the fox"
    assert "\"" in run(capsys, "encode", "-t", model, "--input-file", src, "--format", "tokens")
    out = json.loads(run(capsys, "analyze", "-t", model, "--text", "the fox", "--metrics", "all", "--save-vocab", str(tmp_path / "v.json")))
    assert set(out) == {"basic_statistics", "compression_analysis", "coverage_analysis", "quality_analysis"}
    assert run(capsys, "list", "--domain", "code", "--format", "names").split() == ["code-tokenizer"]
    assert "gpt2-small" in run(capsys, "list") and len(json.loads(run(capsys, "list", "--format", "json"))) == 5
    assert json.loads(run(capsys, "info", "gpt2-small", "--format", "json"))["vocab_size"] == 50257
    assert json.loads(run(capsys, "info", model, "--format", "json"))["num_merges"] > 0
    assert "gpt2-small" in run(capsys, "search", "gpt", "--limit", "1")
    b = json.loads(run(capsys, "benchmark", "-t", model, "-i", src, "--metrics", "all"))
    assert set(b["results"][model]) == {"compression_ratio", "encoding_time", "vocab_utilization"}
    run(capsys, "preprocess", "-i", src, "-o", str(tmp_path / "p.txt"), "--min-length", "10")
    assert (tmp_path / "p.txt").read_text().endswith("fox\n\n")
    run(capsys, "convert", "-i", model, "-o", str(tmp_path / "tables"), "--format", "parquet")
    run(capsys, "decode", "-t", str(tmp_path / "tables"), "--tokens", ids)
    run(capsys, "info", str(tmp_path / "none.json"), status=1)
    run(capsys, "train", "-i", str(tmp_path / "none"), "-o", model, status=1)


def test_package():
    import lodestone

    assert lodestone.get_version() and "gpt2-small" in lodestone.get_available_tokenizers()
    assert lodestone.quick_tokenize("Hello hello!", return_tokens=True) == ["Hello", " hello", "!"]
    lodestone.print_info()
    lodestone.setup_logging("WARNING")


def test_compressed_files_in_other_encodings(spark, tmp_path):
    import bz2
    import gzip

    (tmp_path / "a.txt.gz").write_bytes(gzip.compress("déjà vu\r\n".encode("latin-1")))
    (tmp_path / "b.txt.bz2").write_bytes(bz2.compress("été".encode("cp1252")))
    (tmp_path / "c.txt.gz").write_bytes(b"not packed")
    read = lambda name, enc: [r["text"] for r in readers.read_texts(spark, str(tmp_path / name), enc).collect()]
    assert read("a.txt.gz", "latin-1") == ["déjà vu\n"] and read("b.txt.bz2", "cp1252") == ["été"] and read("c.txt.gz", "latin-1") == []


def test_paths_with_a_scheme(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("one")
    (tmp_path / "in" / "deep" / "b.jsonl").write_text('{"text": "two"}\n{"text": "three"}\n')
    uri = f"file://{tmp_path}/in"
    names = lambda found: [(f.rsplit("/", 1)[1], k) for f, k in found]
    assert names(readers.resolve([uri], spark=spark)) == [("a.txt", "txt"), ("b.jsonl", "jsonl")]
    assert names(readers.resolve([f"{uri}/*.txt"], spark=spark)) == names(readers.resolve([f"{uri}/a.txt"], spark=spark)) == [("a.txt", "txt")]
    assert readers.resolve([f"{uri}/none*"], spark=spark) == []
    assert [tuple(r) for r in readers.read_input(spark, [uri]).orderBy("doc_id").collect()] == [(0, "one"), (1, "two"), (2, "three")]
    out = f"file://{tmp_path}/out"
    cli._emit(spark.createDataFrame([("x",), ("y",)], "value string").coalesce(1), out)
    assert [r[0] for r in spark.read.text(out).collect()] == ["x", "y"]
