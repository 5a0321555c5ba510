"""The command line: python -m lodestone COMMAND."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .config import PreprocessingConfig, TokenizerConfig
from .operators import analyze
from .operators.bpe import BpeModel, train
from .plans import pipeline
from .sources import readers, writers

log = logging.getLogger("lodestone")


class CommandError(Exception):
    """Ends the program with status 1."""


def session() -> SparkSession:
    """The session of the cluster that submits this program, or a local one."""
    return SparkSession.builder.appName("lodestone").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lodestone", description="Train, apply and study tokenizers; prepare corpora.")
    p.add_argument("--verbose", "-v", action="store_true")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        return commands.add_parser(name, help=text, description=text)

    c = command("train", "train a tokenizer")
    c.add_argument("--input", "-i", nargs="+", required=True)
    c.add_argument("--output", "-o", required=True)
    c.add_argument("--vocab-size", type=int, default=50_000)
    c.add_argument("--min-frequency", type=int, default=2)
    c.add_argument("--format", choices=("auto", "txt", "jsonl"), default="auto")
    c.add_argument("--text-field", default="text")
    c.add_argument("--max-files", type=int)
    c.add_argument("--preprocessing", action="store_true")
    c.add_argument("--workers", type=int, help="accepted; Spark decides")
    c.add_argument("--regex-pattern")
    c.add_argument("--special-tokens", nargs="+", default=[], help="added to those of the configuration")
    c.add_argument("--config-file")

    for name, text, what in (("encode", "encode texts", "--text"), ("decode", "decode token ids", "--tokens")):
        c = command(name, text)
        c.add_argument("--tokenizer", "-t", required=True)
        c.add_argument(what)
        c.add_argument("--input-file")
        c.add_argument("--output-file")
        formats = ("ids", "tokens", "json") if name == "encode" else ("text", "json")
        c.add_argument("--format", choices=formats, default=formats[0])
        if name == "encode":
            c.add_argument("--batch-size", type=int, default=1000, help="accepted; Spark decides")

    c = command("analyze", "study how a tokenizer does on texts")
    c.add_argument("--tokenizer", "-t", required=True)
    c.add_argument("--input", "-i", nargs="+")
    c.add_argument("--text")
    c.add_argument("--metrics", nargs="+", choices=("basic", "compression", "coverage", "quality", "all"), default=["basic"])
    c.add_argument("--save-vocab")
    c.add_argument("--output-file")

    c = command("list", "list the tokenizers of the catalog")
    for flag in ("--domain", "--language", "--model-family"):
        c.add_argument(flag)
    c.add_argument("--tags", nargs="+")
    c.add_argument("--format", choices=("table", "json", "names"), default="table")

    c = command("info", "show a tokenizer of the catalog, or a file")
    c.add_argument("tokenizer")
    c.add_argument("--format", choices=("text", "json"), default="text")

    c = command("search", "search the catalog")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=10)

    c = command("benchmark", "compare tokenizers")
    c.add_argument("--tokenizers", "-t", nargs="+", required=True)
    c.add_argument("--input", "-i", required=True)
    c.add_argument("--metrics", nargs="+", choices=("compression", "speed", "coverage", "all"), default=["compression", "speed"])
    c.add_argument("--num-samples", type=int, default=1000)
    c.add_argument("--output-file")

    c = command("preprocess", "clean, filter and deduplicate texts")
    c.add_argument("--input", "-i", nargs="+", required=True)
    c.add_argument("--output", "-o", required=True)
    c.add_argument("--config-file")
    c.add_argument("--min-length", type=int, default=50)
    c.add_argument("--max-length", type=int, default=1_000_000)
    c.add_argument("--remove-duplicates", action="store_true")
    c.add_argument("--quality-threshold", type=float, default=0.5)
    c.add_argument("--workers", type=int, help="accepted; Spark decides")

    c = command("convert", "convert a tokenizer between JSON and Parquet tables")
    c.add_argument("--input", "-i", required=True)
    c.add_argument("--output", "-o", required=True)
    c.add_argument("--format", choices=("json", "parquet"), required=True)
    return p


def tokenizer(name: str) -> BpeModel:
    """The model in a file or a folder, or of the catalog."""
    if Path(name).is_dir():
        return BpeModel.load_tables(session(), name)
    if Path(name).exists():
        return BpeModel.load(name)
    try:
        return catalog.load_tokenizer(name)
    except ValueError as e:
        raise CommandError(str(e)) from None


def _settings(path: str | None) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8")) if path else {}


def _emit(lines: DataFrame | list[str], path: str | None) -> None:
    """Lines in their order, to a file or to standard output. They come to this process one partition at a time.

    A path with a scheme, such as hdfs:// or s3a://, becomes a folder that Spark's tasks write.
    """
    if path and "://" in path and isinstance(lines, DataFrame):
        lines.write.mode("overwrite").text(path)
        return
    rows = (r[0] for r in lines.toLocalIterator()) if isinstance(lines, DataFrame) else iter(lines)
    out = open(path, "w", encoding="utf-8") if path else sys.stdout
    try:
        for line in rows:
            print(line, file=out)
    finally:
        if path:
            out.close()


def _texts(given: str | None, path: str | None) -> DataFrame:
    """(n, text) of one text, of a file's lines, or of standard input's."""
    spark = session()
    if given is not None:
        return spark.createDataFrame([(0, given)], "n long, text string")
    if path:
        return readers.read_lines(spark, path).withColumn("n", F.monotonically_increasing_id())
    lines = [s for line in sys.stdin if (s := line.strip())]
    return spark.createDataFrame(list(enumerate(lines)), "n long, text string")


def _some(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise CommandError(f"no {what} found")
    return df


def run_train(a) -> None:
    docs = _some(readers.read_input(session(), a.input, a.format, a.text_field, a.max_files), "training data")
    if a.preprocessing:
        staged = pipeline.flagged(docs, PreprocessingConfig())
        log.info("preprocessing: %s", pipeline.statistics(staged).first().asDict())
        docs = staged.where(F.col("stage") == pipeline.FINAL)
    settings = _settings(a.config_file) | {"vocab_size": a.vocab_size, "min_frequency": a.min_frequency}
    if a.regex_pattern:
        settings["regex_pattern"] = a.regex_pattern
    specials = dict(settings.get("special_tokens") or TokenizerConfig().special_tokens)
    for t in a.special_tokens:
        specials.setdefault(t, max(specials.values(), default=-1) + 1)
    model = train(docs, TokenizerConfig.from_dict(settings | {"special_tokens": specials}))
    model.save(a.output)
    log.info("saved to %s: %s", a.output, analyze.token_stats_table(docs.orderBy("doc_id").limit(1000), model).first().asDict())


def run_encode(a) -> None:
    model = tokenizer(a.tokenizer)
    coded = _some(_texts(a.text, a.input_file), "input text").withColumn("ids", model.encode(F.col("text")))
    ids = F.col("ids")
    line = {"ids": lambda: writers.as_ids(ids), "tokens": lambda: writers.as_tokens(ids, model), "json": lambda: writers.as_json(F.col("text"), ids, model)}[a.format]()
    _emit(coded.orderBy("n").select(line), a.output_file)


def run_decode(a) -> None:
    model = tokenizer(a.tokenizer)
    if a.tokens is None and a.input_file:
        rows = readers.read_token_ids(session(), a.input_file).withColumn("n", F.monotonically_increasing_id())
    else:
        parsed = []
        for n, line in enumerate([a.tokens] if a.tokens is not None else sys.stdin):
            try:
                if ids := [int(x) for x in line.split()]:
                    parsed.append((n, ids))
            except ValueError:
                log.warning("not token ids: %s", line.strip())
        rows = session().createDataFrame(parsed, "n long, ids array<int>")
    ids = F.col("ids")
    line = model.decode(ids) if a.format == "text" else writers.decoded_json(ids, model)
    _emit(_some(rows, "token sequences").orderBy("n").select(line), a.output_file)


def run_analyze(a) -> None:
    model = tokenizer(a.tokenizer)
    if a.text is None and not a.input:
        raise CommandError("give --text or --input")
    docs = session().createDataFrame([(0, a.text)], "doc_id long, text string") if a.text is not None else readers.read_input(session(), a.input)
    wanted, out = set(a.metrics), {}
    every = "all" in wanted
    if every or "basic" in wanted:
        out["basic_statistics"] = analyze.token_stats_table(docs, model).first().asDict()
    if every or "compression" in wanted:
        rows = analyze.analyze_texts(docs.orderBy("doc_id").limit(10), model).orderBy("doc_id").collect()
        out["compression_analysis"] = {f"text_{k}": {c: r[c] for c in ("compression_ratio", "text_length", "num_tokens")} for k, r in enumerate(rows)}
    if every or "coverage" in wanted:
        out["coverage_analysis"] = analyze.coverage_table(docs, model).first().asDict()
    if every or "quality" in wanted:
        out["quality_analysis"] = analyze.validate(model, docs.orderBy("doc_id").limit(5))
    if a.save_vocab:
        writers.save_vocab(model, a.save_vocab)
    _emit([json.dumps(out, indent=2, ensure_ascii=False)], a.output_file)


def run_list(a) -> None:
    known = catalog.get_catalog()
    entries = [known.get(n) for n in known.list(a.domain, a.language, a.model_family, a.tags)]
    if a.format == "names":
        lines = [e.name for e in entries]
    elif a.format == "json":
        lines = [json.dumps([{k: getattr(e, k) for k in ("name", "description", "vocab_size", "domain", "language", "tags")} for e in entries], indent=2)]
    else:
        rows = [("NAME", "VOCABULARY", "DOMAIN", "LANGUAGE", "DESCRIPTION")] + [(e.name, str(e.vocab_size), e.domain, e.language, e.description) for e in entries]
        wide = [max(map(len, c)) for c in zip(*rows)]
        lines = ["  ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip() for r in rows] if entries else ["no tokenizer matches"]
    _emit(lines, None)


def run_info(a) -> None:
    entry = catalog.get_tokenizer_info(a.tokenizer)
    if entry:
        facts = asdict(entry)
    else:
        try:
            m = tokenizer(a.tokenizer)
        except (OSError, ValueError, KeyError) as e:
            raise CommandError(f"can't load {a.tokenizer}: {e}") from None
        marks = {t: i for t, i in m.vocab.items() if t.startswith("<") and t.endswith(">")}
        facts = {"vocab_size": m.vocab_size(), "num_merges": len(m.merges), "special_tokens": marks, "config": m.config.to_dict()}
    _emit([json.dumps(facts, indent=2, ensure_ascii=False)] if a.format == "json" else [f"{k}: {v}" for k, v in facts.items()], None)


def run_search(a) -> None:
    found = catalog.search_tokenizers(a.query)[: a.limit]
    lines = []
    for name, relevance in found:
        e = catalog.get_tokenizer_info(name)
        lines += [f"{name} ({relevance:.2f}): {e.description}", f"    {e.domain}, {e.language}, {e.vocab_size} tokens"]
    _emit(lines or [f"nothing matches {a.query!r}"], None)


def run_benchmark(a) -> None:
    docs = _some(readers.read_input(session(), [a.input]), "test data").orderBy("doc_id").limit(a.num_samples)
    metrics = ["compression", "speed", "coverage"] if "all" in a.metrics else a.metrics
    results = analyze.benchmark(docs, {n: tokenizer(n) for n in a.tokenizers}, metrics)
    head = {"tokenizers": a.tokenizers, "num_samples": docs.count(), "metrics": metrics}
    _emit([json.dumps({"benchmark_config": head, "results": results}, indent=2)], a.output_file)


def run_preprocess(a) -> None:
    settings = _settings(a.config_file) | {"min_text_length": a.min_length, "max_text_length": a.max_length, "remove_duplicates": a.remove_duplicates, "quality_threshold": a.quality_threshold}
    docs = _some(readers.read_input(session(), a.input), "input")
    staged = pipeline.flagged(docs, PreprocessingConfig.from_dict(settings))
    kept = staged.where(F.col("stage") == pipeline.FINAL).orderBy("doc_id")
    _emit(kept.select(F.concat("text", F.lit("\n"))), a.output)
    log.info("preprocessing: %s", pipeline.statistics(staged).first().asDict())


def run_convert(a) -> None:
    target = a.output
    if a.format == "json" and not target.endswith(".json"):
        target += ".json"
    writers.convert(a.input, target, session())


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, format="%(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    try:
        globals()[f"run_{a.command}"](a)
    except KeyboardInterrupt:
        return 130
    except (CommandError, OSError, ValueError, RuntimeError) as e:
        log.error("%s", e)
        return 1
    return 0
