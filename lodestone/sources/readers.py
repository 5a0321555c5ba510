"""Texts from files. Order of files and lines is in columns; what can't be read is left out."""

from __future__ import annotations

import bz2
import codecs
import glob
import gzip
import lzma
import re
import zlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.analyze import batches


def _lines_unified(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


#: Encodings that Spark decodes by itself, by Python's name.
NATIVE = {"iso8859-1": "ISO-8859-1", "ascii": "US-ASCII", "utf-16": "UTF-16", "utf-16-be": "UTF-16BE", "utf-16-le": "UTF-16LE", "utf-32": "UTF-32"}


def _decoded(content: Column, encoding: str) -> Column:
    """Bytes in any encoding that Python knows; null if they aren't in it."""
    name = codecs.lookup(encoding).name
    if name in NATIVE:
        return F.decode(content, NATIVE[name])

    def decode(b: bytes) -> str | None:
        try:
            return b.decode(name)
        except UnicodeError:
            return None

    def apply(files: pa.Array) -> pa.Array:
        return pa.array([None if (b := x.as_py()) is None else decode(b) for x in files], pa.string())

    return F.arrow_udf(apply, "string")(content)


#: By the extension of a file's name.
PACKED = {"gz": gzip.decompress, "bz2": bz2.decompress, "xz": lzma.decompress}


def _unpacked(content: Column, path: Column) -> Column:
    """The bytes of a compressed file, by its extension; null if they aren't of that kind."""

    def unpack(b: bytes, kind: str) -> bytes | None:
        try:
            return PACKED[kind](b)
        except (OSError, EOFError, lzma.LZMAError, zlib.error):
            return None

    def apply(files: pa.Array, kinds: pa.Array) -> pa.Array:
        return pa.array([None if b is None else unpack(b, k) for b, k in zip(files.to_pylist(), kinds.to_pylist())], pa.binary())

    kind = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    packed = kind.isin(*PACKED)
    return F.when(packed, F.arrow_udf(apply, "binary")(F.when(packed, content), kind)).otherwise(content)


def read_texts(spark: SparkSession, paths: str | list[str], encoding: str = "utf-8", pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, text) of whole files, also compressed ones; line ends are unified, empty and unreadable files are left out."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    options = {"recursiveFileLookup": str(recursive).lower(), "ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"} | ({"pathGlobFilter": pattern} if pattern else {})
    if codecs.lookup(encoding).name == "utf-8":
        files = spark.read.options(**options).text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    else:
        files = spark.read.format("binaryFile").options(**options).load(paths).select("path", _decoded(_unpacked(F.col("content"), F.col("path")), encoding).alias("text"))
    return files.select("path", _lines_unified(F.col("text")).alias("text")).where("text <> ''")


def read_directory(spark: SparkSession, directory: str, pattern: str = "*.txt", recursive: bool = True, encoding: str = "utf-8") -> DataFrame:
    """(path, text) of the files under a directory whose names match."""
    return read_texts(spark, directory, encoding, pattern, recursive)


def read_jsonl(spark: SparkSession, paths: str | list[str], text_field: str = "text", block: bool = False) -> DataFrame:
    """(path, text): one field of each line's JSON object. Lines that aren't JSON or lack it are skipped. Compression by extension."""
    name = text_field.replace("'", "\\'")
    rows = spark.read.text([paths] if isinstance(paths, str) else list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    return rows.select("path", *(["block"] if block else []), F.get_json_object("value", f"$['{name}']").alias("text")).where(F.col("text").isNotNull())


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of lines without white space around them; blank ones are left out."""
    rows = spark.read.text([paths] if isinstance(paths, str) else list(paths)).select(F.col("_metadata.file_path").alias("path"), T.strip(F.col("value")).alias("text"))
    return rows.where("text <> ''")


def read_token_ids(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text, ids) of lines of integers between white space; lines with anything else are left out."""
    rows = read_lines(spark, paths)
    parsed = F.transform(T.words(F.col("text")), lambda w: w.try_cast("int"))
    return rows.withColumn("ids", parsed).where(~F.exists("ids", lambda i: i.isNull()))


def _listed(spark: SparkSession, path: str) -> list[str]:
    """The files that a path of any file system of Spark's names, as :func:`resolve` has it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    matches = list(fs.globStatus(p) or [])
    if len(matches) != 1 or matches[0].isFile():
        return sorted(str(m.getPath().toString()) for m in matches if m.isFile())
    every, found = fs.listFiles(matches[0].getPath(), True), []
    while every.hasNext():
        found.append(str(every.next().getPath().toString()))
    return [*sorted(f for f in found if f.endswith(".txt")), *sorted(f for f in found if f.endswith(".jsonl"))]


def resolve(paths: list[str], format: str = "auto", max_files: int | None = None, spark: SparkSession | None = None) -> list[tuple[str, str]]:
    """(path, "txt" or "jsonl") of the files that paths name: a file, a directory (its *.txt, then its *.jsonl, at any depth) or a pattern.

    A path with a scheme, such as hdfs:// or s3a://, is listed by Spark's file systems. "auto" goes by the extension; all but
    .jsonl is text. max_files counts over all paths.
    """
    found: list[tuple[str, str]] = []
    for p in paths:
        if spark is not None and "://" in p:
            files = _listed(spark, p)
        else:
            path = Path(p)
            every = [path] if path.is_file() else [*sorted(path.rglob("*.txt")), *sorted(path.rglob("*.jsonl"))] if path.is_dir() else [Path(x) for x in sorted(glob.glob(p, recursive=True))]
            files = [str(f) for f in every if f.is_file()]
        found += [(f, format if format != "auto" else "jsonl" if f.lower().endswith(".jsonl") else "txt") for f in files]
    return found[:max_files] if max_files else found


def read_input(spark: SparkSession, paths: list[str], format: str = "auto", text_field: str = "text", max_files: int | None = None) -> DataFrame:
    """(doc_id, text) of everything under paths, doc_id counting in the order of files, then of lines in them."""
    files = resolve(paths, format, max_files, spark)
    parts = []
    if texts := [f for f, kind in files if kind == "txt"]:
        parts.append(read_texts(spark, texts).withColumn("block", F.lit(0).cast("long")).withColumn("line", F.lit(0).cast("long")))
    if lines := [f for f, kind in files if kind == "jsonl"]:
        # A file may be read in blocks; within one, Spark's ids keep the order of lines.
        parts.append(read_jsonl(spark, lines, text_field, block=True).withColumn("line", F.monotonically_increasing_id()))
    if not parts:
        return spark.createDataFrame([], "doc_id long, text string")
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    place = spark.createDataFrame([(re.sub("^file:/+", "file:///", f) if re.match(r"\w+:/", f) else Path(f).resolve().as_uri(), k) for k, (f, _) in enumerate(files)], "path string, file int")
    ordered = every.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")).join(place, "path")
    numbered = batches(ordered.select(F.struct("file", "block", "line").alias("at"), "text"), 1, "at")
    return numbered.select(F.col("batch_id").alias("doc_id"), "text")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
