"""A catalog of tokenizers: entries in memory, mirrored as a DataFrame; search, import, export, fetching."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from threading import RLock
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import BASE_SPECIALS, CODE_PATTERN, WORD_PATTERN, TokenizerConfig, numbered
from .operators import analyze
from .operators.bpe import BpeModel

ENTRY = (
    "name string, description string, vocab_size int, language string, domain string, model_family string, version string, file_url string, "
    "file_hash string, file_size bigint, config string, created_by string, license string, tags array<string>"
)


@dataclass
class Entry:
    """What the catalog knows of a tokenizer. ``config`` holds settings of TokenizerConfig that differ from the defaults."""

    name: str
    description: str
    vocab_size: int
    language: str = "en"
    domain: str = "general"
    model_family: str | None = None
    version: str = "1.0"
    file_url: str | None = None
    file_hash: str | None = None
    file_size: int | None = None
    config: dict[str, Any] | None = None
    created_by: str = "unknown"
    license: str = "unknown"
    tags: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.tags = list(self.tags or [])


def built_in() -> list[Entry]:
    """Five configurations, none of them trained."""

    def entry(name: str, description: str, size: int, tags: str, specials: dict[str, int], more: dict | None = None, **rest) -> Entry:
        return Entry(name, description, size, config={"vocab_size": size, "special_tokens": specials} | (more or {}), tags=tags.split(), **rest)

    low = numbered(BASE_SPECIALS)
    high = numbered(BASE_SPECIALS, 50_256, -1)
    gpt = {"model_family": "gpt2"}
    return [
        entry("gpt2-small", "GPT-2 small model tokenizer (117M parameters)", 50_257, "gpt autoregressive english", high, {"regex_pattern": WORD_PATTERN}, **gpt),
        entry("gpt2-medium", "GPT-2 medium model tokenizer (345M parameters)", 50_257, "gpt autoregressive english", high, **gpt),
        entry("code-tokenizer", "Tokenizer optimized for source code", 32_000, "code programming software", numbered((*BASE_SPECIALS, "indent", "dedent", "newline")), {"regex_pattern": CODE_PATTERN}, domain="code"),
        entry("multilingual-base", "Base multilingual tokenizer", 64_000, "multilingual general", low, {"normalize_unicode": True}, language="multilingual"),
        entry("scientific-tokenizer", "Tokenizer optimized for scientific text", 40_000, "scientific academic research", numbered((*BASE_SPECIALS, "formula", "citation")), domain="scientific"),
    ]


class Catalog:
    """Entries by name. Fetched files are kept in cache_dir."""

    def __init__(self, cache_dir: str | None = None, entries: list[Entry] | None = None):
        self.cache_dir = Path(cache_dir or os.path.expanduser("~/.lodestone"))
        self._lock, self._entries = RLock(), {}
        for e in built_in() if entries is None else entries:
            self.register(e)

    # -- entries

    def register(self, entry: Entry) -> None:
        """Add an entry, or replace the one of that name."""
        with self._lock:
            self._entries[entry.name] = entry

    def unregister(self, name: str) -> None:
        with self._lock:
            self._entries.pop(name, None)

    def get(self, name: str) -> Entry | None:
        return self._entries.get(name)

    def list(self, domain: str | None = None, language: str | None = None, model_family: str | None = None, tags: list[str] | None = None) -> list[str]:
        """Sorted names of the entries that match all that is given, and have all the tags."""
        wanted = {"domain": domain, "language": language, "model_family": model_family}

        def fits(e: Entry) -> bool:
            return all(not v or getattr(e, k) == v for k, v in wanted.items()) and set(tags or []) <= set(e.tags)

        return sorted(n for n, e in self._entries.items() if fits(e))

    def search(self, query: str) -> list[tuple[str, float]]:
        """(name, relevance), best first, of equal ones in the order of registration."""
        q = query.lower()

        def relevance(e: Entry) -> float:
            ranked = ((1.0, q == e.name.lower()), (0.8, q in e.name.lower()), (0.6, q in e.description.lower()), (0.4, any(q in t.lower() for t in e.tags)), (0.3, q in e.domain.lower() or q in e.language.lower()))
            return next((s for s, hit in ranked if hit), 0.0)

        found = [(n, relevance(e)) for n, e in self._entries.items()]
        return sorted((x for x in found if x[1] > 0), key=lambda x: -x[1])

    # -- as tables

    def table(self, spark: SparkSession) -> DataFrame:
        """The entries in the order of registration (column ord); config as JSON text."""
        rows = [(*(v if k != "config" else (None if v is None else json.dumps(v)) for k, v in asdict(e).items()), n) for n, e in enumerate(self._entries.values())]
        return spark.createDataFrame(rows, ENTRY + ", ord int")

    # -- models

    def create(self, name: str, **overrides) -> BpeModel:
        """An untrained tokenizer of an entry's configuration, overlaid by what is given."""
        entry = self.get(name)
        if entry is None:
            raise ValueError(f"no such tokenizer: {name}")
        return BpeModel(TokenizerConfig.from_dict((entry.config or {"vocab_size": entry.vocab_size}) | overrides))

    def load(self, name: str, force_download: bool = False) -> BpeModel:
        """The trained tokenizer of an entry with a file; of one without, the untrained configuration."""
        entry = self.get(name)
        if entry is None:
            raise ValueError(f"no such tokenizer: {name}")
        return BpeModel.load(self.fetch(name, force_download)) if entry.file_url else self.create(name)

    def _cached(self, entry: Entry) -> Path:
        return self.cache_dir / f"{hashlib.sha256(entry.name.encode()).hexdigest()[:16]}.json"

    def fetch(self, name: str, force: bool = False) -> str:
        """The path of an entry's file, copied to the cache and checked against its SHA-256 if the entry has one.

        A cached file of another hash is fetched again; a fetched one raises ValueError.
        """
        entry = self.get(name)
        if entry is None or not entry.file_url:
            raise ValueError(f"nothing to fetch for {name}")
        path = self._cached(entry)
        if path.exists() and not force and self._intact(path, entry):
            return str(path)
        if urllib.parse.urlparse(entry.file_url).scheme not in ("", "file", "http", "https"):
            raise ValueError(f"can't fetch {entry.file_url}")
        self.cache_dir.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(".part")
        url = entry.file_url if "://" in entry.file_url else Path(entry.file_url).resolve().as_uri()
        with urllib.request.urlopen(url) as source, open(part, "wb") as f:  # noqa: S310
            shutil.copyfileobj(source, f)
        if not self._intact(part, entry):
            part.unlink()
            raise ValueError(f"the file of {name} hasn't the expected hash")
        part.replace(path)
        return str(path)

    @staticmethod
    def _intact(path: Path, entry: Entry) -> bool:
        if not entry.file_hash:
            return True
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest() == entry.file_hash

    def clear_cache(self, name: str | None = None) -> None:
        """Remove the cached file of one entry, or all."""
        if name is None:
            paths = self.cache_dir.glob("*.json") if self.cache_dir.exists() else []
        else:
            paths = [self._cached(e)] if (e := self.get(name)) else []
        for p in paths:
            p.unlink(missing_ok=True)

    # -- files

    def export(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({n: asdict(e) for n, e in self._entries.items()}, f, ensure_ascii=False, indent=2)

    def import_(self, path: str, merge: bool = True) -> None:
        """Register what an exported file has; without merge, in place of all there is."""
        with open(path, encoding="utf-8") as f:
            entries = [Entry(**e) for e in json.load(f).values()]
        with self._lock:
            if not merge:
                self._entries.clear()
            for e in entries:
                self.register(e)


def listed(table: DataFrame, domain: str | None = None, language: str | None = None, model_family: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """(name) of a catalog table's rows that match all that is given, sorted."""
    for c, v in (("domain", domain), ("language", language), ("model_family", model_family)):
        if v:
            table = table.where(F.col(c) == v)
    for t in tags or []:
        table = table.where(F.array_contains("tags", t))
    return table.select("name").orderBy("name")


def searched(table: DataFrame, query: str) -> DataFrame:
    """(name, relevance) of a catalog table, best first."""
    q = query.lower()
    has = lambda c: F.contains(F.lower(c), F.lit(q))
    score = F.when(F.lower("name") == q, 1.0).when(has(F.col("name")), 0.8).when(has(F.col("description")), 0.6)
    score = score.when(F.exists("tags", lambda t: has(t)), 0.4).when(has(F.col("domain")) | has(F.col("language")), 0.3)
    return table.withColumn("relevance", score).where(F.col("relevance").isNotNull()).orderBy(F.desc("relevance"), "ord").select("name", "relevance")


class Collection:
    """Several tokenizers side by side."""

    def __init__(self, names: list[str] | None = None, catalog: Catalog | None = None, report: Callable[[str], None] = lambda m: None):
        self.models: dict[str, BpeModel] = {}
        self.catalog, self.report = catalog or get_catalog(), report
        self.load(names or [])

    def load(self, names: list[str]) -> None:
        """Load entries; one that can't be is reported and left out."""
        for n in names:
            try:
                self.models[n] = self.catalog.load(n)
            except (OSError, ValueError) as e:
                self.report(f"{n} wasn't loaded: {e}")

    def add(self, name: str, model: BpeModel) -> None:
        self.models[name] = model

    def names(self) -> list[str]:
        return list(self.models)

    def get(self, name: str) -> BpeModel | None:
        return self.models.get(name)

    def compare(self, df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
        """(id, tokenizer, ids): each text by each tokenizer; an untrained one makes no ids."""
        none = F.array().cast("array<int>")
        each = [F.struct(F.lit(n).alias("tokenizer"), (m.encode(F.col(text_col)) if m.trained else none).alias("ids")) for n, m in self.models.items()]
        return df.select(F.col(id_col), F.explode(F.array(*each)).alias("x")).select(id_col, "x.tokenizer", "x.ids")

    def compression(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return analyze.compression(df, self.models, text_col)

    def benchmark(self, df: DataFrame, metrics: list[str] | None = None, text_col: str = "text") -> dict[str, dict[str, float]]:
        return analyze.benchmark(df, {n: m for n, m in self.models.items() if m.trained}, metrics, text_col)


def collection(domain: str | None = None, catalog: Catalog | None = None, **filters) -> Collection:
    """The tokenizers of the entries that match."""
    c = catalog or get_catalog()
    return Collection(c.list(domain=domain, **filters), c)


_global: Catalog | None = None


def get_catalog() -> Catalog:
    """The catalog of this process."""
    global _global
    if _global is None:
        _global = Catalog()
    return _global


def list_tokenizers(**filters) -> list[str]:
    return get_catalog().list(**filters)


def load_tokenizer(name: str, force_download: bool = False) -> BpeModel:
    return get_catalog().load(name, force_download)


def create_tokenizer_from_config(name: str, **overrides) -> BpeModel:
    return get_catalog().create(name, **overrides)


def register_tokenizer(entry: Entry) -> None:
    get_catalog().register(entry)


def get_tokenizer_info(name: str) -> Entry | None:
    return get_catalog().get(name)


def search_tokenizers(query: str) -> list[tuple[str, float]]:
    return get_catalog().search(query)
