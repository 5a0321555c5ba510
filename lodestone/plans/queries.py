"""The operators as queries over whole tables, and their SQL for another engine where SQL can say it.

SQL is for DuckDB, whose patterns are RE2's: without look-around or back-references, so repetition ratios and what goes beyond its
functions have none. Those are held against brute-force versions in the tests. Byte-pair merges are a recursion over the words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, built_in, listed, searched
from ..config import CODE_PATTERN, PreprocessingConfig, TokenizerConfig, chat_config
from ..functions import text as T
from ..operators import analyze, clean, conversation, dedup, pretokenize, quality
from ..operators.bpe import BpeModel, build, merge_models, train
from ..runtime import spread
from ..sources import writers
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

W = T.WS_RE2
STRIP = f"regexp_replace({{0}}, '^[{W}]+|[{W}]+$', '', 'g')"
COLLAPSE = STRIP.replace("{0}", f"regexp_replace({{0}}, '[{W}]+', ' ', 'g')")
WORDS = f"list_filter(regexp_split_to_array({{0}}, '[{W}]+'), lambda x: x <> '')"
#: The code pattern in RE2, with Unicode classes spelled out.
CODE_RE2 = rf"[\t ]+|[_a-zA-Z][_a-zA-Z0-9]*|\p{{Nd}}+\.?\p{{Nd}}*|[^{W}\p{{L}}\p{{N}}\p{{M}}_]|\n"
CODE = TokenizerConfig(regex_pattern=CODE_PATTERN, vocab_size=0, min_frequency=1)


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


# -- cleaning


def _projected(name: str, sql: str, expression, table: str = "documents", key: str = "doc_id", text: str = "text") -> None:
    """A query of one text expression: (key, out)."""
    query(f"SELECT {key}, {sql.replace('{0}', text)} AS out FROM {table}" if sql else None, name)(lambda s, d: docs(s, d, table).select(key, expression(F.col(text)).alias("out")))


_PLACES = r"regexp_replace({0}, '%s', '%s', 'g')"
_projected("clean_controls", _PLACES % (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]", ""), clean.remove_controls)
_projected("clean_controls_all", _PLACES % (r"[\x00-\x1f\x7f-\x{9f}]", ""), lambda t: clean.remove_controls(t, False))
_projected("clean_zero_width", _PLACES % (r"[\x{200b}-\x{200d}\x{2060}\x{feff}]", ""), clean.remove_zero_width)
_projected("mask_urls", _PLACES % (r"(?i)https?://[.\w-]+(?::[0-9]+)?(?:/[/.\w]*)?(?:\?[%&=.\w]*)?(?:#[.\w]*)?".replace(r"\w", r"\p{L}\p{N}_"), " [URL] "), clean.mask_urls, "pages", "page_id", "html")
_projected("mask_emails", _PLACES % (r"\b[a-zA-Z0-9%+._-]+@[a-zA-Z0-9.-]+\.[a-z|A-Z]{2,}\b", " [EMAIL] "), clean.mask_emails)
_projected("mask_phones", _PLACES % (rf"(?:\+?1[.{W}-]?)?\(?\p{{Nd}}{{3}}\)?[.{W}-]?\p{{Nd}}{{3}}[.{W}-]?\p{{Nd}}{{4}}", " [PHONE] "), clean.mask_phones)
_projected("collapse_whitespace", COLLAPSE, T.collapse)
PARAGRAPHS = rf"list_aggregate(list_filter(list_transform(regexp_split_to_array({{0}}, '\n[{W}]*\n'), lambda p: {COLLAPSE.replace('{0}', 'p')}), lambda p: length(p) >= 10), 'string_agg', chr(10) || chr(10))"
_projected("clean_paragraphs", f"coalesce({PARAGRAPHS}, '')", clean.paragraphs)
_projected("clean_paragraphs_pages", f"coalesce({PARAGRAPHS}, '')", clean.paragraphs, "pages", "page_id", "html")
_projected("unicode_nfc", "nfc_normalize({0})", lambda t: T.unicode_form(t, "NFC"))
_projected("unicode_nfkd", "", lambda t: T.unicode_form(t, "NFKD"))
_projected("html_unescape", "", T.html_unescape, "pages", "page_id", "html")
_projected("fix_encoding", "", T.fix_encoding)
_projected("clean_default", "", lambda t: clean.clean(t, PreprocessingConfig()))
_projected("normalise_text", COLLAPSE.replace("{0}", "lower(strip_accents(nfc_normalize({0})))"), lambda t: clean.normalise(t, strip_accents=True, lowercase=True))
_projected("split_sentences", f"list_filter(list_transform(regexp_split_to_array({{0}}, '[.!?]+[{W}]+'), lambda s: {STRIP.replace('{0}', 's')}), lambda s: s <> '')", lambda t: F.to_json(clean.sentences(t)))
ORACLE_SQL["split_sentences"] = ORACLE_SQL["split_sentences"].replace("SELECT doc_id, ", "SELECT doc_id, to_json(").replace(" AS out", ")::VARCHAR AS out")
SENTENCES = f"list_filter(list_transform(regexp_split_to_array({{0}}, '[.!?]+[{W}]+'), lambda s: {STRIP.replace('{0}', 's')}), lambda s: length(s) BETWEEN 20 AND 1000)"
_projected("keep_sentences", f"list_aggregate({SENTENCES}, 'string_agg', ' ')", clean.keep_sentences)


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) BETWEEN 10 AND 10000")
def filter_by_length(spark, sf_dir):
    return clean.filter_by_length(docs(spark, sf_dir)).select("doc_id", F.length("text").cast("long").alias("n"))


# -- quality


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


METRICS_SQL = f"""
WITH w AS (SELECT doc_id, lang, text, {WORDS.replace('{0}', 'text')} AS words, string_split(text, chr(10)) AS lines FROM {{documents}} d),
m AS (SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS length, CAST(len(words) AS BIGINT) AS word_count,
  CASE WHEN len(words) > 0 THEN list_sum(list_transform(words, lambda x: length(x))) / len(words) ELSE 0.0 END AS avg_word_length,
  CASE WHEN len(words) > 0 THEN len(list_distinct(words)) / len(words) ELSE 0.0 END AS unique_words_ratio,
  {_count(rf'[^{W}\p{{L}}\p{{N}}]')} / length(text) AS special_char_ratio,
  {_count(r'\p{Nd}')} / length(text) AS digit_ratio,
  {_count(r'\p{Lu}')} / length(text) AS uppercase_ratio,
  CAST(len(lines) AS BIGINT) AS line_count,
  list_sum(list_transform(lines, lambda x: length(x))) / len(lines) AS avg_line_length
  FROM w WHERE text <> ''),
s AS (SELECT *, least(1.0::DOUBLE, 1.0::DOUBLE * (CASE WHEN unique_words_ratio < 0.3 THEN 0.7::DOUBLE ELSE 1 END)
  * (CASE WHEN special_char_ratio > 0.2 THEN 0.8::DOUBLE ELSE 1 END) * (CASE WHEN uppercase_ratio > 0.5 THEN 0.6::DOUBLE ELSE 1 END)
  * (CASE WHEN avg_word_length BETWEEN 3 AND 8 THEN 1.1::DOUBLE ELSE 1 END)) AS quality_score FROM m)
"""
_RATIOS = ("avg_word_length", "unique_words_ratio", "special_char_ratio", "digit_ratio", "uppercase_ratio", "avg_line_length")


@query(METRICS_SQL.replace("{documents}", "documents") + "SELECT doc_id, length, word_count, line_count, " + ", ".join(f"round({c}, 6) AS {c}" for c in _RATIOS) + " FROM s")
def quality_metrics(spark, sf_dir):
    m = quality.metrics(docs(spark, sf_dir).where("text <> ''"))
    return m.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("length", "word_count", "line_count")], *[F.round(c, 6).alias(c) for c in _RATIOS])


@query()
def repetition_ratio(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", quality.repetition_ratio(F.col("text")).alias("repetition_ratio"))


@query(METRICS_SQL.replace("{documents}", "documents") + "SELECT doc_id, round(quality_score, 6) AS quality_score FROM s")
def quality_score(spark, sf_dir):
    rows = docs(spark, sf_dir).where("text <> ''").withColumn("w", T.word_numbers(F.col("text")))
    return rows.select("doc_id", F.round(quality.score(F.col("text"), None, F.col("w")), 6).alias("quality_score"))


_GOOD = "length BETWEEN 50 AND 1000000 AND word_count >= 10 AND quality_score >= 0.5"


@query(METRICS_SQL.replace("{documents}", "documents") + f"SELECT doc_id FROM s WHERE {_GOOD}")
def high_quality(spark, sf_dir):
    return quality.judged(docs(spark, sf_dir), "good").where("good").select("doc_id")


_CLEANED = f"(SELECT doc_id, lang, coalesce({PARAGRAPHS.replace('{0}', 't')}, '') AS text FROM (SELECT doc_id, lang, regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]', '', 'g'), '[\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}]', '', 'g') AS t FROM documents))"
LIGHT = PreprocessingConfig(fix_encoding=False, fix_html_entities=False, normalize_unicode=None)


@query(
    METRICS_SQL.replace("{documents}", _CLEANED)
    + f"SELECT lang, count(*) AS n_docs, CAST(sum(CASE WHEN {_GOOD} THEN 1 ELSE 0 END) AS BIGINT) AS n_kept, CAST(sum(CASE WHEN {_GOOD} THEN length ELSE 0 END) AS BIGINT) AS chars_kept, round(avg(CASE WHEN {_GOOD} THEN 1.0::DOUBLE ELSE 0 END), 6) AS retention FROM s GROUP BY lang"
)
def quality_by_language(spark, sf_dir):
    """The flagship: cleaned, judged, and counted by language."""
    cleaned = docs(spark, sf_dir).select("lang", clean.clean(F.col("text"), LIGHT).alias("text")).where("text <> ''")
    judged = quality.judged(cleaned, "good", LIGHT).select("lang", F.length("text").alias("n"), "good")
    return judged.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if("good").alias("n_kept"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).cast("long").alias("chars_kept"), F.round(F.avg(F.col("good").cast("double")), 6).alias("retention")
    )


@query("SELECT l.quality, count(*) AS n, CAST(sum(CASE WHEN g.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_good FROM labels l LEFT JOIN (" + METRICS_SQL.replace("{documents}", "documents") + f"SELECT doc_id FROM s WHERE {_GOOD}) g ON l.doc_id = g.doc_id GROUP BY l.quality")
def quality_against_labels(spark, sf_dir):
    good = quality.judged(docs(spark, sf_dir), "good").where("good").select("doc_id", F.lit(1).alias("g"))
    return docs(spark, sf_dir, "labels").join(good, "doc_id", "left").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count("g").alias("n_good"))


# -- duplicates

NORMAL = COLLAPSE.replace("{0}", "lower(text)")


@query("SELECT doc_id, md5(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def exact_dedup(spark, sf_dir):
    return dedup.deduplicate(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


@query(f"SELECT doc_id, md5({NORMAL}) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY md5({NORMAL}) ORDER BY doc_id) = 1")
def md5_dedup(spark, sf_dir):
    return dedup.first_by_hash(docs(spark, sf_dir)).select("doc_id", dedup.text_hash(F.col("text")).alias("h"))


SHINGLES_SQL = f"""
WITH w AS (SELECT doc_id, {NORMAL} AS form, {WORDS.replace('{0}', NORMAL)} AS words FROM {{documents}} d WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5({NORMAL}) ORDER BY doc_id) = 1),
s AS (SELECT doc_id, CASE WHEN len(words) < 5 THEN [form] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS s FROM w),
p AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS i, b.doc_id AS j, a.n AS ni, b.n AS nj, count(*) AS c FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT i, j, c / (ni + nj - c) AS similarity FROM c WHERE c / (ni + nj - c) >= 0.85)
"""


@query(SHINGLES_SQL.replace("{documents}", "documents") + "SELECT i, j, round(similarity, 6) AS similarity FROM pairs")
def shingle_pairs(spark, sf_dir):
    return dedup.similar_pairs(dedup.first_by_hash(docs(spark, sf_dir).where("text is not null"))).select("i", "j", F.round("similarity", 6).alias("similarity"))


GREEDY_SQL = (
    SHINGLES_SQL.replace("WITH", "WITH RECURSIVE", 1)
    + """, seq AS (SELECT j, list(i ORDER BY i) AS earlier, row_number() OVER (ORDER BY j) AS k FROM pairs GROUP BY j),
walk(k, dropped) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT walk.k + 1, CASE WHEN len(list_filter(seq.earlier, lambda e: NOT list_contains(walk.dropped, e))) > 0 THEN list_append(walk.dropped, seq.j) ELSE walk.dropped END FROM walk JOIN seq ON seq.k = walk.k + 1),
kept AS (SELECT doc_id FROM w WHERE NOT list_contains((SELECT dropped FROM walk ORDER BY k DESC LIMIT 1), doc_id))"""
)


@query(GREEDY_SQL.replace("{documents}", "documents") + " SELECT doc_id FROM kept")
def near_dedup_greedy(spark, sf_dir):
    return dedup.near_deduplicate(docs(spark, sf_dir)).select("doc_id")


# -- preparation


_ADMITTED = _CLEANED.replace("FROM documents", "FROM documents WHERE text <> ''")
_JUDGED = f"(SELECT doc_id, text FROM {_ADMITTED} c WHERE doc_id IN (" + METRICS_SQL.replace("{documents}", _ADMITTED) + f"SELECT doc_id FROM s WHERE {_GOOD}))"
SPLIT = LIGHT.with_(split_sentences=True)


@query(GREEDY_SQL.replace("{documents}", _JUDGED) + f" SELECT doc_id, text FROM {_JUDGED} j WHERE doc_id IN (FROM kept)")
def prepared_documents(spark, sf_dir):
    return pipeline.prepare(docs(spark, sf_dir), LIGHT)


@query(
    GREEDY_SQL.replace("{documents}", _JUDGED)
    + f""", n AS (SELECT (SELECT count(*) FROM documents WHERE text <> '') AS total_processed, (SELECT count(*) FROM {_ADMITTED} a WHERE text <> '') AS after_cleaning,
  (SELECT count(*) FROM {_JUDGED} j) AS after_quality_filter, (SELECT count(*) FROM kept) AS after_deduplication,
  (SELECT count(*) FROM {_JUDGED} j WHERE doc_id IN (FROM kept) AND {SENTENCES.replace("{0}", "text")} <> []) AS final_count)
SELECT *, round(after_cleaning / total_processed, 6) AS cleaning_retention_rate, round(after_quality_filter / total_processed, 6) AS quality_retention_rate,
  round(after_deduplication / total_processed, 6) AS dedup_retention_rate, round(final_count / total_processed, 6) AS overall_retention_rate FROM n"""
)
def preparation_statistics(spark, sf_dir):
    s = pipeline.statistics(pipeline.flagged(docs(spark, sf_dir), SPLIT))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query()
def prepared_by_default(spark, sf_dir):
    """With encodings, entities and Unicode forms repaired, which SQL can't."""
    return pipeline.prepare(docs(spark, sf_dir))


# -- pre-tokens and training

CODE_WORDS = f"p AS (SELECT doc_id, regexp_extract_all(nfc_normalize(text), '{CODE_RE2}') AS ws FROM documents), e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM p)"
COUNTS_SQL = f"WITH {CODE_WORDS}, c AS (SELECT word, count(*) AS freq, min({{'d': doc_id, 'p': pos}}) AS f FROM e GROUP BY word)"
CHARS_SQL = COUNTS_SQL + ", ch AS (SELECT word, freq, f, unnest(regexp_extract_all(word, '(?s).')) AS ch FROM c)"
IDS_SQL = CHARS_SQL + ", v AS (SELECT ch, CAST(3 + row_number() OVER (ORDER BY encode(ch)) AS INTEGER) AS id FROM (SELECT DISTINCT ch FROM ch))"


@query(COUNTS_SQL + " SELECT word, freq, f.d AS first_doc, CAST(f.p AS INTEGER) AS first_pos FROM c")
def word_counts_code(spark, sf_dir):
    return pretokenize.word_counts(docs(spark, sf_dir), CODE)


# The usual pattern looks ahead once: white space before a word leaves its last blank to the word. A mark before that blank says the same.
_MARK = "\\x{e000}"
_NL = "\\n\\r"
_MARKED = f"regexp_replace(nfc_normalize(text), '([{W}]+)([\\x09\\x0b\\x0c\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}])([^{W}])', '\\1' || chr(57344) || '\\2\\3', 'g')"
USUAL_RE2 = "|".join((rf"''(?i:s|d|m|t|ll|ve|re)", rf"[^\p{{L}}\p{{N}}{_NL}{_MARK}]?\p{{L}}+", r"\p{N}{1,3}", rf" ?[^\p{{N}}\p{{L}}{W}{_MARK}]+[{_NL}]*", rf"[{W}]*[{_NL}]", rf"[{W}]+"))


@query(f"WITH p AS (SELECT doc_id, regexp_extract_all({_MARKED}, '{USUAL_RE2}') AS ws FROM documents), e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM p), c AS (SELECT word, count(*) AS freq, min({{'d': doc_id, 'p': pos}}) AS f FROM e GROUP BY word HAVING count(*) >= 2) SELECT word, freq, f.d AS first_doc, CAST(f.p AS INTEGER) AS first_pos FROM c")
def word_counts_usual(spark, sf_dir):
    return pretokenize.word_counts(docs(spark, sf_dir))


@query(IDS_SQL + " SELECT ch AS token, id FROM v")
def char_vocab(spark, sf_dir):
    return pretokenize.char_vocab(pretokenize.word_counts(docs(spark, sf_dir), CODE), 4)


PAIRS_SQL = COUNTS_SQL + ", q AS (SELECT freq, f, unnest(range(1, length(word))) AS i, word FROM c WHERE length(word) > 1), r AS (SELECT substr(word, i, 1) AS l, substr(word, i + 1, 1) AS r, sum(freq) AS n, min({'d': f.d, 'p': f.p, 'i': i}) AS f FROM q GROUP BY ALL)"


@query(PAIRS_SQL + " SELECT l AS \"left\", r AS \"right\", CAST(n AS BIGINT) AS n FROM r")
def pair_stats(spark, sf_dir):
    return pretokenize.pair_stats(pretokenize.word_counts(docs(spark, sf_dir), CODE)).select("left", "right", "n")


@query(PAIRS_SQL + " SELECT l AS \"left\", r AS \"right\", CAST(n AS BIGINT) AS n FROM r ORDER BY r.n DESC, f LIMIT 1")
def top_pair(spark, sf_dir):
    return pretokenize.top_pair(pretokenize.pair_stats(pretokenize.word_counts(docs(spark, sf_dir), CODE))).select("left", "right", "n")


def _trained(spark: SparkSession, sf_dir: str, size: int = 2000) -> BpeModel:
    return train(docs(spark, sf_dir), TokenizerConfig(vocab_size=size))


def _chars(spark: SparkSession, sf_dir: str) -> BpeModel:
    """The tokenizer of single characters: every pre-token's letters are its tokens."""
    return train(docs(spark, sf_dir), CODE)


#: A tokenizer of few merges, which SQL can learn too.
FEW = TokenizerConfig(regex_pattern=CODE_PATTERN, vocab_size=170)


def _few(spark: SparkSession, sf_dir: str) -> BpeModel:
    return train(docs(spark, sf_dir), FEW)


# Words as symbols between chr(1) and chr(2). In each round the commonest pair of those that training saw, of equal ones the first met, is joined everywhere.
MERGES_SQL = (
    COUNTS_SQL.replace("WITH", "WITH RECURSIVE", 1)
    + f""", bw AS (SELECT DISTINCT unnest(regexp_extract_all(nfc_normalize(text), '{CODE_RE2}')) AS word FROM benchmark),
o AS (SELECT word, freq, freq >= 2 AS learned, row_number() OVER (ORDER BY f) AS o FROM c UNION ALL SELECT word, 0, false, 0 FROM bw WHERE word NOT IN (SELECT word FROM c)),
ch AS (SELECT DISTINCT unnest(regexp_extract_all(word, '(?s).')) AS ch FROM o WHERE learned),
merged(k, word, freq, o, learned, s, l, r) AS (
  SELECT 0, word, freq, o, learned, chr(1) || array_to_string(regexp_extract_all(word, '(?s).'), chr(2) || chr(1)) || chr(2), NULL::VARCHAR, NULL::VARCHAR FROM o
  UNION ALL
  SELECT m.k + 1, m.word, m.freq, m.o, m.learned, replace(m.s, chr(1) || b.l || chr(2) || chr(1) || b.r || chr(2), chr(1) || b.l || b.r || chr(2)), b.l, b.r
  FROM merged m, (
    SELECT l, r FROM (SELECT freq, o, i, t[i] AS l, t[i + 1] AS r FROM (SELECT freq, o, t, unnest(range(1, len(t))) AS i FROM (
      SELECT freq, o, string_split(substr(s, 2, length(s) - 2), chr(2) || chr(1)) AS t FROM merged WHERE learned)))
    GROUP BY l, r HAVING sum(freq) >= 2 ORDER BY sum(freq) DESC, min(o * 1000000 + i) LIMIT 1) b
  WHERE m.k < {FEW.vocab_size} - 4 - (SELECT count(*) FROM ch)),
learned AS (SELECT DISTINCT k, l, r FROM merged WHERE k > 0),
ids AS (SELECT unnest(['<|endoftext|>', '<|startoftext|>', '<|pad|>', '<|unk|>']) AS token, unnest([0, 1, 2, 3]) AS id
  UNION ALL SELECT ch, 3 + row_number() OVER (ORDER BY encode(ch)) FROM ch
  UNION ALL SELECT l || r, 3 + (SELECT count(*) FROM ch) + k FROM learned),
voc AS (SELECT token, max(id) AS id FROM ids GROUP BY token),
ts AS (SELECT word, CASE WHEN word IN (SELECT token FROM voc) THEN [word] ELSE string_split(substr(s, 2, length(s) - 2), chr(2) || chr(1)) END AS t FROM merged WHERE k = (SELECT max(k) FROM merged)),
tk AS (SELECT word, i, coalesce(id, 3) AS id, coalesce(voc.token, '<|unk|>') AS token FROM (SELECT word, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM ts) x LEFT JOIN voc ON x.token = voc.token)
"""
)


@query(MERGES_SQL + 'SELECT CAST(k - 1 AS INTEGER) AS rank, l AS "left", r AS "right" FROM learned')
def bpe_merges(spark, sf_dir):
    return _few(spark, sf_dir).merge_table(spark)


@query(MERGES_SQL + "SELECT token, CAST(id AS INTEGER) AS id FROM ids")
def bpe_vocab(spark, sf_dir):
    return _few(spark, sf_dir).vocab_table(spark)


@query(MERGES_SQL + "SELECT documents.doc_id, coalesce(x.ids, '') AS ids FROM documents LEFT JOIN (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos, i) AS ids FROM e JOIN tk USING (word) GROUP BY doc_id) x USING (doc_id)")
def encode_documents(spark, sf_dir):
    m = _few(spark, sf_dir)
    return docs(spark, sf_dir).select("doc_id", writers.as_ids(m.encode(F.col("text"))).alias("ids"))


@query()
def bpe_merges_usual(spark, sf_dir):
    """Two thousand tokens, by the usual pattern."""
    return _trained(spark, sf_dir).merge_table(spark)


@query()
def encode_usual(spark, sf_dir):
    m = _trained(spark, sf_dir)
    return docs(spark, sf_dir).select("doc_id", m.encode(F.col("text")).alias("ids"))


@query()
def encode_compat(spark, sf_dir):
    m = _trained(spark, sf_dir).with_mode("compat")
    return docs(spark, sf_dir).select("doc_id", m.encode(F.col("text")).alias("ids"))


@query("SELECT doc_id, nfc_normalize(text) AS decoded FROM documents")
def encode_decode_round_trip(spark, sf_dir):
    m = train(docs(spark, sf_dir), TokenizerConfig(vocab_size=2000, min_frequency=1))
    return docs(spark, sf_dir).select("doc_id", m.decode(m.encode(F.col("text"))).alias("decoded"))


ENCODED_SQL = IDS_SQL + ", d AS (SELECT doc_id, pos, generate_subscripts(cs, 1) AS k, unnest(cs) AS ch FROM (SELECT doc_id, pos, regexp_extract_all(word, '(?s).') AS cs FROM e)), t AS (SELECT d.*, v.id FROM d JOIN v USING (ch))"


@query(ENCODED_SQL + " SELECT documents.doc_id, coalesce(x.ids, '') AS ids FROM documents LEFT JOIN (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos, k) AS ids FROM t GROUP BY doc_id) x USING (doc_id)")
def encode_characters(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", writers.as_ids(_chars(spark, sf_dir).encode(F.col("text"))).alias("ids"))


@query()
def merged_vocab(spark, sf_dir):
    small = build([("abab", 3), ("abc", 2)], TokenizerConfig(vocab_size=8))
    return merge_models([_trained(spark, sf_dir), small], reindex=True).vocab_table(spark)


# -- statistics

TEXT_SUMS = "SELECT count(text) AS total_texts, CAST(sum(length(text)) AS BIGINT) AS total_characters FROM documents"


@query(
    IDS_SQL
    + f""", u AS (SELECT CAST(sum(freq) AS BIGINT) AS total_tokens, count(DISTINCT ch) AS unique_tokens FROM ch), x AS ({TEXT_SUMS})
SELECT total_texts, total_characters, total_tokens, unique_tokens, round(total_characters / total_texts, 6) AS avg_chars_per_text, round(total_tokens / total_texts, 6) AS avg_tokens_per_text,
  round(total_characters / total_tokens, 6) AS compression_ratio, round(unique_tokens / (SELECT count(*) + 4 FROM v), 6) AS vocab_utilization, 1.0::DOUBLE AS avg_token_length FROM x, u"""
)
def token_stats(spark, sf_dir):
    s = analyze.token_stats_table(docs(spark, sf_dir), _chars(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(IDS_SQL + " SELECT CAST(sum(freq) AS BIGINT) AS total_tokens, count(DISTINCT ch) AS unique_tokens_used, round(count(DISTINCT ch) / (SELECT count(*) + 4 FROM v), 6) AS vocab_utilization, 0.0::DOUBLE AS unknown_rate, 1.0::DOUBLE AS coverage_rate FROM ch")
def vocab_coverage(spark, sf_dir):
    s = analyze.coverage_table(docs(spark, sf_dir), _chars(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(
    MERGES_SQL
    + f""", b AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(nfc_normalize(text), '{CODE_RE2}')) AS word FROM benchmark) GROUP BY word),
u AS (SELECT id, CAST(sum(n) AS BIGINT) AS n FROM b JOIN tk USING (word) GROUP BY id),
z AS (SELECT CAST(sum(n) AS BIGINT) AS total_tokens, count(*) AS unique_tokens_used, coalesce(sum(n) FILTER (WHERE id = 3), 0) AS unknown FROM u)
SELECT total_tokens, unique_tokens_used, round(unique_tokens_used / (SELECT count(*) FROM voc), 6) AS vocab_utilization, round(unknown / total_tokens, 6) AS unknown_rate, round(1 - unknown / total_tokens, 6) AS coverage_rate FROM z"""
)
def benchmark_coverage(spark, sf_dir):
    """How a tokenizer trained on documents does on texts it wasn't trained on."""
    s = analyze.coverage_table(docs(spark, sf_dir, "benchmark"), _few(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(CHARS_SQL + " SELECT ch AS token, CAST(sum(freq) AS BIGINT) AS n FROM ch GROUP BY ch HAVING sum(freq) < 5000")
def rare_tokens(spark, sf_dir):
    return analyze.rare_tokens(docs(spark, sf_dir), _chars(spark, sf_dir), 5000)


@query(
    ENCODED_SQL
    + """, g AS (SELECT doc_id, ch, count(*) AS n, min(pos * 1000000 + k) AS f FROM t GROUP BY doc_id, ch), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS r FROM g),
y AS (SELECT doc_id, count(*) AS unique_tokens, CAST(sum(n) AS BIGINT) AS num_tokens, string_agg(ch || CAST(n AS VARCHAR), ' ' ORDER BY r) FILTER (WHERE r <= 10) AS common FROM b GROUP BY doc_id)
SELECT documents.doc_id, CAST(length(text) AS BIGINT) AS text_length, coalesce(num_tokens, 0) AS num_tokens, coalesce(unique_tokens, 0) AS unique_tokens, coalesce(common, '') AS common FROM documents LEFT JOIN y USING (doc_id)"""
)
def analyze_texts(spark, sf_dir):
    a = analyze.analyze_texts(docs(spark, sf_dir), _chars(spark, sf_dir))
    common = F.array_join(F.transform("most_common_tokens", lambda x: F.concat(x["token"], x["n"].cast("string"))), " ")
    return a.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("text_length", "num_tokens", "unique_tokens")], common.alias("common"))


@query(
    MERGES_SQL
    + """, x AS (SELECT sum(length(text)) AS chars FROM documents), t AS (SELECT 'characters' AS tokenizer, sum(freq * length(word)) AS n FROM c UNION ALL SELECT 'pairs', sum(freq) FROM c JOIN tk USING (word))
SELECT tokenizer, round(chars / n, 6) AS compression_ratio, round(n / chars, 6) AS tokens_per_char, round(chars / n, 6) AS avg_token_length FROM t, x"""
)
def compression_by_tokenizer(spark, sf_dir):
    s = analyze.compression(docs(spark, sf_dir), {"characters": _chars(spark, sf_dir), "pairs": _few(spark, sf_dir)})
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(MERGES_SQL + "SELECT CAST(id AS INTEGER) AS id, token, CAST(sum(freq) AS BIGINT) AS n FROM c JOIN tk USING (word) GROUP BY ALL")
def token_usage(spark, sf_dir):
    m = _few(spark, sf_dir)
    return analyze.named(analyze.token_usage(docs(spark, sf_dir), m), m).select("id", "token", "n")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch_id FROM documents")
def document_batches(spark, sf_dir):
    return analyze.batches(docs(spark, sf_dir).select("doc_id"), 64).select("doc_id", "batch_id")


# -- conversations

_ROLE = "CASE WHEN lower(role) IN (" + ", ".join(f"'{r}'" for r in conversation.ROLES) + ") THEN '<|' || lower(role) || '|>' ELSE '<|user|>' END"


@query(f"SELECT conv_id, string_agg({_ROLE} || coalesce(text, ''), '<|turn|>' ORDER BY turn, {_ROLE}, coalesce(text, '')) AS laid_out, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def conversation_layout(spark, sf_dir):
    laid = conversation.layout(docs(spark, sf_dir, "conversations"))
    return laid.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role_token"], m["content"])), "<|turn|>").alias("laid_out"), F.size("messages").cast("long").alias("n_turns"))


CHATS = chat_config(0).with_(regex_pattern=CODE_PATTERN, min_frequency=1)
_SPECIALS = list(CHATS.special_tokens)


@query(
    f"""WITH t AS (SELECT conv_id, turn, {_ROLE} AS token, row_number() OVER () AS r, regexp_extract_all(array_to_string(regexp_extract_all(nfc_normalize(coalesce(text, '')), '{CODE_RE2}'), ''), '(?s).') AS cs FROM conversations),
v AS (SELECT ch, {len(_SPECIALS) - 1} + row_number() OVER (ORDER BY encode(ch)) AS id FROM (SELECT DISTINCT unnest(cs) AS ch FROM t)),
sp AS (SELECT unnest({_SPECIALS}) AS token, unnest(range({len(_SPECIALS)})) AS id),
m AS (SELECT r, string_agg(CAST(v.id AS VARCHAR), ' ' ORDER BY i) AS ids FROM (SELECT r, unnest(cs) AS ch, generate_subscripts(cs, 1) AS i FROM t) u JOIN v USING (ch) GROUP BY r)
SELECT conv_id, '{_SPECIALS.index("<|startoftext|>")} ' || string_agg(concat_ws(' ', sp.id, m.ids, {_SPECIALS.index("<|turn|>")}), ' ' ORDER BY turn, t.token) AS ids
FROM t JOIN sp ON t.token = sp.token LEFT JOIN m ON t.r = m.r GROUP BY conv_id"""
)
def encode_conversations(spark, sf_dir):
    turns = docs(spark, sf_dir, "conversations")
    numbered = turns.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("doc_id"), "text")
    coded = conversation.encode_conversations(turns, train(numbered, CHATS))
    return coded.select("conv_id", writers.as_ids(F.col("ids")).alias("ids"))


# -- the catalog

_ENTRIES = "(VALUES " + ", ".join(f"({k}, '{e.name}', '{e.description}', '{e.domain}', '{e.language}', [{', '.join(repr(t) for t in e.tags)}])" for k, e in enumerate(built_in())) + ") t(ord, name, description, domain, language, tags)"


@query(f"SELECT name FROM {_ENTRIES} WHERE domain = 'general' AND list_contains(tags, 'english')")
def catalog_list(spark, sf_dir):
    return listed(Catalog().table(spark), domain="general", tags=["english"])


@query(
    f"SELECT * FROM (SELECT name, CASE WHEN lower(name) = 'code' THEN 1.0::DOUBLE WHEN contains(lower(name), 'code') THEN 0.8::DOUBLE WHEN contains(lower(description), 'code') THEN 0.6::DOUBLE "
    f"WHEN len(list_filter(tags, lambda t: contains(lower(t), 'code'))) > 0 THEN 0.4::DOUBLE WHEN contains(lower(domain), 'code') OR contains(lower(language), 'code') THEN 0.3::DOUBLE END AS relevance FROM {_ENTRIES}) WHERE relevance IS NOT NULL"
)
def catalog_search(spark, sf_dir):
    return searched(Catalog().table(spark), "code")
