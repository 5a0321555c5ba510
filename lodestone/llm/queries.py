"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread
from . import ann, chat, exactdedup, langid, mixing, packing, ppm, sharding, simhash, tokencount
from .common import checkpoint, run_path


#: So small that the tables given here split: 64 MB is the default.
SHARD_BYTES = 128 << 10
#: Target weights of the mix, for want of an owner of these tables who would give some.
WEIGHTS = {"src0": 2.0}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 100 against all."""
    table = _table(spark, sf_dir, "embeddings")
    return ann.neighbours(table, table.where("vec_id % 100 = 0"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, then a second look at them in which those of one half are revised and the others deleted and brought back."""
    store = tokencount.Rollups(spark, run_path(spark, "tokens"))
    store.commit("documents", tokencount.inserts(tokencount.count_tokens(_table(spark, sf_dir, "documents"))))
    known = checkpoint(store.current())
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    store.commit("again", tokencount.inserts(known.where(half), "revise").unionByName(tokencount.inserts(known.where(~half), "delete")))
    back = tokencount.inserts(known.where(~half))
    store.commit("back", back)
    store.commit("back", back)  # nothing: it counts already
    totals = checkpoint(store.totals())
    store.delete()
    return totals


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even ids, then all of them, then all again, into one index: what each batch adds."""
    documents, index = _table(spark, sf_dir, "documents"), exactdedup.fresh_index(spark)
    batches = [documents.where("doc_id % 2 = 0"), documents, documents]
    added = [exactdedup.ingest(b, index).withColumn("batch", F.lit(k)) for k, b in enumerate(batches)]
    index.delete()
    return added[0].union(added[1]).union(added[2])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), WEIGHTS).drop("place")


QUERIES = {f.__name__: f for f in (op1_packing, op2_sharding, op3_near_dedup, op4_nearest_neighbours, op5_language_id, op6_lm_scoring, op7_chat_formatting, op8_token_counts, op9_exact_dedup, op10_mixing)}

_MD5_60 = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"

_SHARDING = f"""
WITH docs AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         {_MD5_60.format("coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS h FROM documents),
levels AS (
  SELECT docs.*, CAST(d AS INTEGER) AS depth, h >> CAST(60 - d AS INTEGER) AS prefix,
         CAST(sum(n_bytes) OVER (PARTITION BY d, h >> CAST(60 - d AS INTEGER)) AS BIGINT) AS shard_bytes
  FROM docs CROSS JOIN range(0, 61) r(d)),
fits AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM levels
  WHERE shard_bytes <= {SHARD_BYTES} OR depth = 60)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth) END AS shard, depth, shard_bytes
FROM fits WHERE k = 1
"""

_CHAT = """
SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS text,
       CAST(count(*) AS BIGINT) AS n_turns
FROM (SELECT conv_id, turn, replace(coalesce(text, ''), '<|im_', '<|_im_') AS text,
             CASE WHEN lower(trim(role)) IN ('system', 'user', 'assistant', 'tool') THEN lower(trim(role)) ELSE 'user' END AS role
      FROM conversations)
GROUP BY conv_id
"""

_EXACT = """
WITH first AS (SELECT min(doc_id) AS doc_id, text, CAST(count(*) AS BIGINT) AS n_copies FROM documents WHERE doc_id % 2 = 0 GROUP BY text),
every AS (SELECT min(doc_id) AS doc_id, text, CAST(count(*) AS BIGINT) AS n_copies FROM documents GROUP BY text),
added AS (SELECT *, 0 AS batch FROM first UNION ALL
  SELECT *, 1 AS batch FROM every e WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.text IS NOT DISTINCT FROM e.text))
SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE sha256(text) END AS digest, n_copies, batch FROM added
"""


def mix_sql(documents: str) -> str:
    """The mix of a relation with the columns of documents, as SQL."""
    weight = " ".join(f"WHEN source = '{s}' THEN {float(w)!r}::DOUBLE" for s, w in WEIGHTS.items())
    return f"""
WITH counted AS (
  SELECT source, doc_id, {_MD5_60.format("'mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS place,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) AS n FROM {documents}),
narrow AS (SELECT source, place, doc_id, CAST(sum(n) AS BIGINT) AS n_tokens FROM counted GROUP BY ALL),
queued AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY place) AS BIGINT) AS own FROM narrow),
timed AS (SELECT *, CAST(own AS DOUBLE) / CASE {weight} ELSE 1.0::DOUBLE END AS finish FROM queued),
mixed AS (SELECT *, CAST(sum(n_tokens) OVER (ORDER BY finish, source NULLS FIRST, place) AS BIGINT) AS mixed_tokens FROM timed)
SELECT doc_id, source, n_tokens, finish, mixed_tokens FROM mixed
WHERE mixed_tokens <= (SELECT floor(CAST(sum(n_tokens) AS DOUBLE) * {mixing.BUDGET_FRACTION}::DOUBLE) FROM narrow)
"""


ORACLE_SQL = {"op2_sharding": _SHARDING, "op7_chat_formatting": _CHAT, "op9_exact_dedup": _EXACT, "op10_mixing": mix_sql("documents")}
