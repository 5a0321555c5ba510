"""Deduplication: exact, by normalised text, and by exact Jaccard similarity of word shingles in document order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..runtime import checkpoint, col, fresh, join_small

SHINGLE_WORDS = 5


def first_of_each(df: DataFrame, key: Column, order_col: str, costly: bool = False) -> DataFrame:
    """One row of df for each value of ``key``: the first by order_col, rows without one being last.

    Of rows alike in that, the one whose columns hash least stays, any one if they are equal throughout. Rows whose key occurs once are
    kept where they lie: only keys are shuffled, combined before it, and the rows that share one. Rows are read three times; a costly
    key is computed in the first and written with them.
    """
    k, n, best = fresh(df, "key", "rows", "best")
    keyed = df.withColumn(k, key)
    if costly:
        keyed = checkpoint(keyed)
    several = checkpoint(keyed.groupBy(k).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).select(k))
    single = join_small(keyed, several, k, "left_anti", 128).drop(k)
    order = F.struct(col(order_col).isNull(), col(order_col), F.xxhash64(*[col(c) for c in df.columns]))
    # Fields go by number: a column's name may have dots.
    whole = F.struct(*[col(c).alias(f"f{i}") for i, c in enumerate(df.columns)])
    firsts = join_small(keyed, several, k, "left_semi", 128).groupBy(k).agg(F.min_by(whole, order).alias(best))
    return single.unionByName(firsts.select(*[F.col(best)[f"f{i}"].alias(c) for i, c in enumerate(df.columns)]))


def deduplicate(df: DataFrame, text_col: str = "text", order_col: str = "doc_id") -> DataFrame:
    """One row of each distinct text, the first by order_col; see :func:`first_of_each` for ties and nulls. Null is a text like others."""
    return first_of_each(df, F.coalesce(F.sha2(col(text_col).cast("binary"), 256), F.lit("")), order_col)


def normal_form(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return T.collapse(F.lower(text))


def text_hash(text: Column) -> Column:
    """MD5 of the normal form."""
    return F.md5(normal_form(text).cast("binary"))


def shingles(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """The distinct runs of k words of the normal form; the whole form if it has fewer words."""
    def runs(w: Column) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(joined))

    # A normal form is its words between blanks.
    return T.bound(T.words(F.lower(text)), runs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def first_by_hash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of the first document of each normal form, of which null is one."""
    narrow = df.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return first_of_each(narrow, F.coalesce(text_hash(F.col("text")), F.lit("")), "doc_id", costly=True)


def shingle_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, s, n): each document's distinct shingles as 64-bit hashes, and how many there are."""
    hashed = F.transform(shingles(col(text_col), k), lambda s: F.xxhash64(s))
    return df.select(col(id_col).alias("doc_id"), F.array_distinct(hashed).alias("s")).withColumn("n", F.size("s"))


def prefix_length(n: Column, threshold: float) -> Column:
    """Of n shingles in any one order for all documents, how many must be looked at: a set as similar as that shares one of those."""
    return n - F.ceil(threshold * n - 1e-9) + 1


def similar_pairs(df: DataFrame, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """(i, j, similarity) of the pairs i < j whose shingle sets have at least that Jaccard similarity; exact, for threshold > 0.

    Shingles are 64-bit hashes. A set as similar as that to another shares one of its |S| - ceil(t |S|) + 1 rarest shingles with
    it, so only those are joined, and only sets of sizes in proportion; the survivors' whole sets are then compared.
    """
    if threshold <= 0:
        raise ValueError("every pair is that similar")
    sets = checkpoint(shingle_sets(df, id_col, text_col, k))
    posts = sets.select("doc_id", "n", F.explode("s").alias("x"))
    often = posts.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    # A shingle that only one document has can't be shared, but it does count among the rarest.
    ranked = posts.join(often, "x").withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "x")))
    prefix = ranked.where((F.col("r") <= prefix_length(F.col("n"), threshold)) & (F.col("df") > 1)).select("doc_id", "n", "x")
    a = prefix.select(F.col("doc_id").alias("i"), F.col("n").alias("ni"), "x")
    b = prefix.select(F.col("doc_id").alias("j"), F.col("n").alias("nj"), "x")
    pairs = a.join(b, "x").where((F.col("i") < F.col("j")) & (F.least("ni", "nj") >= (threshold - 1e-9) * F.greatest("ni", "nj"))).select("i", "j").distinct()
    left = sets.select(F.col("doc_id").alias("i"), F.col("s").alias("si"))
    right = sets.select(F.col("doc_id").alias("j"), F.col("s").alias("sj"))
    found = pairs.join(left, "i").join(right, "j").select("i", "j", jaccard(F.col("si"), F.col("sj")).alias("similarity"))
    return found.where(F.col("similarity") >= threshold)


def greedy_dropped(pairs: DataFrame) -> DataFrame | None:
    """(doc_id) of what is dropped, None if nothing, when documents come in order and one similar to an earlier kept one is dropped.

    Not one of each connected group: if a ~ b ~ c and not a ~ c, a and c stay. In each round an undecided document without
    earlier undecided or kept neighbours is kept, and one with an earlier kept neighbour is dropped. The rounds work on
    the documents that have neighbours only.
    """
    open_pairs = checkpoint(pairs.select("i", "j"))
    kept = checkpoint(open_pairs.select(F.col("i").alias("doc_id")).distinct().join(open_pairs.select(F.col("j").alias("doc_id")), "doc_id", "left_anti"))
    dropped = None
    while True:
        now = checkpoint(open_pairs.join(kept.withColumnRenamed("doc_id", "i"), "i", "left_semi").select(F.col("j").alias("doc_id")).distinct())
        if now.isEmpty():
            break
        dropped = now if dropped is None else dropped.union(now)
        # Pairs of dropped documents no longer matter; those left are between undecided ones.
        open_pairs = open_pairs.join(now.withColumnRenamed("doc_id", "i"), "i", "left_anti").join(now.withColumnRenamed("doc_id", "j"), "j", "left_anti")
        open_pairs = checkpoint(open_pairs.join(kept.withColumnRenamed("doc_id", "i"), "i", "left_anti"))
        freed = open_pairs.select(F.col("i").alias("doc_id")).distinct().join(open_pairs.select(F.col("j").alias("doc_id")), "doc_id", "left_anti")
        kept = checkpoint(freed)
    return dropped


def greedy_survivors(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id) of those of ids that :func:`greedy_dropped` leaves."""
    dropped = greedy_dropped(pairs)
    return ids if dropped is None else ids.join(dropped, "doc_id", "left_anti")


def near_deduplicate(df: DataFrame, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of df that an order-dependent detector keeps: not the normal form of an earlier document, nor similar to an earlier kept one.

    A threshold of 0 or less keeps the first document only; one above 1 leaves exact deduplication of normal forms. Null texts are
    dropped. Rows without id come after all others and are compared by normal form only. Of rows with one id and different normal
    forms, a similarity of one is a similarity of all.
    """
    rows = df.where(col(text_col).isNotNull())
    if threshold <= 0:
        return first_of_each(rows, F.lit(0), id_col)
    firsts = first_of_each(rows, text_hash(col(text_col)), id_col, costly=True)
    if threshold > 1:
        return firsts
    named = firsts.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).where("doc_id is not null")
    dropped = greedy_dropped(similar_pairs(named, threshold))
    if dropped is None:
        return firsts
    (gone,) = fresh(firsts, "gone")
    return firsts.join(dropped.select(F.col("doc_id").alias(gone)), col(id_col) == F.col(gone), "left_anti")
