"""Language identification by compression.

For each labelled language a zstandard dictionary of raw content is made of sample texts. A text is cut into blocks, each
block is compressed with every language's dictionary, and the language with the smallest total wins. It is rejected when
the runner-up is hardly larger. Blocks keep the dictionary in play however long the text is, and all of the text counts.
Texts fall into two folds by their hash, each with its own dictionaries, and each is judged by those of the other.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, col, fresh, join_small, whole_id
from .kernels import release

#: The bounds of the training sample, parameters of every function here: texts of each language and fold (in the mean), bytes of each
#: dictionary. A text gives it a PIECES-th part of a dictionary at most.
SAMPLE_DOCS, DICT_BYTES, PIECES = 400, 128 << 10, 32
#: More labels than this are taken for a mistake in the column.
MAX_LANGUAGES = 1000
BLOCK_BYTES, LEVEL = 8192, 6
#: A text is rejected if the second smallest size exceeds the smallest by less than this share of it.
MIN_MARGIN = 0.01
RESULT = "lang string, size long, runner_up string, runner_up_size long, margin double, accepted boolean"
Dictionaries = dict[str, bytes]

# Letters stay, in lower case; all other ASCII is white space, so that shouting and symbols don't hide a language.
FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def fold(text: bytes) -> bytes:
    """Lower-case words, each with a space on both sides, as in the dictionaries; nothing if there are none."""
    words = text.translate(FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b""


def piece(words: bytes, limit: int) -> bytes:
    """All of a folded text, or four blocks from all over it of that many bytes together; not cut within words."""
    if len(words) <= limit:
        return words
    size, out = limit // 4, b""
    for k in range(4):
        begin = words.index(b" ", k * (len(words) - size) // 3) if k else 0
        end = words.rfind(b" ", begin, begin + size)
        out += words[begin : end if end > begin else begin + size]
    return out + b" "


def fold_of(text: Column) -> Column:
    """0 or 1 by the text, so that copies are of one fold."""
    return F.pmod(F.xxhash64(F.lower(text)), F.lit(2)).cast("int")


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES, max_languages: int = MAX_LANGUAGES,
) -> tuple[Dictionaries, Dictionaries]:
    """Raw-content dictionaries of the two folds, for each language in lang_col.

    Of each language 2 * sample_docs documents are taken in the order of a hash of doc_id; they go to the dictionary of their fold until
    that has dict_bytes, long ones by blocks from all over the text. A language with no text in one fold has the other's there. One whose sampled
    texts have no letters can't be learned, which is warned of. More than max_languages labels raise ValueError.
    """
    rank, order = fresh(docs, "rank", "order")
    labelled = docs.where(col(lang_col).isNotNull() & col(text_col).isNotNull() & col(id_col).isNotNull())
    ids = labelled.select(col(lang_col).alias("l"), whole_id(docs, id_col).alias("i"), F.xxhash64(col(id_col)).alias(order)).distinct()
    ids = ids.withColumn(rank, F.row_number().over(Window.partitionBy("l").orderBy(order, "i"))).where(F.col(rank) <= 2 * sample_docs)
    ids = checkpoint(ids.select("l", "i", order))
    if (n := ids.select("l").distinct().count()) > max_languages:
        raise ValueError(f"{lang_col} has {n} values, more than {max_languages}")
    limit = max(dict_bytes // PIECES, 64)

    def pieces(texts: pa.Array) -> pa.Array:
        return pa.array([piece(fold(t.encode()), limit) for t in texts.to_pylist()], pa.binary())

    texts = labelled.select(col(lang_col).alias("l"), whole_id(docs, id_col).alias("i"), col(text_col).alias("t"))
    # ids has 2 * sample_docs rows for each language, and the pieces are of a bounded size.
    picked = join_small(texts, ids, ["l", "i"], "inner").select("l", order, "i", fold_of(F.col("t")).alias("f"), F.arrow_udf(pieces, "binary")(F.lower("t")).alias("p"))
    dicts: tuple[Dictionaries, Dictionaries] = ({}, {})
    languages = set()
    for lang, _, _, f, part in sorted(map(tuple, picked.collect())):
        languages.add(lang)
        have = dicts[f].get(lang, b"")
        if part and len(have) + len(part) <= dict_bytes:
            dicts[f][lang] = bytes(part) + have
    for own, other in (dicts, dicts[::-1]):
        for lang, words in other.items():
            own.setdefault(lang, words)
    if lost := sorted(languages - dicts[0].keys()):
        warnings.warn(f"no letters to learn from: {', '.join(lost)}", stacklevel=2)
    # zstandard takes no less than eight bytes.
    return tuple({lang: words.rjust(8) for lang, words in d.items()} for d in dicts)


def classifier(dicts: tuple[Dictionaries, Dictionaries], min_margin: float = MIN_MARGIN):
    """A function from texts and their folds to a struct array (RESULT): a text is judged by the dictionaries of the other fold."""
    langs = sorted(dicts[0])
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.bool_()]

    coders: list[list] = []  # made once by each task

    def classify(texts: pa.Array, folds: pa.Array) -> pa.Array:
        for f in range(2 * (not coders)):
            coders.append([])
            for lang in langs:
                d = zstandard.ZstdCompressionDict(dicts[1 - f][lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                coders[f].append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        n = len(texts)
        sizes, known = np.zeros((n, max(len(langs), 1)), np.int64), np.zeros(n, bool)
        for r, (raw, f) in enumerate(zip(texts.to_pylist(), folds.to_pylist())):
            folded = fold(raw.encode()) if raw and langs else b""
            known[r] = bool(folded)
            for a in range(0, len(folded), BLOCK_BYTES):
                block = folded[a : a + BLOCK_BYTES]
                sizes[r] += [len(c.compress(block)) for c in coders[f]]
        order = np.argsort(sizes, axis=1, kind="stable")
        rows = np.arange(n)
        best = sizes[rows, order[:, 0]]
        name = lambda k, ok: pa.array([langs[i] if o else None for i, o in zip(order[:, k], ok)], pa.string())
        if len(langs) > 1:
            second = sizes[rows, order[:, 1]]
            margin = (second - best) / np.maximum(best, 1)
            fine = known & (second > best) & (margin >= min_margin)
            columns = [name(0, known), pa.array(best, mask=~known), name(1, known), pa.array(second, mask=~known), pa.array(margin, mask=~known), pa.array(fine)]
        else:
            columns = [name(0, known), pa.array(best, mask=~known), pa.nulls(n, kinds[2]), pa.nulls(n, kinds[3]), pa.nulls(n, kinds[4]), pa.array(known)]
        release()
        return pa.StructArray.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], [x.split()[0] for x in RESULT.split(", ")])

    return classify


def with_language(docs: DataFrame, out: str, dicts: tuple[Dictionaries, Dictionaries], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with a struct column ``out`` of RESULT. Only the text and its fold cross to Python."""
    classify = classifier(dicts, min_margin)

    def call(texts: pa.Array, folds: pa.Array) -> pa.Array:
        return classify(texts, folds)

    return docs.withColumn(out, F.arrow_udf(call, RESULT)(F.lower(col(text_col)), F.coalesce(fold_of(col(text_col)), F.lit(0))))


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", min_margin: float = MIN_MARGIN, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> DataFrame:
    """(doc_id, lang, size, runner_up, runner_up_size, margin, accepted) for every row, having trained on its own labelled rows.

    A text is judged by dictionaries that hold texts of the other fold only, so that a wrong label can't vouch for itself. Sizes are
    compressed bytes. Null and empty texts, and those without letters, are rejected with no language. A tie, or
    a margin below min_margin, is rejected, with the first of the tied languages by name. If one language is labelled
    it is everyone's, without margin; if none is, all are rejected. Rows without doc_id are classified but not learned from;
    repeated rows are classified each time. Ids are whole numbers. Other columns are ignored; an empty table gives an empty result.
    """
    dicts = train(docs, text_col, lang_col, id_col, sample_docs, dict_bytes)
    narrow = docs.select(whole_id(docs, id_col).alias("doc_id"), col(text_col).alias("text"))
    return with_language(narrow, "r", dicts, "text", min_margin).select("doc_id", "r.*")


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", min_margin: float = MIN_MARGIN, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> DataFrame:
    """docs, all columns, without the rows that :func:`identify` rejects: ties, narrow margins, null and empty texts, texts without letters.

    A null language is filled in; a given one stays. Repeated rows stay or go alike. An empty table stays empty.
    """
    (found,) = fresh(docs, "found")
    dicts = train(docs, text_col, lang_col, id_col, sample_docs, dict_bytes)
    out = with_language(docs, found, dicts, text_col, min_margin).where(F.col(found)["accepted"])
    return out.withColumn(lang_col, F.coalesce(col(lang_col), F.col(found)["lang"])).drop(found)
