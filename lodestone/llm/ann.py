"""Nearest neighbours by inner product, with score-aware quantisation.

Vectors fall into cells of a two-level k-means. What remains of a vector after its cell's centre is quantised in SUB-dimensional pieces
of 16 codewords each. Codewords are trained and chosen to minimise the anisotropic loss: the part of the residual error
that is parallel to the vector, which is what changes large inner products, weighs ``eta`` times the rest. A scan sums, for
each code, entries of the query's four-bit tables (two at a time, as a byte). The best RERANK of a cell are scored exactly, and
then every vector whose rough score plus |q| times its own quantisation error reaches the k-th of those: in the cells that a query
visits, none is left out but by that bound.

A query visits the cells whose centres score best, as many as it takes: CALIBRATE queries are scored against all vectors, and the
number of cells is the least that holds the wanted share of their true neighbours. So recall is measured on the very data, by one linear
scan. Every vector is indexed. A cell beyond group_rows is cut by a hash of the id, and the queries of a cell beyond
query_rows likewise, so that a hot cell is the work of many tasks.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, col, join_small, whole_id
from .kernels import mix64

#: The least training sample; queries that calibrate the search, and the share of their neighbours that it has to find.
TRAIN_ROWS, CALIBRATE, RECALL = 20_000, 256, 0.95
K, RERANK, SUB, THRESHOLD, GROUP_ROWS, QUERY_ROWS, QUERY_BLOCK, PAIRS = 10, 128, 2, 0.2, 8192, 65_536, 256, 1 << 16
RESULT = "q long, x long, score double"


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = x[np.random.Generator(np.random.PCG64(7)).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def training_size(n: int, least: int = TRAIN_ROWS) -> tuple[int, int]:
    """Vectors to train on and cells, for n vectors: as many cells as the root of n, and eight vectors of the sample for each."""
    cells = round(math.sqrt(n))
    sample = min(n, max(least, 8 * cells))
    return sample, max(1, min(cells, sample // 8))


class Cells:
    """Centres in two levels: about the root of ``cells`` at the top, and under each its share of them."""

    def __init__(self, x: np.ndarray, cells: int):
        self.top = kmeans(x, max(1, round(math.sqrt(cells))))
        own = nearest(x, self.top)
        under = []
        for c in range(len(self.top)):
            mine = x[own == c]
            under.append(kmeans(mine, max(1, min(len(mine), round(cells * len(mine) / len(x))))) if len(mine) else self.top[c : c + 1])
        self.first = np.cumsum([0, *map(len, under)])
        self.centres = np.concatenate(under)

    def of(self, x: np.ndarray) -> np.ndarray:
        out, own = np.zeros(len(x), np.int64), nearest(x, self.top)
        for c in np.unique(own):
            at = np.flatnonzero(own == c)
            out[at] = self.first[c] + nearest(x[at], self.centres[self.first[c] : self.first[c + 1]])
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(x[a : a + 4096] @ centres.T - half).argmax(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _pieces(x: np.ndarray) -> np.ndarray:
    pad = -x.shape[1] % (2 * SUB)
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SUB)


def eta(dims: int, threshold: float = THRESHOLD) -> float:
    """How much more the parallel part of the error weighs, for a threshold on the cosine."""
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


def encode(rest: np.ndarray, x: np.ndarray, book: np.ndarray, weight: float, sweeps: int = 3) -> np.ndarray:
    """Codes (n, pieces) of the residuals ``rest`` of vectors x: coordinate descent on the anisotropic loss."""
    codes = np.zeros((len(x), book.shape[0]), np.uint8)
    for a in range(0, len(x), 4096):
        t, v = _pieces(rest[a : a + 4096]), _pieces(x[a : a + 4096])
        scale = (weight - 1) / np.maximum((v * v).sum((1, 2)), 1e-12)
        far = ((t[:, :, None, :] - book[None]) ** 2).sum(3)
        along = ((t[:, :, None, :] - book[None]) * v[:, :, None, :]).sum(3)
        own = far.argmin(2)
        rows, now = np.arange(len(t)), np.take_along_axis(along, own[:, :, None], 2)[:, :, 0]
        total = now.sum(1)
        for _ in range(sweeps):
            for m in range(book.shape[0]):
                others = total - now[:, m]
                own[:, m] = (far[:, m] + scale[:, None] * (others[:, None] + along[:, m]) ** 2).argmin(1)
                now[:, m] = along[rows, m, own[:, m]]
                total = others + now[:, m]
        codes[a : a + 4096] = own
    return codes


def train_book(rest: np.ndarray, x: np.ndarray, weight: float, rounds: int = 8) -> np.ndarray:
    """Codebooks (pieces, 16, SUB), each codeword the minimiser of the anisotropic loss of what it stands for."""
    t, v = _pieces(rest), _pieces(x)
    book = np.stack([np.resize(kmeans(t[:, m], min(16, len(t))), (16, SUB)) for m in range(t.shape[1])])
    scale = (weight - 1) / np.maximum((v * v).sum((1, 2)), 1e-12)
    for _ in range(rounds):
        codes = encode(rest, x, book, weight).astype(np.int64)
        error = t - book[np.arange(t.shape[1])[None, :], codes]
        along = (error * v).sum(2)
        total = along.sum(1)
        for m in range(t.shape[1]):
            others = total - along[:, m]
            aim = t[:, m] + (scale * (others + (t[:, m] * v[:, m]).sum(1)))[:, None] * v[:, m]
            outer = np.eye(SUB)[None] + scale[:, None, None] * v[:, m, :, None] * v[:, m, None, :]
            left, right, n = np.zeros((16, SUB, SUB)), np.zeros((16, SUB)), np.bincount(codes[:, m], minlength=16)
            np.add.at(left, codes[:, m], outer)
            np.add.at(right, codes[:, m], aim)
            used = n > 0
            book[m, used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            along[:, m] = ((t[:, m] - book[m, codes[:, m]]) * v[:, m]).sum(1)
            total = others + along[:, m]
    return book


def scan(q: np.ndarray, joined: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries, codes) with the residuals, from four-bit tables joined in pairs.

    ``joined`` has a row for each pair of tables: 16 times one code plus the other.
    """
    tables = np.einsum("qms,mcs->qmc", _pieces(q), book).astype(np.float32)
    pairs = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(q), -1, 256)
    out = np.take(pairs[:, 0], joined[0], axis=1)
    for m in range(1, len(joined)):
        out += np.take(pairs[:, m], joined[m], axis=1)
    return out


def missing(x: np.ndarray, cell: np.ndarray, centres: np.ndarray, codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each vector, what times |q| bounds the difference of its rough score and <q, x>: the norm of its quantisation error, and rounding."""
    coded = book[np.arange(book.shape[0])[None, :], codes]
    error = _pieces(x - centres[cell]) - coded
    norm = lambda a: np.sqrt((a * a).sum(tuple(range(1, a.ndim))))
    return norm(error) + (book.shape[0] + 8) * 2.0**-23 * (norm(coded) + norm(centres[cell]) + norm(x))


def pair_scores(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The inner product of each pair of rows, the same whatever pairs it is with, so that copies tie."""
    out = np.empty(len(row))
    for a in range(0, len(row), PAIRS):
        out[a : a + PAIRS] = np.einsum("pd,pd->p", q[row[a : a + PAIRS]], x[col[a : a + PAIRS]])
    return out


def best_of(q: np.ndarray, q_id: np.ndarray, bar: np.ndarray, rough: np.ndarray, miss: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int):
    """Each query's k best by exact score, not itself and not under its bar: (query row, id, score). Where rough is -inf is left out.

    The RERANK roughly best give each query its k-th score so far; all whose rough score plus its bound reaches that are
    scored. ``miss`` is that of :func:`missing`.
    """
    length = np.sqrt((q * q).sum(1))
    usable = ~np.isneginf(rough) & (x_id != q_id[:, None])
    top = np.argpartition(-rough, RERANK - 1, axis=1)[:, :RERANK] if len(x) > RERANK else np.broadcast_to(np.arange(len(x)), rough.shape)
    first = np.where(np.take_along_axis(usable, top, 1), np.einsum("qd,qrd->qr", q, x[top]), -np.inf)
    floor = np.maximum(bar, np.partition(first, -k, axis=1)[:, -k]) if first.shape[1] >= k else bar
    may = usable & ~(rough + length[:, None] * miss < floor[:, None])
    columns = np.flatnonzero(may.any(0))
    # Products by matrix differ in their last digits from those by pair: they only say which pairs needn't be scored.
    exact = np.where(may[:, columns], q @ x[columns].T, -np.inf)
    if len(columns) > k:
        floor = np.maximum(floor, np.partition(exact, -k, axis=1)[:, -k])
    slack = 1e-12 * length * np.sqrt((x * x).sum(1).max(initial=0))
    row, c = np.nonzero((exact > -np.inf) & (exact >= (floor - slack)[:, None]))
    at = columns[c]
    score = pair_scores(q, x, row, at)
    order = np.lexsort((x_id[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    good = (place < k) & (score >= bar[row])
    return row[good], x_id[at[good]], score[good]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def cleaned(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the usable rows, one for each id. Only vectors of ids that repeat are shuffled."""
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))
    rows = vectors.select(whole_id(vectors, id_col).alias("id"), col(vector_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", bad))
    twice = checkpoint(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    return join_small(rows, twice, "id", "left_anti").unionByName(join_small(rows, twice, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))


def _exact(q: np.ndarray, q_id: np.ndarray, k: int):
    """The k best of a task's vectors for each of some queries: (q, x, cell, score)."""

    def exact(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(q)
        for batch in batches:
            x, ids, cell = _matrix(batch.column(1)), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            scores = np.where(q_id[:, None] == ids[None, :], -np.inf, q @ x.T)
            for r in range(len(q)):
                at = np.argpartition(-scores[r], k)[:k] if len(ids) > k else np.arange(len(ids))
                at = at[scores[r, at] > -np.inf]
                i, c, v = (np.concatenate(z) for z in zip(best[r], (ids[at], cell[at], scores[r, at])))
                top = np.lexsort((i, -v))[:k]
                best[r] = (i[top], c[top], v[top])
        sizes = [len(b[0]) for b in best]
        i, c, v = (np.concatenate(z) for z in zip(*best))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_id, sizes)), pa.array(i), pa.array(c), pa.array(v)], names=["q", "x", "cell", "score"])

    return exact


def cells_to_visit(q: np.ndarray, q_id: np.ndarray, truth, centres: np.ndarray, size: np.ndarray, recall: float) -> int:
    """The least number of best cells that hold that share of the neighbours in ``truth`` (q, cell)."""
    place = {int(i): r for r, i in enumerate(q_id)}
    order = np.argsort(-np.where(size > 0, q @ centres.T, -np.inf), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    ranks = np.sort([rank[place[i], c] for i, c in truth])
    return int(ranks[max(0, math.ceil(recall * len(ranks)) - 1)]) + 1 if len(ranks) else 1


def neighbours(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
    recall: float = RECALL, train_rows: int = TRAIN_ROWS, group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(vec_id, rank, neighbour_id, score): for each row of ``queries`` (by default of vectors) its k largest inner products, best first.

    Scores are exact; that share ``recall`` of the true neighbours of calibrating queries is found (1.0 visits all cells that hold
    any). A query isn't its own neighbour: its id is left out. Of equal scores the lesser id comes first. Rows without id or
    vector, with a null or NaN or infinity in it, or of other than the usual length (the commonest among vectors, the least of
    those) are left out, the last with a warning that counts them. Repeated rows are one; of vectors under one id the least
    counts. A table of fewer than k + 1 vectors gives each all the others; an empty one gives an empty result. Ids are whole
    numbers. Other columns are ignored.

    train_rows is the least size of the sample that centres and codewords are fitted on; eight vectors for each of the sqrt(n)
    cells are taken if that is more.
    """
    rows = cleaned(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").collect()
    if not lengths:
        return rows.select(F.col("id").alias("vec_id"), F.lit(1).alias("rank"), F.col("id").alias("neighbour_id"), F.lit(0.0).alias("score")).where("false")
    dims, n = lengths[0]["d"], lengths[0]["n"]
    if len(lengths) > 1:
        warnings.warn(f"{sum(x['n'] for x in lengths[1:])} vectors of other lengths than {dims} are left out", stacklevel=2)
    rows = rows.where(F.size("v") == dims)
    sample_rows, cells = training_size(n, train_rows)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()
    learn, learn_id = _matrix(sample.column(1)), sample.column(0).to_numpy()
    weight = eta(dims)
    tree = Cells(learn, cells)
    centres, own = tree.centres, tree.of(learn)
    book = train_book(learn - centres[own], learn, weight)

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            cell = tree.of(x)
            codes = encode(x - centres[cell], x, book, weight)
            packed = codes[:, 0::2] * 16 + codes[:, 1::2]
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * packed.shape[1]).astype(np.int32)), pa.py_buffer(packed.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(missing(x, cell, centres, codes, book)), raw], names=["id", "v", "cell", "miss", "codes"])

    coded = checkpoint(rows.mapInArrow(assign, "id long, v array<double>, cell long, miss double, codes binary"))
    asked = coded.select("id", "v") if queries is None else cleaned(queries, id_col, vector_col).where(F.size("v") == dims)
    # Each of these has a row for each cell, about sqrt(n).
    size, wanted = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
    for c, m in coded.groupBy("cell").agg(F.count(F.lit(1))).collect():
        size[c] = m
    some = asked.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATE).toArrow()
    if not some.num_rows:
        return rows.select(F.col("id").alias("vec_id"), F.lit(1).alias("rank"), F.col("id").alias("neighbour_id"), F.lit(0.0).alias("score")).where("false")
    some_v, some_id = _matrix(some.column(1)), some.column(0).to_numpy()
    first = Window.partitionBy("q").orderBy(F.desc("score"), "x")
    truth = coded.select("id", "v", "cell").mapInArrow(_exact(some_v, some_id, k), "q long, x long, cell long, score double").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    visits = cells_to_visit(some_v, some_id, [(r["q"], r["cell"]) for r in truth.select("q", "cell").collect()], centres, size, recall)
    # Vectors of the sample give a query neighbours to begin with, and so a bar that those in the cells must reach.
    known, known_id = learn[:TRAIN_ROWS], learn_id[:TRAIN_ROWS]

    def of_known(q: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, place among the known, score) of each query's k best there."""
        scores = np.where(ids[:, None] == known_id[None, :], -np.inf, q @ known.T)
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k] if len(known) > k else np.broadcast_to(np.arange(len(known)), scores.shape)
        row, place = np.nonzero(np.take_along_axis(scores, top, 1) > -np.inf)
        return row, top[row, place], pair_scores(q, known, row, top[row, place])

    def begin(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                ids = batch.column(0).to_numpy()
                row, at, score = of_known(_matrix(batch.column(1)), ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(known_id[at]), pa.array(score)], names=["q", "x", "score"])

    def cells_of(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query row, cell) of the cells to visit: the best ``visits``, and more if those hold no k + 1 vectors."""
        order = np.argsort(-np.where(size > 0, q @ centres.T, -np.inf), axis=1, kind="stable")
        enough = np.maximum(visits, (np.cumsum(size[order], axis=1) < min(k + 1, n)).sum(1) + 1)
        use = (np.arange(order.shape[1])[None, :] < enough[:, None]) & (size[order] > 0)
        row, place = np.nonzero(use)
        return row, order[row, place]

    def count(batches):
        total = np.zeros(len(centres), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                total += np.bincount(cells_of(_matrix(batch.column(0).slice(a, 1024)))[1], minlength=len(centres))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["cell", "n"])

    for c, m in asked.select("v").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        wanted[c] = m
    # A cell's vectors are in parts, its queries in chunks; each part meets each chunk at a place.
    parts, chunks = -(-size // group_rows), -(-wanted // query_rows)
    at_place = np.cumsum(np.append(0, parts * chunks))

    def spread(cell: np.ndarray, mine: np.ndarray, stride: np.ndarray, copies: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place): a row's own part or chunk, with each of the other kind."""
        row = np.repeat(np.arange(len(cell)), copies)
        other = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
        return row, at_place[cell[row]] + (mine * stride)[row] + other * step[row]

    def share(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (mix64(ids.astype(np.uint64)) % np.maximum(n, 1).astype(np.uint64)).astype(np.int64)

    def emit(batch, row, place, kind, bar, miss, codes):
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [pa.array(place), pa.array(np.full(len(row), kind, np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.array(bar[row]), pa.array(miss[row]), codes.take(take)],
            names=["place", "kind", "id", "v", "bar", "miss", "codes"],
        )

    def lay(batches):
        for batch in batches:
            ids, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            row, place = spread(cell, share(ids, parts[cell]), chunks[cell], chunks[cell], np.ones(len(cell), np.int64))
            yield emit(batch, row, place, 0, np.zeros(len(ids)), batch.column(3).to_numpy(), batch.column(4))

    def send(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1))
                row, _, score = of_known(q, ids)
                bar = np.full(len(q), np.inf)
                np.minimum.at(bar, row, score)
                bar[np.bincount(row, minlength=len(q)) < k] = -np.inf
                row, cell = cells_of(q)
                part_of, place = spread(cell, share(ids[row], chunks[cell]), np.ones(len(cell), np.int64), parts[cell], chunks[cell])
                yield emit(batch, row[part_of], place, 1, bar, np.zeros(len(ids)), pa.nulls(len(ids), pa.binary()))

    fields = "place long, kind int, id long, v array<double>, bar double, miss double, codes binary"
    met = coded.mapInArrow(lay, fields).union(asked.mapInArrow(send, fields)).repartition("place").sortWithinPartitions("place", "kind")

    def search(batches):
        now, held, base = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])))
            for i, j in zip(edge, [*edge[1:], len(place)]):
                if place[i] != now:
                    now, held, base = place[i], [], None
                if kind[i] == 0:
                    held.append(batch.slice(i, j - i))
                    continue
                if not held:
                    continue  # its hash gave this part no vector
                if base is None:
                    table = pa.Table.from_batches(held)
                    packed = table.column(6).combine_chunks()
                    raw = np.frombuffer(packed.buffers()[2], np.uint8)[: len(packed) * -(-dims // (2 * SUB))] if packed.offset == 0 else np.frombuffer(b"".join(packed.to_pylist()), np.uint8)
                    base = _matrix(table.column(3)), table.column(2).to_numpy(), table.column(5).to_numpy(), np.ascontiguousarray(raw.reshape(len(packed), -1).T).astype(np.intp)
                x, x_id, miss, codes = base
                centre = centres[np.searchsorted(at_place, now, "right") - 1]
                for a in range(i, j, QUERY_BLOCK):
                    some = batch.slice(a, min(QUERY_BLOCK, j - a))
                    q, q_id, bar = _matrix(some.column(3)), some.column(2).to_numpy(), some.column(4).to_numpy()
                    rough = scan(q, codes, book) + (q @ centre).astype(np.float32)[:, None]
                    row, found, score = best_of(q, q_id, bar, rough, miss, x, x_id, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_id[row]), pa.array(found), pa.array(score)], names=["q", "x", "score"])

    every = met.mapInArrow(search, RESULT).union(asked.mapInArrow(begin, RESULT)).distinct()
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "x"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("vec_id"), "rank", F.col("x").alias("neighbour_id"), "score")
