"""What the operators of this subpackage share: the shared folder, prefix sums in a total order, size-checked joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..runtime import checkpoint, col, fresh, join_small, run_path, shared_dir

__all__ = ["checkpoint", "col", "fresh", "join_small", "ordered_sums", "run_path", "shared_dir", "whole_id"]


def whole_id(df: DataFrame, name: str) -> Column:
    """The column of ids as a long. Any other type than a whole number's raises TypeError: a cast would make nulls of ids."""
    kind = dict(df.dtypes)[name]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"ids in {name} are {kind}: whole numbers are needed; number the rows or hash the ids to 64 bits")
    return col(name).cast("long")


def _running(order: int, value: int, group: bool):
    """Adds the running sum of a column, and the task's number, to the rows of a task that are sorted by their first ``order`` columns.

    Rows that tie share the sum that includes them all. With ``group``, sums begin anew with each value of the first column.
    """

    def changes(batch: pa.RecordBatch, columns: range) -> np.ndarray:
        out = np.zeros(batch.num_rows, bool)
        out[:1] = True
        for k in columns:
            now, before = batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)
            differ = pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(now.is_null(), before.is_null()))
            out[1:] |= differ.to_numpy(zero_copy_only=False)
        return out

    def run(batches):
        from pyspark import TaskContext

        part, total, last, held = TaskContext.get().partitionId(), 0, None, None

        def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal total, last
            n = batch.num_rows
            own = batch.column(value).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(own)
            if group:
                first = batch.column(0)[0]
                total = total if last is not None and last.equals(first) else 0
                begin = np.flatnonzero(changes(batch, range(1)))
                before = sums[begin] - own[begin]
                before[0] = -total
                sums = sums - np.repeat(before, np.diff(np.append(begin, n)))
                last = batch.column(0)[n - 1]
            else:
                sums = sums + total
            total = int(sums[-1])
            end = np.append(np.flatnonzero(changes(batch, range(order)))[1:], n) - 1
            sums = np.repeat(sums[end], np.diff(np.append(-1, end)))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(np.full(n, part, np.int32))], names=[*batch.schema.names, "sum", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            cut = int(np.flatnonzero(changes(batch, range(order)))[-1])  # what ties with the last row may go on
            if cut:
                yield summed(batch.slice(0, cut))
            held = batch.slice(cut)
        if held is not None:
            yield summed(held)

    return run


def ordered_sums(df: DataFrame, order: list[str], value: str, out: str, group: str | None = None) -> DataFrame:
    """Running sums of an integer column in a total order, over any number of partitions.

    df is range-partitioned by ``order`` and sorted once; the tasks that read it in order add up as they go, and each partition's total
    (one row for each partition and group) gives the sum before it. No task sees more than its own range, so
    a hot group is as parallel as any. Rows that tie in ``order`` share one sum, which includes them all; values are 0 or more.
    ``group``, if given, must be the first of ``order``. df should be narrow and already materialised: Spark samples it.
    """
    part, base, g2, p2 = fresh(df, "part", "base", "group2", "part2")
    columns = [*order, *[c for c in df.columns if c not in order]]
    ranged = df.select(*[col(c) for c in columns]).repartitionByRange(*[col(c) for c in order]).sortWithinPartitions(*[col(c) for c in order])
    schema = StructType([*ranged.schema, StructField(out, LongType()), StructField(part, IntegerType())])
    summed = checkpoint(ranged.mapInArrow(_running(len(order), columns.index(value), group is not None), schema))
    keys = [part] + ([group] if group else [])
    before = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(part)
    # A row for each partition and group in it: as groups are ranges too, no more than there are of both together.
    totals = summed.groupBy(*keys).agg(F.max(out).alias(base))
    bases = totals.withColumn(base, F.sum(base).over(before) - F.col(base))
    bases = checkpoint(bases.select(F.col(part).alias(p2), base, *([F.col(group).alias(g2)] if group else [])))
    on = F.col(part) == F.col(p2)
    if group:
        on = on & F.col(group).eqNullSafe(F.col(g2))
    joined = join_small(summed, bases, on, "left")
    return joined.withColumn(out, F.col(out) + F.col(base)).drop(base, part, p2, g2)
