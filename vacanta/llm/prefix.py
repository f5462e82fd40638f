"""Global row numbers and prefix sums over a total order, from totals per partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from vacanta.llm.common import written

PART, ROW = "__part", "__row"


def in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows dealt to partitions by ranges of the order, sorted within each.

    Give an order that ends with a hash of the row, so that a value held by many rows is split as well.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def numbered(sums: list[str]) -> Callable:
    """First pass, within a partition: its number, the row's number, and the sums of the rows before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, before = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for batch in batches:
            n = batch.num_rows
            out = [*batch.columns, pa.array(np.full(n, part, "i4")), pa.array(np.arange(row, row + n))]
            names = [*batch.schema.names, PART, ROW]
            for name in sums:
                values = batch.column(name).to_numpy(zero_copy_only=False).astype("i8")
                upto = before[name] + np.cumsum(values)
                out.append(pa.array(upto - values))
                names.append(f"__before_{name}")
                before[name] = int(upto[-1]) if n else before[name]
            row += n
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def numbered_schema(schema: StructType, sums: list[str]) -> StructType:
    added = [StructField(PART, IntegerType()), StructField(ROW, LongType())]
    return StructType([*schema.fields, *added, *[StructField(f"__before_{s}", LongType()) for s in sums]])


def with_prefix(df: DataFrame, order: list[Column], sums: list[str], label: str) -> tuple[DataFrame, dict[str, int]]:
    """Add `__row` and `__before_<sum>` over the whole order; also returns the totals, with `rows` among them.

    The first pass is written to the shared folder, so both passes see the same partitions whatever is lost.
    """
    sorted_rows = in_order(df, order)
    first = written(
        sorted_rows.mapInArrow(numbered(sums), numbered_schema(sorted_rows.schema, sums)), label
    )
    return add_offsets(first, {ROW: F.lit(1), **{f"__before_{s}": F.col(s) for s in sums}})


def add_offsets(first: DataFrame, counted: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """Second pass: move each partition's own prefixes by the totals of the partitions before it.

    Only one row of totals per partition reaches the driver and is broadcast back, whatever the rows.
    """
    names = list(counted)
    totals = (
        first.groupBy(PART).agg(*[F.sum(c).cast("long").alias(n) for n, c in counted.items()]).orderBy(PART).collect()
    )
    at, rows = dict.fromkeys(names, 0), []
    for t in totals:
        rows.append((t[PART], *[at[n] for n in names]))
        for n in names:
            at[n] += t[n]
    fields = [StructField(PART, IntegerType()), *[StructField(f"__at{i}", LongType()) for i in range(len(names))]]
    offsets = first.sparkSession.createDataFrame(rows, StructType(fields))
    moved = first.join(F.broadcast(offsets), PART).withColumns({n: F.col(n) + F.col(f"__at{i}") for i, n in enumerate(names)})
    renamed = {("rows" if n == ROW else n.removeprefix("__before_")): v for n, v in at.items()}
    return moved.select(*[c for c in first.columns if c != PART]), renamed
