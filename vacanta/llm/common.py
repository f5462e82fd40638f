"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.sources.scratch import scratch_dir

# The six ASCII white-space characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# Spark's setting to remove a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def words(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, however often later steps use them.

    Catalyst copies the text of a column into each of its uses. It does not reach through a one-row explode.
    """
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    out = df.select("*", F.explode(F.array(packed)).alias("__once"))
    return out.select(*df.columns, *[F.col(f"__once.{name}").alias(name) for name in columns])


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns of these names, in any case of letters."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written once below spark.checkpoint.dir and read back.

    Later jobs start from the files, which outlive a lost executor. They stay until the folder is cleared or the table
    is given to `dropped`. The shuffle files of the write itself go when it has ended.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables from `written` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def document_texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def per_worker(name: str, make: Callable):
    """A value kept for the life of a Python worker, over all its tasks."""
    kept = sys.modules.setdefault("__vacanta_worker", types.ModuleType("__vacanta_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def in_slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `size` bytes of a text or binary column; a longer value is one of its own."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows:
            upto = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype("i8"))
            cuts = [0, *(np.flatnonzero(np.diff(upto // size)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                yield batch.slice(begin, end - begin)


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list]]:
    """Runs of rows with equal integer keys, over batch borders: the key and one array per column."""
    held: list[list] = []
    where = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        changed = np.zeros(batch.num_rows - 1, bool)
        for k in key:
            changed |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            now = tuple(k[begin] for k in key)
            if now != where and held:
                yield where, [np.concatenate(v) for v in zip(*held)]
                held = []
            where = now
            held.append([v[begin:end] for v in values])
    if held:
        yield where, [np.concatenate(v) for v in zip(*held)]
