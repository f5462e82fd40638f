"""Contiguous shards of near-equal size, cut from global prefix sums of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from vacanta.llm.common import without
from vacanta.llm.prefix import ROW, with_prefix


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add `size`, `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard) to every document.

    Documents are laid end to end by id; a document's size is the UTF-8 bytes of its text (NULL: none) plus 1.
    The line is cut at equal targets and a document belongs to the shard that holds its middle, so shards are
    contiguous and differ from an equal share by at most one document's size. Their number of documents differs.

    NULL ids come first; rows with one id are ordered by a hash of their text, and rows alike in both may take
    each other's slot. An empty table gives no rows. Input columns called like an added one are replaced. All
    other columns, the text too, are kept as they are.
    """
    sized = without(docs, "size", "shard", "slot").withColumn(
        "size", F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 1
    )
    order = [F.col(id_col), F.xxhash64(F.col(text_col)), F.monotonically_increasing_id()]
    laid, total = with_prefix(sized, order, ["size"], "shards")
    middle = F.expr(f"(2 * __before_size + size) * {shards} div {max(2 * total['size'], 1)}")
    cut = laid.withColumn("shard", middle.cast("int"))
    # One row per shard.
    firsts = [tuple(r) for r in cut.groupBy("shard").agg(F.min(ROW)).collect()]
    fields = StructType([StructField("shard", IntegerType()), StructField("__first", LongType())])
    first = docs.sparkSession.createDataFrame(firsts, fields)
    return cut.join(F.broadcast(first), "shard").select(
        *sized.columns, "shard", (F.col(ROW) - F.col("__first")).alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, rows in slot order within each file. Rows stay where they are: no shuffle."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
