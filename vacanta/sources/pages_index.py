"""The listing laid out by position, so that any page of it is read from one or two folders.

Jobs are sorted newest first, as in the listing, and numbered from 0; `block` folders hold `rows` numbers each. A page is
a range of numbers: the folders are chosen by the range alone and row groups by their least and greatest number, so page
1000 costs what page 1 costs. With a status, jobs are numbered within it, in a layout of its own below `status=...`.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.operators.listing import LIST_LIMIT, listed
from vacanta.sources.scratch import written_once

BLOCK_ROWS = 100_000
_ROW_GROUP = 1 << 20
_LOW = (1 << 33) - 1


def _numbered(jobs: DataFrame, groups: list[str]) -> DataFrame:
    """Add `position` in the order of the listing, from 0 in each group.

    Rows are sorted by ranges; each partition numbers its own rows and moves them by the counts of the partitions before
    it. What reaches the driver is a row per partition and group.
    """
    order: list[Column] = [*[F.col(g) for g in groups], F.desc_nulls_last("extracted_at"), F.desc("id")]
    rows = jobs.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written_once(rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW))}), "listing")
    counts = rows.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first"))
    done, moved = {}, []
    for r in counts.orderBy("_part").collect():
        key = tuple(r[g] for g in groups)
        moved.append((*key, r["_part"], done.get(key, 0) - r["first"]))
        done[key] = done.get(key, 0) + r["n"]
    names = ", ".join([*[f"{g} string" for g in groups], "_part int", "_by bigint"])
    offsets = jobs.sparkSession.createDataFrame(moved, names)
    on = rows["_part"] == offsets["_part"]
    for g in groups:
        on = on & rows[g].eqNullSafe(offsets[g])
    joined = rows.join(offsets, on).select(*[rows[c] for c in rows.columns], (F.col("_row") + F.col("_by")).alias("position"))
    return joined.drop("_part", "_row")


def write_listing(jobs: DataFrame, path: str, by_status: bool = False, rows: int = BLOCK_ROWS) -> None:
    """Write the listing by position, with `by_status` numbered within each status that is not blank."""
    groups = ["status"] if by_status else []
    jobs = jobs.filter("status <> ''") if by_status else jobs
    numbered = _numbered(jobs, groups).withColumn("block", F.floor(F.col("position") / rows).cast("int"))
    numbered = numbered.withColumn("_status", F.col("status")) if by_status else numbered
    keep = [c for c in numbered.columns if c not in (*groups, "block")]
    numbered.select(*keep, *groups, "block").repartitionByRange(*groups, "block").sortWithinPartitions(
        *groups, "block", "position"
    ).write.option("parquet.block.size", _ROW_GROUP).partitionBy(*groups, "block").parquet(path)


def read_page(spark, path: str, page: int, size: int = LIST_LIMIT, status: str | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """Page `page` (from 0) of the listing, as `list_jobs` gives it with an offset of page * size."""
    first, last = page * size, (page + 1) * size - 1
    blocks = list(range(first // rows, last // rows + 1))
    layout = spark.read.option("basePath", path).parquet(path)
    here = layout.filter(F.col("block").isin(blocks) & F.col("position").between(first, last))
    if status is not None:
        here = here.filter(F.col("status") == status)
    return listed(here.withColumn("status", F.col("_status")) if "_status" in layout.columns else here)
