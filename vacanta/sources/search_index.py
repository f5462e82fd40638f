"""Substring search by an index of three-letter pieces.

Each of the searched columns is cut into all its runs of three characters. A posting is such a piece, the column and the
job's id; postings lie in folders by a hash of the piece and are sorted within files, so a search reads the folders and
row groups of its own pieces only. What they leave is tested by the pattern itself, on the text kept with the job's row.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.functions.text import ASCII_LOWER, ASCII_UPPER, fold_ascii
from vacanta.operators.listing import SEARCH_LIMIT, matches_term, newest_hits

FIELDS = ("job_title", "company_name", "location_full")
SIZE = 3
FOLDERS = 64
_ROW_GROUP = 1 << 20


def _pieces(folded: Column) -> Column:
    """The distinct pieces of a text."""
    starts = F.sequence(F.lit(1), F.char_length(folded) - (SIZE - 1))
    return F.when(
        F.char_length(folded) >= SIZE, F.array_distinct(F.transform(starts, lambda i: F.substr(folded, i, F.lit(SIZE))))
    ).otherwise(F.array().cast("array<string>"))


def write_index(jobs: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Write the postings of all jobs. A piece that a third of all jobs hold is dealt to several files by id."""
    column = F.explode(F.array(*[
        F.struct(F.lit(i).alias("field"), fold_ascii(F.col(name)).alias("text")) for i, name in enumerate(FIELDS)
    ])).alias("_f")
    texts = jobs.select("id", column).select("id", "_f.field", F.col("_f.text").alias("_folded"))
    postings = texts.select("id", "field", F.explode(_pieces(F.col("_folded"))).alias("piece"))
    placed = postings.withColumn("folder", F.pmod(F.xxhash64("piece"), F.lit(folders)).cast("int"))
    placed.repartitionByRange("folder", "piece", "id").sortWithinPartitions("folder", "piece", "field", "id").write.option(
        "parquet.block.size", _ROW_GROUP
    ).partitionBy("folder").parquet(path)


def wanted_pieces(term: str) -> list[str]:
    """Pieces that every text LIKE %term% holds: those of the stretches between wildcards."""
    folded = term.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))
    stretches = re.split(r"[%_]", folded)
    return sorted({s[i:i + SIZE] for s in stretches for i in range(len(s) - SIZE + 1)})


def candidates(index: DataFrame, term: str, folders: int = FOLDERS) -> DataFrame | None:
    """Ids of the jobs of which one column holds all pieces of the term; None where it has no stretch of three letters."""
    pieces = wanted_pieces(term)
    if not pieces:
        return None
    spark = index.sparkSession
    # As many rows as the term has pieces.
    places = spark.createDataFrame([(p,) for p in pieces], "p string").select(F.pmod(F.xxhash64("p"), F.lit(folders)).cast("int"))
    numbers = sorted({r[0] for r in places.collect()})
    postings = index.filter(F.col("folder").isin(numbers) & F.col("piece").isin(pieces))
    whole = postings.groupBy("id", "field").agg(F.count_distinct("piece").alias("n")).filter(F.col("n") == len(pieces))
    return whole.select("id").distinct()


def search_indexed(
    jobs: DataFrame, index: DataFrame, term: str, limit: int = SEARCH_LIMIT, folders: int = FOLDERS
) -> DataFrame:
    """The rows of `search_jobs`, found through the index. A term without three letters in a row is searched for in all
    jobs. Jobs that were stored after the index was written are not found."""
    found = candidates(index, term, folders)
    chosen = jobs if found is None else jobs.join(found, "id", "left_semi")
    return newest_hits(chosen.filter(matches_term(term)), limit)


def read_index(spark, path: str) -> DataFrame:
    return spark.read.schema("id bigint, field int, piece string, folder int").parquet(path)
