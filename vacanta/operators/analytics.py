"""Aggregates over `jobs` and `job_skills`. Counts are of skill rows unless asked otherwise."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacanta.schemas import ANALYTICS_CATEGORIES, STATUSES

_SALTS = 256


def top_n_per_group(counted: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their position as `rank`.

    Salted parts of each group are cut first, so no task sorts a whole group.
    """
    salted = counted.withColumn("_salt", F.pmod(F.xxhash64(*counted.columns), F.lit(_SALTS)))
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    cut = salted.withColumn("_part", F.row_number().over(part)).filter(F.col("_part") <= n).drop("_salt", "_part")
    ranked = cut.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("bigint"))


def job_stats(jobs: DataFrame) -> DataFrame:
    """One row: total and a count per known status, zeros for an empty table."""
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES]
    return jobs.agg(F.count(F.lit(1)).alias("total"), *counts)


def summary_line(jobs: DataFrame) -> DataFrame:
    stats = job_stats(jobs)
    return stats.select(
        F.format_string(
            "You have %d jobs tracked. Applied: %d, Interview: %d, Offer: %d.",
            "total", "applied", "interview", "offer",
        ).alias("summary")
    )


def _count(distinct_jobs: bool) -> Column:
    return (F.countDistinct("job_id") if distinct_jobs else F.count(F.lit(1))).alias("cnt")


def top_skills(skills: DataFrame, n: int, distinct_jobs: bool = False) -> DataFrame:
    return (
        skills.groupBy("skill_name", "skill_category")
        .agg(_count(distinct_jobs))
        .orderBy(F.desc("cnt"), "skill_name", "skill_category")
        .limit(n)
    )


def top_skills_by_category(skills: DataFrame, category: str, n: int, distinct_jobs: bool = False) -> DataFrame:
    return top_skills(skills.filter(F.col("skill_category") == category), n, distinct_jobs)


def top_skills_all_categories(
    skills: DataFrame, n: int = 15, categories: list[str] | None = ANALYTICS_CATEGORIES
) -> DataFrame:
    """top_skills_by_category for several categories in one pass; None takes every category."""
    chosen = skills if categories is None else skills.filter(F.col("skill_category").isin(categories))
    counted = chosen.groupBy("skill_category", "skill_name").agg(F.count(F.lit(1)).alias("cnt"))
    return top_n_per_group(counted, ["skill_category"], [F.desc("cnt"), F.asc("skill_name")], n)


def skills_by_status(jobs: DataFrame, skills: DataFrame, n: int = 10, distinct_jobs: bool = False) -> DataFrame:
    """The n most frequent skills per status. Skills without a job are left out.

    The join moves three narrow columns; a job with very many skills is split by the adaptive skew join.
    """
    joined = skills.select("job_id", "skill_name", "skill_category").join(
        jobs.select(F.col("id").alias("job_id"), "status"), "job_id"
    )
    counted = joined.groupBy("status", "skill_name", "skill_category").agg(_count(distinct_jobs))
    order = [F.desc("cnt"), F.asc("skill_name"), F.asc("skill_category")]
    return top_n_per_group(counted, ["status"], order, n)


def skill_status_matrix(by_status: DataFrame) -> DataFrame:
    """skills_by_status turned into one row per skill and a column per known status.

    `sort_key` is the order of first appearance from the first status to the last.
    """
    position = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    rows = by_status.filter(F.col("status").isin(STATUSES)).select(
        "skill_name", "status", "cnt", (position * 1_000_000_000 + F.col("rank")).alias("place")
    )
    counts = [F.coalesce(F.max(F.when(F.col("status") == s, F.col("cnt"))), F.lit(0)).alias(s) for s in STATUSES]
    return rows.groupBy("skill_name").agg(F.min("place").alias("sort_key"), *counts).orderBy("sort_key")


def skill_locations(jobs: DataFrame, skills: DataFrame, skill: str, n: int) -> DataFrame:
    """Where a skill is asked for. A stored blank city counts as a place of its own."""
    per_job = skills.filter(F.col("skill_name") == skill).groupBy("job_id").agg(F.count(F.lit(1)).alias("rows"))
    place = F.coalesce("location_city", "location_full", F.lit("Unknown"))
    return (
        per_job.join(jobs.select(F.col("id").alias("job_id"), place.alias("location")), "job_id")
        .groupBy("location")
        .agg(F.sum("rows").alias("cnt"))
        .orderBy(F.desc("cnt"), "location")
        .limit(n)
    )


def top_job_titles(jobs: DataFrame, n: int = 15) -> DataFrame:
    return (
        jobs.filter(F.col("job_title") != "")
        .groupBy("job_title")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "job_title")
        .limit(n)
    )
