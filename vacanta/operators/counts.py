"""Counts kept up to date: what a change takes back and adds, instead of counting all jobs and skills again.

A count is a row `kind`, `status`, `category`, `name`, `cnt`:

    job           jobs of a status
    title         jobs with a title that is not blank
    skill         skill rows of a category and name, those without a job too
    status_skill  skill rows of a category and name, by the status of their job

A change log yields rows of the same form with positive and negative numbers. Added up with the counts they give the
counts after the log, so a status edit moves numbers from one status to another and reads the skills of edited jobs only.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.operators.analytics import top_n_per_group
from vacanta.operators.changes import apply_changes, latest_changes
from vacanta.schemas import ANALYTICS_CATEGORIES, STATUSES

KEY = ["kind", "status", "category", "name"]


def _rows(df: DataFrame, kind: str, status=None, category=None, name=None, by: Column | None = None) -> DataFrame:
    """Counts of one kind. The key is reduced in each task before it is shuffled, however hot it is."""
    keys = [F.lit(kind).alias("kind")]
    for column, alias in ((status, "status"), (category, "category"), (name, "name")):
        keys.append((F.lit("") if column is None else F.col(column)).alias(alias))
    weight = F.lit(1) if by is None else by
    return df.select(*keys, weight.cast("bigint").alias("cnt")).groupBy(*KEY).agg(F.sum("cnt").alias("cnt"))


def job_counts(jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """All counts, from the whole tables."""
    joined = skills.select("job_id", "skill_name", "skill_category").join(
        jobs.select(F.col("id").alias("job_id"), "status"), "job_id"
    )
    return (
        _rows(jobs, "job", status="status")
        .unionByName(_rows(jobs.filter(F.col("job_title") != ""), "title", name="job_title"))
        .unionByName(_rows(skills, "skill", category="skill_category", name="skill_name"))
        .unionByName(_rows(joined, "status_skill", "status", "skill_category", "skill_name"))
    )


def add_up(counts: DataFrame, delta: DataFrame) -> DataFrame:
    """The counts after a delta; what has gone to zero is left out."""
    both = counts.select(*KEY, "cnt").unionByName(delta.select(*KEY, "cnt"))
    return both.groupBy(*KEY).agg(F.sum("cnt").alias("cnt")).filter(F.col("cnt") != 0)


def transitions(jobs: DataFrame, changes: DataFrame, seq: str = "seq") -> DataFrame:
    """What a change log does to the jobs it names: `job_id`, `old`, `new` (NULL: deleted) status, and `job_title`.

    Only jobs whose status changes, or that go, are given. Unknown ids are ignored, as where changes are applied.
    """
    latest = latest_changes(changes, seq).select("id", F.col("status").alias("_status"), "deleted")
    known = jobs.select("id", "status", "job_title").join(latest, "id")
    new = F.when(F.col("deleted"), None).otherwise(F.coalesce("_status", "status"))
    moved = known.select(F.col("id").alias("job_id"), F.col("status").alias("old"), new.alias("new"), "job_title", "deleted")
    return moved.filter(F.col("deleted") | ~F.col("old").eqNullSafe(F.col("new")))


def count_changes(moved: DataFrame, skills: DataFrame) -> DataFrame:
    """The delta of `transitions`. `skills` may hold any rows besides those of the jobs that moved."""
    gone, kept = moved.filter("deleted"), moved.filter("not deleted")
    # An edit takes a job's rows from its old status and adds them to the new one; a delete only takes.
    sides = F.explode(F.array(
        F.struct(F.col("old").alias("status"), F.lit(-1).alias("by")),
        F.struct(F.col("new").alias("status"), F.when(F.col("deleted"), 0).otherwise(1).alias("by")),
    )).alias("_s")
    skilled = skills.select("job_id", "skill_name", "skill_category").join(moved.select("job_id", "old", "new", "deleted"), "job_id")
    of_skills = skilled.select("skill_name", "skill_category", "deleted", sides).filter("_s.by <> 0").select("*", "_s.status", "_s.by")
    of_jobs = gone.unionByName(kept).select("job_title", "deleted", sides).filter("_s.by <> 0").select("*", "_s.status", "_s.by")
    minus = F.lit(-1)
    return (
        _rows(of_jobs, "job", status="status", by=F.col("by"))
        .unionByName(_rows(gone.filter(F.col("job_title") != ""), "title", name="job_title", by=minus))
        .unionByName(_rows(skilled.filter("deleted"), "skill", category="skill_category", name="skill_name", by=minus))
        .unionByName(_rows(of_skills, "status_skill", "status", "skill_category", "skill_name", by=F.col("by")))
    )


def inserted(jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """The delta of jobs that are new, with their skills."""
    return job_counts(jobs, skills)


# ---------------------------------------------------------------- analytics from counts


def stats_of(counts: DataFrame) -> DataFrame:
    """As `job_stats`."""
    jobs = counts.filter("kind = 'job'")
    parts = [F.coalesce(F.sum(F.when(F.col("status") == s, F.col("cnt"))), F.lit(0)).alias(s) for s in STATUSES]
    return jobs.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"), *parts)


def top_skills_of(counts: DataFrame, n: int = 15, categories: list[str] | None = ANALYTICS_CATEGORIES) -> DataFrame:
    """As `top_skills_all_categories`."""
    rows = counts.filter("kind = 'skill'").select(F.col("category").alias("skill_category"), F.col("name").alias("skill_name"), "cnt")
    chosen = rows if categories is None else rows.filter(F.col("skill_category").isin(categories))
    return top_n_per_group(chosen, ["skill_category"], [F.desc("cnt"), F.asc("skill_name")], n)


def skills_by_status_of(counts: DataFrame, n: int = 10) -> DataFrame:
    """As `skills_by_status`."""
    rows = counts.filter("kind = 'status_skill'").select(
        "status", F.col("name").alias("skill_name"), F.col("category").alias("skill_category"), "cnt"
    )
    return top_n_per_group(rows, ["status"], [F.desc("cnt"), F.asc("skill_name"), F.asc("skill_category")], n)


def top_titles_of(counts: DataFrame, n: int = 15) -> DataFrame:
    """As `top_job_titles`."""
    rows = counts.filter("kind = 'title'").select(F.col("name").alias("job_title"), "cnt")
    return rows.orderBy(F.desc("cnt"), "job_title").limit(n)


def bundle_of(counts: DataFrame) -> dict[str, DataFrame]:
    """The parts of the analytics bundle."""
    return {
        "status_stats": stats_of(counts), "skills_by_category": top_skills_of(counts),
        "skills_by_status": skills_by_status_of(counts), "top_job_titles": top_titles_of(counts),
    }


def apply_and_count(
    jobs: DataFrame, skills: DataFrame, changes: DataFrame, counts: DataFrame, now: Column | datetime, seq: str = "seq",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edits and deletes of one batch, and the counts after it."""
    moved = transitions(jobs, changes, seq)
    after, rest = apply_changes(jobs, skills, changes, now, seq)
    return after, rest, add_up(counts, count_changes(moved, skills))
