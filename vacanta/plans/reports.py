"""Reports made of several operators."""

from pyspark.sql import DataFrame

from vacanta.operators.analytics import (
    job_stats,
    skills_by_status,
    top_job_titles,
    top_skills_all_categories,
)


def analytics_bundle(jobs: DataFrame, skills: DataFrame) -> dict[str, DataFrame]:
    """The four parts of the analytics page. Each reads two or three narrow columns, so nothing is cached."""
    return {
        "status_stats": job_stats(jobs),
        "skills_by_category": top_skills_all_categories(skills, 15),
        "skills_by_status": skills_by_status(jobs, skills, 10),
        "top_job_titles": top_job_titles(jobs, 15),
    }
