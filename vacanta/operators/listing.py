"""Listing, search, single jobs and the readable report."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.functions.postings import flat_skills, list_or_empty, salary_text
from vacanta.functions.text import fold_ascii, like_pattern, or_default
from vacanta.operators.documents import parse_stored
from vacanta.schemas import SKILL_FIELDS


# Size of a search result and of the first listing page.
SEARCH_LIMIT = 50
LIST_LIMIT = 100


def _newest(jobs: DataFrame) -> DataFrame:
    """Newest first; an unreadable time comes last; the id settles ties."""
    return jobs.orderBy(F.desc_nulls_last("extracted_at"), F.desc("id"))


def list_jobs(
    jobs: DataFrame, limit: int = LIST_LIMIT, offset: int = 0, status: str = "", after: tuple | None = None
) -> DataFrame:
    """Newest jobs, optionally of one status.

    An offset makes each task hold all rows before the page. For pages far down give `after`, the `extracted_at`
    and `id` of the last row of the page before: only rows below it are looked at.
    """
    chosen = jobs.filter(F.col("status") == status) if status else jobs
    if after is not None:
        moment, last_id = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        same = F.col("extracted_at").eqNullSafe(moment) & (F.col("id") < last_id)
        below = F.coalesce(F.col("extracted_at") < moment, F.col("extracted_at").isNull() & moment.isNotNull())
        chosen = chosen.filter(below | same)
    page = _newest(chosen)
    return _listed((page.offset(offset) if offset else page).limit(limit))


def listed(rows: DataFrame) -> DataFrame:
    """The rows of a page in the listing's order and columns."""
    return _listed(_newest(rows))


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", F.col("job_title").alias("title"), F.col("company_name").alias("company"),
        F.col("location_full").alias("location"), "job_type", "workplace_type",
        F.col("seniority_level").alias("level"), "department",
        salary_text(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency")).alias("salary_range"),
        "status", "extracted_at", F.col("source_url").alias("url"),
    )


def search_jobs(jobs: DataFrame, term: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Newest jobs whose title, company or location is LIKE %term%; only ASCII letters ignore case."""
    return newest_hits(jobs.filter(matches_term(term)), limit)


def matches_term(term: str) -> Column:
    """Whether a job's title, company or location is LIKE %term%."""
    pattern = fold_ascii(F.lit(like_pattern(term)))
    hit = F.lit(False)
    for name in ("job_title", "company_name", "location_full"):
        hit = hit | F.coalesce(F.like(fold_ascii(F.col(name)), pattern), F.lit(False))
    return hit


def newest_hits(hits: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    return _newest(hits).limit(limit).select(
        "id", F.col("job_title").alias("title"), F.col("company_name").alias("company"),
        F.col("location_full").alias("location"), "workplace_type", "status", "extracted_at",
        F.col("source_url").alias("url"),
    )


def filter_listing(listing: DataFrame, search: str = "", status: str = "") -> DataFrame:
    """Narrow a listing by a literal piece of title or company in any case, and by an exact status."""
    out = listing
    if search:
        wanted = F.lower(F.lit(search))
        out = out.filter(F.contains(F.lower("title"), wanted) | F.contains(F.lower("company"), wanted))
    return out.filter(F.col("status") == status) if status else out


def get_jobs(jobs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Stored documents with tracking fields and flat skills, for all jobs or for the given ids.

    An id without a job gives no row. A document that no longer parses keeps its row, with `unreadable` set and
    blank facts.
    """
    wanted = jobs if ids is None else jobs.join(ids.select("id").distinct(), "id", "left_semi")
    parsed = parse_stored(wanted.select("id", "status", "notes", "rating", "raw_json"))
    return parsed.select(
        "id",
        F.col("posting.metadata.job_title").alias("title"),
        F.col("posting.company_info.company_name").alias("company"),
        F.col("posting.company_info.location_full").alias("location"),
        F.col("posting.source_url").alias("url"),
        F.coalesce("status", F.lit("")).alias("status"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        F.coalesce("rating", F.lit(0).cast("bigint")).alias("rating"),
        flat_skills(F.col("posting")).alias("skills"),
        F.col("posting").alias("extracted"),
        "unreadable",
    )


def get_job(jobs: DataFrame, job_id: int) -> DataFrame:
    """The one job with this id. Running the result fails with an error if there is none."""
    asked = jobs.sparkSession.range(1).select(F.lit(job_id).cast("bigint").alias("id"))
    found = asked.join(jobs.filter(F.col("id") == job_id).withColumn("_there", F.lit(True)), "id", "left")
    known = F.when(F.col("_there").isNull(), F.raise_error(F.lit(f"no job {job_id}")))
    # The error is part of the id, which every use of the row needs.
    return get_jobs(found.withColumn("id", F.coalesce(known.cast("bigint"), F.col("id"))))


# Texts shown for category codes and missing facts.
CATEGORY_LABELS = {
    "programming_languages": "Programming languages",
    "frameworks": "Frameworks",
    "databases": "Databases",
    "cloud_platforms": "Cloud platforms",
    "devops_tools": "DevOps tools",
    "other": "Other",
}
DASH = "—"
UNSET = "Not specified"


def category_labels(details: DataFrame) -> DataFrame:
    """One row per job and non-empty skill list: its display label and the joined names."""
    tech = F.col("extracted.requirements.technical_skills")
    lists = F.array(*[
        F.struct(
            F.lit(i).cast("bigint").alias("position"),
            F.lit(CATEGORY_LABELS[field]).alias("label"),
            list_or_empty(tech.getField(field)).alias("names"),
        )
        for i, field in enumerate(SKILL_FIELDS)
    ])
    return details.select("id", F.explode(F.filter(lists, lambda x: F.size(x["names"]) > 0)).alias("g")).select(
        "id", "g.position", "g.label", F.array_join("g.names", ", ").alias("names")
    )


def _yes_no(col: Column) -> Column:
    return F.when(col, "Yes").otherwise("No")


def _joined(col: Column, separator: str, default: str) -> Column:
    return or_default(F.array_join(list_or_empty(col), separator), default)


def job_report(details: DataFrame) -> DataFrame:
    """Readable facts per job from get_jobs, with defaults for what the posting does not say."""
    x = lambda path: F.col("extracted." + path)
    low, high = x("compensation.salary_min"), x("compensation.salary_max")
    salary = F.when(
        (low != 0) | (high != 0),
        F.rtrim(F.concat(low.cast("string"), F.lit("–"), high.cast("string"), F.lit(" "), x("compensation.salary_currency"))),
    ).otherwise(UNSET)
    bullets = F.transform(list_or_empty(x("role_details.key_responsibilities")), lambda r: F.concat(F.lit("• "), r))
    flags = {
        "specific_degree": "requirements.requires_specific_degree", "equity": "compensation.has_equity",
        "remote_stipend": "compensation.has_remote_stipend",
        "visa_sponsorship": "compensation.offers_visa_sponsorship",
        "health_insurance": "compensation.offers_health_insurance", "pto": "compensation.offers_pto",
        "professional_development": "compensation.offers_professional_development",
        "k401": "compensation.offers_401k", "remote_friendly": "work_arrangement.is_remote_friendly",
        "take_home": "market_signals.has_take_home", "pair_programming": "market_signals.has_pair_programming",
    }
    return details.select(
        "id",
        or_default(F.col("title"), "Untitled role").alias("title"),
        F.concat(
            or_default(F.col("company"), "Unknown company"), F.lit(" · "),
            or_default(F.col("location"), "Location not set"),
        ).alias("subtitle"),
        F.col("url"),
        _joined(F.col("skills"), ", ", "None extracted").alias("skills"),
        x("metadata.department").alias("department"),
        x("metadata.seniority_level").alias("seniority"),
        x("metadata.job_function").alias("job_function"),
        x("company_info.industry").alias("industry"),
        x("company_info.company_size").alias("company_size"),
        x("role_details.summary").alias("summary"),
        _joined(bullets, "\n", DASH).alias("responsibilities"),
        or_default(x("role_details.team_structure"), DASH).alias("team_structure"),
        F.concat(
            x("requirements.years_experience_min").cast("string"), F.lit("–"),
            x("requirements.years_experience_max").cast("string"), F.lit(" years"),
        ).alias("experience"),
        or_default(x("requirements.education_level"), UNSET).alias("education"),
        _joined(x("requirements.soft_skills"), ", ", DASH).alias("soft_skills"),
        _joined(x("requirements.nice_to_have"), ", ", DASH).alias("nice_to_have"),
        salary.alias("salary"),
        _joined(x("compensation.benefits"), ", ", DASH).alias("benefits"),
        or_default(x("work_arrangement.workplace_type"), UNSET).alias("workplace_type"),
        or_default(x("work_arrangement.job_type"), UNSET).alias("job_type"),
        or_default(x("work_arrangement.timezone_requirements"), DASH).alias("timezone_requirements"),
        or_default(x("market_signals.urgency_level"), "Standard").alias("urgency"),
        x("market_signals.interview_rounds").cast("string").alias("interview_rounds"),
        x("extracted_at").alias("extracted_at"),
        F.col("notes"),
        *[_yes_no(x(path)).alias(name) for name, path in flags.items()],
    )
