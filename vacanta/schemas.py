"""Schemas of the posting document, the two tables, captures, board files and changes."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

STR, INT, BOOL, TS = StringType(), LongType(), BooleanType(), TimestampType()
STRS = ArrayType(STR)

# The vocabulary and the document layout that stored data already uses.
STATUSES = ["saved", "applied", "interview", "offer", "rejected"]
CATEGORIES = ["programming_language", "framework", "database", "cloud", "devops", "other"]
ANALYTICS_CATEGORIES = ["programming_language", "database", "cloud", "devops", "other"]
SKILL_FIELDS = ["programming_languages", "frameworks", "databases", "cloud_platforms", "devops_tools", "other"]
SENIORITY = ["Junior", "Mid", "Senior", "Staff", "Principal", "Lead"]
JOB_FUNCTIONS = ["Backend", "Frontend", "FullStack", "DevOps", "Data", "Mobile", "Security", "Embedded"]


def _struct(**fields):
    return StructType([StructField(name, kind) for name, kind in fields.items()])


TECHNICAL_SKILLS = _struct(**{name: STRS for name in SKILL_FIELDS})

POSTING_SCHEMA = _struct(
    metadata=_struct(job_title=STR, department=STR, seniority_level=STR, job_function=STR),
    company_info=_struct(
        company_name=STR, industry=STR, company_size=STR,
        location_full=STR, location_city=STR, location_country=STR,
    ),
    role_details=_struct(summary=STR, key_responsibilities=STRS, team_structure=STR),
    requirements=_struct(
        years_experience_min=INT, years_experience_max=INT,
        education_level=STR, requires_specific_degree=BOOL,
        technical_skills=TECHNICAL_SKILLS, soft_skills=STRS, nice_to_have=STRS,
    ),
    compensation=_struct(
        salary_min=INT, salary_max=INT, salary_currency=STR,
        has_equity=BOOL, has_remote_stipend=BOOL, benefits=STRS,
        offers_visa_sponsorship=BOOL, offers_health_insurance=BOOL, offers_pto=BOOL,
        offers_professional_development=BOOL, offers_401k=BOOL,
    ),
    work_arrangement=_struct(workplace_type=STR, job_type=STR, is_remote_friendly=BOOL, timezone_requirements=STR),
    market_signals=_struct(urgency_level=STR, interview_rounds=INT, has_take_home=BOOL, has_pair_programming=BOOL),
    extracted_at=STR,
    source_url=STR,
)

JOBS_SCHEMA = _struct(
    id=INT, source_url=STR, extracted_at_raw=STR, extracted_at=TS,
    job_title=STR, company_name=STR, company_size=STR, industry=STR,
    location_full=STR, location_city=STR, location_country=STR,
    seniority_level=STR, department=STR, job_function=STR,
    workplace_type=STR, job_type=STR, is_remote_friendly=BOOL, timezone_requirements=STR,
    years_experience_min=INT, years_experience_max=INT, education_level=STR, requires_specific_degree=BOOL,
    salary_min=INT, salary_max=INT, salary_currency=STR, has_equity=BOOL, has_remote_stipend=BOOL,
    offers_visa_sponsorship=BOOL, offers_health_insurance=BOOL, offers_pto=BOOL,
    offers_professional_development=BOOL, offers_401k=BOOL,
    urgency_level=STR, interview_rounds=INT, has_take_home=BOOL, has_pair_programming=BOOL,
    summary=STR, key_responsibilities=STR, team_structure=STR, benefits=STR, soft_skills=STR, nice_to_have=STR,
    status=STR, applied_date=TS, notes=STR, rating=INT,
    raw_json=STR, created_at=TS, updated_at=TS,
)

JOB_SKILLS_SCHEMA = _struct(id=INT, job_id=INT, skill_name=STR, skill_category=STR, is_required=BOOL)

CAPTURE_SCHEMA = _struct(text=STR, url=STR, title=STR, contentLength=INT, capture_id=INT, ts=TS)

BOARD_JOB_SCHEMA = _struct(
    title=STR, content=STR, location=_struct(name=STR), departments=ArrayType(_struct(name=STR)),
    absolute_url=STR, updated_at=STR,
)

CHANGE_SCHEMA = _struct(id=INT, seq=INT, action=STR, status=STR, notes=STR, rating=INT)
