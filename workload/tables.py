"""Posting tables derived from the star-schema test tables.

The texts below are plain SQL that Spark and DuckDB both read, so a query and its reference SQL start
from the same rows. `{name}` stands for a given table.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.schemas import CHANGE_SCHEMA, JOBS_SCHEMA, POSTING_SCHEMA

GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages",
    "conversations", "labels", "benchmark",
]

JOBS = """
select o_orderkey as id,
       'https://jobs.example.com/' || cast(o_orderkey as string) as source_url,
       o_orderdate as extracted_at,
       case when o_orderkey % 11 = 0 then '' else c_mktsegment || ' ' || o_orderpriority end as job_title,
       c_name as company_name,
       case when o_orderkey % 7 = 0 then '' when o_orderkey % 13 = 0 then null else n_name end as location_city,
       case when o_orderkey % 26 = 0 then null else n_name end as location_full,
       case o_orderstatus when 'F' then 'Full-time' when 'O' then 'Contract' else '' end as job_type,
       case when o_custkey % 2 = 0 then 'Remote' else 'On-site' end as workplace_type,
       case when o_custkey % 3 = 0 then 'Senior' else 'Mid' end as seniority_level,
       c_mktsegment as department,
       case when o_orderkey % 17 = 0 then null else cast(floor(o_totalprice) as bigint) end as salary_min,
       cast(floor(o_totalprice * 1.2) as bigint) as salary_max,
       case when o_orderkey % 3 = 0 then 'USD' when o_orderkey % 19 = 0 then null else '' end as salary_currency,
       case substr(o_orderpriority, 1, 1) when '1' then 'offer' when '2' then 'interview'
            when '3' then 'applied' when '4' then 'saved' else 'rejected' end as status,
       case when o_orderkey % 4 = 0 then 'note ' || o_orderstatus else null end as notes,
       case when o_orderkey % 5 = 0 then o_custkey % 6 else null end as rating
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
"""

JOB_SKILLS = """
select l_orderkey as job_id, p_name as skill_name,
       case p_type when 'MEDIUM' then 'programming_language' when 'STANDARD' then 'framework'
            when 'LARGE' then 'database' when 'PROMO' then 'cloud' when 'SMALL' then 'devops'
            else 'other' end as skill_category
from {lineitem} join {part} on l_partkey = p_partkey
"""

# One row per message sent for a posting. Several messages share a URL, and some have none.
MESSAGES = """
select o_orderkey as seq,
       case when o_custkey % 50 = 0 then ''
            else 'https://careers.example.com/' || cast(o_custkey as string) end as url,
       c_mktsegment || ' ' || substr(o_orderpriority, 3) as title,
       c_mktsegment as department,
       case when o_orderkey % 3 = 0 then 'Senior' else '' end as seniority,
       'F' || o_orderstatus as job_function,
       c_name as company,
       case when o_orderkey % 9 = 0 then '' else n_name end as city,
       n_name as place,
       'About ' || o_orderpriority as summary,
       o_orderpriority as duty1, o_orderstatus as duty2,
       o_orderkey % 7 as years_min, o_orderkey % 11 as years_max,
       cast(floor(o_totalprice) as bigint) as salary_min,
       case when o_orderkey % 8 = 0 then 0 else cast(floor(o_totalprice * 1.2) as bigint) end as salary_max,
       case when o_orderkey % 2 = 0 then 'EUR' else '' end as currency,
       o_orderkey % 2 = 0 as remote, o_orderkey % 5 = 0 as equity,
       case when o_orderkey % 6 = 0 then 'Urgent' else '' end as urgency,
       o_orderkey % 4 as rounds,
       cast(cast(o_orderdate as date) as string) || 'T08:00:00Z' as extracted_at,
       c_mktsegment as skill_lang, o_orderpriority as skill_framework, n_name as skill_db,
       case when o_orderkey % 5 = 0 then null else o_orderstatus end as skill_cloud,
       'tool ' || cast(o_custkey % 4 as string) as skill_devops
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
"""

CHANGES = """
select user_id as id, event_id as seq,
       case when event_type = 'error' and event_id % 97 = 0 then 'delete' else 'update' end as action,
       case event_type when 'view' then 'saved' when 'click' then 'applied' when 'signup' then 'interview'
            when 'purchase' then 'offer' else '' end as status,
       case when event_id % 4 = 0 then props when event_id % 9 = 0 then '' else null end as notes,
       case when event_id % 3 = 0 then cast(floor(value) as bigint) else null end as rating
from {events}
"""

# Text the generated documents lack, planted by document number.
PLANTED_TEXT = """text || case doc_id % 6
  when 0 then chr(10) || 'URL: https://jobs.example.com/d' || cast(doc_id as string) || ' ' || chr(10)
              || 'more https://cdn.example.com/a.js end arial.woff2 Wall of Love x'
  when 1 then ' .a{color:red} /* note */ @font-face { x: y } tail'
  when 2 then chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || 'Cookie Preferences x' || chr(10) || 'keep'
  when 3 then chr(10) || 'Copyright 2024 x'
  when 4 then ' 3-5 years €80k-100k ASAP, knows Python and SQL Server, visa sponsorship. Similar Jobs zzz'
  else '    © 2024 inc' end"""

LINKEDIN_TEXT = """text || case doc_id % 4
  when 0 then chr(10) || 'Apply now x Reposted 3 days ago kept' || chr(10) || 'Over 100 people clicked apply'
  when 1 then chr(10) || '12 notifications total Keyboard shortcuts' || chr(10) || 'Close your conversation with A' || chr(10) || 'chat'
  when 2 then chr(10) || 'Show more options Premium insights' || chr(10) || 'More jobs at x' || chr(10) || 'end'
  else chr(10) || 'Looking for talent? Post a job' || chr(10) || 'Job activity y' end"""

# Hosts and paths that the routing rules need; all generated URLs are generic.
PLANTED_URL = """case page_id % 6
  when 0 then 'https://boards.greenhouse.io/acme' || cast(page_id as string) || '/jobs/' || cast(page_id + 1000 as string)
  when 1 then 'https://wellfound.com/jobs/' || cast(page_id as string) || '-role'
  when 2 then 'https://www.remoterocketship.com/company/' || cast(page_id as string)
  when 3 then 'https://www.linkedin.com/jobs/view/' || cast(page_id as string)
  when 4 then 'https://careers.example.com/apply?x=1&gh_jid=' || cast(page_id as string) || '%2B1#top'
  else url end"""

# The article of every page, put into the blocks that the site rules look for.
SITE_HTML = """replace(replace(html, '<article>',
  '<main><div class="topcard__flavor topcard__flavor--bullet x_location__a">Lyon ' || cast(page_id as string)
  || '</div><div class="x_compensation__b">' || case when page_id % 2 = 0 then '€' else '' end || cast(page_id as string)
  || 'k</div><div class="jobs-description__content"><button>Apply</button><article>'), '</article>',
  '</article></div></main><p>Similar Jobs</p><p>elsewhere</p>')"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a dealt table that a task gets, about.
ROWS_PER_TASK = 50_000


def tasks(spark: SparkSession, rows: int, each: int | None = None) -> int:
    """How many tasks so many rows are for: it grows with them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (each or ROWS_PER_TASK)))


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of about so many rows, dealt out evenly."""
    return df.repartition(tasks(df.sparkSession, rows))


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table dealt out evenly, for work that is heavy per row. Counting reads the files' footers only."""
    rows = read(spark, sf_dir, name)
    return dealt(rows, rows.count())


def derived(spark: SparkSession, sf_dir: str, text: str, heavy: str = "") -> DataFrame:
    """The rows of a text above. If they carry heavy work, `heavy` names the given table that has one for each.

    They are dealt out after the joins, as a join by shuffle deals anew, in tasks by bytes and not by work.
    """
    rows = spark.sql(text, **{name: read(spark, sf_dir, name) for name in GIVEN if "{" + name + "}" in text})
    return dealt(rows, read(spark, sf_dir, heavy).count()) if heavy else rows


def duck(text: str) -> str:
    for name in GIVEN:
        text = text.replace("{" + name + "}", name)
    return text


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, JOBS)


def all_columns(jobs_df: DataFrame) -> DataFrame:
    """The derived jobs with every column of the jobs table, NULL where there is nothing to derive."""
    return jobs_df.select(*[
        (F.col(f.name) if f.name in jobs_df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in JOBS_SCHEMA.fields
    ])


def job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, JOB_SKILLS)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, MESSAGES, heavy="orders")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived(spark, sf_dir, CHANGES)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in CHANGE_SCHEMA.fields])


_FROM_MESSAGE = {
    "metadata.job_title": "title", "metadata.department": "department", "metadata.seniority_level": "seniority",
    "metadata.job_function": "job_function", "company_info.company_name": "company",
    "company_info.location_full": "place", "company_info.location_city": "city", "role_details.summary": "summary",
    "requirements.years_experience_min": "years_min", "requirements.years_experience_max": "years_max",
    "compensation.salary_min": "salary_min", "compensation.salary_max": "salary_max",
    "compensation.salary_currency": "currency", "compensation.has_equity": "equity",
    "work_arrangement.is_remote_friendly": "remote", "market_signals.urgency_level": "urgency",
    "market_signals.interview_rounds": "rounds", "extracted_at": "extracted_at", "source_url": "url",
}


_LISTS_FROM_MESSAGE = {
    "role_details.key_responsibilities": "array(duty1, duty2)",
    "requirements.technical_skills.programming_languages": "array(skill_lang, '')",
    "requirements.technical_skills.frameworks": "array(skill_framework)",
    "requirements.technical_skills.databases": "array(skill_db)",
    "requirements.technical_skills.cloud_platforms": "case when skill_cloud is not null then array(skill_cloud) end",
    "requirements.technical_skills.devops_tools": "array(skill_devops)",
    "requirements.technical_skills.other": "array(skill_lang, skill_lang)",
    "requirements.nice_to_have": "array(duty2, duty1)",
    "compensation.benefits": "array(duty1, duty1)",
}


def _document(schema, prefix: str = "") -> str:
    parts = []
    for field in schema.fields:
        path = prefix + field.name
        if field.dataType.typeName() == "struct":
            value = _document(field.dataType, path + ".")
        else:
            value = _FROM_MESSAGE.get(path) or _LISTS_FROM_MESSAGE.get(path) or "null"
            value = f"cast({value} as {field.dataType.simpleString()})"
        parts.append(f"'{field.name}', {value}")
    return f"named_struct({', '.join(parts)})"


def posting_of() -> Column:
    """The nested document of a message row. Fields without a value are left NULL, as in a sparse answer."""
    return F.expr(_document(POSTING_SCHEMA))


def posting_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as fenced JSON answers; missing fields are absent from the text."""
    return messages(spark, sf_dir).select(
        F.col("seq").alias("ingest_seq"), F.col("url").alias("request_url"),
        F.concat(F.lit("```json\n"), F.to_json(posting_of()), F.lit("\n```\n")).alias("response"),
    )
