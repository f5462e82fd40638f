"""One query per operator, each over whole derived tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.functions import rules, text, urls
from vacanta.functions.postings import flat_skills, join_list, salary_text, skill_counts
from vacanta.operators import analytics, changes, counts, documents, listing, pages, skills
from vacanta.plans.reports import analytics_bundle
from vacanta.schemas import JOB_SKILLS_SCHEMA, JOBS_SCHEMA
from vacanta.sources import files, pages_index, search_index
from vacanta.sources.scratch import scratch_dir, write_scratch
from vacanta.sources.store import JobStore
from vacanta.streaming import streams
from workload import tables as t

QUERIES = {}
NOW = "2024-06-01 00:00:00"
SKILL = "hot rod"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def moment(value: str = NOW):
    return F.lit(value).cast("timestamp")


def planted_docs(spark, d, extra: str = t.PLANTED_TEXT) -> DataFrame:
    return t.spread(spark, d, "documents").select("doc_id", F.expr(extra).alias("text"))


def planted_pages(spark, d) -> DataFrame:
    return t.spread(spark, d, "pages").select(
        "page_id", F.expr(t.PLANTED_URL).alias("url"), F.expr(t.SITE_HTML).alias("html")
    )


def site_pages(spark, d, prefix: str) -> DataFrame:
    return t.spread(spark, d, "pages").select(
        "page_id", F.concat(F.lit(prefix), F.col("page_id").cast("string")).alias("url"),
        F.expr(t.SITE_HTML).alias("html"),
    )


def postings(spark, d) -> DataFrame:
    """Messages parsed back from their JSON answers, with their sequence number."""
    answers = t.posting_texts(spark, d).withColumn("json", text.strip_fences(F.col("response")))
    return documents.accepted(documents.parse_posting(answers)).select("ingest_seq", "posting")


# ---------------------------------------------------------------- sources and sinks


@query
def read_captures(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "captures")
    planted_docs(spark, d).select(
        "text", F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit("doc").alias("title"), text.utf16_length(F.col("text")).alias("contentLength"),
        F.col("doc_id").alias("capture_id"),
    ).write.json(path)
    return files.read_captures(spark, path).select(
        "capture_id", "url", "title", "text", F.col("contentLength").alias("content_length")
    )


@query
def read_pages(spark, d):
    return files.read_pages(spark, f"{d}/pages.parquet")


def board_records(spark, d) -> DataFrame:
    return t.spread(spark, d, "pages").select(
        F.expr("regexp_extract(html, '<h1>(.*?)</h1>', 1)").alias("title"),
        F.col("html").alias("content"),
        F.struct(F.expr("case when page_id % 3 = 0 then '' else 'City ' || cast(page_id as string) end").alias("name"))
        .alias("location"),
        F.expr(
            "case when page_id % 4 = 0 then null else transform(array('Data', 'Ops'), x -> named_struct('name', x)) end"
        ).alias("departments"),
        F.col("url").alias("absolute_url"),
        F.lit("2024-01-02T03:04:05Z").alias("updated_at"),
    )


@query
def read_board_jobs(spark, d):
    path = scratch_dir(spark, "board")
    board_records(spark, d).write.json(path)
    return files.read_board_jobs(spark, path).select(
        "title", F.col("location.name").alias("location"),
        F.coalesce(F.array_join("departments.name", "|"), F.lit("none")).alias("departments"),
        F.col("absolute_url").alias("url"), "updated_at", F.length("content").cast("bigint").alias("content_chars"),
    )


@query
def read_postings(spark, d):
    path = scratch_dir(spark, "postings")
    files.write_postings(postings(spark, d), path)
    return documents.accepted(files.read_postings(spark, path, whole_files=False)).select(
        "posting.source_url", "posting.extracted_at", "posting.metadata.job_title", "posting.compensation.salary_min",
        "posting.compensation.salary_max", "posting.work_arrangement.is_remote_friendly",
    )


@query
def write_postings(spark, d):
    path = scratch_dir(spark, "postings")
    files.write_postings(postings(spark, d), path)
    return spark.read.text(path).select(
        F.get_json_object("value", "$.source_url").alias("source_url"),
        F.get_json_object("value", "$.extracted_at").alias("extracted_at"),
        F.get_json_object("value", "$.compensation.salary_min").cast("bigint").alias("salary_min"),
        F.contains("value", F.lit('"cloud_platforms":null')).alias("null_list_kept"),
    )


@query
def write_raw(spark, d):
    path = scratch_dir(spark, "raw")
    files.write_raw(planted_docs(spark, d), path, moment())
    return spark.read.parquet(path).select("doc_id", "text", F.col("ingest_date").cast("string").alias("ingest_date"))


def skills_per_job(store: JobStore) -> DataFrame:
    """The number of skills of each job that has any, one row per job: to be joined by shuffle."""
    return store.skills().groupBy("job_id").agg(F.count(F.lit(1)).alias("skills")).hint("merge")


@query
def job_store(spark, d):
    store = JobStore(spark, scratch_dir(spark, "store"))
    store.write(t.all_columns(t.jobs(spark, d)), full_skills(spark, d))
    per_job = skills_per_job(store)
    return (
        store.jobs().join(per_job, F.col("id") == F.col("job_id"), "left")
        .select("source_url", "job_title", "status", F.coalesce("skills", F.lit(0)).alias("skills"))
    )


@query
def register_views(spark, d):
    files.register_views(t.jobs(spark, d), t.job_skills(spark, d))
    return spark.sql("""
        select j.department, s.skill_category, count(*) as cnt, max(j.salary_max) as top_salary
        from job_skills s join jobs j on j.id = s.job_id
        group by j.department, s.skill_category""")


# ---------------------------------------------------------------- routing


@query
def route_source(spark, d):
    return planted_pages(spark, d).select("page_id", urls.route_source(F.col("url")).alias("site"))


@query
def host_predicates(spark, d):
    url = F.col("url")
    return planted_pages(spark, d).select(
        "page_id", urls.is_wellfound(url).alias("wellfound"), urls.is_rocketship(url).alias("rocketship"),
        urls.is_linkedin(url).alias("linkedin"),
    )


@query
def board_ids(spark, d):
    ids = planted_pages(spark, d).select("page_id", urls.board_ids(F.col("url")).alias("b"))
    return ids.select("page_id", "b.board_token", "b.job_id", "b.type")


@query
def board_token_from_frames(spark, d):
    frames = F.expr("""array(url, case when page_id % 3 = 0
        then 'https://boards.greenhouse.io/embed/job_app?b=1&for=co' || cast(page_id as string) || '&token=9' else url end)""")
    token = urls.board_token_from_frames(F.col("frames"))
    return t.read(spark, d, "pages").select("page_id", frames.alias("frames")).select(
        "page_id", F.coalesce(token, F.lit("none")).alias("board_token")
    )


@query
def board_links(spark, d):
    frame = F.expr("""case when page_id % 2 = 0 then '<iframe src="https://boards.greenhouse.io/embed/job_app?for=co'
        || cast(page_id as string) || '&amp;token=1"></iframe>' else '' end""")
    embedded = F.expr("'https://careers.example.com/jobs?gh_jid=' || cast(page_id as string)")
    source = t.spread(spark, d, "pages").select(
        "page_id", embedded.alias("url"), F.replace("html", F.lit("<nav>"), F.concat(frame, F.lit("<nav>"))).alias("html")
    )
    return pages.board_links(source).select("page_id", "job_id", F.coalesce("board_token", F.lit("none")).alias("board_token"))


# ---------------------------------------------------------------- pages to text


def one_space(col):
    return F.trim(F.regexp_replace(col, r"[ \t\n\r\f]+", " "))


@query
def page_text(spark, d):
    out = pages.page_text(t.spread(spark, d, "pages").select("page_id", "html"))
    return out.select("page_id", one_space(F.col("text")).alias("text"))


@query
def drop_elements(spark, d):
    source = t.spread(spark, d, "pages").select("page_id", "html")
    return pages.drop_elements(source, ("script", "style", "nav", "footer", '[class*="ad"]'))


@query
def first_field(spark, d):
    found = pages.site_fields(pages.page_candidates(
        planted_pages(spark, d).withColumn("site", F.lit("wellfound"))
    ))
    return found.select("page_id", "title", "salary", "location")


@query
def wellfound_text(spark, d):
    return pages.wellfound_text(site_pages(spark, d, "https://wellfound.com/jobs/")).select("page_id", "text")


@query
def rocketship_text(spark, d):
    source = site_pages(spark, d, "https://www.remoterocketship.com/company/")
    return pages.rocketship_text(source).select("page_id", "text")


@query
def linkedin_text(spark, d):
    return pages.linkedin_text(site_pages(spark, d, "https://www.linkedin.com/jobs/view/")).select("page_id", "text")


@query
def board_text(spark, d):
    return pages.board_text(board_records(spark, d)).select("title", "url", "text")


@query
def pages_to_text(spark, d):
    """All rule sets together, each page by its own URL."""
    return pages.pages_to_text(planted_pages(spark, d)).select(
        "page_id", "site", one_space(F.col("text")).alias("text")
    )


# Blocks that pages hide, each in another way, and some that only seem to be hidden.
HIDDEN_HTML = """replace(replace(html, '</head>',
  '<style>.gone, #x > .y { display : none } @media print { p { display:none } } .back{display:none}
   article .back { display: block } .quiet { visibility:hidden } b:not(.z):hover{display:none}</style></head>'), '<article>',
  case page_id % 8 when 0 then '<div class="a gone">HIDDEN</div>'
    when 1 then '<p style="color:red; display: none">HIDDEN<b>HIDDEN</b></p>' when 2 then '<div hidden>HIDDEN</div>'
    when 3 then '<i id="x"><b class="y">HIDDEN</b><b>shown </b></i>' when 4 then '<i class="quiet">HIDDEN<b style="visibility:visible">shown </b></i>'
    when 5 then '<dialog>HIDDEN</dialog>' when 6 then '<div class="gone" style="display:block!important">shown </div>'
    else '<div><i class="quiet" hidden style="display:inline">HIDDEN</i></div>' end
  || '<article><p class="back">back </p>')"""


@query
def hidden_elements(spark, d):
    """Visible text of all pages, without what style sheets, styles and attributes hide."""
    out = pages.page_text(t.spread(spark, d, "pages").select("page_id", F.expr(HIDDEN_HTML).alias("html")))
    return out.select("page_id", one_space(F.col("text")).alias("text"))


SITES = [
    ("acme", "acme.example", None, None, None), ("acme", None, "title", 1, "nav h1, article > p:first-child ~ h1"),
    ("acme", None, "title", 2, "main > div:not(.topcard__flavor) > article:empty"),
    ("acme", None, "title", 3, "div.jobs-description__content[class$='content'] > button + article > h1:first-child"),
    ("acme", None, "salary", 1, "[class^='x_'][class$='__b']"),
    ("acme", None, "company", 1, "main > div.topcard__flavor:first-child ~ div:nth-child(2n + 9)"),
    ("acme", None, "location", 1, "main > :is(div, p)[class~='topcard__flavor']:not(nav *)"),
    ("acme", None, "description", 1, "main:not([hidden]) > .jobs-description__content"),
    ("acme", None, "description_drop", 1, "button, script, style"), ("acme", None, "fallback", 1, "main"),
    ("acme", None, "fallback_drop", 1, "button, .topcard__flavor, [class*='compensation' i]"),
]


@query
def added_site(spark, d):
    """Pages of a site that is added by a table of selectors, without code."""
    source = t.spread(spark, d, "pages").select(
        "page_id", F.concat(F.lit("https://jobs.acme.example/"), F.col("page_id").cast("string")).alias("url"),
        F.expr(t.SITE_HTML).alias("html"),
    )
    table = spark.createDataFrame(SITES, "site string, host string, field string, position int, selector string")
    return pages.pages_to_text(source, table).select("page_id", "site", "text")


@query
def cut_at_marker(spark, d):
    marked = planted_docs(spark, d)
    return marked.select("doc_id", text.cut_at_marker(F.col("text"), "Similar Jobs").alias("text"))


@query
def clean_text(spark, d):
    return pages.clean_text(planted_docs(spark, d))


@query
def clean_linkedin_text(spark, d):
    return pages.clean_linkedin_text(planted_docs(spark, d, t.LINKEDIN_TEXT))


@query
def capture_envelope(spark, d):
    texts = planted_docs(spark, d).select(
        "doc_id", "text", F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.expr("case when doc_id % 2 = 0 then 'linkedin' else 'generic' end").alias("site"),
        F.lit("t").alias("page_title"),
    )
    return pages.capture_envelope(texts).select(
        "doc_id", "text", F.col("contentLength").alias("content_length")
    )


@query
def first_capture(spark, d):
    frames = t.read(spark, d, "conversations").select(
        F.col("conv_id").alias("capture_id"), F.col("turn").alias("ts"), "text", "role"
    )
    return pages.first_capture(frames).select("capture_id", "ts", "text", "role")


@query
def is_complete(spark, d):
    length = text.utf16_length(F.col("text"))
    return planted_docs(spark, d).select("doc_id", pages.is_complete(length).alias("complete"))


# ---------------------------------------------------------------- text to posting

STAMP = "2024-06-01T00:00:00Z"


@query
def build_prompt(spark, d):
    prompt = documents.build_prompt(F.col("text"), text.extract_url(F.col("text")), F.lit(STAMP))
    return planted_docs(spark, d).select("doc_id", F.md5(prompt).alias("prompt_md5"))


FENCED = """case doc_id % 4 when 0 then chr(10) || '```json' || chr(10) || text || '```' || chr(10)
  when 1 then '``` ' || text || ' ``` ' when 2 then '  ' || text else '```json```' || text end"""


@query
def strip_fences(spark, d):
    docs = t.read(spark, d, "documents").select("doc_id", F.expr(FENCED).alias("response"))
    return docs.select("doc_id", text.strip_fences(F.col("response")).alias("text"))


def broken_answers(spark, d) -> DataFrame:
    """Answers as models spoil them, by message number."""
    answers = t.posting_texts(spark, d).withColumn("json", text.strip_fences(F.col("response")))
    return answers.withColumn("json", F.expr("""
        case ingest_seq % 9 when 0 then json || ' done' when 1 then replace(json, '"salary_min":', '"salary_min":1.5,"x":')
             when 2 then '' when 3 then 'null' when 4 then substr(json, 2) when 5 then json || ',' || json
             when 6 then replace(json, '"has_equity":', '"has_equity":"yes","y":') else json end"""))


@query
def parse_posting(spark, d):
    parsed = documents.parse_posting(broken_answers(spark, d))
    ok = F.col("reject_reason").isNull()
    return parsed.select(
        "ingest_seq", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"),
        F.when(ok, F.col("posting.metadata.job_title")).otherwise("").alias("job_title"),
        F.when(ok, F.col("posting.compensation.salary_min")).otherwise(0).alias("salary_min"),
        F.when(ok, F.col("posting.requirements.education_level")).otherwise("").alias("education_level"),
    )


@query
def extract_url(spark, d):
    return planted_docs(spark, d).select("doc_id", text.extract_url(F.col("text")).alias("source_url"))


@query
def resolve_source_url(spark, d):
    given = postings(spark, d).withColumn(
        "source_url", F.expr("case when ingest_seq % 2 = 0 then 'https://given.example/' else '' end")
    )
    return documents.resolve_source_url(given).select("ingest_seq", F.col("posting.source_url").alias("resolved"))


def fake_model(prompts, providers, models):
    """Stands for a model: answers with what it was asked, and how long the prompt was."""
    return [
        '```json\n{"metadata":{"job_title":"%s/%s"},"compensation":{"salary_min":%d}}\n```' % (p, m, len(q))
        for q, p, m in zip(prompts, providers, models)
    ]


@query
def extract_with(spark, d):
    requests = planted_docs(spark, d).select(
        "doc_id", "text",
        F.expr("case when doc_id % 2 = 0 then 'https://given.example/' else '' end").alias("source_url"),
        F.expr("case when doc_id % 3 = 0 then 'perplexity' else '' end").alias("provider"),
        F.expr("case when doc_id % 5 = 0 then 'own-model' else '' end").alias("model"),
    )
    out = documents.accepted(documents.extract_with(requests, fake_model, F.lit(STAMP)))
    return out.select(
        "doc_id", F.col("posting.metadata.job_title").alias("asked"),
        F.col("posting.compensation.salary_min").alias("prompt_chars"), F.col("posting.source_url").alias("resolved"),
    )


class FailingModel:
    """Stands for a model that fails some calls: those with a row of the model `broken`, and answers short for `short`."""

    def __call__(self, prompts, providers, models):
        if "broken" in set(models):
            raise ConnectionError("refused")
        answers = fake_model(prompts, providers, models)
        return answers[:-1] if "short" in set(models) else answers


@query
def extract_isolated(spark, d):
    """All documents through a model that fails every fiftieth call and answers short now and then."""
    requests = planted_docs(spark, d).select(
        "doc_id", F.expr("case when doc_id % 61 = 0 then null else text end").alias("text"),
        F.expr("case when doc_id % 50 = 0 then 'broken' when doc_id % 73 = 1 then 'short' else 'm' end").alias("model"),
    )
    out = write_scratch(documents.extract_with(requests, FailingModel(), F.lit(STAMP)), scratch_dir(spark, "asked"))
    stored = documents.accepted(out).select(
        "doc_id", F.lit("stored").alias("outcome"), F.col("posting.metadata.job_title").alias("asked"),
    )
    refused = documents.rejected(out).select("doc_id", F.col("reject_reason").alias("outcome"), F.lit("").alias("asked"))
    return stored.unionByName(refused)


RULE_TEXT = """text || case doc_id % 7
  when 0 then ' 3-5 years of work, $90,000 - $120,000, 401k and equity' when 1 then ' 5+ years, €80k-100k, ASAP'
  when 2 then ' 7 yrs; GBP 50-60k; pair programming, paid time off' when 3 then ' urgently hiring, take-home test'
  when 4 then ' AWS, Docker and Go; SQL Server or Spring Boot; python, Python' when 5 then ' health insurance, remote stipend'
  else ' C++, C# and Node.js. Hybrid. Degree in physics required' end"""
TITLE = """case doc_id % 8 when 0 then 'Senior Backend Engineer' when 1 then 'Sr. Data Analyst' when 2 then 'Principal iOS Developer'
  when 3 then 'Lead DevOps' when 4 then 'Junior Full-Stack Developer' when 5 then 'Staff Security Engineer'
  when 6 then '' else 'Accountant' end"""


def rule_docs(spark, d) -> DataFrame:
    return t.spread(spark, d, "documents").select(
        "doc_id", F.expr(TITLE).alias("title"), F.expr(RULE_TEXT).alias("text")
    )


@query
def years_experience(spark, d):
    out = rule_docs(spark, d).select("doc_id", rules.years_experience(rules.years_text(F.col("text"), F.lower("text"))).alias("y"))
    return out.select("doc_id", F.col("y.min").alias("years_min"), F.col("y.max").alias("years_max"))


@query
def seniority(spark, d):
    return rule_docs(spark, d).select("doc_id", rules.seniority(F.col("title")).alias("seniority"))


@query
def job_function(spark, d):
    return rule_docs(spark, d).select("doc_id", rules.job_function(F.col("title")).alias("job_function"))


@query
def salary_range(spark, d):
    stated = rule_docs(spark, d).select("doc_id", rules.salary_statement(F.col("text"), F.lower("text")).alias("s"))
    out = stated.select("doc_id", rules.salary_range(F.col("s")).alias("s"))
    return out.select(
        "doc_id", F.col("s.min").alias("salary_min"), F.col("s.max").alias("salary_max"),
        F.col("s.currency").alias("currency"),
    )


@query
def technical_skills(spark, d):
    words = rule_docs(spark, d).select(
        "doc_id", rules.skill_words(F.col("text")).alias("words"), F.lower("text").alias("lower")
    )
    found = words.select("doc_id", rules.known_skills(F.col("words"), F.col("lower")).alias("found"))
    s = found.select("doc_id", rules.skills_by_category(F.col("found")).alias("s"))
    return s.select("doc_id", *[F.array_join(f"s.{f}", "|").alias(f) for f in documents.SKILL_FIELDS])


# Every run of one to three words in the headings of all pages and in all benchmark texts; every fifth counts case.
HEADING = "regexp_extract(html, '<h1>(.*?)</h1>', 1)"


def term_table(spark, d) -> DataFrame:
    headings = t.read(spark, d, "pages").select(F.expr(HEADING).alias("text"))
    whole = headings.unionByName(t.read(spark, d, "benchmark").select("text"))
    words = whole.select(rules.skill_words(F.col("text")).alias("w"))
    runs = words.select("w", F.posexplode("w").alias("i", "_")).select(
        F.explode(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.slice("w", F.col("i") + 1, n))).alias("run")
    )
    terms = runs.select(F.concat_ws(" ", "run").alias("term")).filter("term <> ''").distinct()
    return terms.select(
        "term", F.lower("term").alias("name"),
        F.expr("case when length(term) % 2 = 0 then 'databases' else 'other' end").alias("category"),
        F.expr("length(term) % 5 = 0").alias("exact"),
    )


@query
def match_terms(spark, d):
    """Terms of a dictionary of tens of thousands that stand in all documents."""
    texts = t.spread(spark, d, "documents").select("doc_id", "text")
    parts = t.tasks(spark, texts.count(), each=10_000)  # each text is much work
    found = skills.match_terms(texts, term_table(spark, d), parts=parts)
    return found.groupBy("doc_id", "category").agg(
        F.count(F.lit(1)).alias("names"), F.sum("cnt").alias("hits"), F.sum("place").cast("bigint").alias("places"),
        F.min("name").alias("first_name"),
    )


@query
def flags(spark, d):
    docs = rule_docs(spark, d).withColumn("lower", F.lower("text"))
    return docs.select("doc_id", rules.flags(F.col("text"), F.col("lower")).alias("f")).select("doc_id", "f.*")


@query
def urgency(spark, d):
    return rule_docs(spark, d).select("doc_id", rules.urgency(F.col("text"), F.lower("text")).alias("urgency"))


@query
def rules_extract(spark, d):
    docs = rule_docs(spark, d).select(
        "doc_id", F.concat(F.lit("\nURL: https://x.example/a \n\nJOB TITLE: "), "title",
                           F.lit("\n\nLOCATION: Lyon, France\n\nDESCRIPTION:\n"), "text").alias("text")
    )
    x = documents.rules_extract(docs).select("doc_id", "posting")
    return x.select(
        "doc_id", F.col("posting.metadata.job_title").alias("title"),
        F.col("posting.metadata.seniority_level").alias("seniority"),
        F.col("posting.company_info.location_city").alias("city"),
        F.col("posting.requirements.years_experience_min").alias("years_min"),
        F.col("posting.compensation.salary_max").alias("salary_max"),
        F.col("posting.compensation.has_equity").alias("has_equity"),
        F.col("posting.market_signals.urgency_level").alias("urgency"), F.col("posting.source_url").alias("source_url"),
    )


@query
def skill_count(spark, d):
    required, nice = skill_counts(F.col("posting"))
    return postings(spark, d).select("ingest_seq", required.alias("num_required"), nice.alias("num_nice_to_have"))


# ---------------------------------------------------------------- flatten and explode


@query
def flatten_posting(spark, d):
    rows = documents.flatten_posting(postings(spark, d), keep=("ingest_seq",))
    return rows.drop("extracted_at").withColumn(
        "raw_json", F.get_json_object("raw_json", "$.company_info.company_name")
    )


@query
def join_lists(spark, d):
    p = "posting."
    return postings(spark, d).select(
        "ingest_seq",
        join_list(F.col(p + "role_details.key_responsibilities"), documents.LIST_BREAK).alias("key_responsibilities"),
        join_list(F.col(p + "compensation.benefits"), ", ").alias("benefits"),
        join_list(F.col(p + "requirements.soft_skills"), ", ").alias("soft_skills"),
        join_list(F.col(p + "requirements.nice_to_have"), "; ").alias("nice_to_have"),
    )


@query
def explode_skills(spark, d):
    rows = documents.explode_skills(postings(spark, d), "ingest_seq")
    return rows.select("job_id", "skill_name", "skill_category", "is_required")


@query
def flat_skill_list(spark, d):
    return postings(spark, d).select("ingest_seq", F.array_join(flat_skills(F.col("posting")), "|").alias("skills"))


# ---------------------------------------------------------------- changes


def upserted(spark, d) -> tuple[DataFrame, DataFrame]:
    """Jobs and skills after two batches: all messages, then all again with changed values and some new URLs."""
    sent = write_scratch(postings(spark, d), scratch_dir(spark, "sent"))
    again = second_batch(sent)
    empty = spark.createDataFrame([], JOBS_SCHEMA)
    first = changes.upsert_jobs(empty, documents.flatten_posting(sent, ("ingest_seq",)), moment())
    second = changes.upsert_jobs(
        first, documents.flatten_posting(again, ("ingest_seq",)), moment("2024-06-02 00:00:00")
    )
    no_skills = spark.createDataFrame([], JOB_SKILLS_SCHEMA)
    skills = changes.replace_skills(changes.replace_skills(no_skills, sent), again)
    return second, skills


def second_batch(sent: DataFrame) -> DataFrame:
    p = F.col("posting")
    url = p.source_url
    other = F.when(F.col("ingest_seq") % 3 == 0, F.concat(url, F.lit("/new"))).otherwise(url)
    changed = (
        p.withField("source_url", other)
        .withField("metadata.job_title", F.concat(p.metadata.job_title, F.lit(" II")))
        .withField("company_info.location_city", F.lit("moved"))
        .withField("requirements.technical_skills.databases", F.array(F.lit("moved db")))
    )
    return sent.select("ingest_seq", changed.alias("posting"))


@query
def upsert_jobs(spark, d):
    jobs, _ = upserted(spark, d)
    return jobs.select(
        "source_url", "job_title", "company_name", "salary_min", "salary_max", "location_city", "salary_currency",
        "extracted_at_raw", "status", F.get_json_object("raw_json", "$.company_info.location_city").alias("raw_city"),
        F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"),
    )


@query
def replace_skills(spark, d):
    jobs, skills = upserted(spark, d)
    named = jobs.select(F.col("id").alias("job_id"), "source_url")
    return skills.join(named, "job_id").select("source_url", "skill_name", "skill_category")


def tracked_jobs(spark, d) -> DataFrame:
    return t.jobs(spark, d).select("id", "status", "notes", "rating").withColumn("updated_at", moment("2024-01-01"))


def tracked(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "status", F.coalesce("notes", F.lit("-")).alias("notes"),
        F.coalesce("rating", F.lit(-1).cast("bigint")).alias("rating"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"),
    )


@query
def update_status(spark, d):
    return tracked(changes.update_status(tracked_jobs(spark, d), t.changes(spark, d), moment()))


@query
def update_notes(spark, d):
    return tracked(changes.update_notes(tracked_jobs(spark, d), t.changes(spark, d), moment()))


@query
def update_rating(spark, d):
    return tracked(changes.update_rating(tracked_jobs(spark, d), t.changes(spark, d), moment()))


@query
def apply_patch(spark, d):
    latest = changes.latest_changes(t.changes(spark, d))
    return tracked(changes.apply_patch(tracked_jobs(spark, d), latest, moment()))


@query
def delete_jobs(spark, d):
    gone = changes.latest_changes(t.changes(spark, d)).filter("deleted")
    jobs, skills = changes.delete_jobs(t.jobs(spark, d), t.job_skills(spark, d), gone)
    left = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("cnt")).select(F.lit("jobs").alias("kind"), F.col("status").alias("name"), "cnt")
    rest = skills.groupBy("skill_category").agg(F.count(F.lit(1)).alias("cnt")).select(F.lit("skills").alias("kind"), F.col("skill_category").alias("name"), "cnt")
    return left.unionByName(rest)


@query
def apply_changes(spark, d):
    """Edits and deletes of one change log, ids as given."""
    jobs, _ = changes.apply_changes(tracked_jobs(spark, d), t.job_skills(spark, d), t.changes(spark, d), moment())
    return tracked(jobs)


# ---------------------------------------------------------------- listing and analytics


@query
def list_jobs(spark, d):
    return listing.list_jobs(t.jobs(spark, d))


@query
def list_jobs_by_status(spark, d):
    return listing.list_jobs(t.jobs(spark, d), limit=25, offset=50, status="interview")


@query
def salary_column(spark, d):
    column = salary_text(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"))
    return t.jobs(spark, d).select("id", column.alias("salary_range"))


def stored_jobs(spark, d) -> DataFrame:
    """Jobs whose documents can be opened, keyed by message number."""
    rows = documents.flatten_posting(postings(spark, d), ("ingest_seq",))
    return rows.select(
        F.col("ingest_seq").alias("id"), "status",
        F.expr("case when ingest_seq % 2 = 0 then 'n' else null end").alias("notes"),
        F.expr("case when ingest_seq % 3 = 0 then 4L else null end").alias("rating"), "raw_json",
    )


@query
def get_jobs(spark, d):
    return listing.get_jobs(stored_jobs(spark, d)).select(
        "id", "title", "company", "location", "url", "status", "notes", "rating",
        F.array_join("skills", "|").alias("skills"),
        F.col("extracted.market_signals.urgency_level").alias("urgency"),
    )


@query
def search_jobs(spark, d):
    return listing.search_jobs(t.jobs(spark, d), "machinery%LOW")


TERMS = ["machinery%LOW", "a_er#0000001", "uild", "5", "o_e%d s", "%", "hou%hold 1-u%gent"]


@query
def search_indexed(spark, d):
    """Several terms through an index of all jobs: with wildcards, with none, and shorter than three letters."""
    path = scratch_dir(spark, "index")
    search_index.write_index(t.jobs(spark, d), path)
    index, found = search_index.read_index(spark, path), None
    for term in TERMS:
        one = search_index.search_indexed(t.jobs(spark, d), index, term).select(F.lit(term).alias("term"), "id", "title", "status")
        found = one if found is None else found.unionByName(one)
    return found


@query
def read_pages_by_position(spark, d):
    """The first, the third and a far page of the listing and of one status, read from a layout by position."""
    path = scratch_dir(spark, "positions")
    jobs = t.jobs(spark, d)
    pages_index.write_listing(jobs, path + "/all", rows=5000)
    pages_index.write_listing(jobs, path + "/status", by_status=True, rows=2000)
    found = None
    for page in (0, 2, 140):
        for status in (None, "interview"):
            where, rows = (path + "/all", 5000) if status is None else (path + "/status", 2000)
            one = pages_index.read_page(spark, where, page, 10, status, rows)
            one = one.select(F.lit(page).alias("page"), F.lit(status or "all").alias("part"), "id", "title", "status", "salary_range")
            found = one if found is None else found.unionByName(one)
    return found


@query
def filter_listing(spark, d):
    whole = t.jobs(spark, d).select("id", F.col("job_title").alias("title"), F.col("company_name").alias("company"), "status")
    return listing.filter_listing(whole, "Build", "offer")


@query
def job_stats(spark, d):
    return analytics.job_stats(t.jobs(spark, d))


@query
def top_skills(spark, d):
    return analytics.top_skills(t.job_skills(spark, d), 20)


@query
def top_skills_by_category(spark, d):
    return analytics.top_skills_by_category(t.job_skills(spark, d), "database", 15)


@query
def top_skills_all_categories(spark, d):
    return analytics.top_skills_all_categories(t.job_skills(spark, d))


@query
def skills_by_status(spark, d):
    return analytics.skills_by_status(t.jobs(spark, d), t.job_skills(spark, d))


@query
def skill_locations(spark, d):
    return analytics.skill_locations(t.jobs(spark, d), t.job_skills(spark, d), SKILL, 10)


@query
def top_job_titles(spark, d):
    return analytics.top_job_titles(t.jobs(spark, d))


@query
def analytics_parts(spark, d):
    """The analytics bundle as one table."""
    return as_one_table(analytics_bundle(t.jobs(spark, d), t.job_skills(spark, d)))


@query
def counts_kept(spark, d):
    """The analytics bundle from counts, after a change log that came in two batches."""
    jobs, job_skills = t.jobs(spark, d), t.job_skills(spark, d)
    log = t.changes(spark, d)
    kept = write_scratch(counts.job_counts(jobs, job_skills), scratch_dir(spark, "counts"))
    rows = jobs.withColumn("updated_at", moment("2024-01-01"))
    half = F.col("seq") % 2 == 0
    for part in (log.filter(half), log.filter(~half)):
        rows, job_skills, kept = counts.apply_and_count(rows, job_skills, part, kept, moment())
        kept = write_scratch(kept, scratch_dir(spark, "counts"))
    return as_one_table(counts.bundle_of(kept))


def as_one_table(parts: dict[str, DataFrame]) -> DataFrame:
    stats = parts["status_stats"].unpivot(
        [], ["total", "saved", "applied", "interview", "offer", "rejected"], "name", "cnt"
    ).select(F.lit("status").alias("part"), F.lit("").alias("grp"), "name", "cnt")
    category = parts["skills_by_category"].select(F.lit("category"), "skill_category", "skill_name", "cnt")
    by_status = parts["skills_by_status"].select(F.lit("by_status"), "status", "skill_name", "cnt")
    titles = parts["top_job_titles"].select(F.lit("title"), F.lit(""), "job_title", "cnt")
    return stats.union(category).union(by_status).union(titles)


@query
def skill_status_matrix(spark, d):
    return analytics.skill_status_matrix(analytics.skills_by_status(t.jobs(spark, d), t.job_skills(spark, d)))


@query
def summary_line(spark, d):
    return analytics.summary_line(t.jobs(spark, d))


@query
def job_report(spark, d):
    return listing.job_report(listing.get_jobs(stored_jobs(spark, d))).select(
        "id", "title", "subtitle", "skills", "responsibilities", "experience", "education", "salary", "benefits",
        "urgency", "interview_rounds", "equity", "remote_friendly", "team_structure",
    )


@query
def category_labels(spark, d):
    return listing.category_labels(listing.get_jobs(stored_jobs(spark, d)))


# ---------------------------------------------------------------- streams


def full_skills(spark, d) -> DataFrame:
    return t.job_skills(spark, d).select(
        F.lit(0).cast("bigint").alias("id"), "job_id", "skill_name", "skill_category", F.lit(True).alias("is_required")
    )


def _answers(captures: DataFrame) -> DataFrame:
    return documents.parse_posting(captures.withColumn("json", text.strip_fences(F.col("text"))))


@query
def ingest_stream(spark, d):
    """All messages as captures, then all again with changed values, each drained by the same stream."""
    base = scratch_dir(spark, "ingest")
    store = JobStore(spark, base + "/store")
    sent = write_scratch(postings(spark, d), scratch_dir(spark, "sent"))
    for turn, batch in enumerate((sent, second_batch(sent))):
        # What is sent again has numbers of its own: a number that is known is a message that is known.
        number = (F.col("ingest_seq") + F.lit(turn << 40)).alias("capture_id")
        # Texts of one shape take a tenth of the space as gzip; one file per task, each read by one task.
        sent_texts = batch.select(documents.posting_json(F.col("posting")).alias("text"), number)
        sent_texts.write.mode("append").option("compression", "gzip").json(base + "/captures")
        streams.ingest_stream(
            files.stream_captures(spark, base + "/captures"), _answers, store, base + "/checkpoint", "capture_id",
            lambda refused: refused.write.mode("append").parquet(base + "/refused"), now=moment(), available_now=True,
        ).awaitTermination()
    per_job = skills_per_job(store)
    return store.jobs().join(per_job, F.col("id") == F.col("job_id"), "left").select(
        "source_url", "job_title", "salary_min", "location_city", "status", "skills"
    )


PERIOD = 1800


def streamed_captures(spark, d) -> DataFrame:
    return t.read(spark, d, "events").select(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("capture_id"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("text"),
    )


@query
def first_capture_stream(spark, d):
    base = scratch_dir(spark, "first")
    streamed_captures(spark, d).write.json(base + "/captures")
    first = streams.first_capture_stream(
        files.stream_captures(spark, base + "/captures"), period=PERIOD, lateness="1 hour"
    )
    first.writeStream.format("parquet").option("path", base + "/out").option(
        "checkpointLocation", base + "/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(first.schema).parquet(base + "/out").select("url", "capture_id", "text")


# Events of users as captures of pages of known and other sites, a third of them on one page, drawn together in time so
# that periods overlap. Some are complete, some have no length.
PAGE_URL = """case when user_id % 3 = 0 then 'https://www.linkedin.com/jobs/view/1'
  when user_id % 3 = 1 then 'https://wellfound.com/jobs/' || cast(user_id % 50 as string)
  else 'https://x.example/' || cast(user_id % 50 as string) end"""
PAGE_LENGTH = "case when event_id % 7 = 0 then 900 when event_id % 5 = 0 then null else event_id % 501 end"
SLOWER = 2000


@query
def capture_periods_stream(spark, d):
    """First captures in periods as each page's site asks for, 15 or 20 seconds, ended early by complete captures."""
    base = scratch_dir(spark, "periods")
    t.read(spark, d, "events").select(
        F.expr(PAGE_URL).alias("url"), F.col("event_id").alias("capture_id"), F.col("props").alias("text"),
        F.expr(PAGE_LENGTH).cast("bigint").alias("contentLength"),
        F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / SLOWER)).alias("ts"),
    ).write.json(base + "/captures")
    first = streams.first_capture_stream(files.stream_captures(spark, base + "/captures"), lateness="1 day")
    first.writeStream.format("parquet").option("path", base + "/out").option(
        "checkpointLocation", base + "/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(first.schema).parquet(base + "/out").select("url", "capture_id", F.col("contentLength").alias("length"))


@query
def tracking_stream(spark, d):
    base = scratch_dir(spark, "tracking")
    store = JobStore(spark, base + "/store")
    store.write(t.all_columns(t.jobs(spark, d)), full_skills(spark, d))
    # The store numbers jobs by their URL.
    log = t.changes(spark, d)
    log.withColumn("id", changes.job_id(F.concat(F.lit("https://jobs.example.com/"), F.col("id").cast("string")))) \
        .write.options(compression="gzip", maxRecordsPerFile=files.LINES_PER_FILE).json(base + "/changes")
    incoming = spark.readStream.schema(log.schema).json(base + "/changes")
    streams.tracking_stream(incoming, store, base + "/checkpoint", now=moment(), available_now=True).awaitTermination()
    per_job = skills_per_job(store)
    return store.jobs().join(per_job, F.col("id") == F.col("job_id"), "left").select(
        "source_url", "status", F.coalesce("notes", F.lit("-")).alias("notes"),
        F.coalesce("rating", F.lit(-1).cast("bigint")).alias("rating"), F.coalesce("skills", F.lit(0)).alias("skills"),
    )
