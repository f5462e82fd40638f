import json

import pytest
from pyspark.sql import functions as F

from vacanta.functions.postings import skill_counts
from vacanta.operators import documents, listing
from vacanta.schemas import JOBS_SCHEMA, POSTING_SCHEMA
from vacanta.sources import files

FULL = {
    "metadata": {"job_title": "Dev", "department": "Eng"},
    "company_info": {"company_name": "ACME", "location_full": "Oslo, Norway", "location_city": ""},
    "role_details": {"summary": "s", "key_responsibilities": ["one", "two"]},
    "requirements": {
        "years_experience_min": 3,
        "technical_skills": {
            "programming_languages": ["Go", "", "Go"], "frameworks": None, "databases": ["Redis", None],
            "other": ["Git"],
        },
        "soft_skills": ["a", "b"], "nice_to_have": ["c", "d"],
    },
    "compensation": {"salary_min": 10, "benefits": ["x", "y"], "has_equity": True},
    "extracted_at": "2024-05-01T10:00:00+02:00",
    "source_url": "https://x/1",
    "unknown": {"deep": [1, 2]},
}


def parsed(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n bigint, json string")
    return documents.parse_posting(df)


@pytest.mark.parametrize("text, reason", [
    ("{}", None),
    ("null", None),
    (' {"metadata":null} \n', None),
    ('{"metadata":{"job_title":5}}', None),
    ('{"compensation":{"salary_min":1.5}}', "wrong type in a field"),
    ('{"compensation":{"salary_min":"5"}}', "wrong type in a field"),
    ('{"compensation":{"has_equity":"yes"}}', "wrong type in a field"),
    ('{"compensation":{"benefits":"x"}}', "wrong type in a field"),
    ('{"metadata":[]}', "wrong type in a field"),
    ('{"source_url":"a"} thanks', "not a single JSON object"),
    ('{"source_url":"a"},{"source_url":"b"}', "not a single JSON object"),
    ("{'source_url':'a'}", "not a single JSON object"),
    ("[{}]", "not a single JSON object"),
    ("no json", "not a single JSON object"),
    ("", "empty response"),
    (None, "empty response"),
])
def test_parse_outcomes(spark, text, reason):
    (row,) = parsed(spark, text).collect()
    assert row.reject_reason == reason


def test_text_after_a_document_cannot_take_its_place(spark):
    first = '{"source_url":"a"}'
    texts = [first + '],"x":[1', first + "]} x", first + " \n", first + ",", f"{{\"x\":[{first}]}}"]
    got = [(r.reject_reason, r.posting.source_url) for r in parsed(spark, *texts).collect()]
    assert got == [(None, "a"), (None, "a"), (None, "a"), ("not a single JSON object", "a"), (None, "")]


def test_missing_values_become_zero_values(spark):
    (row,) = documents.accepted(parsed(spark, "{}")).collect()
    assert row.posting.metadata.job_title == "" and row.posting.requirements.years_experience_min == 0
    assert row.posting.compensation.has_equity is False and row.posting.compensation.benefits is None


def test_split_keeps_every_row(spark):
    both = parsed(spark, "{}", "x", "{}", "")
    assert documents.accepted(both).count() == 2
    assert sorted(r.n for r in documents.rejected(both).collect()) == [1, 3]


def test_flatten(spark):
    rows = documents.flatten_posting(documents.accepted(parsed(spark, json.dumps(FULL))), ("n",))
    (row,) = rows.collect()
    assert row.key_responsibilities == "one\n• two" and row.benefits == "x, y"
    assert row.soft_skills == "a, b" and row.nice_to_have == "c; d" and row.status == "saved"
    assert str(row.extracted_at) == "2024-05-01 08:00:00" and row.extracted_at_raw == FULL["extracted_at"]
    assert row.company_size == "" and row.salary_max == 0 and row.has_take_home is False
    stored = json.loads(row.raw_json)
    assert stored["requirements"]["technical_skills"]["frameworks"] is None and "unknown" not in stored
    server_side = {"id", "applied_date", "notes", "rating", "created_at", "updated_at"}
    assert set(rows.columns) == set(JOBS_SCHEMA.fieldNames()) - server_side | {"n"}


def test_unreadable_time_is_null(spark):
    texts = ['{"extracted_at":"yesterday"}', "{}"]
    rows = documents.flatten_posting(documents.accepted(parsed(spark, *texts))).collect()
    assert [r.extracted_at for r in rows] == [None, None]


def test_explode_skills(spark):
    rows = documents.explode_skills(documents.accepted(parsed(spark, json.dumps(FULL), "{}")), "n").collect()
    assert [(r.job_id, r.skill_name, r.skill_category, r.is_required) for r in rows] == [
        (0, "Go", "programming_language", True), (0, "Go", "programming_language", True),
        (0, "Redis", "database", True), (0, "Git", "other", True),
    ]
    assert len({r.id for r in rows}) == 4


def test_skill_counts(spark):
    required, nice = skill_counts(F.col("posting"))
    got = documents.accepted(parsed(spark, json.dumps(FULL), "{}")).select("n", required, nice).orderBy("n").collect()
    assert [tuple(r)[1:] for r in got] == [(6, 2), (0, 0)]


def test_prompt_holds_its_three_insertions(spark):
    df = spark.createDataFrame([("50% off %s\nURL: https://x",)], "t string")
    (row,) = df.select(documents.build_prompt(F.col("t"), F.lit("https://x"), F.lit("STAMP"))).collect()
    assert "50% off %s" in row[0] and '"extracted_at": "STAMP"' in row[0] and '"source_url": "https://x"' in row[0]
    shape = row[0].split("Shape of the answer:\n")[1].split("\n\nRules:")[0]
    assert list(json.loads(shape)) == POSTING_SCHEMA.fieldNames()


def test_extract_with_defaults_and_rejects(spark):
    df = spark.createDataFrame(
        [(1, "URL: https://doc", "", "perplexity", ""), (2, "t", "https://set", "other", "m"), (3, "bad", "", "", None)],
        "n bigint, text string, source_url string, provider string, model string",
    )

    def model(prompts, providers, models):
        return [
            "sorry" if "\nbad\n" in p else '```json\n{"source_url":"https://own","metadata":{"job_title":"%s %s"}}```' % (v, m)
            for p, v, m in zip(prompts, providers, models)
        ]

    out = documents.extract_with(df, model, F.lit("now"))
    good = {r.n: r.posting for r in documents.accepted(out).collect()}
    assert good[1].metadata.job_title == "perplexity sonar-pro" and good[1].source_url == "https://own"
    assert good[2].metadata.job_title == "ollama m" and good[2].source_url == "https://set"
    (refused,) = documents.rejected(out).collect()
    assert refused.n == 3 and refused.model == "qwen2.5:7b" and refused.response == "sorry"


def asked(spark, n, model, **options):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(n)] + [(n, None)], "n bigint, text string").coalesce(1)
    out = documents.extract_with(df, model, F.lit("now"), **options).select("n", "reject_reason", "posting.metadata.job_title").collect()
    return {r.n: r.job_title for r in out if r.reject_reason is None}, {r.n: r.reject_reason for r in out if r.reject_reason}


def numbers(prompts):
    return [int(p.split("text ")[1].split()[0]) for p in prompts]


def answer(i):
    return '{"metadata":{"job_title":"t%d"}}' % i


def test_one_failing_call_costs_one_row(spark):
    def model(prompts, providers, models):
        found = numbers(prompts)
        if any(i % 50 == 7 for i in found):
            raise RuntimeError("no quota")
        if 31 in found:
            return [answer(i) for i in found] + ["more"]
        return [None if i == 40 else answer(i) for i in found]

    stored, refused = asked(spark, 200, model, rows=64)
    assert refused == {200: "no text", 31: "model call failed: ValueError: 2 answers to 1 prompts", 40: "empty response", **{
        i: "model call failed: RuntimeError: no quota" for i in (7, 57, 107, 157)}}
    assert stored == {i: f"t{i}" for i in range(200) if i not in refused}


def test_a_late_call_is_given_up(spark):
    def model(prompts, providers, models):
        import time

        found = numbers(prompts)
        if 5 in found:
            time.sleep(30)
        return [answer(i) for i in found]

    stored, refused = asked(spark, 12, model, seconds=0.5, rows=4)
    assert refused == {12: "no text", 5: "model call failed: TimeoutError: no answer in 0.5 s"} and len(stored) == 11


def test_a_model_that_always_fails_refuses_all(spark):
    def model(prompts, providers, models):
        raise SystemExit("gone")

    stored, refused = asked(spark, 5, model, rows=2)
    assert not stored and len(refused) == 6


def test_rules_extract_needs_no_model(spark):
    text = (
        "\nURL: https://x/1\nSOURCE: LinkedIn (Scraped)\n\nJOB TITLE: Senior Backend Engineer\n\nCOMPANY: ACME\n\n"
        "LOCATION: Oslo, Norway\n\nDESCRIPTION:\n5+ years of Go and Kubernetes. €80k-100k. Remote. ASAP."
    )
    (row,) = documents.rules_extract(spark.createDataFrame([(text,)], "text string")).collect()
    p = row.posting
    assert (p.metadata.seniority_level, p.metadata.job_function) == ("Senior", "Backend")
    assert (p.company_info.company_name, p.company_info.location_city) == ("ACME", "Oslo")
    assert (p.requirements.years_experience_min, p.requirements.years_experience_max) == (5, 0)
    assert p.requirements.technical_skills.devops_tools == ["Kubernetes"]
    assert (p.compensation.salary_min, p.compensation.salary_max, p.compensation.salary_currency) == (80000, 100000, "EUR")
    assert p.work_arrangement.is_remote_friendly and p.market_signals.urgency_level == "Urgent"
    assert p.source_url == "https://x/1" and row.posting.__fields__ == POSTING_SCHEMA.fieldNames()


def test_posting_files(spark, tmp_path):
    for i, text in enumerate([json.dumps(FULL, indent=2), "broken"]):
        (tmp_path / f"{i}.json").write_text(text)
    read = files.read_postings(spark, str(tmp_path))
    assert documents.accepted(read).count() == 1 and documents.rejected(read).count() == 1
    files.write_postings(documents.accepted(read), str(tmp_path / "out"))
    again = documents.accepted(files.read_postings(spark, str(tmp_path / "out"), whole_files=False))
    assert again.select("posting").collect() == documents.accepted(read).select("posting").collect()


def stored(spark, doc, **tracking):
    rows = documents.flatten_posting(documents.accepted(parsed(spark, json.dumps(doc))))
    return rows.select(
        F.lit(1).cast("bigint").alias("id"), "status", F.lit(tracking.get("notes")).cast("string").alias("notes"),
        F.lit(tracking.get("rating")).cast("bigint").alias("rating"), "raw_json",
    )


def test_get_job(spark):
    (job,) = listing.get_job(stored(spark, FULL), 1).collect()
    assert (job.title, job.company, job.location, job.notes, job.rating) == ("Dev", "ACME", "Oslo, Norway", "", 0)
    assert job.skills == ["Go", "", "Go", "Redis", "", "Git"] and job.extracted.role_details.summary == "s"
    with pytest.raises(Exception, match="no job 2"):
        listing.get_job(stored(spark, FULL), 2).collect()
    ids = spark.createDataFrame([(1,), (1,), (9,)], "id bigint")
    assert listing.get_jobs(stored(spark, FULL), ids).count() == 1


def test_report_defaults(spark):
    (r,) = listing.job_report(listing.get_jobs(stored(spark, {}))).collect()
    assert (r.title, r.subtitle) == ("Untitled role", "Unknown company · Location not set")
    assert (r.skills, r.salary, r.urgency, r.interview_rounds) == ("None extracted", "Not specified", "Standard", "0")
    assert (r.responsibilities, r.experience, r.equity, r.team_structure) == ("—", "0–0 years", "No", "—")
    (r,) = listing.job_report(listing.get_jobs(stored(spark, FULL, notes="n"))).collect()
    assert (r.salary, r.responsibilities, r.equity, r.notes) == ("10–0", "• one\n• two", "Yes", "n")


def test_category_labels(spark):
    rows = listing.category_labels(listing.get_jobs(stored(spark, FULL))).orderBy("position").collect()
    assert [(r.label, r.names) for r in rows] == [
        ("Programming languages", "Go, , Go"), ("Databases", "Redis, "), ("Other", "Git"),
    ]
