import pytest
from pyspark.sql import functions as F

from vacanta.functions.postings import salary_text
from vacanta.operators import analytics, listing
from vacanta.plans.reports import analytics_bundle
from vacanta.sources.files import register_views


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [
        (1, "Dev", "ACME", "Oslo", "Oslo, NO", "saved", "2024-01-03"), (2, "Dev", "Beta 100%", "", "Lyon", "applied", "2024-01-01"),
        (3, "", "Gamma", None, "Lyon", "applied", None), (4, "Ops", "ÉCLAIR", None, None, "odd", "2024-01-03"),
        (5, None, "a\\b_c", "Oslo", "x", None, "2024-01-02"),
    ]
    df = spark.createDataFrame(
        rows, "id bigint, job_title string, company_name string, location_city string, location_full string, status string, t string"
    )
    return df.withColumns({
        "extracted_at": F.to_timestamp("t"), "salary_min": F.lit(0).cast("bigint"), "salary_max": F.lit(0).cast("bigint"),
        **{n: F.lit("") for n in ("job_type", "workplace_type", "seniority_level", "department", "source_url", "salary_currency")},
    })


@pytest.fixture(scope="module")
def skills(spark):
    rows = [(1, "Go", "other"), (1, "Go", "other"), (2, "Go", "cloud"), (2, "SQL", "other"), (3, "SQL", "other"),
            (4, "Go", "other"), (9, "Go", "other"), (9, "C", "framework")]
    return spark.createDataFrame(rows, "job_id bigint, skill_name string, skill_category string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stats_and_summary(spark, jobs):
    assert rows(analytics.job_stats(jobs)) == [(5, 1, 2, 0, 0, 0)]
    assert rows(analytics.job_stats(jobs.limit(0))) == [(0, 0, 0, 0, 0, 0)]
    assert rows(analytics.summary_line(jobs)) == [("You have 5 jobs tracked. Applied: 2, Interview: 0, Offer: 0.",)]


def test_top_skills_count_rows_and_keep_orphans(skills):
    assert rows(analytics.top_skills(skills, 2)) == [("Go", "other", 4), ("SQL", "other", 2)]
    assert rows(analytics.top_skills(skills, 1, distinct_jobs=True)) == [("Go", "other", 3)]
    assert rows(analytics.top_skills_by_category(skills, "cloud", 5)) == [("Go", "cloud", 1)]
    assert {r.skill_category for r in analytics.top_skills_all_categories(skills).collect()} == {"other", "cloud"}
    assert "framework" in {r.skill_category for r in analytics.top_skills_all_categories(skills, 5, None).collect()}


def test_by_status_leaves_orphans_out(jobs, skills):
    got = sorted((r.status, r.rank, r.skill_name, r.cnt) for r in analytics.skills_by_status(jobs, skills, 2).collect())
    assert got == [("applied", 1, "SQL", 2), ("applied", 2, "Go", 1), ("odd", 1, "Go", 1), ("saved", 1, "Go", 2)]


def test_matrix_order_and_unknown_status(jobs, skills):
    got = rows(analytics.skill_status_matrix(analytics.skills_by_status(jobs, skills)).drop("sort_key"))
    assert got == [("Go", 2, 1, 0, 0, 0), ("SQL", 0, 2, 0, 0, 0)]


def test_locations(jobs, skills):
    assert rows(analytics.skill_locations(jobs, skills, "Go", 9)) == [("Oslo", 2), ("", 1), ("Unknown", 1)]


def test_titles(jobs):
    assert rows(analytics.top_job_titles(jobs)) == [("Dev", 2), ("Ops", 1)]


def test_large_n_takes_the_salted_way(spark):
    counted = spark.range(5000).select(
        F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("g"), F.col("id").alias("v")
    )
    got = analytics.top_n_per_group(counted, ["g"], [F.desc("v")], 1500)
    assert got.groupBy("g").count().orderBy("g").collect() == [("cold", 1000), ("hot", 1500)]
    assert got.filter("g = 'hot'").agg(F.min("v"), F.max("rank")).first() == (2500, 1500)
    assert got.columns == ["g", "v", "rank"]


def test_one_job_with_a_third_of_all_skills(spark, jobs):
    many = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("job_id"),
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("skill_name"), F.lit("other").alias("skill_category"),
    )
    got = analytics.skills_by_status(jobs, many, 100).filter("status = 'saved'").agg(F.sum("cnt")).first()[0]
    assert got == many.filter("job_id = 1").count()


def test_a_hot_job_is_split_by_the_skew_join(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000",
        "spark.sql.shuffle.partitions": "100",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        many = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("job_id"),
            F.concat(F.lit("skill "), F.col("id") % 50).alias("skill_name"), F.lit("other").alias("skill_category"),
        )
        ids = spark.range(60000).select("id", F.lit("saved").alias("status"))
        got = analytics.skills_by_status(ids, many, 5)
        assert [r.cnt for r in got.collect()] == [1200] * 5
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_bundle(jobs, skills):
    assert {k: v.count() for k, v in analytics_bundle(jobs, skills).items()} == {
        "status_stats": 1, "skills_by_category": 3, "skills_by_status": 4, "top_job_titles": 2,
    }


def test_listing_order_and_paging(jobs):
    assert [r.id for r in listing.list_jobs(jobs).collect()] == [4, 1, 5, 2, 3]
    assert [r.id for r in listing.list_jobs(jobs, limit=2, offset=1).collect()] == [1, 5]
    assert [r.id for r in listing.list_jobs(jobs, status="applied").collect()] == [2, 3]
    assert len(listing.list_jobs(jobs).columns) == 12


def test_salary_text(spark):
    df = spark.createDataFrame([(0, 0, ""), (1, 2, "EUR"), (None, 2, "EUR"), (1, 2, None)], "a bigint, b bigint, c string")
    got = [r[0] for r in df.select(salary_text(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["0-0 ", "1-2 EUR", "", "1-2 "]


@pytest.mark.parametrize("term, ids", [
    ("acme", [1]), ("d_v", [1, 2]), ("100%", [2]), ("", [1, 2, 3, 4, 5]), ("éclair", []), ("Éclair", [4]), ("a\\b", [5]),
    ("LYON", [2, 3]),
])
def test_search(jobs, term, ids):
    assert sorted(r.id for r in listing.search_jobs(jobs, term).collect()) == ids


def test_filter_listing_is_literal(jobs):
    shown = listing.list_jobs(jobs.fillna({"job_title": ""}))
    assert [r.id for r in listing.filter_listing(shown, "100%").collect()] == [2]
    assert [r.id for r in listing.filter_listing(shown, "%").collect()] == [2]
    assert [r.id for r in listing.filter_listing(shown, "éclair").collect()] == [4]
    assert [r.id for r in listing.filter_listing(shown, "dev", "saved").collect()] == [1]
    assert listing.filter_listing(shown).count() == 5


def test_views(spark, jobs, skills):
    register_views(jobs, skills)
    assert spark.sql("select count(*) from job_skills s join jobs j on j.id = s.job_id").first()[0] == 6


def test_plans_use_top_k_and_group_limits(jobs, skills):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(listing.list_jobs(jobs, 5, 5))
    assert "TakeOrderedAndProject" in plan(analytics.top_skills(skills, 5))
    by_status = plan(analytics.skills_by_status(jobs, skills))
    assert "WindowGroupLimit" in by_status and "partial_count" in by_status
