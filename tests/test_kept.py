"""Counts kept up to date, the search index and the listing by position."""

import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from vacanta.operators import analytics, counts, listing
from vacanta.operators.changes import apply_changes
from vacanta.schemas import CHANGE_SCHEMA
from vacanta.sources import pages_index, search_index

NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)


def tables(spark, rng, n=200):
    status = ["saved", "applied", "interview", "odd", ""]
    jobs = [(i, rng.choice(status), rng.choice(["", "Dev", "Ops", None]), None, None, None) for i in range(n)]
    skills = [(rng.randint(0, n + 20), rng.choice("abc"), rng.choice(["database", "other"])) for _ in range(3 * n)]
    skills += [(7, "hot", "cloud")] * n  # one job holds a third of all rows
    jobs = spark.createDataFrame(jobs, "id long, status string, job_title string, notes string, rating long, updated_at timestamp")
    return jobs, spark.createDataFrame(skills, "job_id long, skill_name string, skill_category string")


def plain(df):
    return sorted(map(tuple, df.select(*counts.KEY, "cnt").collect()), key=str)


def test_counts_after_any_log_are_those_from_scratch(spark):
    rng = random.Random(1)
    jobs, skills = tables(spark, rng)
    kept = counts.job_counts(jobs, skills)
    for batch in range(3):
        log = [
            (rng.choice([rng.randint(0, 260), 7, None]), s if s % 9 else None, rng.choice(["update"] * 9 + ["delete", None]),
             rng.choice(["saved", "offer", "", None, "odd"]), rng.choice(["n", None]), None)
            for s in range(120)
        ]
        changes = spark.createDataFrame(log, CHANGE_SCHEMA)
        jobs, skills, kept = counts.apply_and_count(jobs, skills, changes, kept, NOW)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        jobs = spark.createDataFrame(jobs.collect(), jobs.schema)
        skills = spark.createDataFrame(skills.collect(), skills.schema)
        assert plain(kept) == plain(counts.job_counts(jobs, skills)), batch
    assert counts.stats_of(kept).collect() == analytics.job_stats(jobs).collect()
    assert sorted(counts.skills_by_status_of(kept, 2).collect()) == sorted(analytics.skills_by_status(jobs, skills, 2).collect())
    assert sorted(counts.top_skills_of(kept).collect()) == sorted(analytics.top_skills_all_categories(skills).collect())
    assert counts.top_titles_of(kept).collect() == analytics.top_job_titles(jobs).collect()


def test_only_skills_of_jobs_that_move_are_asked_for(spark):
    jobs, skills = tables(spark, random.Random(2))
    log = spark.createDataFrame([(7, 1, "update", "offer", None, None), (8, 1, "update", None, "n", None)], CHANGE_SCHEMA)
    moved = counts.transitions(jobs, log)
    assert [r.job_id for r in moved.collect()] == [7]
    own = skills.join(moved, "job_id", "left_semi")
    assert plain(counts.count_changes(moved, own)) == plain(counts.count_changes(moved, skills))


def test_a_store_gives_the_skills_of_jobs(spark, tmp_path):
    from tests.test_store_and_streams import FIRST, SECOND, ingest
    from vacanta.sources.store import JobStore

    store = JobStore(spark, str(tmp_path / "s"), buckets=4)
    ingest(spark, [*FIRST, *SECOND], store)
    kept = counts.job_counts(store.jobs(), store.skills()).collect()
    kept = spark.createDataFrame(kept, "kind string, status string, category string, name string, cnt long")
    job = store.jobs().filter("source_url = 'a'").first().id
    log = spark.createDataFrame([(job, 1, "update", "offer", None, None)], CHANGE_SCHEMA)
    moved = spark.createDataFrame(counts.transitions(store.jobs(), log).collect(), "job_id long, old string, new string, job_title string, deleted boolean")
    kept = counts.add_up(kept, counts.count_changes(moved, store.skills_of(moved))).collect()
    store.apply_changes(log, NOW)
    assert sorted(kept) == sorted(counts.job_counts(store.jobs(), store.skills()).select(*counts.KEY, "cnt").collect())


def searched(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abÄßx%_ \\") for _ in range(rng.randint(0, 12)))
    rows = [(i, word(), None if i % 7 == 0 else word().upper(), word(), rng.choice([None, NOW])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, job_title string, company_name string, location_full string, extracted_at timestamp")
    return df.withColumns({c: F.lit("w") for c in ("workplace_type", "status", "source_url")})


def test_the_index_finds_what_a_scan_finds(spark, tmp_path):
    jobs = searched(spark)
    search_index.write_index(jobs, str(tmp_path / "i"), folders=8)
    index = search_index.read_index(spark, str(tmp_path / "i"))
    terms = ["abx", "AB", "ab%xa", "a_b", "ÄßX", "x  ", "%", "", "bab_abx%a", "\\ab", "nothing here", "äß"]
    for term in terms:
        want = listing.search_jobs(jobs, term, 1000).collect()
        assert search_index.search_indexed(jobs, index, term, 1000, folders=8).collect() == want, term
    assert search_index.wanted_pieces("aBcd%xy_zzz") == ["abc", "bcd", "zzz"]


def test_only_matching_postings_are_read(spark, tmp_path):
    jobs = searched(spark)
    search_index.write_index(jobs, str(tmp_path / "i"), folders=8)
    found = search_index.candidates(search_index.read_index(spark, str(tmp_path / "i")), "abx", 8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "piece" in plan.split("PushedFilters")[1]
    assert len({f.split("folder=")[1].split("/")[0] for f in found.inputFiles()}) >= 1


def paged(spark, n=1000):
    rng = random.Random(4)
    rows = [(i, f"t{i}", rng.choice(["saved", "offer", None, ""]), rng.choice([None, datetime(2024, 1, rng.randint(1, 28))])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, job_title string, status string, extracted_at timestamp")
    none = ["company_name", "location_full", "job_type", "workplace_type", "seniority_level", "department", "salary_currency", "source_url"]
    return df.withColumns({**{c: F.lit("") for c in none}, "salary_min": F.lit(1).cast("long"), "salary_max": F.lit(2).cast("long")})


def test_pages_by_position_are_those_of_the_listing(spark, tmp_path):
    jobs = paged(spark)
    pages_index.write_listing(jobs, str(tmp_path / "a"), rows=64)
    pages_index.write_listing(jobs, str(tmp_path / "s"), by_status=True, rows=64)
    for page, size in ((0, 10), (7, 10), (99, 10), (100, 10), (3, 100)):
        want = listing.list_jobs(jobs, size, page * size).collect()
        assert pages_index.read_page(spark, str(tmp_path / "a"), page, size, rows=64).collect() == want
        want = listing.list_jobs(jobs, size, page * size, "offer").collect()
        assert pages_index.read_page(spark, str(tmp_path / "s"), page, size, "offer", rows=64).collect() == want


def test_files_read_do_not_grow_with_the_page(spark, tmp_path):
    pages_index.write_listing(paged(spark), str(tmp_path / "a"), rows=50)

    for page in (0, 50, 99):
        df = pages_index.read_page(spark, str(tmp_path / "a"), page, 10, rows=50)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "(block#" in plan.split("PartitionFilters")[1] and f"= {page // 5})" in plan
        assert "GreaterThanOrEqual(position" in plan.split("PushedFilters")[1]
        files = {r[0] for r in df.select("id").join(
            spark.read.parquet(str(tmp_path / "a")).select("id", F.input_file_name().alias("f")), "id").select("f").collect()}
        assert len(files) == 1 and f"block={page // 5}/" in files.pop()
