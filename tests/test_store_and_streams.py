import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from vacanta.functions.text import strip_fences
from vacanta.operators import changes, documents, listing, pages
from vacanta.plans.ingest import ingest_batch
from vacanta.plans.reports import analytics_bundle
from vacanta.schemas import CAPTURE_SCHEMA, CHANGE_SCHEMA
from vacanta.sources import files
from vacanta.sources.store import JobStore
from vacanta.streaming import streams

NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)


def captures(spark, *rows):
    return spark.createDataFrame(
        [(json.dumps(doc) if isinstance(doc, dict) else doc, seq) for seq, doc in rows], "text string, capture_id bigint"
    )


def doc(url, title, *skills):
    return {"source_url": url, "metadata": {"job_title": title}, "requirements": {"technical_skills": {"other": list(skills)}}}


def answers(df):
    return documents.parse_posting(df.withColumn("json", strip_fences(F.col("text"))))


def content(store):
    names = store.jobs().select(F.col("id").alias("job_id"), "source_url", "job_title", "status", "notes")
    jobs = sorted((r.source_url, r.job_title, r.status, r.notes or "") for r in names.collect())
    skills = sorted((r.source_url, r.skill_name) for r in store.skills().join(names, "job_id").collect())
    return jobs, skills


def ingest(spark, rows, store, extract=None):
    ingest_batch(captures(spark, *rows), extract or answers, store, NOW, "capture_id", lambda df: df.count())


FIRST = [(1, doc("a", "A1", "x")), (2, doc("b", "B1", "y", "y")), (3, "broken"), (4, doc("a", "A2", "z"))]
SECOND = [(5, doc("b", "B2")), (6, doc("c", "C1", "w"))]
WANT = (
    [("a", "A2", "saved", ""), ("b", "B2", "saved", ""), ("c", "C1", "saved", "")],
    [("a", "z"), ("c", "w")],
)


def test_batches_build_the_same_store_as_one(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "s"))
    assert store.jobs().count() == 0
    refused = []
    ingest_batch(captures(spark, *FIRST), answers, store, NOW, "capture_id", lambda df: refused.extend(df.collect()))
    assert [r.capture_id for r in refused] == [3]
    ingest(spark, SECOND, store)
    assert content(store) == WANT
    assert content(JobStore(spark, str(tmp_path / "s"))) == WANT
    whole = JobStore(spark, str(tmp_path / "w"))
    ingest(spark, [*FIRST, *SECOND], whole)
    assert content(whole) == WANT


def sizes(root):
    return {f: f.stat().st_size for f in root.rglob("*.parquet")}


def test_a_batch_costs_its_own_size(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "s"))
    ingest(spark, [(i, doc(f"u{i}", "t", "s")) for i in range(400)], store)
    before = sizes(tmp_path / "s" / "jobs")
    job = store.jobs().filter("source_url = 'u7'").first().id
    edit = spark.createDataFrame([(job, 1, "update", "offer", "n", None), (5, 2, "update", "offer", "n", None)], CHANGE_SCHEMA)
    store.apply_changes(edit, NOW)
    ingest(spark, [(401, doc("u7", "new"))], store)
    # Only the buckets of the ids named were written again.
    changed = {f.parent.name for f in before.keys() ^ sizes(tmp_path / "s" / "jobs").keys()}
    assert changed == {f"bucket={job % store.buckets()}", f"bucket={5 % store.buckets()}"}
    assert store.jobs().count() == 400
    row = store.find(job).first()
    assert (row.source_url, row.job_title, row.status, row.notes) == ("u7", "new", "offer", "n")
    assert store.find(job + 1).count() == 0 and store.skills().count() == 399
    copy = store.copy_to(str(tmp_path / "c"), buckets=3)
    assert content(copy) == content(store) and copy.skills().count() == 399
    assert JobStore(spark, str(tmp_path / "c")).buckets() == 3 and copy.find(job).first().source_url == "u7"


def test_find_and_merges_read_one_bucket(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "s"), buckets=8)
    ingest(spark, [(i, doc(f"u{i}", "t", "s")) for i in range(100)], store)
    job = store.jobs().filter("source_url = 'u7'").first().id
    for df in (store.find(job), store._read("jobs", [job % 8])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan, plan
        assert {f"bucket={job % 8}"} == {f.split("/")[-2] for f in df.inputFiles()} or df.count() < 40
    assert store.find(job).count() == 1
    # Plain Parquet: any reader sees the columns of the table.
    assert spark.read.parquet(str(tmp_path / "s" / "jobs")).filter("not _deleted").count() == 100


def change(store, spark, *rows):
    store.apply_changes(spark.createDataFrame(list(rows), CHANGE_SCHEMA), NOW)


def test_numbers_order_edits_not_clocks_or_batches(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "s"))
    ingest(spark, [(200, doc("a", "A200", "x"))], store)
    job = store.jobs().first().id
    change(store, spark, (job, 150, "update", "offer", None, None))
    assert store.find(job).first().status == "offer"
    # A later batch with an earlier edit, and the same batch again.
    change(store, spark, (job, 140, "update", "rejected", "early", None))
    change(store, spark, (job, 150, "update", "offer", None, None))
    row = store.find(job).first()
    assert (row.status, row.notes) == ("offer", "early")
    # A late posting gives what only first postings give, an early one replaces nothing.
    late = doc("a", "A100", "old")
    late["company_info"] = {"location_city": "Lyon"}
    ingest(spark, [(100, late)], store)
    row = store.find(job).first()
    assert (row.job_title, row.location_city, row.status) == ("A200", "Lyon", "offer")
    assert [r.skill_name for r in store.skills().collect()] == ["x"]
    # Deleted, sent again as it was, then really sent again.
    change(store, spark, (job, 160, "delete", None, None, None))
    ingest(spark, [(100, late), (200, doc("a", "A200", "x"))], store)
    assert store.jobs().count() == 0 and store.skills().count() == 0
    ingest(spark, [(201, doc("a", "A201", "y")), (150, doc("a", "A150"))], store)
    change(store, spark, (job, 155, "update", "interview", None, None), (job, 160, "delete", None, None, None))
    row = store.find(job).first()
    assert (row.job_title, row.status, row.notes) == ("A201", "saved", None)
    change(store, spark, (job, 161, "update", "applied", None, 5), (None, 162, "delete", None, None, None))
    row = store.find(job).first()
    assert (row.status, row.rating) == ("applied", 5) and [r.skill_name for r in store.skills().collect()] == ["y"]


def test_a_batch_between_its_two_writes_is_not_seen(spark, tmp_path, monkeypatch):
    store = JobStore(spark, str(tmp_path / "s"))
    ingest(spark, FIRST, store)
    want, whole = content(store), JobStore._replace

    def fails(self, table, rows):
        if table == "jobs":
            raise RuntimeError("lost")
        whole(self, table, rows)

    monkeypatch.setattr(JobStore, "_replace", fails)
    with pytest.raises(RuntimeError):
        ingest(spark, SECOND, store)
    monkeypatch.undo()
    assert content(store) == want
    ingest(spark, SECOND, store)
    assert content(store) == WANT


def test_a_failed_second_writer_harms_nothing(spark, tmp_path):
    one, two = (JobStore(spark, str(tmp_path / "s")) for _ in range(2))
    ingest(spark, FIRST, one)
    want = content(one)
    with pytest.raises(Exception, match="broken model"):
        broken = F.when(F.col("capture_id") > 0, F.raise_error(F.lit("broken model"))).otherwise(F.col("text"))
        ingest(spark, SECOND, two, lambda df: answers(df.withColumn("text", broken)))

    def refuse(df):
        raise RuntimeError("no place for rejects")

    with pytest.raises(RuntimeError):
        ingest_batch(captures(spark, *SECOND), answers, two, NOW, "capture_id", refuse)
    assert content(JobStore(spark, str(tmp_path / "s"))) == want
    # Both go on, and see each other's batches.
    ingest(spark, SECOND, two)
    assert content(one) == WANT


def test_a_delete_ends_what_came_before(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "s"))
    ingest(spark, FIRST, store)
    ids = {r.source_url: r.id for r in store.jobs().collect()}
    early = [(ids["a"], 1, "update", "offer", "old", 1), (999, 1, "update", "offer", None, None)]
    store.apply_changes(spark.createDataFrame(early, CHANGE_SCHEMA), NOW)
    store.apply_changes(spark.createDataFrame([(ids["a"], 1, "delete", None, None, None)], CHANGE_SCHEMA), NOW)
    assert content(store)[0] == [("b", "B1", "saved", "")]
    ingest(spark, [(9, doc("a", "A9", "n"))], store)
    assert content(store) == ([("a", "A9", "saved", ""), ("b", "B1", "saved", "")], [("a", "n"), ("b", "y"), ("b", "y")])


def test_nothing_is_lost_on_the_way_in(spark, tmp_path):
    lines = [json.dumps({"text": json.dumps(doc("a", "A")), "capture_id": 1}), "{broken", json.dumps({"capture_id": 2}),
             json.dumps({"text": json.dumps(doc("b", "B"))}), json.dumps({"text": "none", "capture_id": 4})]
    (tmp_path / "in.json").write_text("\n".join(lines))
    store, refused = JobStore(spark, str(tmp_path / "s")), []
    read = files.read_captures(spark, str(tmp_path / "in.json"))
    ingest_batch(read, answers, store, NOW, "capture_id", lambda df: refused.extend(df.collect()),
                 raw_path=str(tmp_path / "raw"), json_path=str(tmp_path / "json"))
    assert sorted(r.reject_reason for r in refused) == [
        "empty response", "no capture_id", "not a JSON line", "not a single JSON object"]
    assert len(refused) + store.jobs().count() == len(lines) == spark.read.parquet(str(tmp_path / "raw")).count()
    kept = files.read_postings(spark, str(tmp_path / "json"), whole_files=False).collect()
    assert [r.posting.source_url for r in kept] == ["a"]
    with pytest.raises(Exception, match="ingest_seq is NULL"):
        store.upsert(documents.accepted(answers(captures(spark, (1, doc("z", "Z"))))).select(
            F.lit(None).cast("bigint").alias("ingest_seq"), "posting"), NOW)
    assert store.jobs().count() == 1


def test_postings_between_first_and_last_are_left_out_early(spark, tmp_path, monkeypatch):
    from vacanta.sources import store as module

    seen = []

    def explode_skills(df, *args, **kwargs):
        seen.append(df.select("_of").collect())
        return documents.explode_skills(df, *args, **kwargs)

    monkeypatch.setattr(module, "explode_skills", explode_skills)
    store = JobStore(spark, str(tmp_path / "s"))
    ingest(spark, [(n, doc("a", f"A{n}", f"s{n}")) for n in range(1, 1001)] + [(0, doc("b", "B", "y"))], store)
    assert {0, 1, 1000} <= {r._of for r in seen[0]} and len(seen[0]) < 200
    assert content(store) == ([("a", "A1000", "saved", ""), ("b", "B", "saved", "")], [("a", "s1000"), ("b", "y")])
    # Of a deleted job the first posting that counts is the first one above the number it was deleted with.
    ids = {r.source_url: r.id for r in store.jobs().collect()}
    store.apply_changes(spark.createDataFrame([(ids["a"], 1, "delete", None, None, None)], CHANGE_SCHEMA), NOW)
    sent = [(n, {**doc("a", f"N{n}", f"n{n}"), "extracted_at": f"at {n}"}) for n in range(900, 1100)]
    ingest(spark, sent, store)
    row = store.find(ids["a"]).first()
    assert (row.extracted_at_raw, row.job_title) == ("at 1001", "N1099")
    assert content(store)[1] == [("a", "n1099"), ("b", "y")]


def test_marked_rows(spark):
    from vacanta.sources.bitmap import marked

    rows = spark.createDataFrame([(i, None if i % 100 == 0 else f"k{i % 500}") for i in range(20_000)], "n long, k string")
    keys = rows.filter("n % 7 = 0 and n < 5000").select("n", "k")
    got = {r.n for r in marked(rows, keys, ["n", "k"], 20_000).collect()}
    assert {r.n for r in keys.collect()} <= got and len(got) < 2_000
    assert marked(rows, keys, ["n", "k"], 20_000).columns == ["n", "k"] and marked(rows, keys.limit(0), ["n", "k"], 0).count() == 0


def test_ingest_stream_equals_batch_and_skips_replays(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "s"))
    refused = []

    def drain(checkpoint):
        streams.ingest_stream(
            files.stream_captures(spark, str(tmp_path / "in")), answers, store, str(tmp_path / checkpoint),
            "capture_id", lambda df: refused.append(df.count()), now=NOW, available_now=True,
        ).awaitTermination()

    for rows in (FIRST, SECOND):
        captures(spark, *rows).write.mode("append").json(str(tmp_path / "in"))
        drain("cp")
    assert content(store) == WANT and refused == [1, 0]
    # As after a crash between the store and the checkpoint: the last batch is run again and counts once.
    (tmp_path / "cp" / "commits" / "1").unlink()
    (tmp_path / "cp" / "commits" / ".1.crc").unlink()
    ids = {r.source_url: r.id for r in store.jobs().collect()}
    store.apply_changes(spark.createDataFrame([(ids["c"], 1, "delete", None, None, None)], CHANGE_SCHEMA), NOW)
    drain("cp")
    without_c = ([r for r in WANT[0] if r[0] != "c"], [r for r in WANT[1] if r[0] != "c"])
    assert content(store) == without_c
    # All captures again under a new checkpoint: their numbers are known.
    drain("cp2")
    assert content(store) == without_c


def test_tracking_stream(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "s"))
    ingest(spark, [*FIRST, *SECOND], store)
    ids = {r.source_url: r.id for r in store.jobs().collect()}
    log = [
        (ids["a"], 1, "update", "applied", None, None), (ids["a"], 2, "update", "", "note", 3),
        (ids["b"], 3, "delete", None, None, None), (ids["b"], 4, "update", "offer", None, None), (5, 5, "delete", None, None, None),
    ]
    spark.createDataFrame(log, CHANGE_SCHEMA).write.json(str(tmp_path / "log"))
    incoming = spark.readStream.schema(CHANGE_SCHEMA).json(str(tmp_path / "log"))
    streams.tracking_stream(incoming, store, str(tmp_path / "cp"), now=NOW, available_now=True).awaitTermination()
    assert content(store) == (
        [("a", "A2", "applied", "note"), ("c", "C1", "saved", "")], [("a", "z"), ("c", "w")],
    )


def first_by_hand(rows, period):
    opened, kept = {}, []
    for url, second, name in sorted(rows, key=lambda r: (r[1], r[2])):
        if url not in opened or second >= opened[url] + period:
            opened[url] = second
            kept.append(name)
    return sorted(kept)


def run_first(spark, path, batches, period):
    (path / "in").mkdir()
    captured = files.stream_captures(spark, str(path / "in"))
    first = streams.first_capture_stream(captured, period)
    for rows in batches:
        df = spark.createDataFrame([(n, u, s) for u, s, n in rows], "text string, url string, s bigint")
        df.select("text", "url", F.timestamp_seconds("s").alias("ts")).write.mode("append").json(str(path / "in"))
        first.writeStream.format("parquet").option("path", str(path / "out")).option(
            "checkpointLocation", str(path / "cp")
        ).trigger(availableNow=True).start().awaitTermination()
    return sorted(r.text for r in spark.read.schema(CAPTURE_SCHEMA).parquet(str(path / "out")).collect())


def test_first_capture_of_each_period(spark, tmp_path):
    rng = random.Random(5)
    base = 1_700_000_000
    # One page holds a third of the captures.
    times = sorted(rng.sample(range(4000), 300))
    rows = [(rng.choice(["", "hot", "hot", "a", "b", "c"]), base + s, f"n{i:04d}") for i, s in enumerate(times)]
    assert run_first(spark, tmp_path, [rows[:120], rows[120:200], rows[200:]], 15) == first_by_hand(rows, 15)


def test_a_capture_after_the_period_is_new(spark, tmp_path):
    base = 1_700_000_000
    rows = [("p", base, "first"), ("p", base + 19, "same"), ("p", base + 20, "next"), ("p", base + 39, "same 2")]
    assert run_first(spark, tmp_path, [rows], streams.GENERIC_PERIOD) == ["first", "next"]


def test_a_complete_capture_ends_its_period_early(spark, tmp_path):
    base = 1_700_000_000
    rows = [("https://linkedin.com/jobs/view/1", 0, 10, "a"), ("https://linkedin.com/jobs/view/1", 14, 600, "b"),
            ("https://linkedin.com/jobs/view/1", 15, 10, "c"), ("https://linkedin.com/jobs/view/1", 30, 900, "d"),
            ("https://linkedin.com/jobs/view/1", 31, 10, "e"), ("https://linkedin.com/jobs/view/1", 32, 10, "f"),
            ("https://x.example/", 0, None, "g"), ("https://x.example/", 19, 1, "h"), ("https://x.example/", 20, 1, "i")]
    df = spark.createDataFrame([(n, u, s + base, c) for u, s, c, n in rows], "text string, url string, s bigint, contentLength bigint")
    df.select("text", "url", "contentLength", F.timestamp_seconds("s").alias("ts")).repartition(9).write.json(str(tmp_path / "in"))
    first = streams.first_capture_stream(files.stream_captures(spark, str(tmp_path / "in")))
    first.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(CAPTURE_SCHEMA).parquet(str(tmp_path / "out")).collect()
    # The first period ends at 15, as 14 + 2 is later, the second at 30, the third at 32, as 30 + 2 is earlier than 45.
    assert sorted(r.text for r in got) == ["a", "c", "d", "f", "g", "i"]


def test_from_pages_to_reports(spark, tmp_path):
    page = "<title>t</title><body><h1>%s</h1><div class='topcard__flavor'>ACME</div><article>%s</article></body>"
    text = "5+ years of Python and Docker. $90,000 - $120,000. " * 5
    rows = [(1, "https://linkedin.com/jobs/view/1", page % ("Senior Data Engineer", text)),
            (2, "https://linkedin.com/jobs/view/2", page % ("Backend Developer", "Go or Rust, ASAP. " * 15)),
            (3, "https://linkedin.com/jobs/view/1", page % ("Staff Data Engineer", text))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    captures_df = pages.capture_envelope(pages.pages_to_text(df))
    store = JobStore(spark, str(tmp_path / "s"))
    ingest_batch(captures_df, documents.rules_extract, store, NOW, "page_id", lambda df: df.count())
    jobs = {r.source_url[-1]: r for r in store.jobs().collect()}
    assert (jobs["1"].job_title, jobs["1"].company_name, jobs["1"].salary_max) == ("Staff Data Engineer", "ACME", 120000)
    assert (jobs["2"].job_function, jobs["2"].urgency_level) == ("Backend", "Urgent")
    bundle = analytics_bundle(store.jobs(), store.skills())
    assert bundle["status_stats"].first().saved == 2
    assert {r.skill_name for r in bundle["skills_by_status"].collect()} == {"Python", "Docker", "Go", "Rust"}
    report = listing.job_report(listing.get_jobs(store.jobs())).filter("title = 'Staff Data Engineer'").first()
    assert report.salary == "90000–120000 USD" and report.skills == "Python, Docker"


def test_store_rekeys_imported_tables(spark, tmp_path):
    from workload import tables as t

    d = "/root/testdata/sf0.001"
    store = JobStore(spark, str(tmp_path / "s"))
    jobs = t.all_columns(t.jobs(spark, d)).withColumn("raw_json", F.lit("{}"))
    skills = t.job_skills(spark, d).withColumns({"id": F.lit(0).cast("bigint"), "is_required": F.lit(True)})
    store.write(jobs, skills)
    assert store.jobs().filter(F.col("id") != changes.job_id(F.col("source_url"))).count() == 0
    assert store.skills().count() == skills.count()
    twice = jobs.limit(3).unionByName(jobs.limit(3).withColumn("id", F.col("id") + 10**9))
    other = JobStore(spark, str(tmp_path / "o"))
    other.write(twice, skills.limit(50).withColumn("job_id", F.lit(-7).cast("bigint")))
    assert other.jobs().count() == 3 and {r.job_id for r in other.skills().collect()} == {-7}
    assert other.skills().select("id").distinct().count() == 50
