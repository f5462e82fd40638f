"""What queries start from is dealt out by its rows, and what they write takes little space."""

import pytest

from pyspark.sql import functions as F

from vacanta.operators import documents
from vacanta.plans.ingest import ingest_batch
from vacanta.sources import files
from workload import tables as t


@pytest.fixture
def small(spark, tmp_path):
    spark.range(1000).selectExpr(
        "id as o_orderkey", "id % 20 as o_custkey", "'O' as o_orderstatus", "cast(id as double) as o_totalprice",
        "timestamp '2024-01-01' as o_orderdate", "'1-URGENT' as o_orderpriority",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(20).selectExpr(
        "id as c_custkey", "cast(id as string) as c_name", "id % 2 as c_nationkey", "'M' as c_mktsegment"
    ).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2).selectExpr("id as n_nationkey", "cast(id as string) as n_name").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


def test_tasks_grow_with_the_rows(spark, small, monkeypatch):
    fewest = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert t.spread(spark, small, "orders").rdd.getNumPartitions() == fewest
    monkeypatch.setattr(t, "ROWS_PER_TASK", 70)
    assert t.spread(spark, small, "orders").rdd.getNumPartitions() == 15


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_messages_are_dealt_out_after_their_joins(spark, small, monkeypatch, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(t, "ROWS_PER_TASK", 70)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        sizes = t.messages(spark, small).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(sizes) == 1000 and len(sizes) == 15 and max(sizes) <= 100


def test_postings_are_written_small_and_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LINES_PER_FILE", 3)
    texts = spark.range(10).select(F.concat(F.lit('{"source_url": "u'), "id", F.lit('", "metadata": {"job_title": "é"}}')).alias("json"))
    files.write_postings(documents.accepted(documents.parse_posting(texts.coalesce(1))), str(tmp_path / "out"))
    parts = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert len(parts) == 4 and all(p.suffix == ".gz" for p in parts)
    back = files.read_postings(spark, str(tmp_path / "out"), whole_files=False)
    assert sorted(r.u for r in back.select(F.col("posting.source_url").alias("u")).collect()) == [f"u{i}" for i in range(10)]


def test_texts_of_accepted_captures_are_not_written_again(spark, tmp_path):
    class Store:
        def upsert(self, good, now, seq):
            self.rows = [(r.n, r.posting.source_url) for r in good.collect()]

    store, refused = Store(), []
    rows = spark.createDataFrame([(1, '{"source_url": "a"}'), (2, "broken"), (None, '{"source_url": "c"}')], "n bigint, text string")
    kept = []

    def answers(df):
        return documents.parse_posting(df, "text")

    def on_rejected(df):
        refused.extend((r.n, r.text) for r in df.collect())
        kept.extend(r.text for r in spark.read.parquet(*{f.rsplit("/", 1)[0] for f in df.inputFiles()}).collect())

    ingest_batch(rows, answers, store, F.lit("2024-01-01").cast("timestamp"), "n", on_rejected)
    assert store.rows == [(1, "a")] and sorted(refused, key=str) == [(2, "broken"), (None, '{"source_url": "c"}')]
    assert len(kept) == 3 and set(kept) == {None, "broken", '{"source_url": "c"}'}
