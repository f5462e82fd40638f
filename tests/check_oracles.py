"""Run every query beside its reference SQL and compare rows. Usage: check_oracles.py [sf] [name ...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple("" if v is None or v is pd.NaT else str(v) for v in r) for r in frame.itertuples(index=False)]
    return sorted(rows)


def compare(spark, name, sf_dir, fn, sql):
    started = time.time()
    got = fn(spark, sf_dir).toPandas()
    seconds = time.time() - started
    if sql is None:
        return f"rows only ({len(got)})", seconds
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}", seconds
    a, b = normal(got), normal(want)
    if a == b:
        return f"ok ({len(a)})", seconds
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"DIFF rows {len(a)}/{len(b)} cols {sorted(got.columns)}\n   spark {only_a[:2]}\n   duck  {only_b[:2]}"[:3000], seconds


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    oracles = e.oracle_sql()
    for name, fn in e.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            result, seconds = compare(spark, name, f"/root/testdata/sf{sf}", fn, oracles.get(name))
        except Exception as error:
            result, seconds = "ERROR " + str(error)[:1500], 0
        print(f"{name}: {result} [{seconds:.1f}s]", flush=True)
