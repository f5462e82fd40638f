"""Shared scratch space for data that must be written once and read more than once."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors and the driver must share.

    Raises an error where that is not set: a local folder would give each executor files of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set; name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_once(df: DataFrame, label: str) -> DataFrame:
    """The same rows read back from scratch Parquet, so that no later use computes them again.

    The files outlive a lost executor and stay until the folder is cleared.
    """
    return write_scratch(df, scratch_dir(df.sparkSession, label))
