"""Metric samples and logs as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "ts timestamp_ntz, metric string, labels map<string,string>, value double"
LOGS = "ts timestamp_ntz, service_name string, peer string, detected_level string, message string"


def append(rows: DataFrame, path: str) -> None:
    """Appends rows, partitioned by day, so that time filters prune files."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SAMPLES}, day date").parquet(path)


def logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{LOGS}, day date").parquet(path)
