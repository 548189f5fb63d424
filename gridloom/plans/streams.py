"""Plans of the file-drop streams (X): each handles the table's files as a stream and returns what its sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rounds import shared_folder
from ..streaming import files as st
from .registry import ORACLES, QUERIES


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/gridloom-{name}-{uuid.uuid4().hex[:12]}"


def drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return st.read_drops(spark, f"{sf_dir}/event*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def x01_file_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "drop")
    st.write_append(drops(spark, sf_dir).select("event_id", "user_id", "value"), f"{out}/rows", f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def x02_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watermark's delay spans the table, so the stream keeps one row a key as the batch would."""
    out = folder(spark, "repeats")
    st.write_append(st.drop_repeats(drops(spark, sf_dir), ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"), f"{out}/rows", f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def x04_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "latest")
    st.upsert_latest(drops(spark, sf_dir).select("user_id", "event_id"), ["user_id"], "event_id", f"{out}/rows", f"{out}/progress").awaitTermination()
    return st.newest(spark, f"{out}/rows").select("user_id", "event_id")


def x03_stream_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watermark's delay spans the table, so no row is late."""
    out = folder(spark, "daily")
    st.keep_daily_statistics(drops(spark, sf_dir), "ts", "value", f"{out}/rows", f"{out}/progress", "3650 days").awaitTermination()
    days = st.newest_days(spark, f"{out}/rows")
    return days.select(F.col("day").cast("timestamp_ntz").alias("day"), "n", F.bround("mean", 6).alias("mean"), "lo", "hi")


for run, sql in (
    (x03_stream_statistics, "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(value) AS n, round_even(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1"),
    (x01_file_drop, "SELECT event_id, user_id, value FROM events"),
    (x02_drop_repeats, "SELECT DISTINCT user_id, event_type FROM events"),
    (x04_upsert_latest, "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1"),
):
    QUERIES[run.__name__], ORACLES[run.__name__] = run, sql
