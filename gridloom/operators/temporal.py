"""Change between dates, trends and roll-ups of patch series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dnbr(pre: Column, post: Column) -> Column:
    return pre - post


def rdnbr(pre: Column, post: Column) -> Column:
    return F.try_divide(pre - post, F.sqrt(F.abs(pre)))


def trend(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Linear slope per day and its reading."""
    days = F.col(ts).cast("timestamp").cast("double") / 86400.0
    out = df.groupBy(key).agg(F.regr_slope(F.col(value), days).alias("slope"))
    return out.withColumn("reading", F.when(F.col("slope") > 0, "recovery").when(F.col("slope") < 0, "degradation").otherwise("stable"))


def rollup_by_grain(df: DataFrame, key: str, ts: str, value: str, grain: str) -> DataFrame:
    return df.groupBy(key, F.date_trunc(grain, ts).cast("timestamp").alias("period")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"))
