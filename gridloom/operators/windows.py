"""Ranking, running sums, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import global_rank, largest_after, placed, running_sums, unplaced
from .rounds import Rounds


def axis_ranks(df: DataFrame, column: str, name: str, descending: bool = False) -> DataFrame:
    """Rank of each distinct coordinate. Only the distinct values are ranked, never the pixels."""
    order = F.col(column).desc() if descending else F.col(column)
    ranked = global_rank(df.select(column).distinct(), [order], name, Rounds(df.sparkSession, "axis"))
    return ranked.withColumn(name, (F.col(name) - 1).cast("int"))


def grid_index(df: DataFrame, value: str, order: Column) -> DataFrame:
    """(row, col, value): column by ascending lon, row by descending lat; the last of duplicates wins."""
    cols, rows = axis_ranks(df, "lon", "col"), axis_ranks(df, "lat", "row", True)
    return df.join(cols, "lon").join(rows, "lat").groupBy("row", "col").agg(F.max_by(value, order).alias(value))


def grid_resolution(df: DataFrame, default: float = 1.0) -> DataFrame:
    n = df.agg(F.count_distinct("lon").alias("nx"), F.count_distinct("lat").alias("ny"), F.min("lon").alias("x1"), F.max("lon").alias("x2"), F.min("lat").alias("y1"), F.max("lat").alias("y2"))
    step = lambda lo, hi, k: F.when(F.col(k) > 1, (F.col(hi) - F.col(lo)) / (F.col(k) - 1)).otherwise(default)
    n = n.withColumns({"dx": step("x1", "x2", "nx"), "dy": step("y1", "y2", "ny")})
    return n.withColumns({"left": F.col("x1") - F.col("dx") / 2, "right": F.col("x2") + F.col("dx") / 2, "bottom": F.col("y1") - F.col("dy") / 2, "top": F.col("y2") + F.col("dy") / 2})


def cumulative(df: DataFrame, by: list[str], order: str, count: str, inclusive: bool, delta: float = 0.0) -> DataFrame:
    """Running share of the count: of the bins before (exclusive), or up to and with this one."""
    w = Window.partitionBy(*by).orderBy(order)
    run = F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    total = F.sum(count).over(Window.partitionBy(*by))
    return df.withColumn("cdf", F.coalesce(run, F.lit(0)) / (total + delta))


def running_matches(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Running true and false positives of rows with a flag ``tp``."""
    rows = placed(df, [*by, *order], Rounds(df.sparkSession, "matches"))
    return unplaced(running_sums(rows, by, {"tps": F.col("tp").cast("long"), "fps": 1 - F.col("tp").cast("long")}))


def envelope(df: DataFrame, by: list[str], order: list[Column], column: str) -> DataFrame:
    """Largest value of this and all later rows."""
    return unplaced(largest_after(placed(df, [*by, *order], Rounds(df.sparkSession, "envelope")), by, column, "envelope"))


def phase_change(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(ts)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = df.withColumns({"delta": F.col(value) - F.lag(value).over(w), "from_first": F.col(value) - first})
    return out.withColumn("pct", F.try_divide(F.col("from_first") * 100.0, F.abs(first)))


def most_recent(df: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).filter(F.col("_n") <= n).drop("_n")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def top_class(df: DataFrame, key: str, cls: str, score: str) -> DataFrame:
    """The best score's class, the lowest class of those tied."""
    return df.groupBy(key).agg(F.max_by(F.col(cls), F.struct(F.col(score), -F.col(cls))).alias(cls), F.max(score).alias(score))
