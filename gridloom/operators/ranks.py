"""Ranks, running sums and extremes over rows in one order, without a window that meets in one task.

Rows are placed once by a range sort and written; a row's place is its partition and its number there. A running value is then the
one within its partition, by a window of its own, put together with what the partitions before (or after) it add up to: one row a partition and
group. Where partitions begin doesn't matter, so results depend on the order alone, which must be total (ties: in any order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import Rounds


def placed(df: DataFrame, order: list[Column | str], rounds: Rounds) -> DataFrame:
    """Rows with their place (_part, _at) in the order, in a written table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return rounds.keep(rows, "placed").withColumn("_part", F.shiftright("_at", 33))


def _carried(rows: DataFrame, by: list[str], within: dict[str, Column], over_parts: dict[str, Column]) -> DataFrame:
    """Rows with the values of the parts beside theirs: ``within`` sums up a part, ``over_parts`` joins the parts of a group."""
    per = rows.groupBy(*by, "_part").agg(*(c.alias(n) for n, c in within.items()))
    per = per.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_by__part"), *(c.alias(n) for n, c in over_parts.items()))
    on = F.col("_part") == F.col("_by__part")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(per, on).drop("_by__part", *(f"_by_{c}" for c in by))


def running_sums(rows: DataFrame, by: list[str], sums: dict[str, Column | str]) -> DataFrame:
    """Placed rows with the sums of all rows of their group up to and with them."""
    cols = {n: F.col(c) if isinstance(c, str) else c for n, c in sums.items()}
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    out = _carried(rows, by, {f"_own_{n}": F.sum(c) for n, c in cols.items()}, {f"_carry_{n}": F.coalesce(F.sum(f"_own_{n}").over(before), F.lit(0)) for n in cols})
    inside = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({n: F.sum(c).over(inside) + F.col(f"_carry_{n}") for n, c in cols.items()}).drop(*(f"_carry_{n}" for n in cols))


def largest_after(rows: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Placed rows with the largest value of their group from them on."""
    after = Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    out = _carried(rows, by, {"_own": F.max(column)}, {"_carry": F.max("_own").over(after)})
    inside = Window.partitionBy(*by, "_part").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(name, F.greatest(F.max(column).over(inside), "_carry")).drop("_carry")


def next_row(rows: DataFrame, by: list[str], columns: list[str], name: str) -> DataFrame:
    """Placed rows with a struct of the next row's columns in their group, null for the last."""
    value = F.struct(*columns)
    parts = Window.partitionBy(*by).orderBy("_part")
    out = _carried(rows, by, {"_first": F.min_by(value, F.col("_at"))}, {"_carry": F.lead("_first").over(parts)})
    inside = Window.partitionBy(*by, "_part").orderBy("_at")
    return out.withColumn(name, F.coalesce(F.lead(value).over(inside), "_carry")).drop("_carry")


def unplaced(rows: DataFrame) -> DataFrame:
    return rows.drop("_part", "_at")


def global_rank(df: DataFrame, order: list[Column | str], name: str, rounds: Rounds) -> DataFrame:
    """Rows with their rank from 1."""
    return unplaced(running_sums(placed(df, order, rounds), [], {name: F.lit(1)}))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], rounds: Rounds) -> DataFrame:
    """(by, q array): exact interpolated quantiles of each group's values; nulls don't count, groups without values are left out (without ``by`` they are nulls).

    Distinct values are counted first, with partial sums in every task; so no buffer holds a column, and a value that fills a third of the rows is one row.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    run = running_sums(placed(counts, [*by, "_v"], rounds), by, {"_end": "_n"})
    totals = run.groupBy(*by).agg(F.max("_end").alias("_total")).select(*(F.col(c).alias(f"_t_{c}") for c in by), "_total")
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    run = run.join(totals, on).drop(*(f"_t_{c}" for c in by)) if by else run.crossJoin(F.broadcast(totals))  # one row
    place = [F.lit(s) * (F.col("_total") - 1) for s in shares]
    holds = lambda r: (r >= F.col("_end") - F.col("_n")) & (r < F.col("_end"))
    found = run.groupBy(*by).agg(F.max("_total").alias("_total"), *(F.max(F.when(holds(f(p)), F.col("_v"))).alias(f"_{kind}{i}") for i, p in enumerate(place) for kind, f in (("lo", F.floor), ("hi", F.ceil))))
    q = [F.when(F.floor(p) == F.ceil(p), F.col(f"_lo{i}")).otherwise((F.ceil(p) - p) * F.col(f"_lo{i}") + (p - F.floor(p)) * F.col(f"_hi{i}")) for i, p in enumerate(place)]
    return found.select(*by, F.array(*q).alias("q"))
