"""Shared helpers of the training-data operators: tables, scratch space, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Text handled at once inside a task, in characters; bounds the numpy temporaries.
CHUNK_CHARS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session takes a temporary folder and a cluster fails."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("gridloom.shared.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("gridloom.shared.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder. Writing one cuts the lineage; a lost executor costs only its running stage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def chunks(frame: pd.DataFrame, text: str, most: int = CHUNK_CHARS) -> Iterator[pd.DataFrame]:
    """Row ranges of at most ``most`` characters, one row at least. Null texts count as empty."""
    if not len(frame):
        return
    sizes = frame[text].str.len().fillna(0).to_numpy(dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(frame)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield frame.iloc[a:b]


def map_exact(df: DataFrame, ids: list[str], run, rest: str) -> DataFrame:
    """``df.mapInPandas(run, ids + rest)`` with the integers of the columns ``ids`` kept exact.

    pandas holds an integer column with a null as doubles, which rounds every number beyond 2**53 beside the null. So these columns
    cross as decimal strings (or None) and are cast back; ``run`` sees and returns strings. Columns of ``ids`` that are no integers cross as they are.
    """
    kinds = {c: df.schema[c].dataType for c in ids}
    text = {c for c, kind in kinds.items() if isinstance(kind, IntegralType)}
    sent = df.select(*(F.col(c).cast("string").alias(c) if c in text else F.col(c) for c in df.columns))
    out = sent.mapInPandas(run, ", ".join([*(f"{c} {'string' if c in text else kind.simpleString()}" for c, kind in kinds.items()), rest]))
    return out.select(*(F.col(c).cast(kinds[c]).alias(c) if c in text else F.col(c) for c in out.columns))


def bounded_sample(rows: DataFrame, by: str, most: int, *columns: str) -> DataFrame:
    """At most ``most`` rows of each value of ``by``, those of the least hash of ``columns``.

    A share of the hash range, twice what is needed on average, is cut first; so only few rows are ranked. Rows that are equal in all
    ``columns`` share a hash, but the rank bounds them too.
    """
    sizes = {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}
    h = F.xxhash64(*columns)
    near = F.lit(False)
    for value, n in sizes.items():
        near = near | ((F.col(by) == value) & (F.pmod(h, F.lit(1_000_003)) < int(min(1.0, 2 * most / n + 50 / n) * 1_000_003)))
    order = Window.partitionBy(by).orderBy(F.pmod(h, F.lit(1_000_003)), h)
    return rows.filter(near).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).drop("_rank")


def offsets(rows: DataFrame, order: list[str], size: str, name: str, block: int = 4096) -> DataFrame:
    """(order, name): the sum of ``size`` over all rows before each, in the order of two integer columns that name a row.

    Sums within a block of the first column are windows of their own; only one sum a block meets in one task.
    """
    first = order[0]
    rows = rows.select(*order, size).withColumn("_block", F.floor(F.col(first) / block))
    blocks = rows.groupBy("_block").agg(F.sum(size).alias("_sum"))
    before = blocks.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_before"))
    inside = F.sum(size).over(Window.partitionBy("_block").orderBy(*order)) - F.col(size)
    return rows.withColumn("_inside", inside).join(before, "_block").select(*order, (F.col("_before") + F.col("_inside")).alias(name))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) with the smallest node of each component, for the nodes that occur in ``edges`` (a, b).

    Alternates large-star and small-star steps until nothing changes. A step is a grouped minimum with map-side combining,
    written, and one join of two tables, so that adaptive execution can split hot keys (hubs with all their leaves); the edge count never grows
    and rounds grow with the square of its logarithm at most. Each round is written to the shared folder.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.keep(now, "edges")
    mark, left = None, 40 + 2 * max(1, now.count()).bit_length() ** 2
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large.filter("a <> b").distinct(), "large")
        lower = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(lower.select("a", F.col("m").alias("b"))).distinct()
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        after = scratch.keep(small, "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now, least, large, lower)
        now = after
        if tuple(seen) == mark:
            break
        mark, left = tuple(seen), left - 1
        if not left:
            raise RuntimeError("the components did not converge")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
