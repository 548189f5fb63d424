"""Tables written between the rounds of iterative operators, and connected components of an edge table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session takes a temporary folder and a cluster fails."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("gridloom.shared.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("gridloom.shared.dir", found)
    return found.rstrip("/")


class Rounds:
    """Writes a round's tables to the shared folder, which cuts the lineage: a lost executor costs only its running stage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/gridloom-{name}-{uuid.uuid4().hex[:12]}", 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def components_of(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, component) with the smallest node that edges (a, b) reach, for the nodes that occur in them.

    Large-star and small-star steps alternate until nothing changes: each links nodes to a smaller neighbour's least node, never adds
    edges, and halves long chains. The number of rounds follows the square of the logarithm at most; more is an error.
    """
    now = rounds.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    most = 40 + 2 * max(1, now.count()).bit_length() ** 2
    for _ in range(most):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = rounds.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = rounds.keep(both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        lower = rounds.keep(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b")))
        after = rounds.keep(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            roots = after.select(F.col("b").alias("node")).distinct()
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
        now = after
    raise RuntimeError("the components did not converge")
