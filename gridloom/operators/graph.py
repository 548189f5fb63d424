"""Property graph lookups on node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes_of(nodes: DataFrame, label: str | None = None, limit: int = 100) -> DataFrame:
    return (nodes.filter(F.col("label") == label) if label else nodes).orderBy("id").limit(limit)


def node_by_property(nodes: DataFrame, label: str, name: str, value: str) -> DataFrame:
    return nodes.filter((F.col("label") == label) & (F.col(name) == value)).orderBy("id").limit(1)


def paths_between(edges: DataFrame, start: str, end: str, most_hops: int = 5, most_paths: int = 10) -> DataFrame:
    """Undirected paths without repeated edges, shortest first. Each hop joins the frontier with the edges."""
    both = edges.select(F.col("id").alias("e"), F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("id", "dst", "src"))
    front = both.sparkSession.createDataFrame([(start, [], [start])], "at string, used array<string>, nodes array<string>")
    found = None
    for _ in range(most_hops):
        step = front.join(both, front["at"] == both["a"]).filter(~F.array_contains("used", F.col("e")))
        front = step.select(F.col("b").alias("at"), F.concat("used", F.array("e")).alias("used"), F.concat("nodes", F.array("b")).alias("nodes"))
        hits = front.filter(F.col("at") == end)
        found = hits if found is None else found.union(hits)
        front = front.filter(F.col("at") != end)
    return found.select(F.size("used").alias("hops"), F.array_join("nodes", ">").alias("path")).orderBy("hops", "path").limit(most_paths)


def pattern(nodes: DataFrame, edges: DataFrame, sql: str) -> DataFrame:
    """Spark SQL over the views ``nodes`` and ``edges``, given as arguments of the statement."""
    return nodes.sparkSession.sql(sql, nodes=nodes, edges=edges)
