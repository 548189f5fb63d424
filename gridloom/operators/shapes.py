"""Operators on one geometry at a time: simplification and validity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import box_candidates


def douglas_peucker(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Points kept, with a stack instead of recursion."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b <= a + 1:
            continue
        line, rest = points[b] - points[a], points[a + 1 : b] - points[a]
        size = np.hypot(*line)
        far = np.abs(line[0] * rest[:, 1] - line[1] * rest[:, 0]) / size if size > 0 else np.hypot(rest[:, 0], rest[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def rings_to_lines(df: DataFrame) -> DataFrame:
    """Every ring of polygons (rings, ...) as a closed line (ring, line) with the polygon's own columns."""
    out = df.select(*(c for c in df.columns if c != "rings"), F.posexplode("rings").alias("ring", "line")).filter(F.size("line") > 0)
    closed = F.get("line", F.lit(0)) == F.element_at("line", -1)
    return out.withColumn("line", F.when(closed, F.col("line")).otherwise(F.concat("line", F.slice("line", 1, 1))))


def simplify(df: DataFrame, key: str, tolerance: float) -> DataFrame:
    """(key, points) lines with array columns xs and ys, simplified row by row in tasks."""

    def run(frames):
        for frame in frames:
            out = [douglas_peucker(np.column_stack((x, y)).astype(float), tolerance) if len(x) else np.empty((0, 2)) for x, y in zip(frame["xs"], frame["ys"], strict=True)]
            yield pd.DataFrame({key: frame[key], "xs": [o[:, 0] for o in out], "ys": [o[:, 1] for o in out]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "xs", "ys").mapInPandas(run, f"{key} {kind}, xs array<double>, ys array<double>")


def invalid_rings(df: DataFrame, key: str, cell: float = 64.0) -> DataFrame:
    """Keys of rings (edges key, no, x1, y1, x2, y2) that are open, have fewer than four points, or cross themselves.

    Edges of a ring meet on the grid cells that their bounds cover, so a ring of many edges isn't joined with itself.
    """
    n = df.groupBy(key).agg(F.count("*").alias("n"), F.max_by(F.struct("x2", "y2"), "no").alias("last"), F.min_by(F.struct("x1", "y1"), "no").alias("first"))
    short = n.filter((F.col("n") < 3) | (F.col("first.x1") != F.col("last.x2")) | (F.col("first.y1") != F.col("last.y2"))).select(key)
    ends = F.struct("x1", "y1", "x2", "y2").alias("e")
    bounds = df.select(key, "no", ends, *(f(a, b).alias(n) for f, a, b, n in ((F.least, "x1", "x2", "x1"), (F.least, "y1", "y2", "y1"), (F.greatest, "x1", "x2", "x2"), (F.greatest, "y1", "y2", "y2"))))
    met = box_candidates(bounds, bounds, cell, [key]).filter("no_a < no_b")

    def side(p: str, x: str, y: str):
        """On which side of edge p a point lies."""
        return (F.col(f"{p}.x2") - F.col(f"{p}.x1")) * (F.col(y) - F.col(f"{p}.y1")) - (F.col(f"{p}.y2") - F.col(f"{p}.y1")) * (F.col(x) - F.col(f"{p}.x1"))

    apart = lambda p, q: side(p, f"{q}.x1", f"{q}.y1") * side(p, f"{q}.x2", f"{q}.y2") < 0
    return short.union(met.filter(apart("e_a", "e_b") & apart("e_b", "e_a")).select(key)).distinct()
