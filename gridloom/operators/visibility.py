"""Visibility graphs: which pairs of vertices see each other past obstacles of any shape.

Vertices meet within a reach on grid cells. A segment meets obstacles on the cells that it runs through, column by column, so their number grows with
its length and not with its bounds. Each pair of a segment and an obstacle is tested exactly, a row by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import box_candidates
from .overlay import buffered, dissolved_rings
from .rounds import Rounds


def obstacle_rings(shapes: DataFrame, point_radius: float, line_radius: float, cell: float, steps: int = 8) -> DataFrame:
    """(rings): the obstacles of shapes (fid, type, rings): points and lines are buffered, each by its own radius, polygons stay."""
    radius = F.when(F.col("type") == "Point", point_radius).otherwise(line_radius)
    thin = shapes.filter(F.col("type") != "Polygon").withColumn("_radius", radius)
    grown = dissolved_rings(buffered(thin, F.col("_radius"), steps).select("fid", "rings"), ["fid"], cell)
    return grown.select("rings").union(shapes.filter("type = 'Polygon'").select("rings"))


def ring_vertices(obstacles: DataFrame) -> DataFrame:
    """(x, y) of all distinct corners of obstacles."""
    return obstacles.select(F.explode(F.flatten("rings")).alias("p")).select("p.x", "p.y").distinct()


def near_pairs(vertices: DataFrame, reach: float) -> DataFrame:
    """(a, b, ax, ay, bx, by, w) of the vertices (vid, x, y) at a distance of ``reach`` at most, each pair once."""
    half = reach / 2 * (1 + 1e-9)
    around = vertices.select("vid", "x", "y", (F.col("x") - half).alias("x1"), (F.col("y") - half).alias("y1"), (F.col("x") + half).alias("x2"), (F.col("y") + half).alias("y2"))
    met = box_candidates(around, around, max(reach, 1e-12)).filter("vid_a < vid_b")
    w = F.hypot(F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a"))
    return met.select(F.col("vid_a").alias("a"), F.col("vid_b").alias("b"), F.col("x_a").alias("ax"), F.col("y_a").alias("ay"), F.col("x_b").alias("bx"), F.col("y_b").alias("by"), w.alias("w")).filter(F.col("w") <= reach)


def run_through(segments: DataFrame, cell: float) -> DataFrame:
    """Segments (ax, ay, bx, by) in every cell that they run through or touch."""
    c = F.col
    whole = lambda a, b: F.sequence(F.floor(a / cell - 1e-9), F.floor(b / cell + 1e-9))
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")
    out = segments.withColumn("cx", F.explode(whole(left, right)))
    y_at = lambda x: c("ay") + (x - c("ax")) * (c("by") - c("ay")) / F.nullif(c("bx") - c("ax"), F.lit(0.0))
    a, b = y_at(F.greatest(left, c("cx") * cell)), y_at(F.least(right, (c("cx") + 1) * cell))
    steep = c("ax") == c("bx")
    lo = F.when(steep, F.least("ay", "by")).otherwise(F.greatest(F.least(a, b), F.least("ay", "by")))
    hi = F.when(steep, F.greatest("ay", "by")).otherwise(F.least(F.greatest(a, b), F.greatest("ay", "by")))
    return out.withColumn("cy", F.explode(whole(F.least(lo, hi), F.greatest(lo, hi))))


def crosses(a: np.ndarray, b: np.ndarray, rings: list[np.ndarray], within: bool) -> bool:
    """Whether the segment has parts inside and, with ``within``, also parts outside of the rings (even-odd rule)."""
    p = np.concatenate(rings)
    q = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    d, e = b - a, q - p
    turn = d[0] * e[:, 1] - d[1] * e[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((p[:, 0] - a[0]) * e[:, 1] - (p[:, 1] - a[1]) * e[:, 0]) / turn
        u = ((p[:, 0] - a[0]) * d[1] - (p[:, 1] - a[1]) * d[0]) / turn
    cuts = t[(turn != 0) & (u >= -1e-12) & (u <= 1 + 1e-12)]
    along = ((p - a) @ d) / (d @ d)  # corners on the segment's line cut it too
    cuts = np.unique(np.concatenate(([0.0, 1.0], cuts, along)))
    cuts = cuts[(cuts >= 0) & (cuts <= 1)]
    cuts = cuts[np.concatenate(([True], np.diff(cuts) > 1e-12))]
    inner = outer = False
    for m in a + ((cuts[1:] + cuts[:-1]) / 2)[:, None] * d:
        size = (e**2).sum(axis=1)
        near = np.clip(((m - p) * e).sum(axis=1) / np.where(size > 0, size, 1), 0, 1)
        if (np.hypot(*(p + near[:, None] * e - m).T) <= 1e-9 * max(1.0, float(np.abs(m).max()))).any():
            continue  # along a side
        up = (p[:, 1] > m[1]) != (q[:, 1] > m[1])
        x = p[up, 0] + (m[1] - p[up, 1]) * e[up, 0] / e[up, 1]
        if (x > m[0]).sum() % 2:
            inner = True
        else:
            outer = True
    return inner and (outer or not within)


def _blocked(within: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = [crosses(np.array((ax, ay)), np.array((bx, by)), [np.array([(p["x"], p["y"]) for p in r]) for r in rings if len(r)], within) for ax, ay, bx, by, rings in zip(frame["ax"], frame["ay"], frame["bx"], frame["by"], frame["rings"], strict=True)]
            yield frame.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return run


def in_sight(segments: DataFrame, obstacles: DataFrame, cell: float, within: bool = True) -> DataFrame:
    """Segments (a, b, ax, ay, bx, by, ...) that no obstacle (rings) blocks. Touching and running along sides is free.

    With ``within`` a segment that lies wholly in an obstacle isn't blocked by it, as for the sides and diagonals of one obstacle.
    """
    flat = F.flatten("rings")
    side = lambda f, c: f(F.transform(flat, lambda p: p[c]))
    of = obstacles.filter(F.size(flat) > 0).select("rings").distinct().withColumn("oid", F.xxhash64("rings"))
    box = {"x1": side(F.array_min, "x"), "y1": side(F.array_min, "y"), "x2": side(F.array_max, "x"), "y2": side(F.array_max, "y")}
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    stands = of.withColumns(box).withColumn("cx", cells("x1", "x2")).withColumn("cy", cells("y1", "y2")).select("oid", "cx", "cy", *box)
    apart = (F.greatest("ax", "bx") <= F.col("x1")) | (F.least("ax", "bx") >= F.col("x2")) | (F.greatest("ay", "by") <= F.col("y1")) | (F.least("ay", "by") >= F.col("y2"))
    met = run_through(segments, cell).join(stands, ["cx", "cy"]).filter(~apart).select("a", "b", "ax", "ay", "bx", "by", "oid").distinct()
    kinds = {c: segments.schema[c].dataType.simpleString() for c in ("a", "b")}
    tested = met.join(of.dropDuplicates(["oid"]).select("oid", "rings"), "oid").select("a", "b", "ax", "ay", "bx", "by", "rings")
    blocked = tested.mapInPandas(_blocked(within), f"a {kinds['a']}, b {kinds['b']}").distinct()
    return segments.join(blocked, ["a", "b"], "left_anti")


def visibility_graph(vertices: DataFrame, obstacles: DataFrame, reach: float, cell: float) -> DataFrame:
    """(src, dst, w) in both directions of the vertices (vid, x, y) that see each other, for ``shortest_paths``.

    Places are looked at once: all vertices at a place see what it sees, and each other.
    """
    rounds = Rounds(vertices.sparkSession, "sight")
    places = rounds.keep(vertices.filter("x is not null and y is not null").groupBy("x", "y").agg(F.min("vid").alias("vid")), "places")
    sight = rounds.keep(in_sight(near_pairs(places, reach), obstacles, cell).select("a", "b", "w"), "sight")
    at = rounds.keep(vertices.select("vid", "x", "y").join(places.withColumnRenamed("vid", "place"), ["x", "y"]).select("vid", "place"), "at")
    end = lambda n: at.select(F.col("vid").alias(n), F.col("place").alias(f"_{n}"))
    far = sight.select(F.col("a").alias("_u"), F.col("b").alias("_v"), "w").join(end("u"), "_u").join(end("v"), "_v").select(F.col("u").alias("a"), F.col("v").alias("b"), "w")
    same = end("a").join(end("b"), F.col("_a") == F.col("_b")).filter("a < b").select("a", "b", F.lit(0.0).alias("w"))
    seen = far.union(same)
    return seen.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(seen.select("b", "a", "w"))
