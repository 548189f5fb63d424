"""Overlay of polygons of any shape: clip, erase, dissolve and buffer.

A polygon is a column ``rings``, an array of rings (arrays of points x, y; outer rings and holes alike, closed or not), filled by the even-odd
rule. Polygons are dealt to square grid cells by their bounds; a cell holds only what lies in it, so no task holds a layer. In a cell the
edges are cut by horizontal lines through all their ends and crossings; between two lines no edges cross, so their order from left to right tells
which polygons cover each trapezoid. Cells are exact by themselves: an edge left of a cell counts at the cell's left side.

Results have an area (summed over cells) and rings. A cell gives its part of the result's boundary; what lies on a side that two cells share
cancels where both have the result there, and the rest is chained to rings: outer ones counter-clockwise, holes clockwise. Null or empty rings
cover nothing. Points with a null coordinate are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import per_group
from .rounds import Rounds, components_of

#: Relative width below which an interval is none, and relative area below which a ring is none.
TINY = 1e-12
POINT = "struct<x: double, y: double>"
RINGS = f"array<array<{POINT}>>"


def edges_of(rings: Column) -> Column:
    """All edges of the rings, upwards, without horizontal ones."""

    def of(ring: Column) -> Column:
        ring = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
        ends = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        up = F.transform(ends, lambda e: F.when(e["a"]["y"] < e["b"]["y"], F.struct(e["a"]["x"].alias("x0"), e["a"]["y"].alias("y0"), e["b"]["x"].alias("x1"), e["b"]["y"].alias("y1"))).otherwise(F.struct(e["b"]["x"].alias("x0"), e["b"]["y"].alias("y0"), e["a"]["x"].alias("x1"), e["a"]["y"].alias("y1"))))
        return F.filter(up, lambda e: e["y0"] < e["y1"])

    return F.flatten(F.transform(F.filter(rings, lambda r: r.isNotNull()), of))


def in_cells(polygons: DataFrame, columns: list[str], cell: float) -> DataFrame:
    """(columns, cx, cy, edges): each polygon in every cell that its bounds touch, with the edges at the cell's height that don't lie right of it."""
    df = polygons.select(*columns, edges_of(F.col("rings")).alias("edges")).filter(F.size("edges") > 0)
    least = lambda f, c: f(F.transform("edges", lambda e: e[c]))
    df = df.withColumns({"x1": F.least(least(F.array_min, "x0"), least(F.array_min, "x1")), "x2": F.greatest(least(F.array_max, "x0"), least(F.array_max, "x1")), "y1": least(F.array_min, "y0"), "y2": least(F.array_max, "y1")})
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.greatest(F.floor(F.col(lo) / cell), F.ceil(F.col(hi) / cell) - 1))
    df = df.withColumn("cy", F.explode(span("y1", "y2"))).withColumn("edges", F.filter("edges", lambda e: (e["y0"] < (F.col("cy") + 1) * cell) & (e["y1"] > F.col("cy") * cell)))
    df = df.withColumn("cx", F.explode(span("x1", "x2")))
    return df.select(*columns, "cx", "cy", F.filter("edges", lambda e: F.least(e["x0"], e["x1"]) < (F.col("cx") + 1) * cell).alias("edges")).filter(F.size("edges") > 0)


def crossings(e: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Heights inside the box at which edges cross each other or its left and right sides."""
    x_lo, y_lo, x_hi, y_hi = box
    out = []
    d = e[:, 2:] - e[:, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        for side in (x_lo, x_hi):
            t = (side - e[:, 0]) / d[:, 0]
            out.append((e[:, 1] + t * d[:, 1])[(t > 0) & (t < 1)])
        for i in range(len(e) - 1):
            p, r, q, s = e[i], d[i], e[i + 1 :], d[i + 1 :]
            both = (np.minimum(q[:, 0], q[:, 2]) <= max(p[0], p[2])) & (np.maximum(q[:, 0], q[:, 2]) >= min(p[0], p[2])) & (q[:, 1] <= p[3]) & (q[:, 3] >= p[1])
            q, s = q[both], s[both]
            if not len(q):
                continue
            turn = r[0] * s[:, 1] - r[1] * s[:, 0]
            t = ((q[:, 0] - p[0]) * s[:, 1] - (q[:, 1] - p[1]) * s[:, 0]) / turn
            u = ((q[:, 0] - p[0]) * r[1] - (q[:, 1] - p[1]) * r[0]) / turn
            out.append((p[1] + t * r[1])[(turn != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1) | (turn != 0) & (t >= 0) & (t <= 1) & (u > 0) & (u < 1)])
    y = np.concatenate(out) if out else np.empty(0)
    return y[(y > y_lo) & (y < y_hi)]


def only(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The parts of the disjoint intervals ``a`` outside of the intervals ``b``."""
    out = []
    b = sorted(b)
    for lo, hi in a:
        for x, y in b:
            if y <= lo or x >= hi:
                continue
            if x > lo:
                out.append((lo, x))
            lo = max(lo, y)
        if lo < hi:
            out.append((lo, hi))
    return out


def sweep(edges: np.ndarray, poly: np.ndarray, mask: np.ndarray, rule: str, box: tuple[float, float, float, float]) -> tuple[float, list, list]:
    """(area, inner segments, border segments) of the result in the box; ``mask`` tells which polygons are masks.

    Border segments are (axis, 0 for the lower side or 1, low, high); the result lies inside of them.
    """
    x_lo, y_lo, x_hi, y_hi = box
    order = np.lexsort((poly, *edges.T[::-1]))
    e, poly = edges[order], np.unique(poly[order], return_inverse=True)[1]
    kinds = np.zeros((poly.max() + 1, 2))
    kinds[poly, mask[order].astype(int)] = 1
    tiny = TINY * max(1.0, abs(x_lo), abs(x_hi), abs(y_lo), abs(y_hi))
    ys = np.unique(np.concatenate(([y_lo, y_hi], e[:, 1], e[:, 3], crossings(e, box))))
    ys = ys[(ys >= y_lo) & (ys <= y_hi)]
    ys = ys[np.concatenate(([True], np.diff(ys) > tiny))]
    ys[-1] = y_hi
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])

    def at(rows: np.ndarray, y: float) -> np.ndarray:
        x = np.where(y == e[rows, 3], e[rows, 2], e[rows, 0] + (y - e[rows, 1]) * slope[rows])
        return np.clip(x, x_lo, x_hi)

    area, inner, border, under = 0.0, [], [], []
    for ya, yb in zip(ys, ys[1:], strict=False):
        rows = np.flatnonzero((e[:, 1] <= ya + tiny) & (e[:, 3] >= yb - tiny))
        above, over = [], []
        if len(rows):
            xa, xb = at(rows, ya), at(rows, yb)
            by = np.lexsort((xb, xa, xa + xb))
            rows, xa, xb = rows[by], np.maximum.accumulate(xa[by]), np.maximum.accumulate(xb[by])
            covers = np.zeros((len(rows), len(kinds)))
            covers[np.arange(len(rows)), poly[rows]] = 1
            t, m = ((np.cumsum(covers, axis=0) % 2) @ kinds).T > 0
            full = {"union": t, "clip": t & m, "erase": t & ~m}[rule]
            xa, xb = np.append(xa, x_hi), np.append(xb, x_hi)  # edges right of the box may be missing
            wide = np.flatnonzero((np.diff(xa) > tiny) | (np.diff(xb) > tiny))
            full = full[wide]
            first = wide[full & ~np.concatenate(([False], full[:-1]))] if len(wide) else wide
            last = wide[full & ~np.concatenate((full[1:], [False]))] + 1 if len(wide) else wide
            for la, lb, ra, rb in zip(xa[first].tolist(), xb[first].tolist(), xa[last].tolist(), xb[last].tolist(), strict=True):
                area += (ra - la + rb - lb) / 2 * (yb - ya)
                if la == lb == x_lo:
                    border.append((0, 0, float(ya), float(yb)))
                else:
                    inner.append((lb, float(yb), la, float(ya)))
                if ra == rb == x_hi:
                    border.append((0, 1, float(ya), float(yb)))
                else:
                    inner.append((ra, float(ya), rb, float(yb)))
                above.append((la, ra))
                over.append((lb, rb))
        if ya == y_lo:
            border += [(1, 0, a, b) for a, b in above if a < b]
        else:
            inner += [(a, float(ya), b, float(ya)) for a, b in only(above, under)] + [(b, float(ya), a, float(ya)) for a, b in only(under, above)]
        under = over
    border += [(1, 1, a, b) for a, b in under if a < b]
    return float(area), inner, border


#: What a row of a cell holds: its area, a segment of the inner boundary (x0, y0, x1, y1) or of its border (axis, side, low, high).
AREA, INNER, BORDER = 0, 1, 2
FOUR = {"what": "int", "a": "double", "b": "double", "c": "double", "d": "double"}


def _cell(rule: str, cell: float):
    def run(frame: pd.DataFrame) -> list[tuple]:
        cx, cy = int(frame["cx"].iloc[0]), int(frame["cy"].iloc[0])
        edges = np.concatenate(frame["edges"].to_list()).reshape(-1, 4)
        sizes = [len(x) // 4 for x in frame["edges"]]
        box = (cx * cell, cy * cell, (cx + 1) * cell, (cy + 1) * cell)
        area, inner, border = sweep(edges, np.repeat(np.arange(len(frame)), sizes), np.repeat(frame["mask"].to_numpy(dtype=bool), sizes), rule, box)
        return [(AREA, area, 0.0, 0.0, 0.0), *((INNER, *s) for s in inner), *((BORDER, *s) for s in border)]

    return run


def _shared_side(frame: pd.DataFrame) -> list[tuple]:
    """What the two cells at a side don't have in common, with the result on the left hand."""
    axis, at = int(frame["axis"].iloc[0]), int(frame["line"].iloc[0]) * frame["size"].iloc[0]
    parts = [[(lo, hi) for s, lo, hi in zip(frame["side"], frame["lo"], frame["hi"], strict=True) if s == side] for side in (0, 1)]
    if axis == 0:  # the result right of the line goes down, left of it up
        return [(at, b, at, a) for a, b in only(parts[0], parts[1])] + [(at, a, at, b) for a, b in only(parts[1], parts[0])]
    # above the line to the right, below it to the left
    return [(a, at, b, at) for a, b in only(parts[0], parts[1])] + [(b, at, a, at) for a, b in only(parts[1], parts[0])]


def chain(segments: np.ndarray) -> list[list[tuple[float, float]]]:
    """Rings of directed segments; where several go on from a point, the sharpest turn to the left."""
    start: dict[tuple[float, float], list[int]] = {}
    for i, (a, b, _, _) in enumerate(segments.tolist()):
        start.setdefault((a, b), []).append(i)
    rings = []
    for first in range(len(segments)):
        if not start.get(tuple(segments[first, :2])) or first not in start[tuple(segments[first, :2])]:
            continue
        ring, i = [], first
        while True:
            a, b, c, d = segments[i].tolist()
            start[a, b].remove(i)
            ring.append((a, b))
            ways = start.get((c, d), [])
            if not ways:
                break
            if len(ways) > 1:
                back = math.atan2(b - d, a - c)
                turn = lambda j: (back - math.atan2(segments[j, 3] - d, segments[j, 2] - c)) % (2 * math.pi) or 2 * math.pi  # noqa: B023, E731
                i = min(ways, key=turn)
            else:
                i = ways[0]
        rings.append(ring)
    return rings


def tidy(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Without points on a straight line between their neighbours."""
    out: list[tuple[float, float]] = []

    def straight(p, q, r) -> bool:
        (ax, ay), (bx, by) = (q[0] - p[0], q[1] - p[1]), (r[0] - q[0], r[1] - q[1])
        return abs(ax * by - ay * bx) <= 1e-9 * (math.hypot(ax, ay) * math.hypot(bx, by)) or math.hypot(ax, ay) == 0

    for p in ring:
        while len(out) >= 2 and straight(out[-2], out[-1], p):
            out.pop()
        out.append(p)
    while len(out) >= 3 and straight(out[-2], out[-1], out[0]):
        out.pop()
    while len(out) >= 3 and straight(out[-1], out[0], out[1]):
        out.pop(0)
    return out


def ring_size(ring: list[tuple[float, float]]) -> float:
    """Signed area, positive counter-clockwise."""
    x, y = np.array(ring).T
    x, y = x - x[0], y - y[0]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _rings(frame: pd.DataFrame) -> list[tuple]:
    segments = frame[["x0", "y0", "x1", "y1"]].drop_duplicates().to_numpy()
    parts = [tidy(r) for r in chain(segments)]
    scale = float(np.abs(segments).max())
    parts = [(ring_size(r), r) for r in parts if len(r) >= 3]
    parts = [(size, r) for size, r in parts if abs(size) > TINY * max(1.0, scale) * 1000]
    return [([[{"x": x, "y": y} for x, y in r] for _, r in sorted(parts, key=lambda p: (-p[0], p[1]))],)]


def swept(dealt: DataFrame, by: list[str], rule: str, cell: float) -> DataFrame:
    """(by, cx, cy, what, a, b, c, d): the area and boundary of the result in each cell."""
    dealt = Rounds(dealt.sparkSession, "swept").keep(dealt.select(*by, "cx", "cy", "mask", "edges"), "dealt")
    flat = F.flatten(F.transform("edges", lambda e: F.array(e["x0"], e["y0"], e["x1"], e["y1"])))
    return per_group(dealt.withColumn("edges", flat), [*by, "cx", "cy"], _cell(rule, cell), FOUR)


def summed(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, area) of swept cells, without empty results."""
    return cells.filter(F.col("what") == AREA).groupBy(*by).agg(F.sum("a").alias("area")).filter("area > 0")


def _overlay(dealt: DataFrame, by: list[str], rule: str, cell: float, split: bool) -> DataFrame:
    """(by, area, rings) of dealt polygons (by, mask, cx, cy, edges). With ``split`` rings come a connected group of segments a row, without area."""
    rounds = Rounds(dealt.sparkSession, "overlay")
    cells = rounds.keep(swept(dealt, by, rule, cell), "cells")
    on_x = F.col("a") == 0
    sides = cells.filter(F.col("what") == BORDER).select(*by, F.col("a").cast("int").alias("axis"), F.when(on_x, F.col("cx")).otherwise(F.col("cy")).alias("own"), F.when(on_x, F.col("cy")).otherwise(F.col("cx")).alias("along"), F.lit(cell).alias("size"), F.col("b").cast("int").alias("side"), F.col("c").alias("lo"), F.col("d").alias("hi"))
    sides = sides.withColumn("line", F.col("own") + F.col("side"))
    segment = dict.fromkeys(("x0", "y0", "x1", "y1"), "double")
    lines = per_group(sides, [*by, "axis", "line", "along"], _shared_side, segment).select(*by, *segment)
    inner = cells.filter(F.col("what") == INNER).select(*by, *(F.col(c).alias(n) for c, n in zip("abcd", segment, strict=True)))
    segments = rounds.keep(inner.union(lines), "segments")
    if not split:
        rings = per_group(segments, by, _rings, {"rings": RINGS})
        return summed(cells, by).join(rings, by, "left")
    node = lambda *c: F.xxhash64(*by, *c)
    linked = segments.withColumns({"a": node("x0", "y0"), "b": node("x1", "y1")})
    groups = components_of(linked.select("a", "b"), rounds)
    rings = per_group(linked.join(groups.withColumnRenamed("node", "a"), "a"), [*by, "component"], _rings, {"rings": RINGS}).drop("component")
    return rings.filter(F.size("rings") > 0)


def _met(targets: DataFrame, masks: DataFrame, cell: float, keep_all: bool) -> DataFrame:
    """Each target in its cells, with the masks there; all cells of a target with ``keep_all``, else those with masks."""
    t = in_cells(targets, ["fid"], cell)
    m = in_cells(masks, [], cell).withColumnRenamed("edges", "other")
    met = t.select("fid", "cx", "cy").join(m, ["cx", "cy"]).select("fid", F.lit(True).alias("mask"), "cx", "cy", F.col("other").alias("edges"))
    own = t if keep_all else t.join(met.select("fid", "cx", "cy").distinct(), ["fid", "cx", "cy"], "left_semi")
    return own.select("fid", F.lit(False).alias("mask"), "cx", "cy", "edges").union(met)


def _kinds(targets: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """The distinct shapes (fid, rings) of targets, and each target's shape (fid, _kind): the least fid of those with the same rings."""
    own = targets.groupBy("fid").agg(F.array_sort(F.collect_set("rings")).alias("parts"))
    kinds = rounds.keep(own.groupBy("parts").agg(F.min("fid").alias("_kind")), "kinds")
    members = rounds.keep(own.join(kinds, "parts").select("fid", "_kind"), "members")
    return kinds.select(F.col("_kind").alias("fid"), F.explode("parts").alias("rings")), members


def _by_kind(targets: DataFrame, masks: DataFrame, rule: str, cell: float, outlines: bool) -> DataFrame:
    """Each distinct shape is overlaid once with the distinct masks; its result goes to all targets of that shape."""
    shapes, members = _kinds(targets, Rounds(targets.sparkSession, "kinds"))
    dealt = _met(shapes, masks.select("rings").distinct(), cell, rule == "erase")
    out = _overlay(dealt, ["fid"], rule, cell, False) if outlines else summed(swept(dealt, ["fid"], rule, cell), ["fid"])
    return targets.drop("rings").join(members, "fid").join(out.withColumnRenamed("fid", "_kind"), "_kind").drop("_kind")


def clip(targets: DataFrame, masks: DataFrame, cell: float, outlines: bool = True) -> DataFrame:
    """Targets (fid, rings, ...) within the union of the masks (rings): (area, rings) with each target's own columns; empty results are dropped.

    Without ``outlines`` only areas are made.
    """
    return _by_kind(targets, masks, "clip", cell, outlines)


def erase(targets: DataFrame, masks: DataFrame, cell: float, outlines: bool = True) -> DataFrame:
    """Targets without the union of the masks, as ``clip``."""
    return _by_kind(targets, masks, "erase", cell, outlines)


def dissolve(polygons: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """(keys, area) of the union of each key's polygons. A key may hold any number of polygons."""
    dealt = in_cells(polygons.select(*keys, "rings").distinct(), keys, cell).withColumn("mask", F.lit(False))
    return summed(swept(dealt, keys, "union", cell), keys)


def dissolved_rings(polygons: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """(keys, rings): the boundary of each key's union, a row for every connected group of segments, so that no row holds more than one outline."""
    return _overlay(in_cells(polygons.select(*keys, "rings").distinct(), keys, cell).withColumn("mask", F.lit(False)), keys, "union", cell, True)


def capsule(a: Column, b: Column, radius: Column, steps: int) -> Column:
    """The ring of all points within ``radius`` of the segment from a to b; half circles at both ends of ``2 * steps`` chords."""
    turn = F.when((a["x"] == b["x"]) & (a["y"] == b["y"]), F.lit(0.0)).otherwise(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))
    arc = lambda p, base: F.transform(F.sequence(F.lit(0), F.lit(2 * steps)), lambda i: F.struct((p["x"] + radius * F.cos(turn + base + i * (math.pi / 2 / steps))).alias("x"), (p["y"] + radius * F.sin(turn + base + i * (math.pi / 2 / steps))).alias("y")))
    return F.concat(arc(b, -math.pi / 2), arc(a, math.pi / 2))


def buffered(shapes: DataFrame, radius: Column, steps: int = 10) -> DataFrame:
    """The pieces (columns, rings) whose union is the buffer of each shape: (type, rings, ...) of points, lines and polygons.

    A line's or ring's segments become capsules; a polygon's own rings are a piece too. ``dissolve`` by fid gives the buffers, by no key their union.
    """
    rest = [c for c in shapes.columns if c not in ("rings", "type")]
    closed = F.when(F.col("type") == "Polygon", F.concat("ring", F.slice("ring", 1, 1))).otherwise(F.col("ring"))
    lines = shapes.select(*rest, "type", F.explode("rings").alias("ring")).withColumn("ring", closed)
    n = F.size("ring")
    each = lines.filter(n > 0).select(*rest, F.posexplode("ring").alias("i", "a"), "ring")
    pairs = each.filter((F.col("i") < F.size("ring") - 1) | (F.size("ring") == 1)).select(*rest, "a", F.coalesce(F.get("ring", F.col("i") + 1), F.col("a")).alias("b"))
    pieces = pairs.select(*rest, F.array(capsule(F.col("a"), F.col("b"), radius, steps)).alias("rings"))
    return pieces.union(shapes.filter("type = 'Polygon'").select(*rest, "rings"))


def buffer_areas(shapes: DataFrame, radius: float, steps: int, cell: float) -> DataFrame:
    """(fid, area) of the buffer of each shape (fid, type, rings); shapes of the same type and rings are buffered once."""
    rounds = Rounds(shapes.sparkSession, "buffers")
    own = shapes.groupBy("fid").agg(F.array_sort(F.collect_set(F.struct("type", "rings"))).alias("parts"))
    kinds = rounds.keep(own.groupBy("parts").agg(F.min("fid").alias("_kind")), "kinds")
    pieces = buffered(kinds.select("_kind", F.explode("parts").alias("p")).select("_kind", "p.type", "p.rings"), F.lit(radius), steps)
    areas = rounds.keep(dissolve(pieces.select("_kind", "rings"), ["_kind"], cell), "areas")
    return own.join(kinds, "parts").select("fid", "_kind").join(areas, "_kind").select("fid", "area")
