"""Neighbourhood and region operators on pixel tables (x, y, ...).

A kernel is an array of (dx, dy, weight) structs exploded next to each pixel, whose key is shifted: one shuffle per
operator and no driver state. Connected components are labelled tile by tile and joined across the tiles' rims.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import placed, running_sums, unplaced
from .rounds import Rounds, components_of
from .stats import majority


def windows(extents: DataFrame, size: int, stride: int) -> DataFrame:
    """Upper left corners of the sliding windows inside each row's extent (w, h); the remainder is dropped."""
    starts = lambda c: F.explode(F.when(F.col(c) >= size, F.sequence(F.lit(0), F.col(c) - size, F.lit(stride))))
    return extents.withColumn("x0", starts("w")).withColumn("y0", starts("h"))


def tiles(extents: DataFrame, size: int, stride: int, edge: str = "pad") -> DataFrame:
    """Tiles of each row's extent (w, h): ``pad`` keeps starts, ``square`` shifts the last tile back, ``cut`` shortens it."""

    def starts(side: Column) -> Column:
        return F.sequence(F.lit(0), F.greatest(side - 1, F.lit(0)), F.lit(stride))

    def laid(df: DataFrame, at: Callable[[str], Column]) -> DataFrame:
        return df.withColumn("x0", F.explode(at("w"))).withColumn("y0", F.explode(at("h")))

    if edge == "square":
        # a side's last starts may fall together, so they are made distinct before there are tiles: no tile is shuffled
        back = lambda side: F.array_distinct(F.transform(starts(F.col(side)), lambda p: F.greatest(F.least(p, F.col(side) - size), F.lit(0))))
        return laid(extents.distinct(), back).withColumns({"tw": F.least(F.lit(size), F.col("w")), "th": F.least(F.lit(size), F.col("h"))})
    out = laid(extents, lambda side: starts(F.col(side)))
    if edge == "pad":
        return out.withColumns({"tw": F.lit(size), "th": F.lit(size)})
    return out.withColumns({"tw": F.least(F.lit(size), F.col("w") - F.col("x0")), "th": F.least(F.lit(size), F.col("h") - F.col("y0"))})


def covering_tiles(df: DataFrame, size: int, stride: int) -> DataFrame:
    """Each pixel with every window inside the table's extent (from 0 to its largest x and y) that covers it."""
    far = df.agg(F.max("x").alias("_w"), F.max("y").alias("_h"))  # one row

    def starts(c: str, side: str) -> Column:
        lo = F.greatest(F.ceil((F.col(c) - size + 1) / stride), F.lit(0)).cast("int")
        hi = F.least(F.floor(F.col(c) / stride), F.floor((F.col(side) + 1 - size) / stride)).cast("int")
        return F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))

    out = df.crossJoin(F.broadcast(far)).withColumn("x0", F.explode(starts("x", "_w"))).withColumn("y0", F.explode(starts("y", "_h")))
    return out.drop("_w", "_h")


def box_kernel(k: int) -> list[tuple[int, int, float]]:
    r = k // 2
    return [(dx, dy, 1.0) for dx in range(-r, r + 1) for dy in range(-r, r + 1)]


def disk_kernel(r: int) -> list[tuple[int, int, float]]:
    return [(dx, dy, float(dx * dx + dy * dy)) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if dx * dx + dy * dy <= r * r]


def gaussian_kernel(k: int, sigma: float) -> list[tuple[int, int, float]]:
    import math

    one = [math.exp(-((i - k // 2) ** 2) / (2 * sigma * sigma)) for i in range(k)]
    total = sum(one)
    return [(i - k // 2, j - k // 2, one[i] * one[j] / total**2) for i in range(k) for j in range(k)]


def spread(df: DataFrame, columns: list[str], kernel: list[tuple[int, int, float]], keys: list[str] | None = None) -> DataFrame:
    """Every pixel's values at each neighbour that the kernel reaches, with the kernel's weight."""
    k = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in kernel)))
    out = df.select(*(keys or []), "x", "y", *columns, k.alias("_k"))
    return out.select(*(keys or []), (F.col("x") + F.col("_k.dx")).alias("x"), (F.col("y") + F.col("_k.dy")).alias("y"), *columns, F.col("_k.w").alias("w"), ((F.col("_k.dx") == 0) & (F.col("_k.dy") == 0)).alias("own"))


def neighbourhood(df: DataFrame, column: str, kernel: list[tuple[int, int, float]], value: Column, name: str) -> DataFrame:
    """(x, y, name): an aggregate over the neighbours' values; only pixels of the input stay."""
    s = spread(df, [column], kernel)
    return s.groupBy("x", "y").agg(value.alias(name), F.bool_or("own").alias("_own")).filter("_own").drop("_own")


def dilate(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    return neighbourhood(df, column, box_kernel(k), F.max(column), column)


def erode(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    return neighbourhood(df, column, box_kernel(k), F.min(column), column)


def opened(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    return dilate(erode(df, column, k), column, k)


def closed(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    return erode(dilate(df, column, k), column, k)


def median_filter(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    return neighbourhood(df, column, box_kernel(k), F.median(column), column)


def gaussian(df: DataFrame, column: str, k: int = 5, sigma: float = 1.0) -> DataFrame:
    return neighbourhood(df, column, gaussian_kernel(k, sigma), F.sum(F.col(column) * F.col("w")), column)


def sobel(df: DataFrame, column: str) -> DataFrame:
    """Gradient magnitude clipped to 0..255; the outside counts as 0. Weights are those of a neighbour seen from the centre."""
    gx = {(-1, -1): 1, (-1, 0): 2, (-1, 1): 1, (1, -1): -1, (1, 0): -2, (1, 1): -1}
    kernel = [(dx, dy, float(gx.get((dx, dy), 0) * 100 + gx.get((dy, dx), 0))) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    wx = F.bround(F.col("w") / 100, 0)
    wy = F.col("w") - wx * 100
    size = F.sqrt(F.pow(F.sum(F.col(column) * wx), F.lit(2)) + F.pow(F.sum(F.col(column) * wy), F.lit(2)))
    return neighbourhood(df, column, kernel, F.least(size, F.lit(255.0)), "sobel")


def boundary_band(df: DataFrame, column: str, radius: int = 2) -> DataFrame:
    """Pixels whose distance to the other side of a 0/1 mask is ``radius`` at most."""
    s = spread(df, [column], disk_kernel(radius)).join(df.select("x", "y", F.col(column).alias("_own_v")), ["x", "y"])
    near = F.min(F.when(F.col(column) != F.col("_own_v"), F.col("w")))
    return s.groupBy("x", "y").agg((F.coalesce(near, F.lit(1e9)) <= radius * radius).cast("int").alias("edge"))


def class_edges(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """1 where the k x k neighbourhood holds an edge of a class 1..n: some neighbours are of the class and some are not."""
    if k % 2 == 0:
        raise ValueError("the kernel must be odd")
    mixed = (F.count_distinct(column) > 1) & (F.max(column) > 0)
    return neighbourhood(df, column, box_kernel(k), mixed.cast("int"), "edge")


def tile_labels(column: str, connectivity: int):
    """Components within one tile: neighbours of equal value are linked, roots hook onto smaller roots until none differ."""
    steps = [(1, 0), (0, 1), *([(1, 1), (-1, 1)] if connectivity == 8 else [])]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame["x"].to_numpy(dtype=np.int64), frame["y"].to_numpy(dtype=np.int64)
        x0, y0 = x.min(), y.min()
        width, height = x.max() - x0 + 2, y.max() - y0 + 2  # an empty column and row between planes of one value each
        place = (pd.factorize(frame[column])[0].astype(np.int64) * height + y - y0) * width + x - x0
        node, where = np.unique(place, return_inverse=True)
        links = []
        for dx, dy in steps:
            to = node + dy * width + dx
            at = np.minimum(np.searchsorted(node, to), len(node) - 1)
            links.append(np.column_stack((np.flatnonzero(node[at] == to), at[node[at] == to])))
        a, b = np.concatenate(links).T
        root = np.arange(len(node))
        while (apart := root[a] != root[b]).any():
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while ((up := root[root]) != root).any():
                root = up
        first = node[root]
        component = ((first // width) % height + y0) * (1 << 31) + first % width + x0
        return frame[["x", "y", column]].assign(component=component[where])

    return run


def components(df: DataFrame, column: str, connectivity: int = 8, tile: int = 256) -> DataFrame:
    """(x, y, value, component) of non-null pixels; the component is the smallest y * 2**31 + x of its pixels.

    Tiles of ``tile`` x ``tile`` pixels are labelled each in its task; only pixels at the tiles' rims meet across, and the few labels that touch
    there are joined to components by rounds over written tables, whose number follows the logarithm of their count.
    """
    rounds = Rounds(df.sparkSession, "components")
    kinds = dict(df.dtypes)
    cut = lambda c: F.floor(F.col(c) / tile)
    tiles = df.filter(F.col(column).isNotNull()).select("x", "y", column, cut("x").alias("_tx"), cut("y").alias("_ty"))
    local = tiles.groupBy("_tx", "_ty").applyInPandas(tile_labels(column, connectivity), f"x {kinds['x']}, y {kinds['y']}, `{column}` {kinds[column]}, component long")
    local = rounds.keep(local, "tiles")
    edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    rim = local.filter(edge("x") | edge("y")).withColumns({"_tx": cut("x"), "_ty": cut("y")})
    near = spread(rim, ["component"], [k for k in box_kernel(3) if k[0] != 0 or k[1] != 0] if connectivity == 8 else [(1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)], [column, "_tx", "_ty"])
    near = near.select("x", "y", column, F.col("component").alias("a"), F.col("_tx").alias("_fx"), F.col("_ty").alias("_fy"))
    touch = near.join(rim, ["x", "y", column]).filter("_fx <> _tx or _fy <> _ty").select("a", F.col("component").alias("b")).filter("a > b").distinct()
    edges = rounds.keep(touch, "touch")
    if edges.isEmpty():
        return local
    whole = components_of(edges, rounds).select(F.col("node").alias("component"), F.col("component").alias("_whole"))
    return local.join(whole, "component", "left").select("x", "y", column, F.coalesce("_whole", "component").alias("component"))


def remove_small(df: DataFrame, column: str, least: int, background: int = 0, connectivity: int = 8) -> DataFrame:
    """Components of fewer pixels become background."""
    c = components(df, column, connectivity)
    small = c.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") < least)
    out = c.join(small.select("component", F.lit(True).alias("_small")), "component", "left")
    return out.select("x", "y", F.when(F.col("_small"), background).otherwise(F.col(column)).alias(column))


def ring_of(c: DataFrame, column: str) -> DataFrame:
    """(component, neighbour's value, neighbour's component) of the one-pixel ring around each component."""
    moved = spread(c, ["component"], [k for k in box_kernel(3) if k[:2] != (0, 0)]).select("x", "y", F.col("component").alias("of")).distinct()
    return moved.join(c.select("x", "y", column, "component"), ["x", "y"]).filter(F.col("of") != F.col("component"))


def replace_small(df: DataFrame, column: str, least: int, connectivity: int = 8) -> DataFrame:
    """Small components take the majority class of their ring, the lowest of those tied; all from the source map."""
    c = components(df, column, connectivity)
    small = c.groupBy("component").agg(F.count("*").alias("n"), F.first(column).alias("_own")).filter(F.col("n") < least)
    ring = ring_of(c, column).join(small.select(F.col("component").alias("of"), "_own"), "of").filter(F.col(column) != F.col("_own"))
    best = majority(ring.select(F.col("of").alias("component"), column), ["component"], column).select("component", F.col(column).alias("_new"))
    return c.join(best, "component", "left").select("x", "y", F.coalesce("_new", column).alias(column))


def fill_holes(df: DataFrame, column: str, most: int, background: int = 0) -> DataFrame:
    """Background components of ``most`` pixels at most, off the edge, with exactly one class around, take that class."""
    c = components(df, column, 4)
    box = df.agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))
    holes = c.filter(F.col(column) == background).crossJoin(F.broadcast(box)).groupBy("component").agg(F.count("*").alias("n"), F.bool_or((F.col("x") == F.col("x1")) | (F.col("x") == F.col("x2")) | (F.col("y") == F.col("y1")) | (F.col("y") == F.col("y2"))).alias("edge")).filter((F.col("n") <= most) & ~F.col("edge"))
    ring = ring_of(c, column).join(holes.select(F.col("component").alias("of")), "of").filter(F.col(column) != background)
    one = ring.groupBy("of").agg(F.count_distinct(column).alias("k"), F.min(column).alias("_new")).filter("k = 1")
    return c.join(one.select(F.col("of").alias("component"), "_new"), "component", "left").select("x", "y", F.coalesce("_new", column).alias(column))


def clean_map(df: DataFrame, column: str, kernel: int, least: int, most_hole: int) -> DataFrame:
    """Smooth (majority filter), replace small components, fill holes. The kernel is 0 or odd."""
    if kernel and kernel % 2 == 0:
        raise ValueError("the kernel must be 0 or odd")
    if kernel:
        df = majority(spread(df, [column], box_kernel(kernel)).join(df.select("x", "y"), ["x", "y"], "left_semi").select("x", "y", column), ["x", "y"], column).drop("votes")
    return fill_holes(replace_small(df, column, least), column, most_hole)


def boundary_edges(c: DataFrame, keys: list[str]) -> DataFrame:
    """Unit edges between a component and anything else: (component, x1, y1, x2, y2), clockwise around the component."""
    sides = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(a).alias("ax"), F.lit(b).alias("ay"), F.lit(p).alias("bx"), F.lit(q).alias("by")) for dx, dy, a, b, p, q in ((0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0))))
    s = c.select("component", "x", "y", F.explode(sides).alias("s"))
    other = c.select(F.col("component").alias("_c"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    s = s.withColumns({"nx": F.col("x") + F.col("s.dx"), "ny": F.col("y") + F.col("s.dy")}).join(other, ["nx", "ny"], "left")
    s = s.filter(F.col("_c").isNull() | (F.col("_c") != F.col("component")))
    return s.select("component", (F.col("x") + F.col("s.ax")).alias("x1"), (F.col("y") + F.col("s.ay")).alias("y1"), (F.col("x") + F.col("s.bx")).alias("x2"), (F.col("y") + F.col("s.by")).alias("y2"))


def dihedral(df: DataFrame, size: int) -> DataFrame:
    """The eight variants of tile coordinates: quarter turns and mirrored quarter turns."""
    x, y, n = F.col("x"), F.col("y"), F.lit(size - 1)
    forms = [(x, y), (y, n - x), (n - x, n - y), (n - y, x), (n - x, y), (y, x), (x, n - y), (n - y, n - x)]
    v = F.explode(F.array(*(F.struct(F.lit(i).alias("variant"), a.alias("vx"), b.alias("vy")) for i, (a, b) in enumerate(forms))))
    return df.select("*", v.alias("_v")).select(*df.columns, "_v.variant", "_v.vx", "_v.vy")


def mosaic_offsets(images: DataFrame) -> DataFrame:
    """x offset of each image side by side in list order (no, width)."""
    rows = running_sums(placed(images, ["no"], Rounds(images.sparkSession, "mosaic")), [], {"offset": "width"})
    return unplaced(rows.withColumn("offset", F.col("offset") - F.col("width")))
