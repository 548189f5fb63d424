"""Joins: grids, masks, bands, features, graphs and times. Range conditions meet on grid cells, so they stay equi-joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_grid(points: DataFrame, grid: DataFrame, x0: float, y0: float, dx: float, dy: float, keep_outside: bool = True) -> DataFrame:
    """Band values at points: row and column by floor; points outside stay with nulls (left) or go (inner)."""
    keyed = points.withColumns({"x": F.floor((F.col("lon") - x0) / dx).cast("int"), "y": F.floor((F.col("lat") - y0) / dy).cast("int")})
    return keyed.join(grid, ["x", "y"], "left" if keep_outside else "inner")


def attach_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """1 where the mask is over 0; outside the mask 0."""
    return pixels.join(mask.withColumnRenamed("v", "_v"), ["x", "y"], "left").withColumn("mask", F.coalesce((F.col("_v") > 0).cast("int"), F.lit(0))).drop("_v")


def stack_bands(frames: dict[str, DataFrame]) -> DataFrame:
    """One column a frame. Frames of other sizes are an error, found by an aggregate, not by collecting rows."""
    names = list(frames)
    sizes = {n: f.agg(F.count("*"), F.max("x"), F.max("y")).first() for n, f in frames.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"sizes differ: {sizes}")
    out = frames[names[0]].withColumnRenamed("v", names[0])
    for n in names[1:]:
        out = out.join(frames[n].withColumnRenamed("v", n), ["x", "y"])
    return out


def common_names(files: DataFrame, n_folders: int, suffix: str = ".png") -> DataFrame:
    """Names with the suffix in every folder."""
    return files.filter(F.col("name").endswith(suffix)).groupBy("name").agg(F.count_distinct("folder").alias("n")).filter(F.col("n") == n_folders).select("name")


def pair_by_stem(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs on the file stem, and the unpaired ones of the left side."""
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, "[^/]+$", 0), r"\.[^.]*$", "")
    a, b = a.withColumn("stem", stem("path_a")), b.withColumn("stem", stem("path_b"))
    return a.join(b, "stem"), a.join(b, "stem", "left_anti")


def exclude_ids(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return df.join(used.select(key), key, "left_anti")


def cells(a: Column, b: Column, size: float) -> Column:
    return F.sequence(F.floor(a / size), F.floor(b / size))


def leveled(df: DataFrame, suffix: str, cell: float) -> DataFrame:
    """Adds ``_level``: the least n with sides of cell * 2**n at most, so a box covers four cells of its level at most."""
    side = F.greatest(F.col(f"x2{suffix}") - F.col(f"x1{suffix}"), F.col(f"y2{suffix}") - F.col(f"y1{suffix}"), F.lit(cell))
    return df.withColumn("_level", F.ceil(F.log2(side / cell)).cast("int"))


def copies_met(a: DataFrame, b: DataFrame, on: list[str], meet: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """All pairs of boxes from the pairs that ``meet`` gives for the distinct boxes of both sides: each copy of a box has the pairs of its kind.

    ``meet`` takes and gives boxes as ``box_candidates``; what else it gives (an IoU) stays, and what it drops is dropped for all copies.
    """
    sides = ["x1", "y1", "x2", "y2"]
    kinds = lambda df: df.select(*on, *sides).distinct()
    rows = lambda df, s: df.select(*(F.col(c).alias(c if c in on else f"{c}_{s}") for c in df.columns))
    out = meet(kinds(a), kinds(b))
    for df, s in ((a, "a"), (b, "b")):
        out = out.join(rows(df, s), [*on, *(f"{c}_{s}" for c in sides)])
    return out


def box_candidates(a: DataFrame, b: DataFrame, cell: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of boxes (x1, y1, x2, y2 with the suffixes _a and _b) that overlap, of equal ``on``; boxes meet on the cells they cover.

    Cells double with a box's level, so no shape covers more than four of its own level; it also stands in the cells of every coarser
    level that occurs, and a pair meets on the coarser level of both. It counts in one cell only, that of its
    overlap's lower corner, so nothing needs to be made distinct.
    """
    on = on or []
    left = leveled(a.select(*(F.col(c).alias(c if c in on else f"{c}_a") for c in a.columns)), "_a", cell)
    right = leveled(b.select(*(F.col(c).alias(c if c in on else f"{c}_b") for c in b.columns)), "_b", cell)
    found = sorted({r[0] for r in left.select("_level").union(right.select("_level")).distinct().collect() if r[0] is not None})  # a few dozen at most
    if not found:
        found = [0]

    def placed(df: DataFrame, suffix: str) -> DataFrame:
        levels = F.filter(F.array(*map(F.lit, found)), lambda n: n >= F.col(f"_own{suffix}"))
        df = df.withColumnRenamed("_level", f"_own{suffix}").withColumn("_level", F.explode(levels))
        size = F.pow(F.lit(2.0), F.col("_level")) * cell
        return df.withColumn("cx", F.explode(F.sequence(F.floor(F.col(f"x1{suffix}") / size), F.floor(F.col(f"x2{suffix}") / size)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col(f"y1{suffix}") / size), F.floor(F.col(f"y2{suffix}") / size))))

    meet = (F.col("x1_a") < F.col("x2_b")) & (F.col("x1_b") < F.col("x2_a")) & (F.col("y1_a") < F.col("y2_b")) & (F.col("y1_b") < F.col("y2_a"))
    size = F.pow(F.lit(2.0), F.col("_level")) * cell
    once = (F.col("_level") == F.greatest("_own_a", "_own_b")) & (F.col("cx") == F.floor(F.greatest("x1_a", "x1_b") / size)) & (F.col("cy") == F.floor(F.greatest("y1_a", "y1_b") / size))
    return placed(left, "_a").join(placed(right, "_b"), [*on, "_level", "cx", "cy"]).filter(meet & once).drop("cx", "cy", "_level", "_own_a", "_own_b")


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Crossing parity over the ring's edges, half-open in y."""
    n = F.size(ring)
    edges = F.sequence(F.lit(0), n - 1)

    def crossing(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda s, i: s + crossing(i)) % 2 == 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(point columns, fid): polygons (fid, x1..y2 bounds, ring) meet points on grid cells, then by crossing parity.

    Each distinct place is tested once with each distinct polygon; copies have the pairs of their kind.
    """
    kind = ["x1", "y1", "x2", "y2", "ring"]
    left = points.select("px", "py").distinct().withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    right = polygons.select(*kind).distinct().withColumn("cx", F.explode(cells(F.col("x1"), F.col("x2"), cell))).withColumn("cy", F.explode(cells(F.col("y1"), F.col("y2"), cell)))
    met = left.join(right, ["cx", "cy"]).filter(inside_ring(F.col("px"), F.col("py"), F.col("ring"))).select("px", "py", *kind)
    own = polygons.select("fid", *(F.col(c).alias(f"_{c}") for c in kind))
    same = [F.col(c) == F.col(f"_{c}") for c in kind]
    return points.join(met, ["px", "py"]).join(own, same).select(*points.columns, "fid")


def merge_verdicts(regions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The last verdict of each region wins; ids of 0 and less are skipped."""
    last = verdicts.filter("region_id > 0").groupBy("region_id").agg(F.max_by("verdict", "seq").alias("verdict"))
    return regions.join(last, "region_id", "left").withColumn("classified", F.col("verdict").isNotNull())


def union_with_split(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in frames.items():
        df = df.withColumn("_split", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def triples(nodes: DataFrame, edges: DataFrame, limit: int | None = 100) -> DataFrame:
    a = nodes.select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    b = nodes.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    out = edges.join(a, "src").join(b, "dst").select("id", "type", "src", "src_name", "dst", "dst_name")
    return out.orderBy("id").limit(limit) if limit else out


def neighbours(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """Edges at a node, seen from it; an unknown direction means both."""
    out = edges.filter(F.col("src") == node).select("type", F.col("dst").alias("neighbour"), F.lit("out").alias("direction"))
    into = edges.filter(F.col("dst") == node).select("type", F.col("src").alias("neighbour"), F.lit("in").alias("direction"))
    return {"out": out, "in": into}.get(direction, out.union(into))


def as_of(observations: DataFrame, dates: DataFrame, key: str, ts: str, date: str) -> DataFrame:
    """The latest observation at or before each date, per key.

    Both sides are united and swept once in time order per key: no range join.
    """
    rest = [c for c in observations.columns if c not in (key, ts)]
    o = observations.select(key, F.col(ts).alias("_t"), F.struct(F.col(ts).alias(ts), *rest).alias("_o"), F.lit(0).alias("_kind"), F.lit(None).cast(dates.schema[date].dataType).alias(date))
    d = dates.select(key, F.col(date).alias("_t"), F.lit(None).cast(o.schema["_o"].dataType).alias("_o"), F.lit(1).alias("_kind"), date)
    w = Window.partitionBy(key).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = o.unionByName(d).withColumn("_o", F.last("_o", ignorenulls=True).over(w)).filter("_kind = 1")
    return out.select(key, date, "_o.*")
