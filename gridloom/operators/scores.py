"""Reductions of score maps and change maps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import components, dilate, tile_labels
from .joins import box_candidates


def class_scores(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Per pixel and class the best of its prompts; a class without prompts scores 0. Classes are a small fixed list."""
    best = df.groupBy("x", "y", "class_id").agg(F.max("score").alias("score"))
    listed = classes.agg(F.sort_array(F.collect_set("class_id")).alias("_ids"))
    full = df.select("x", "y").distinct().crossJoin(F.broadcast(listed)).select("x", "y", F.explode("_ids").alias("class_id"))
    return full.join(best, ["x", "y", "class_id"], "left").na.fill(0.0, ["score"])


def discrete(df: DataFrame, threshold: float, background: int = 0) -> DataFrame:
    best = df.groupBy("x", "y").agg(F.max_by(F.col("class_id"), F.struct(F.col("score"), -F.col("class_id"))).alias("class_id"), F.max("score").alias("score"))
    return best.withColumn("class_id", F.when(F.col("score") < threshold, background).otherwise(F.col("class_id")))


def otsu(df: DataFrame, column: str, by: list[str], bins: int = 256) -> DataFrame:
    """Threshold of the largest variance between classes over a histogram of fixed size; 0 where the range is 1e-4 or less."""
    bounds = df.groupBy(*by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    b = F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    hist = df.join(bounds, by).filter(F.col("hi") - F.col("lo") > 1e-4).groupBy(*by, b.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    mid = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    w = Window.partitionBy(*by).orderBy("bin")
    run, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    h = hist.withColumn("mid", mid).withColumns({"n0": F.sum("n").over(run), "s0": F.sum(F.col("n") * F.col("mid")).over(run), "nt": F.sum("n").over(whole), "st": F.sum(F.col("n") * F.col("mid")).over(whole)})
    n1 = F.col("nt") - F.col("n0")
    spread = F.when(n1 > 0, F.col("n0") * n1 * F.pow(F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / n1, F.lit(2)))
    best = h.withColumn("v", F.bround(spread, 3)).filter("v is not null").groupBy(*by).agg(F.max_by("mid", F.struct(F.col("v"), -F.col("bin"))).alias("threshold"))
    return bounds.select(*by).join(best, by, "left").na.fill(0.0, ["threshold"])


def change_energy(df: DataFrame, least: float = 0.01) -> DataFrame:
    """(x, y, class_id) kept: confidence over both dates x largest score change x feature change, above the class's Otsu threshold."""
    e = df.groupBy("x", "y", "class_id").agg((F.greatest(F.max("s1"), F.max("s2")) * F.max(F.abs(F.col("s2") - F.col("s1"))) * F.max("feature")).alias("energy"))
    t = otsu(e, "energy", ["class_id"])
    kept = e.join(t, "class_id").filter(F.col("energy") > F.greatest("threshold", F.lit(least)))
    return kept.groupBy("x", "y").agg(F.max("class_id").alias("class_id"))


def agreement(a: DataFrame, b: DataFrame, background: int = 0) -> DataFrame:
    both = a.join(b.select("x", "y", F.col("v").alias("_b")), ["x", "y"])
    return both.select("x", "y", F.when((F.col("v") != background) & (F.col("_b") != background), F.col("v")).otherwise(background).alias("v"))


def multipass(df: DataFrame, n_pixels: int, thresholds: tuple[float, ...] = (0.7, 0.49, 0.343), coverage: float = 0.95, gain: float = 0.001) -> DataFrame:
    """First pass whose score exceeds its threshold owns the pixel; passes stop at the coverage or at too small a gain."""
    limit = F.get(F.array(*map(F.lit, thresholds)), F.least(F.col("pass"), F.lit(len(thresholds) - 1)))
    owned = df.filter(F.col("score") > limit).groupBy("x", "y").agg(F.min("pass").alias("pass"))
    per = owned.groupBy("pass").agg(F.count("*").alias("n"))
    w = Window.orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)  # a row a pass
    per = per.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)) / n_pixels).withColumn("small", F.coalesce(F.bool_or(F.col("n") / n_pixels < gain).over(w), F.lit(False)))
    run = per.filter((F.col("before") < coverage) & ~F.col("small")).select("pass")
    return owned.join(F.broadcast(run), "pass", "left_semi").select("x", "y", "pass")


def verification(df: DataFrame, least_side: float = 10, threshold: float = 0.5) -> DataFrame:
    """Instances of enough size with their class score, its share of the best class, rank and verdict."""
    best = df.filter((F.col("w") >= least_side) & (F.col("h") >= least_side)).groupBy("instance", "target", "class_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("instance")
    out = best.withColumns({"top": F.max("score").over(w), "rank": F.rank().over(w.orderBy(F.desc("score")))}).filter("class_id = target")
    return out.select("instance", "target", F.bround("score", 4).alias("score"), F.bround(F.try_divide("score", "top"), 4).alias("relative"), "rank", (F.col("rank") == 1).alias("top1"), (F.try_divide("score", "top") >= threshold).alias("keep"))


def verdict_policy(df: DataFrame, mode: str, threshold: float) -> DataFrame:
    """``uncertain`` leaves rows with a sure score; an error keeps the old flag."""
    skip = (F.col("score") >= threshold) if mode == "uncertain" else F.lit(False)
    new = F.when(skip | F.col("error").isNotNull(), F.col("keep")).otherwise(F.col("verdict"))
    return df.withColumn("new_keep", new).withColumn("changed", F.col("new_keep") != F.col("keep"))


def nearest_colour(df: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """Palette index of least squared distance, the lowest of those tied."""
    far = [F.pow(F.col("r") - r, F.lit(2)) + F.pow(F.col("g") - g, F.lit(2)) + F.pow(F.col("b") - b, F.lit(2)) for r, g, b in palette]
    best = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far))))
    return df.withColumn("class_id", best["i"])


def class_list(df: DataFrame, skip_first: bool = False) -> DataFrame:
    """(class_id, name, synonym) of lines in order: the line's number is the class, its first word the name."""
    lines = df.select(F.col("line_no"), F.split("line", r"\s*,\s*").alias("w"))
    lines = lines.filter("line_no > 0") if skip_first else lines
    return lines.select(F.col("line_no").alias("class_id"), F.get("w", F.lit(0)).alias("name"), F.explode("w").alias("synonym"))


def instance_changes(df: DataFrame, radius: int = 2, most_cover: float = 0.3, least: int = 20) -> DataFrame:
    """(x, y, changed) of a pixel table with the masks ``t1`` and ``t2`` of two dates.

    An instance (8-neighbours, mask over 0) of one date has changed when the other date's mask, widened by ``radius``, covers less than
    ``most_cover`` of it and it has ``least`` pixels. Either date counts.
    """
    marks = []
    for own, other in (("t1", "t2"), ("t2", "t1")):
        wide = dilate(df.select("x", "y", (F.col(other) > 0).cast("int").alias("_cover")), "_cover", 2 * radius + 1) if radius else df.select("x", "y", (F.col(other) > 0).cast("int").alias("_cover"))
        parts = components(df.filter(F.col(own) > 0).select("x", "y", F.lit(1).alias("_on")), "_on").join(wide, ["x", "y"])
        changed = parts.groupBy("component").agg(F.avg("_cover").alias("_share"), F.count("*").alias("_area")).filter((F.col("_share") < most_cover) & (F.col("_area") >= least))
        marks.append(parts.join(changed.select("component"), "component", "left_semi").select("x", "y"))
    hit = marks[0].union(marks[1]).distinct().withColumn("_hit", F.lit(True))
    return df.select("x", "y").join(hit, ["x", "y"], "left").select("x", "y", F.coalesce("_hit", F.lit(False)).alias("changed"))


def remove_rejected(pixels: DataFrame, instances: DataFrame, column: str = "v", cell: float = 64.0) -> DataFrame:
    """The class map without the rejected instances (instance, class_id, area, x1, y1, x2, y2, keep): inside an instance's box, the
    component of its class whose area is closest to the recorded one (the first in raster order of those tied) becomes 0.

    A box is cut out of the source map and labelled in one task; it is an image's size at most. Boxes meet pixels on grid cells.
    """
    gone = instances.filter(~F.coalesce("keep", F.lit(True)) & (F.col("class_id") > 0))
    boxes = gone.select("instance", "class_id", "area", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    unit = pixels.select("x", "y", F.col(column).alias("class_id"), F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), (F.col("x") + 1.0).alias("x2"), (F.col("y") + 1.0).alias("y2"))
    inside = box_candidates(unit, boxes, cell, ["class_id"]).select(F.col("instance_b").alias("instance"), F.col("area_b").alias("area"), F.col("x_a").alias("x"), F.col("y_a").alias("y"), F.lit(1).alias("_on"))
    label = tile_labels("_on", 8)

    def closest(frame: pd.DataFrame) -> pd.DataFrame:
        parts = label(frame)
        size = parts.groupby("component")["x"].transform("size")
        best = min(zip((size - frame["area"].iloc[0]).abs(), parts["component"], strict=True))[1]
        return parts.loc[parts["component"] == best, ["x", "y"]]

    kinds = dict(pixels.dtypes)
    cut = inside.groupBy("instance").applyInPandas(closest, f"x {kinds['x']}, y {kinds['y']}").distinct().withColumn("_gone", F.lit(True))
    return pixels.join(cut, ["x", "y"], "left").withColumn(column, F.when(F.col("_gone"), 0).otherwise(F.col(column))).drop("_gone")
