"""Table operators on pixel and band tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as px

REQUIRED = ["longitude", "latitude", "red", "green", "blue", "nir", "water_mask"]


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def bands_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("band_")]


def compute_indices(df: DataFrame) -> DataFrame:
    """Gray, NDWI, NDVI and their byte forms, in the fixed output order with the mask last."""
    require(df, REQUIRED)
    c = F.col
    water, plant = px.ndwi(c("green"), c("nir")), px.ndvi(c("red"), c("nir"))
    return df.select(
        *REQUIRED[:-1], px.rgb_to_gray(c("red"), c("green"), c("blue")).alias("gray"), F.bround(water, 6).alias("ndwi"), F.bround(plant, 6).alias("ndvi"),
        px.stretch_255(water).alias("ndwi_255"), px.stretch_255(plant).alias("ndvi_255"), "water_mask",
    )


def stretch_to_scene(df: DataFrame, columns: list[str], key: str = "scene") -> DataFrame:
    """Second stretch to each scene's own range. The per-scene bounds are one grouped row a scene."""
    bounds = df.groupBy(key).agg(*(f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))))
    out = df.join(bounds, key)
    for c in columns:
        lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        out = out.withColumn(c, F.when(hi > lo, ((F.col(c) - lo) * 255.0 / (hi - lo)).cast("int")).otherwise(F.col(c)))
    return out.select(*df.columns)


def scale_bands(df: DataFrame, factor: float = 1e-4) -> DataFrame:
    bands = set(bands_of(df))
    return df.select(*((F.col(c) * factor).alias(c) if c in bands else F.col(c) for c in df.columns))


def scale_offset(df: DataFrame, meta: DataFrame) -> DataFrame:
    """v * scale + offset by band; a band without metadata keeps scale 1 and offset 0."""
    out = df.join(meta, "band", "left")
    return out.withColumn("v", F.col("v") * F.coalesce("scale", F.lit(1.0)) + F.coalesce("offset", F.lit(0.0))).drop("scale", "offset")


def rings_to_geo(rings: Column, gt: list[float]) -> Column:
    """Every ring of at least three points in geographic coordinates."""

    def point(p: Column) -> Column:
        x, y = px.pixel_to_geo(p["x"], p["y"], gt)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.filter(F.transform(rings, lambda ring: F.transform(ring, point)), lambda ring: F.size(ring) >= 3)


def label_color_to_class(df: DataFrame, colours: DataFrame) -> DataFrame:
    """Class of the exactly matching colour, else 0."""
    return df.join(colours, ["r", "g", "b"], "left").withColumn("class_id", F.coalesce("class_id", F.lit(0)))


def one_vs_rest(df: DataFrame, column: str) -> DataFrame:
    """One binary row a pixel and present class. The class list is one aggregated row, exploded in place."""
    classes = df.agg(F.collect_set(column).alias("classes"))
    out = df.crossJoin(F.broadcast(classes)).withColumn("class_id", F.explode("classes")).drop("classes")
    return out.withColumn("v", (F.col(column) == F.col("class_id")).cast("int"))


def binary_threshold(df: DataFrame, column: str, kind: str, threshold: float = 127, key: str = "scene") -> DataFrame:
    """0 or 255: booleans as they are, floats over .5, integers over 0 where the scene's maximum is 1 at most, else over the threshold."""
    v = F.col(column)
    if kind == "bool":
        hit = v
    elif kind == "float":
        hit = v > 0.5
    else:
        tops = df.groupBy(key).agg(F.max(column).alias("_top"))
        df = df.join(tops, key)
        hit = F.when(F.col("_top") <= 1, v > 0).otherwise(v > threshold)
    return df.withColumn(column, F.when(hit, 255).otherwise(0)).drop("_top")


def overwrite_class(base: DataFrame, insert: DataFrame, value: int) -> DataFrame:
    both = base.join(insert.withColumnRenamed("v", "_v"), ["x", "y"], "full_outer")
    return both.select("x", "y", F.when(F.col("_v") == 1, value).otherwise(F.coalesce("v", F.lit(0))).alias("v"))


def resample_mean(df: DataFrame, tx: Column, ty: Column, bands: list[str]) -> DataFrame:
    """Mean of each target cell; null (nodata) values don't count."""
    return df.groupBy(tx.cast("int").alias("tx"), ty.cast("int").alias("ty")).agg(*(F.avg(b).alias(b) for b in bands), F.count(bands[0]).alias("n"))


def ndvi_class(v: Column) -> Column:
    return F.when(v < 0, "below_0").when(v < 0.2, "0_to_0.2").when(v < 0.4, "0.2_to_0.4").when(v < 0.6, "0.4_to_0.6").when(v.isNotNull(), "from_0.6")
