"""Filters, predicates and cleaning of point, pixel, box and label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pixels import bands_of, scale_bands
from .stats import column_quantiles


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def valid_coordinates(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Finite, in range with both ends; a depth column named in Chinese is renamed."""
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    out = df.filter(finite(x) & finite(y) & x.between(-180, 180) & y.between(-90, 90))
    return out.withColumnRenamed("水深", "depth") if "depth" not in df.columns else out


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows with every band missing go."""
    return df.dropna(how="all", subset=bands_of(df))


def drop_nonpositive(df: DataFrame, bands: list[str]) -> DataFrame:
    """Keep rows with a band over 0; missing counts as 0."""
    return df.filter(F.greatest(*(F.coalesce(b, F.lit(0)) for b in bands)) > 0)


def drop_any_missing(df: DataFrame, bands: list[str]) -> DataFrame:
    return df.dropna(how="any", subset=bands)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in the given order: one grouped minimum with map-side combining, no sort of groups."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def impute_median(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Missing values become the column's median (interpolated, or approximate for very large inputs)."""
    out = df.crossJoin(F.broadcast(column_quantiles(df, columns, [0.5], approximate)))  # one row
    return out.select(*(F.coalesce(c, F.get(f"_{c}", F.lit(0))).alias(c) if c in columns else F.col(c) for c in df.columns))


def clip_quantiles(df: DataFrame, columns: list[str], lo: float = 0.005, hi: float = 0.995, approximate: bool = False) -> DataFrame:
    """Values beyond the column's quantiles become the quantile; all columns in one aggregation."""
    out = df.crossJoin(F.broadcast(column_quantiles(df, columns, [lo, hi], approximate)))  # one row
    bound = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(c, F.get(f"_{c}", F.lit(0))), F.get(f"_{c}", F.lit(1))))
    return out.select(*(bound(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def preprocess(df: DataFrame, factor: float = 1e-4, lo: float = 0.005, hi: float = 0.995, approximate: bool = False) -> DataFrame:
    """Scale, drop empty rows, impute medians (bands and depth), clip bands, cast to float, in that order."""
    bands = bands_of(df)
    more = [c for c in ("depth",) if c in df.columns]
    out = clip_quantiles(impute_median(drop_empty_rows(scale_bands(df, factor)), bands + more, approximate), bands, lo, hi, approximate)
    return out.select(*(F.col(c).cast("float").alias(c) if c in bands else F.col(c) for c in out.columns))


def round_coordinates(df: DataFrame, columns: tuple[str, ...] = ("lon", "lat"), decimals: int = 6) -> DataFrame:
    return df.select(*(F.bround(c, decimals).alias(c) if c in columns else F.col(c) for c in df.columns))


def mask_nodata(v: Column, nodata: float) -> Column:
    return F.nullif(v, F.lit(nodata))


def scenes_at(scenes: DataFrame, box: tuple[float, float, float, float], most_cloud: float, day: Column | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Scenes whose footprint meets the box, with less cloud, in the half-open date range."""
    x1, y1, x2, y2 = box
    out = scenes.filter((F.col("min_lon") <= x2) & (F.col("max_lon") >= x1) & (F.col("min_lat") <= y2) & (F.col("max_lat") >= y1) & (F.col("cloud_pct") < most_cloud))
    if day is not None and start is not None and end is not None:
        out = out.filter((day >= F.lit(start)) & (day < F.lit(end)))
    return out


def clip_boxes(df: DataFrame, width: float, height: float) -> DataFrame:
    """Clip to the image and drop boxes that are empty then."""
    side = lambda c, top: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(top))
    out = df.withColumns({"x1": side("x1", width), "x2": side("x2", width), "y1": side("y1", height), "y2": side("y2", height)})
    return out.filter("x2 > x1 and y2 > y1")


def verify_labels(df: DataFrame, key: str = "image_id") -> DataFrame:
    """Per image: rows, duplicates, rows with values out of 0..1, and whether it is found or corrupt."""
    bad = F.lit(False)
    for c in ("cls", "cx", "cy", "w", "h"):
        bad = bad | F.coalesce(F.col(c) < 0, F.lit(True)) | ((F.col(c) > 1) if c != "cls" else F.lit(False))
    rows = df.groupBy(key, "cls", "cx", "cy", "w", "h").agg(F.count("*").alias("times")).withColumn("bad", bad)
    out = rows.groupBy(key).agg(F.sum("times").alias("n_rows"), F.sum(F.col("times") - 1).alias("n_duplicates"), F.sum(F.when(F.col("bad"), F.col("times")).otherwise(0)).alias("n_bad"))
    return out.withColumn("status", F.when(F.col("n_bad") > 0, "corrupt").otherwise("found"))


def drop_small(df: DataFrame, area: str, least: float, width: str | None = None, height: str | None = None, side: float = 10) -> DataFrame:
    out = df.filter(F.col(area) >= least)
    return out.filter((F.col(width) >= side) & (F.col(height) >= side)) if width and height else out
