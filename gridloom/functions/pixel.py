"""Column functions on pixel values: spectral indices, stretches, projections. All stay in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(v: Column, lo: float, hi: float) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


def normalized_difference(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return clip((a - b) / (a + b + F.lit(eps)), -1.0, 1.0)


def ndwi(green: Column, nir: Column, eps: float = 1e-10) -> Column:
    return normalized_difference(green, nir, eps)


def ndvi(red: Column, nir: Column, eps: float = 1e-10) -> Column:
    return normalized_difference(nir, red, eps)


def nbr(nir: Column, swir2: Column) -> Column:
    """Null where both are zero."""
    return F.try_divide(nir - swir2, nir + swir2)


#: Bands of the named indices, positive one first.
INDEX_BANDS = {"NDVI": ("nir", "red"), "NDWI": ("green", "nir"), "NBR": ("nir", "swir2")}


def index_by_name(name: str, bands: dict[str, Column], eps: float = 1e-8) -> Column:
    if name.upper() not in INDEX_BANDS:
        raise ValueError(f"unknown index {name}")
    a, b = INDEX_BANDS[name.upper()]
    return normalized_difference(bands[a], bands[b], eps)


def stretch_255(v: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return clip((v - lo) / (hi - lo) * 255, 0.0, 255.0).cast("int")


def index_to_byte(index: Column, nodata: Column) -> Column:
    return F.when(nodata, 255).otherwise(clip((index + 1) * 127, 0.0, 254.0).cast("int"))


def rgb_to_gray(red: Column, green: Column, blue: Column, weights: tuple[float, float, float] = (0.299, 0.587, 0.114)) -> Column:
    return clip(red * weights[0] + green * weights[1] + blue * weights[2], 0.0, 255.0).cast("int")


def reflectance_to_rgb(band: Column, lo: float = 0.005, hi: float = 0.3, gamma: float = 2.2) -> Column:
    scaled = (clip(band / 10000.0, lo, hi) - lo) / (hi - lo)
    return F.bround(F.pow(scaled, F.lit(1 / gamma)) * 255, 6).cast("int")


def rgb_to_reflectance(value: Column, lo: float = 0.005, hi: float = 0.3, gamma: float = 2.2) -> Column:
    back = F.pow(value / 255.0, F.lit(gamma)) * (hi - lo) + lo
    return F.bround(clip(back * 10000, 0.0, 10000.0), 6).cast("int")


#: Divisors of the stored kinds; the 16-bit one is the reference default, not 65535.
DTYPE_SCALE = {"uint8": 255.0, "uint10": 1024.0, "uint16": 25535.0}


def normalize_dtype(v: Column, kind: str = "uint8", scale: dict[str, float] | None = None) -> Column:
    return clip(v / (scale or DTYPE_SCALE)[kind], 0.0, 1.0)


def pixel_to_geo(x: Column, y: Column, gt: list[float]) -> tuple[Column, Column]:
    return gt[0] + x * gt[1] + y * gt[2], gt[3] + x * gt[4] - y * abs(gt[5])


def geo_to_pixel(lon: Column, lat: Column, gt: list[float]) -> tuple[Column, Column]:
    """(0, 0) when the transform can't be inverted."""
    a, b, c, d = gt[1], gt[2], gt[4], -abs(gt[5])
    det = a * d - b * c
    if abs(det) < 1e-12:
        return F.lit(0.0), F.lit(0.0)
    dx, dy = lon - gt[0], lat - gt[3]
    return (dx * d - dy * b) / det, (dy * a - dx * c) / det


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = (F.floor((lon + 180) / 6) + 1).cast("int")
    return F.when(lat >= 0, zone + 32600).otherwise(zone + 32700)


def band_name(description: Column, tag: Column, position: Column, n_bands: int) -> Column:
    """Name from the description, else the tag, else the usual band at that position. The longest match wins, so B11 is not B1."""
    usual = {4: ["B2", "B3", "B4", "B8"], 3: ["B2", "B3", "B4"]}.get(n_bands, [f"B{i + 1}" for i in range(n_bands)])
    found = lambda c: F.nullif(F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), r"B(\d+A?)", 0), F.lit(""))
    return F.coalesce(found(description), found(tag), F.get(F.array(*map(F.lit, usual)), position))


def resized_axis(origin: Column, step: Column, scale: float) -> tuple[Column, Column]:
    """Only the two step terms of the transform change with a resample."""
    return origin, step * scale


def disturbance_class(nbr_value: Column) -> Column:
    return F.when(nbr_value < -0.25, "severe").when(nbr_value < 0.1, "moderate").when(nbr_value <= 0.27, "light").when(nbr_value.isNotNull(), "none")


def gauss_kruger_inverse(easting: Column, northing: Column, meridian: float = 96.0, false_easting: float = 500000.0) -> tuple[Column, Column]:
    """(lon, lat) degrees from transverse Mercator metres on GRS80, by the closed series of footpoint latitude."""
    import math

    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    mu = northing / radius
    series = (3 * n / 2 - 27 * n**3 / 32, 21 * n**2 / 16 - 55 * n**4 / 32, 151 * n**3 / 96, 1097 * n**4 / 512)
    foot = mu
    for k, c in enumerate(series, 1):
        foot = foot + F.sin(mu * (2 * k)) * c
    ep2 = e2 / (1 - e2)
    s, c, t = F.sin(foot), F.cos(foot), F.tan(foot)
    big_n, big_r = a / F.sqrt(1 - e2 * s * s), a * (1 - e2) / F.pow(1 - e2 * s * s, F.lit(1.5))
    cc, tt = ep2 * c * c, t * t
    d = (easting - false_easting) / big_n
    lat = foot - big_n * t / big_r * (d * d / 2 - (5 + 3 * tt + 10 * cc - 4 * cc * cc - 9 * ep2) * F.pow(d, F.lit(4)) / 24 + (61 + 90 * tt + 298 * cc + 45 * tt * tt - 252 * ep2 - 3 * cc * cc) * F.pow(d, F.lit(6)) / 720)
    lon = (d - (1 + 2 * tt + cc) * F.pow(d, F.lit(3)) / 6 + (5 - 2 * cc + 28 * tt - 3 * cc * cc + 8 * ep2 + 24 * tt * tt) * F.pow(d, F.lit(5)) / 120) / c
    return meridian + lon * (180 / math.pi), lat * (180 / math.pi)
