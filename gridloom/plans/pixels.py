"""Plans of the pixel projections (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixel as px
from ..operators import pixels as op
from .registry import plan

C = F.col
GT = [100.0, 0.01, 0.002, 30.0, 0.001, -0.01]


def r6(c):
    return F.bround(c, 6)


ND = "greatest(-1.0E0, least(1.0E0, ({a} - {b}) / ({a} + {b} + {eps})))"
NDWI_SQL = "CASE WHEN nir IS NOT NULL THEN " + ND.format(a="green", b="nir", eps="1e-10") + " END"
NDVI_SQL = "CASE WHEN nir IS NOT NULL THEN " + ND.format(a="nir", b="red", eps="1e-10") + " END"


@plan("pixels", f"SELECT x, y, round_even({NDWI_SQL}, 6) AS ndwi FROM pixels")
def p01_ndwi(p: DataFrame) -> DataFrame:
    return p.select("x", "y", r6(px.ndwi(C("green"), C("nir"))).alias("ndwi"))


@plan("pixels", f"SELECT x, y, round_even({NDVI_SQL}, 6) AS ndvi FROM pixels")
def p02_ndvi(p: DataFrame) -> DataFrame:
    return p.select("x", "y", r6(px.ndvi(C("red"), C("nir"))).alias("ndvi"))


@plan("pixels", "SELECT x, y, round_even(CASE WHEN nir + swir2 = 0 THEN NULL ELSE (nir - swir2) / (nir + swir2) END, 6) AS nbr FROM pixels")
def p03_nbr(p: DataFrame) -> DataFrame:
    return p.select("x", "y", r6(px.nbr(C("nir"), C("swir2"))).alias("nbr"))


@plan("pixels", "SELECT x, y, round_even(" + ND.format(a="red", b="blue", eps="1e-8") + ", 6) AS nd FROM pixels")
def p04_normalized_difference(p: DataFrame) -> DataFrame:
    return p.select("x", "y", r6(px.normalized_difference(C("red"), C("blue"))).alias("nd"))


STRETCH_SQL = "CAST(trunc(greatest(0.0E0, least(255.0E0, ({v} - (-1.0E0)) / (1.0E0 - (-1.0E0)) * 255))) AS INT)"


@plan("pixels", "SELECT x, y, CASE WHEN nir IS NOT NULL THEN " + STRETCH_SQL.format(v=f"({NDVI_SQL})") + " END AS ndvi_255 FROM pixels")
def p05_stretch_255(p: DataFrame) -> DataFrame:
    return p.select("x", "y", px.stretch_255(px.ndvi(C("red"), C("nir"))).alias("ndvi_255"))


@plan("pixels", f"SELECT x, y, CASE WHEN nir IS NULL THEN 255 ELSE CAST(trunc(greatest(0.0E0, least(254.0E0, ({NDVI_SQL} + 1) * 127))) AS INT) END AS ndvi_byte FROM pixels")
def p06_index_to_byte(p: DataFrame) -> DataFrame:
    return p.select("x", "y", px.index_to_byte(px.ndvi(C("red"), C("nir")), C("nir").isNull()).alias("ndvi_byte"))


GRAY_SQL = "CAST(trunc(greatest(0.0E0, least(255.0E0, red / 10 * 0.299E0 + green / 10 * 0.587E0 + blue / 10 * 0.114E0))) AS INT)"


@plan("pixels", f"SELECT x, y, {GRAY_SQL} AS gray FROM pixels")
def p07_rgb_to_gray(p: DataFrame) -> DataFrame:
    return p.select("x", "y", px.rgb_to_gray(C("red") / 10, C("green") / 10, C("blue") / 10).alias("gray"))


@plan(
    "pixels",
    f"""SELECT lon AS longitude, lat AS latitude, red, green, blue, nir,
    CAST(trunc(greatest(0.0E0, least(255.0E0, red * 0.299E0 + green * 0.587E0 + blue * 0.114E0))) AS INT) AS gray,
    round_even({NDWI_SQL}, 6) AS ndwi, round_even({NDVI_SQL}, 6) AS ndvi,
    CASE WHEN nir IS NOT NULL THEN {STRETCH_SQL.format(v=f"({NDWI_SQL})")} END AS ndwi_255,
    CASE WHEN nir IS NOT NULL THEN {STRETCH_SQL.format(v=f"({NDVI_SQL})")} END AS ndvi_255, water_mask FROM pixels""",
)
def p08_compute_indices(p: DataFrame) -> DataFrame:
    return op.compute_indices(p.withColumnsRenamed({"lon": "longitude", "lat": "latitude"}))


RGB_SQL = "CAST(trunc(round_even(pow((greatest(0.005E0, least(0.3E0, {b} / 10000.0E0)) - 0.005E0) / (0.3E0 - 0.005E0), 1 / 2.2E0) * 255, 6)) AS INT)"


@plan("pixels", "SELECT x, y, " + ", ".join(f"{RGB_SQL.format(b=b)} AS {b}_rgb" for b in ("red", "green", "blue")) + " FROM pixels")
def p09_reflectance_to_rgb(p: DataFrame) -> DataFrame:
    return p.select("x", "y", *(px.reflectance_to_rgb(C(b)).alias(f"{b}_rgb") for b in ("red", "green", "blue")))


@plan(
    "pixels",
    f"""WITH v AS (SELECT scene, x, y, {RGB_SQL.format(b="red")} AS v FROM pixels), s AS (SELECT scene, min(v) AS lo, max(v) AS hi FROM v GROUP BY scene)
    SELECT scene, x, y, CAST(CASE WHEN hi > lo THEN trunc((v - lo) * 255.0E0 / (hi - lo)) ELSE v END AS INT) AS red_rgb FROM v JOIN s USING (scene)""",
)
def p10_stretch_to_scene(p: DataFrame) -> DataFrame:
    return op.stretch_to_scene(p.select("scene", "x", "y", px.reflectance_to_rgb(C("red")).alias("red_rgb")), ["red_rgb"])


@plan("pixels", "SELECT x, y, CAST(trunc(round_even(greatest(0.0E0, least(10000.0E0, (pow(CAST(red % 256 AS INT) / 255.0E0, 2.2E0) * (0.3E0 - 0.005E0) + 0.005E0) * 10000)), 6)) AS INT) AS red_reflectance FROM pixels")
def p11_rgb_to_reflectance(p: DataFrame) -> DataFrame:
    return p.select("x", "y", px.rgb_to_reflectance((C("red") % 256).cast("int")).alias("red_reflectance"))


@plan("samples", "SELECT seq, sub, lon, lat, round_even(band_2 * 1e-4, 6) AS band_2, round_even(band_3 * 1e-4, 6) AS band_3, round_even(band_4 * 1e-4, 6) AS band_4, round_even(band_8 * 1e-4, 6) AS band_8 FROM samples")
def p12_scale_bands(s: DataFrame) -> DataFrame:
    out = op.scale_bands(s)
    return out.select("seq", "sub", "lon", "lat", *(r6(c).alias(c) for c in op.bands_of(out)))


@plan("pixels", "SELECT x, y, 'red' AS band, round_even(red * 0.5E0 + 10, 6) AS v FROM pixels UNION ALL SELECT x, y, 'green', round_even(green * 1.0E0 + 0.0E0, 6) FROM pixels")
def p13_scale_offset(p: DataFrame) -> DataFrame:
    long = p.unpivot(["x", "y"], ["red", "green"], "band", "v")
    meta = p.sparkSession.createDataFrame([("red", 0.5, 10.0)], "band string, scale double, offset double")
    return op.scale_offset(long, meta).select("x", "y", "band", r6("v").alias("v"))


@plan("pixels", "SELECT x, y, round_even(greatest(0.0E0, least(1.0E0, red / 255.0E0)), 6) AS u8, round_even(greatest(0.0E0, least(1.0E0, red / 1024.0E0)), 6) AS u10, round_even(greatest(0.0E0, least(1.0E0, red / 25535.0E0)), 6) AS u16 FROM pixels")
def p14_normalize_dtype(p: DataFrame) -> DataFrame:
    return p.select("x", "y", *(r6(px.normalize_dtype(C("red"), k)).alias(n) for k, n in (("uint8", "u8"), ("uint10", "u10"), ("uint16", "u16"))))


DET = f"({GT[1]}E0 * -abs({GT[5]}E0) - {GT[2]}E0 * {GT[4]}E0)"


@plan(
    "pixels",
    f"""WITH g AS (SELECT x, y, {GT[0]}E0 + x * {GT[1]}E0 + y * {GT[2]}E0 AS gx, {GT[3]}E0 + x * {GT[4]}E0 - y * abs({GT[5]}E0) AS gy FROM pixels)
    SELECT x, y, round_even(gx, 6) AS gx, round_even(gy, 6) AS gy,
      round_even(((gx - {GT[0]}E0) * -abs({GT[5]}E0) - (gy - {GT[3]}E0) * {GT[2]}E0) / {DET}, 4) + 0.0E0 AS bx,
      round_even(((gy - {GT[3]}E0) * {GT[1]}E0 - (gx - {GT[0]}E0) * {GT[4]}E0) / {DET}, 4) + 0.0E0 AS bv FROM g""",
)
def p15_pixel_to_geo(p: DataFrame) -> DataFrame:
    gx, gy = px.pixel_to_geo(C("x"), C("y"), GT)
    bx, by = px.geo_to_pixel(gx, gy, GT)
    return p.select("x", "y", r6(gx).alias("gx"), r6(gy).alias("gy"), (F.bround(bx, 4) + 0.0).alias("bx"), (F.bround(by, 4) + 0.0).alias("bv"))


@plan(
    "rect_targets",
    """SELECT fid, unnest([0, 1, 2, 3]) AS corner,
    round_even(100.0E0 + unnest([x1, x2, x2, x1]) * 0.01E0 + unnest([y1, y1, y2, y2]) * 0.002E0, 6) AS gx,
    round_even(30.0E0 + unnest([x1, x2, x2, x1]) * 0.001E0 - unnest([y1, y1, y2, y2]) * 0.01E0, 6) AS gy FROM rect_targets""",
)
def p16_rings_to_geo(t: DataFrame) -> DataFrame:
    corners = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    rings = F.array(F.array(*(F.struct(C(a).alias("x"), C(b).alias("y")) for a, b in corners)))
    out = t.select("fid", op.rings_to_geo(rings, GT).alias("rings"))
    return out.select("fid", F.posexplode(F.get("rings", F.lit(0))).alias("corner", "p")).select("fid", "corner", r6("p.x").alias("gx"), r6("p.y").alias("gy"))


@plan("customer")
def p17_gauss_kruger_inverse(c: DataFrame) -> DataFrame:
    """Projected survey coordinates made from the customer key; the unit test holds it against known points."""
    e, n = 500000.0 + (C("c_custkey") * 97 % 150000), 3300000.0 + (C("c_custkey") * 41 % 200000)
    lon, lat = px.gauss_kruger_inverse(e, n)
    return c.select("c_custkey", e.alias("easting"), n.alias("northing"), F.bround(lon, 8).alias("lon"), F.bround(lat, 8).alias("lat"))


@plan("samples", "SELECT seq, sub, CAST(floor((lon - 270 + 180) / 6) + 1 AS INT) + CASE WHEN lat - 31 >= 0 THEN 32600 ELSE 32700 END AS epsg FROM samples")
def p18_utm_epsg(s: DataFrame) -> DataFrame:
    return s.select("seq", "sub", px.utm_epsg(C("lon") - 270, C("lat") - 31).alias("epsg"))


@plan(
    "part",
    r"""SELECT p_partkey, coalesce(nullif(regexp_extract(upper(concat(CASE WHEN p_partkey % 3 = 0 THEN 'band ' WHEN p_partkey % 3 = 1 THEN 'Sentinel b' ELSE '' END, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size % 13 AS VARCHAR) ELSE '' END)), 'B(\d+A?)', 0), ''),
    nullif(regexp_extract(upper(coalesce(CASE WHEN p_partkey % 5 = 0 THEN 'tag b8a' END, '')), 'B(\d+A?)', 0), ''), ['B2', 'B3', 'B4', 'B8'][CAST(p_partkey % 4 AS INT) + 1]) AS band FROM part""",
)
def p19_band_name(p: DataFrame) -> DataFrame:
    key = C("p_partkey") % 3
    size = F.when(key < 2, (C("p_size") % 13).cast("string")).otherwise("")
    text = F.concat(F.when(key == 0, "band ").when(key == 1, "Sentinel b").otherwise(""), size)
    tag = F.when(C("p_partkey") % 5 == 0, "tag b8a")
    return p.select("p_partkey", px.band_name(text, tag, (C("p_partkey") % 4).cast("int"), 4).alias("band"))


@plan("pixels", "SELECT x, y, CASE WHEN r = 0 AND g = 0 THEN 1 WHEN r = 1 AND g = 1 THEN 2 WHEN r = 2 AND g = 0 THEN 3 ELSE 0 END AS class_id FROM (SELECT x, y, CAST(red AS BIGINT) % 3 AS r, CAST(green AS BIGINT) % 2 AS g FROM pixels)")
def p20_label_color_to_class(p: DataFrame) -> DataFrame:
    colours = p.sparkSession.createDataFrame([(0, 0, 0, 1), (1, 1, 0, 2), (2, 0, 0, 3)], "r long, g long, b long, class_id int")
    rgb = p.select("x", "y", (C("red").cast("long") % 3).alias("r"), (C("green").cast("long") % 2).alias("g"), F.lit(0).cast("long").alias("b"))
    return op.label_color_to_class(rgb, colours).select("x", "y", "class_id")


@plan("pixels", "SELECT x, y, t.c AS class_id, CAST(gt_class = t.c AS INT) AS v FROM pixels CROSS JOIN (SELECT DISTINCT gt_class AS c FROM pixels) t")
def p21_one_vs_rest(p: DataFrame) -> DataFrame:
    return op.one_vs_rest(p.select("x", "y", "gt_class"), "gt_class").select("x", "y", "class_id", "v")


@plan("pixels", "SELECT scene, x, y, CASE WHEN m <= 1 THEN CASE WHEN gt_class > 0 THEN 255 ELSE 0 END ELSE CASE WHEN gt_class > 127 THEN 255 ELSE 0 END END AS v FROM pixels JOIN (SELECT scene, max(gt_class) AS m FROM pixels GROUP BY scene) USING (scene)")
def p22_binary_threshold(p: DataFrame) -> DataFrame:
    return op.binary_threshold(p.select("scene", "x", "y", C("gt_class").alias("v")), "v", "int")


@plan("pixels", "SELECT x, y, CASE WHEN water_mask = 1 THEN 9 ELSE coalesce(gt_class, 0) END AS v FROM pixels")
def p23_overwrite_class(p: DataFrame) -> DataFrame:
    return op.overwrite_class(p.select("x", "y", C("gt_class").alias("v")), p.select("x", "y", C("water_mask").alias("v")), 9)


@plan("scenes", "SELECT scene_id, min_lon AS a, round_even(0.01E0 * 2.5E0, 6) AS step FROM scenes")
def p24_resize_coords(s: DataFrame) -> DataFrame:
    origin, step = px.resized_axis(C("min_lon"), F.lit(0.01), 2.5)
    return s.select("scene_id", origin.alias("a"), r6(step).alias("step"))


@plan("pixels", "SELECT CAST(floor(x * 25 / 100) AS INT) AS tx, CAST(floor(y / 4) AS INT) AS ty, round_even(avg(nir), 6) AS nir, count(nir) AS n FROM pixels GROUP BY 1, 2")
def p25_resample_mean(p: DataFrame) -> DataFrame:
    out = op.resample_mean(p, F.floor(C("x") * 25 / 100), F.floor(C("y") / 4), ["nir"])
    return out.select("tx", "ty", r6("nir").alias("nir"), "n")


@plan(
    "pixels",
    f"""WITH v AS (SELECT scene, water_mask, {NDVI_SQL} AS ndvi FROM pixels WHERE red IS NOT NULL AND green IS NOT NULL AND blue IS NOT NULL AND nir IS NOT NULL AND (red > 0 OR green > 0 OR blue > 0 OR nir > 0)),
    c AS (SELECT scene, CASE WHEN ndvi < 0 THEN 'below_0' WHEN ndvi < 0.2 THEN '0_to_0.2' WHEN ndvi < 0.4 THEN '0.2_to_0.4' WHEN ndvi < 0.6 THEN '0.4_to_0.6' ELSE 'from_0.6' END AS ndvi_class, water_mask FROM v),
    g AS (SELECT scene, ndvi_class, count(*) AS n, count(*) FILTER (water_mask = 1) AS water FROM c GROUP BY 1, 2)
    SELECT scene, ndvi_class, n, round_even(100.0E0 * n / sum(n) OVER (PARTITION BY scene), 6) AS pct, round_even(100.0E0 * water / n, 6) AS water_pct FROM g""",
)
def entry_scene_index_report(p: DataFrame) -> DataFrame:
    """Flagship: valid pixels, NDVI classes and water share of each scene, in one aggregation."""
    bands = ["red", "green", "blue", "nir"]
    valid = p.dropna(how="any", subset=bands).filter(F.greatest(*bands) > 0)
    g = valid.select("scene", "water_mask", op.ndvi_class(px.ndvi(C("red"), C("nir"))).alias("ndvi_class")).groupBy("scene", "ndvi_class").agg(F.count("*").alias("n"), F.count_if(C("water_mask") == 1).alias("water"))
    total = F.sum("n").over(Window.partitionBy("scene"))
    return g.select("scene", "ndvi_class", "n", r6(100.0 * C("n") / total).alias("pct"), r6(100.0 * C("water") / C("n")).alias("water_pct"))
