"""Plans of filters and cleaning (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cleaning as op
from .registry import plan

C = F.col


def r6(c):
    return F.bround(c, 6)


BANDS = ["band_2", "band_3", "band_4", "band_8"]


@plan("samples", "SELECT seq, sub, lon, lat FROM (SELECT seq, sub, CASE WHEN seq % 7 = 0 THEN lon + 100 WHEN seq % 19 = 0 THEN CAST('nan' AS DOUBLE) ELSE lon END AS lon, lat FROM samples) WHERE isfinite(lon) AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90")
def f01_valid_coordinates(s: DataFrame) -> DataFrame:
    lon = F.when(C("seq") % 7 == 0, C("lon") + 100).when(C("seq") % 19 == 0, float("nan")).otherwise(C("lon"))
    return op.valid_coordinates(s.select("seq", "sub", lon.alias("lon"), "lat"))


@plan("samples", "SELECT seq, sub, band_2, band_3 FROM samples WHERE band_2 IS NOT NULL OR band_3 IS NOT NULL OR band_4 IS NOT NULL OR band_8 IS NOT NULL")
def f02_drop_empty_rows(s: DataFrame) -> DataFrame:
    return op.drop_empty_rows(s).select("seq", "sub", "band_2", "band_3")


@plan("pixels", "SELECT x, y FROM pixels WHERE red - 1500 > 0 OR coalesce(nir - 1500, 0) > 0")
def f03_drop_nonpositive(p: DataFrame) -> DataFrame:
    return op.drop_nonpositive(p.select("x", "y", (C("red") - 1500).alias("red"), (C("nir") - 1500).alias("nir")), ["red", "nir"]).select("x", "y")


@plan("pixels", "SELECT x, y, nir FROM pixels WHERE red IS NOT NULL AND green IS NOT NULL AND blue IS NOT NULL AND nir IS NOT NULL")
def f04_drop_any_missing(p: DataFrame) -> DataFrame:
    return op.drop_any_missing(p, ["red", "green", "blue", "nir"]).select("x", "y", "nir")


@plan("samples", "SELECT lon, lat, source, seq, sub, band_4 FROM (SELECT *, row_number() OVER (PARTITION BY lon, lat ORDER BY source, seq, sub, band_4 NULLS FIRST, depth NULLS FIRST) AS rn FROM samples) WHERE rn = 1")
def f05_keep_first(s: DataFrame) -> DataFrame:
    return op.keep_first(s.select("lon", "lat", "source", "seq", "sub", "band_4", "depth"), ["lon", "lat"], ["source", "seq", "sub", "band_4", "depth"]).drop("depth")


@plan("samples", "WITH m AS (SELECT median(band_2) AS a, median(band_3) AS b, median(depth) AS c FROM samples) SELECT seq, sub, coalesce(band_2, a) AS band_2, coalesce(band_3, b) AS band_3, coalesce(depth, c) AS depth FROM samples, m")
def f06_impute_median(s: DataFrame) -> DataFrame:
    return op.impute_median(s, ["band_2", "band_3", "depth"]).select("seq", "sub", "band_2", "band_3", "depth")


@plan("samples", "WITH m AS (SELECT quantile_cont(band_2, 0.005) AS a, quantile_cont(band_2, 0.995) AS b FROM samples) SELECT seq, sub, round_even(CASE WHEN band_2 IS NOT NULL THEN least(greatest(band_2, a), b) END, 6) AS band_2 FROM samples, m")
def f07_clip_quantiles(s: DataFrame) -> DataFrame:
    return op.clip_quantiles(s, ["band_2"]).select("seq", "sub", r6("band_2").alias("band_2"))


PRE = ", ".join(f"{b} * 1e-4 AS {b}" for b in BANDS)
MED = ", ".join(f"coalesce({b}, (SELECT median({b}) FROM e)) AS {b}" for b in [*BANDS, "depth"])
CLIP = ", ".join(f"round_even(CAST(CAST(least(greatest({b}, (SELECT quantile_cont({b}, 0.005) FROM i)), (SELECT quantile_cont({b}, 0.995) FROM i)) AS FLOAT) AS DOUBLE), 4) AS {b}" for b in BANDS)


@plan("samples", f"WITH s AS (SELECT seq, sub, {PRE}, depth FROM samples), e AS (SELECT * FROM s WHERE {' OR '.join(f'{b} IS NOT NULL' for b in BANDS)}), i AS (SELECT seq, sub, {MED} FROM e) SELECT seq, sub, {CLIP}, depth FROM i")
def f08_preprocess(s: DataFrame) -> DataFrame:
    out = op.preprocess(s)
    return out.select("seq", "sub", *(F.bround(C(b).cast("double"), 4).alias(b) for b in BANDS), "depth")


@plan("samples", "SELECT seq, sub, round_even(lon / 3, 6) AS lon, round_even(lat / 7, 6) AS lat FROM samples")
def f09_round_coordinates(s: DataFrame) -> DataFrame:
    return op.round_coordinates(s.select("seq", "sub", (C("lon") / 3).alias("lon"), (C("lat") / 7).alias("lat")))


@plan("pixels", "SELECT scene, count(nullif(red, 0.0E0)) AS n, round_even(avg(nullif(red, 0.0E0)), 6) AS mean FROM pixels GROUP BY scene")
def f10_mask_nodata(p: DataFrame) -> DataFrame:
    v = op.mask_nodata(C("red"), 0.0)
    return p.groupBy("scene").agg(F.count(v).alias("n"), r6(F.avg(v)).alias("mean"))


@plan("scenes", "SELECT scene_id, cloud_pct FROM scenes WHERE min_lon <= 100.0 AND max_lon >= 97.0 AND min_lat <= 31.0 AND max_lat >= 30.2 AND cloud_pct < 40")
def f11_scenes_at(s: DataFrame) -> DataFrame:
    return op.scenes_at(s, (97.0, 30.2, 100.0, 31.0), 40).select("scene_id", "cloud_pct")


@plan("boxes_gt", "SELECT box_id, a AS x1, b AS y1, c AS x2, d AS y2 FROM (SELECT box_id, least(greatest(x1 - 100, 0), 500) AS a, least(greatest(y1 - 100, 0), 400) AS b, least(greatest(x2 - 100, 0), 500) AS c, least(greatest(y2 - 100, 0), 400) AS d FROM boxes_gt) WHERE c > a AND d > b")
def f12_clip_boxes(b: DataFrame) -> DataFrame:
    return op.clip_boxes(b.select("box_id", *((C(c) - 100).alias(c) for c in ("x1", "y1", "x2", "y2"))), 500, 400)


LABELS = "SELECT image_id, box_id % 7 AS cls, round_even(x1 / 900.0E0, 1) AS cx, round_even(y1 / 900.0E0, 1) AS cy, round_even((x2 - x1) / 900.0E0, 1) AS w, round_even((y2 - y1) / 70.0E0, 1) AS h FROM boxes_gt"


@plan(
    "boxes_gt",
    f"""WITH l AS ({LABELS}), r AS (SELECT *, count(*) AS times, cls < 0 OR cx < 0 OR cx > 1 OR cy < 0 OR cy > 1 OR w < 0 OR w > 1 OR h < 0 OR h > 1 AS bad FROM l GROUP BY ALL)
    SELECT image_id, CAST(sum(times) AS BIGINT) AS n_rows, CAST(sum(times - 1) AS BIGINT) AS n_duplicates, CAST(sum(CASE WHEN bad THEN times ELSE 0 END) AS BIGINT) AS n_bad, CASE WHEN sum(CASE WHEN bad THEN times ELSE 0 END) > 0 THEN 'corrupt' ELSE 'found' END AS status FROM r GROUP BY image_id""",
)
def f13_verify_labels(b: DataFrame) -> DataFrame:
    one = lambda c: F.bround(c, 1)
    rows = b.select("image_id", (C("box_id") % 7).alias("cls"), one(C("x1") / 900.0).alias("cx"), one(C("y1") / 900.0).alias("cy"), one((C("x2") - C("x1")) / 900.0).alias("w"), one((C("y2") - C("y1")) / 70.0).alias("h"))
    return op.verify_labels(rows)


@plan("regions", "SELECT region_id, bw * bh AS area FROM regions WHERE bw * bh >= 600 AND bw >= 10 AND bh >= 10")
def f14_drop_small(r: DataFrame) -> DataFrame:
    return op.drop_small(r.withColumn("area", C("bw") * C("bh")), "area", 600, "bw", "bh").select("region_id", "area")
