"""Plans of aggregations and statistics (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as px
from ..operators import pixels as pop
from ..operators import stats as op
from .pixels import NDVI_SQL, NDWI_SQL
from .registry import plan

C = F.col
BANDS = ["band_2", "band_3", "band_4", "band_8"]


def r6(c):
    return F.bround(c, 6)


LONG = " UNION ALL ".join(f"SELECT '{b}' AS \"column\", CAST({b} AS DOUBLE) AS v FROM samples" for b in BANDS)


@plan("samples", f"SELECT \"column\", count(v) AS n, round_even(avg(v), 4) AS mean, round_even(stddev_samp(v), 4) AS std, min(v) AS lo, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS hi FROM ({LONG}) GROUP BY 1")
def a01_describe(s: DataFrame) -> DataFrame:
    return op.describe(s, BANDS).withColumns({"mean": F.bround("mean", 4), "std": F.bround("std", 4)})


@plan("samples", f"SELECT \"column\", count(*) FILTER (v IS NULL) AS n_missing, round_even(100.0E0 * count(*) FILTER (v IS NULL) / count(*), 6) AS pct FROM ({LONG}) GROUP BY 1 HAVING count(*) FILTER (v IS NULL) > 0")
def a02_missing_report(s: DataFrame) -> DataFrame:
    return op.missing_report(s, BANDS).withColumn("pct", r6("pct"))


@plan("samples", f"WITH l AS ({LONG}), q AS (SELECT \"column\", quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM l GROUP BY 1) SELECT \"column\", count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS n_outliers FROM l JOIN q USING (\"column\") GROUP BY 1")
def a03_iqr_outliers(s: DataFrame) -> DataFrame:
    return op.iqr_outliers(s, BANDS)


@plan("samples", "SELECT min(lon) AS min_x, max(lon) AS max_x, min(lat) AS min_y, max(lat) AS max_y, (min(lon) + max(lon)) / 2 AS centre_x, (min(lat) + max(lat)) / 2 AS centre_y, max(lon) - min(lon) AS width, max(lat) - min(lat) AS height FROM samples")
def a04_extent(s: DataFrame) -> DataFrame:
    return op.extent(s)


@plan("samples", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round_even(corr({a}, {b}), 6) AS r FROM samples" for a in ("band_2", "band_3", "band_4") for b in ("band_2", "band_3", "band_4")))
def a05_correlations(s: DataFrame) -> DataFrame:
    return op.correlations(s, ["band_2", "band_3", "band_4"]).withColumn("r", r6("r"))


CLASS_SQL = "CASE WHEN v < 0 THEN 'below_0' WHEN v < 0.2 THEN '0_to_0.2' WHEN v < 0.4 THEN '0.2_to_0.4' WHEN v < 0.6 THEN '0.4_to_0.6' ELSE 'from_0.6' END"


@plan("pixels", f"WITH c AS (SELECT scene, {CLASS_SQL} AS k FROM (SELECT scene, {NDVI_SQL} AS v FROM pixels WHERE nir IS NOT NULL)), g AS (SELECT scene, k AS ndvi_class, count(*) AS n FROM c GROUP BY 1, 2) SELECT scene, ndvi_class, n, round_even(100.0E0 * n / sum(n) OVER (PARTITION BY scene), 6) AS pct FROM g")
def a06_value_classes(p: DataFrame) -> DataFrame:
    k = p.filter("nir is not null").select("scene", pop.ndvi_class(px.ndvi(C("red"), C("nir"))).alias("ndvi_class"))
    return op.shares(k, ["ndvi_class"], ["scene"]).withColumn("pct", r6("pct"))


@plan("pixels", f"SELECT scene, count(*) FILTER (w > 0) AS positive, count(*) FILTER (w <= 0) AS rest FROM (SELECT scene, {NDWI_SQL} AS w FROM pixels) GROUP BY scene")
def a07_sign_split(p: DataFrame) -> DataFrame:
    w = px.ndwi(C("green"), C("nir"))
    return p.groupBy("scene").agg(F.count_if(w > 0).alias("positive"), F.count_if(w <= 0).alias("rest"))


@plan("pixels", "SELECT scene, count(*) FILTER (water_mask = 1) AS n_mask, round_even(100.0E0 * count(*) FILTER (water_mask = 1) / count(*), 6) AS pct FROM pixels GROUP BY scene")
def a08_mask_share(p: DataFrame) -> DataFrame:
    n = F.count_if(C("water_mask") == 1)
    return p.groupBy("scene").agg(n.alias("n_mask"), r6(op.distinct_share(n, F.count("*"))).alias("pct"))


NBR_SQL = "CASE WHEN nir + swir2 = 0 THEN NULL ELSE (nir - swir2) / (nir + swir2) END"


@plan("pixels", f"SELECT x, y, CASE WHEN v < -0.25 THEN 'severe' WHEN v < 0.1 THEN 'moderate' WHEN v <= 0.27 THEN 'light' WHEN v IS NOT NULL THEN 'none' END AS class FROM (SELECT x, y, {NBR_SQL} AS v FROM pixels)")
def a09_disturbance_class(p: DataFrame) -> DataFrame:
    return p.select("x", "y", px.disturbance_class(px.nbr(C("nir"), C("swir2"))).alias("class"))


@plan("pixels", f"SELECT scene, count(*) FILTER (v < -0.25) * 100.0E0 AS area FROM (SELECT scene, {NBR_SQL} AS v FROM pixels) GROUP BY scene")
def a10_area_under_threshold(p: DataFrame) -> DataFrame:
    return p.groupBy("scene").agg((F.count_if(px.nbr(C("nir"), C("swir2")) < -0.25) * 100.0).alias("area"))


@plan(
    "pixels",
    """WITH c AS (SELECT scene, CAST(red AS BIGINT) AS bin, count(*) AS cnt FROM pixels WHERE red >= 0 AND red < 256 GROUP BY 1, 2),
    f AS (SELECT s.scene, b.bin, coalesce(c.cnt, 0) AS cnt FROM (SELECT DISTINCT scene FROM c) s CROSS JOIN (SELECT unnest(range(256)) AS bin) b LEFT JOIN c ON c.scene = s.scene AND c.bin = b.bin),
    e AS (SELECT scene, sum(cnt) AS total, sum(cnt) FILTER (bin = 0) AS first FROM f GROUP BY 1), h AS (SELECT scene, least(first, floor(total * 0.02E0)) AS head, total - first + least(first, floor(total * 0.02E0)) AS rest FROM e)
    SELECT scene, bin, CAST(CASE WHEN bin = 0 THEN head WHEN bin = 255 THEN least(cnt, floor(rest * 0.02E0)) ELSE cnt END AS BIGINT) AS cnt FROM f JOIN h USING (scene)""",
)
def a11_histogram(p: DataFrame) -> DataFrame:
    return op.histogram(p, "red", 256, ["scene"])


PCT_SQL = "SELECT scene, greatest(quantile_cont(nullif(red, 7.0E0), 0.02), 0.0E0) AS lo, quantile_cont(nullif(red, 7.0E0), 0.98) AS hi FROM pixels GROUP BY scene"


@plan("pixels", f"SELECT scene, round_even(lo, 6) AS lo, round_even(hi, 6) AS hi FROM ({PCT_SQL})")
def a12_valid_percentiles(p: DataFrame) -> DataFrame:
    return op.valid_percentiles(p, "red", 7.0, 2, 98, ["scene"]).withColumns({"lo": r6("lo"), "hi": r6("hi")})


@plan("pixels", f"SELECT x, y, CASE WHEN red = 7 THEN 255 ELSE CAST(trunc(least(greatest((red - lo) / greatest(hi - lo, 1e-6), 0.0E0), 1.0E0) * 254) AS INT) END AS byte FROM pixels JOIN ({PCT_SQL}) USING (scene)")
def a13_stretch_8bit(p: DataFrame) -> DataFrame:
    return op.stretch_8bit(p, "red", op.valid_percentiles(p, "red", 7.0, 2, 98, ["scene"]), 7.0, ["scene"]).select("x", "y", "byte")


@plan("samples", "SELECT lon, lat, median(band_2) AS band_2, median(band_4) AS band_4 FROM samples WHERE cloud_pct < 60 GROUP BY lon, lat")
def a14_median_composite(s: DataFrame) -> DataFrame:
    return op.median_composite(s.filter("cloud_pct < 60"), ["lon", "lat"], ["band_2", "band_4"])


@plan("samples", "SELECT lon, lat, count(band_4) AS n FROM samples GROUP BY lon, lat")
def a15_coverage_count(s: DataFrame) -> DataFrame:
    return s.groupBy("lon", "lat").agg(F.count("band_4").alias("n"))


@plan(
    "samples scenes",
    """WITH b AS (SELECT CAST(floor(seq / 2000) AS BIGINT) AS batch, min(lon) AS x1, max(lon) AS x2, min(lat) AS y1, max(lat) AS y2 FROM samples GROUP BY 1)
    SELECT batch, x1, x2, y1, y2, count(scene_id) AS n_scenes, count(*) FILTER (cloud_pct < 20) AS below_20, count(*) FILTER (cloud_pct < 50) AS below_50, min(cloud_pct) AS cloud_lo, max(cloud_pct) AS cloud_hi, round_even(avg(cloud_pct), 6) AS cloud_mean, median(cloud_pct) AS cloud_median, count(scene_id) > 0 AS has_coverage
    FROM b LEFT JOIN scenes ON min_lon <= x2 AND max_lon >= x1 AND min_lat <= y2 AND max_lat >= y1 GROUP BY batch, x1, x2, y1, y2""",
)
def a16_batch_coverage(p: DataFrame, s: DataFrame) -> DataFrame:
    return op.batch_coverage(p, s, 2000, [20, 50]).withColumn("cloud_mean", r6("cloud_mean"))


@plan("rect_targets", "WITH g AS (SELECT coalesce(nullif(kind, 'BUILDING'), 'Unknown') AS type, count(*) AS n FROM rect_targets GROUP BY 1) SELECT type, n, round_even(100.0E0 * n / (SELECT sum(n) FROM g), 2) AS pct FROM g")
def a17_type_share(t: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(C("kind"), F.lit("BUILDING")), F.lit("Unknown"))
    return op.shares(t.select(kind.alias("type")), ["type"], []).withColumn("pct", F.bround("pct", 2))


@plan("pixels", "SELECT gt_class, count(*) AS area, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, round_even(avg(x), 6) AS cx, round_even(avg(y), 6) AS cy FROM pixels GROUP BY gt_class")
def a18_region_statistics(p: DataFrame) -> DataFrame:
    return p.groupBy("gt_class").agg(F.count("*").alias("area"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), r6(F.avg("x")).alias("cx"), r6(F.avg("y")).alias("cy"))


@plan("regions", "SELECT split_tag, clip_class, count(*) AS n, count(DISTINCT image_id) AS n_images, count(*) FILTER (llm_class IS NULL) AS unlabelled FROM regions GROUP BY ROLLUP (split_tag, clip_class)")
def a19_class_counts(r: DataFrame) -> DataFrame:
    return r.rollup("split_tag", "clip_class").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("n_images"), F.count_if(C("llm_class").isNull()).alias("unlabelled"))


W_SQL = "WITH n AS (SELECT label, count(*) AS n FROM boxes_gt GROUP BY 1 UNION ALL SELECT 'none', 0), w AS (SELECT label, n, 1.0E0 / greatest(n, 1) AS w FROM n), k AS (SELECT label, n, w / (SELECT sum(w) FROM w) AS weight FROM w)"


def weights_of(b: DataFrame) -> DataFrame:
    classes = b.select("label").distinct().union(b.sparkSession.createDataFrame([("none",)], "label string"))
    return op.class_weights(b, "label", classes)


@plan("boxes_gt", f"{W_SQL} SELECT label, n, round_even(weight, 9) AS weight FROM k")
def a20_class_weights(b: DataFrame) -> DataFrame:
    return weights_of(b).withColumn("weight", F.bround("weight", 9))


@plan("boxes_gt", f"{W_SQL} SELECT image_id, round_even(sum(weight), 9) AS weight FROM boxes_gt JOIN k USING (label) GROUP BY 1")
def a21_image_weights(b: DataFrame) -> DataFrame:
    return op.image_weights(b, weights_of(b), "image_id", "label").withColumn("weight", F.bround("weight", 9))


@plan("pixels", "WITH v AS (SELECT x // 4 AS tx, y // 4 AS ty, gt_class, count(*) AS n FROM pixels GROUP BY 1, 2, 3) SELECT CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, gt_class, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY tx, ty ORDER BY n DESC, gt_class) AS rn FROM v) WHERE rn = 1")
def a22_majority(p: DataFrame) -> DataFrame:
    return op.majority(p.select(F.floor(C("x") / 4).alias("tx"), F.floor(C("y") / 4).alias("ty"), "gt_class"), ["tx", "ty"], "gt_class")


@plan("pixels", "WITH w AS (SELECT x // 2 AS tx, y // 2 AS ty, red AS p, 1.0E0 / (1 + x % 3) AS w, y * 100000 + x AS no FROM pixels) SELECT CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, round_even(sum(p * w) / greatest(sum(w), 1e-6), 6) AS blended, max_by(p, no) AS last FROM w GROUP BY 1, 2")
def a23_weighted_blend(p: DataFrame) -> DataFrame:
    w = p.select(F.floor(C("x") / 2).alias("tx"), F.floor(C("y") / 2).alias("ty"), C("red").alias("p"), (1.0 / (1 + C("x") % 3)).alias("w"), (C("y").cast("long") * 100000 + C("x")).alias("window_no"))
    return op.blend(w, ["tx", "ty"], "p", "w").withColumn("blended", r6("blended"))


@plan("regions", "SELECT split_tag, count(*) FILTER (llm_class IS NOT NULL) AS success, count(*) FILTER (llm_class IS NULL AND clip_class = 'water') AS no_change, count(*) FILTER (llm_class IS NULL AND clip_class <> 'water') AS error FROM regions GROUP BY 1")
def a24_stage_counters(r: DataFrame) -> DataFrame:
    known = C("llm_class").isNotNull()
    return r.groupBy("split_tag").agg(F.count_if(known).alias("success"), F.count_if(~known & (C("clip_class") == "water")).alias("no_change"), F.count_if(~known & (C("clip_class") != "water")).alias("error"))


@plan("qa_items", "WITH w AS (SELECT unnest(regexp_split_to_array(lower(question), '[^a-z]+')) AS term FROM qa_items) SELECT term, count(*) AS n FROM w WHERE length(term) >= 2 AND term NOT IN ('the', 'of', 'de', 'la', 'der') GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def a25_term_frequency(q: DataFrame) -> DataFrame:
    stop = q.sparkSession.createDataFrame([(w,) for w in ("the", "of", "de", "la", "der")], "term string")
    return op.term_frequency(q, "question", stop)


@plan("rect_targets rect_masks", "SELECT (SELECT count(*) FROM rect_targets) AS n_targets, (SELECT count(*) FROM rect_masks) AS n_masks, (SELECT sum((x2 - x1) * (y2 - y1)) FROM rect_targets) AS total_area")
def a26_spatial_statistics(t: DataFrame, m: DataFrame) -> DataFrame:
    area = (C("x2") - C("x1")) * (C("y2") - C("y1"))
    return t.agg(F.count("*").alias("n_targets"), F.sum(area).alias("total_area")).crossJoin(m.agg(F.count("*").alias("n_masks"))).select("n_targets", "n_masks", "total_area")


@plan("kg_nodes kg_edges", "SELECT (SELECT count(*) FROM kg_nodes) AS n_nodes, 'customer,nation,region,supplier' AS labels, (SELECT count(*) FROM kg_edges) AS n_edges, (SELECT string_agg(type, ',' ORDER BY type) FROM (SELECT DISTINCT type FROM kg_edges)) AS types")
def a27_graph_summary(n: DataFrame, e: DataFrame) -> DataFrame:
    return op.graph_summary(n, e)


@plan("pixels", "WITH q AS (SELECT scene, quantile_cont(red, 0.02) AS lo, quantile_cont(red, 0.98) AS hi FROM pixels GROUP BY 1) SELECT x, y, CAST(trunc(round_even((least(greatest(red, lo), hi) - lo) * 255 / greatest(hi - lo, 1e-6), 6)) AS INT) AS byte FROM pixels JOIN q USING (scene)")
def a28_stretch_2_98(p: DataFrame) -> DataFrame:
    return op.stretch_2_98(p, "red", ["scene"]).select("x", "y", "byte")
