"""Plans of joins (J) and of windows, ranking and set operations (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as op
from ..operators import windows as wop
from .registry import plan

C = F.col


def r6(c):
    return F.bround(c, 6)


@plan("samples pixels", "SELECT seq, sub, p.red FROM samples s LEFT JOIN pixels p ON p.x = CAST(floor((s.lon - 95.0E0) / 0.1E0) AS INT) AND p.y = CAST(floor((s.lat - 29.0E0) / 0.03E0) AS INT)")
def j01_sample_grid(s: DataFrame, p: DataFrame) -> DataFrame:
    return op.sample_grid(s, p.select("x", "y", "red"), 95.0, 29.0, 0.1, 0.03).select("seq", "sub", "red")


@plan("pixels", "SELECT a.x, a.y, coalesce(CAST(b.water_mask > 0 AS INT), 0) AS mask FROM pixels a LEFT JOIN (SELECT * FROM pixels WHERE x < 50) b ON a.x = b.x AND a.y = b.y")
def j02_attach_mask(p: DataFrame) -> DataFrame:
    return op.attach_mask(p.select("x", "y"), p.filter("x < 50").select("x", "y", C("water_mask").alias("v"))).select("x", "y", "mask")


@plan("pixels", "SELECT x, y, red, green, nir FROM pixels")
def j03_stack_bands(p: DataFrame) -> DataFrame:
    return op.stack_bands({b: p.select("x", "y", C(b).alias("v")) for b in ("red", "green", "nir")})


@plan("documents", "SELECT CONCAT('doc', CAST(k AS VARCHAR), '.png') AS name FROM (SELECT DISTINCT doc_id % 40 AS k, source FROM documents) GROUP BY k HAVING count(*) = 10")
def j04_common_names(d: DataFrame) -> DataFrame:
    files = d.select(C("source").alias("folder"), F.concat(F.lit("doc"), (C("doc_id") % 40).cast("string"), F.lit(".png")).alias("name"))
    return op.common_names(files, 10)


@plan("orders", "SELECT CAST(o_orderkey AS VARCHAR) AS stem FROM orders WHERE o_orderkey % 3 = 0")
def j05_pair_by_stem(o: DataFrame) -> DataFrame:
    key = C("o_orderkey").cast("string")
    a, b = o.select(F.concat(F.lit("img/"), key, F.lit(".png")).alias("path_a")), o.filter("o_orderkey % 3 = 0").select(F.concat(F.lit("lab/"), key, F.lit(".txt")).alias("path_b"))
    return op.pair_by_stem(a, b)[0].select("stem")


@plan("orders", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)")
def j06_exclude_ids(o: DataFrame) -> DataFrame:
    return op.exclude_ids(o.select("o_orderkey"), o.filter("o_orderkey % 5 = 0"), "o_orderkey")


@plan("rect_targets rect_masks", "SELECT t.fid AS fid_a, m.fid AS fid_b FROM rect_targets t JOIN rect_masks m ON t.x1 < m.x2 AND m.x1 < t.x2 AND t.y1 < m.y2 AND m.y1 < t.y2")
def j07_box_candidates(t: DataFrame, m: DataFrame) -> DataFrame:
    return op.copies_met(t.drop("kind"), m.drop("kind"), [], lambda a, b: op.box_candidates(a, b, 50.0)).select("fid_a", "fid_b")


@plan("rect_targets rect_masks", "SELECT t.fid AS point, m.fid FROM rect_targets t JOIN rect_masks m ON t.x1 + 0.5 > m.x1 AND t.x1 + 0.5 < m.x2 AND t.y1 + 0.5 > m.y1 AND t.y1 + 0.5 < m.y2")
def j08_points_in_polygons(t: DataFrame, m: DataFrame) -> DataFrame:
    corners = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    ring = F.array(*(F.struct(C(a).alias("x"), C(b).alias("y")) for a, b in corners))
    return op.points_in_polygons(t.select(C("fid").alias("point"), (C("x1") + 0.5).alias("px"), (C("y1") + 0.5).alias("py")), m.withColumn("ring", ring), 50.0).select("point", "fid")


IOU_SQL = """i AS (SELECT a.box_id AS a, b.box_id AS b, a.image_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
  (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb FROM boxes_pred a JOIN boxes_gt b ON a.image_id = b.image_id)"""


@plan("boxes_pred boxes_gt", f"WITH {IOU_SQL} SELECT a, b, round_even(inter * 1.0E0 / (sa + sb - inter), 6) AS iou FROM i WHERE inter * 1.0E0 / (sa + sb - inter) >= 0.5")
def j09_box_iou_join(p: DataFrame, g: DataFrame) -> DataFrame:
    from ..operators.boxes import SIDES, iou_pairs_of_copies

    slim = ["image_id", "box_id", *SIDES]
    return iou_pairs_of_copies(p.select(slim), g.select(slim), ["image_id"], 0.5).select(C("box_id_a").alias("a"), C("box_id_b").alias("b"), r6("iou").alias("iou"))


@plan("regions labels", "SELECT region_id, v.verdict, v.verdict IS NOT NULL AS classified FROM regions LEFT JOIN (SELECT doc_id, max_by(quality, toxic * 10 + quality) AS verdict FROM labels WHERE doc_id > 0 GROUP BY 1) v ON region_id = doc_id")
def j10_merge_verdicts(r: DataFrame, labels: DataFrame) -> DataFrame:
    v = labels.select(C("doc_id").alias("region_id"), C("quality").alias("verdict"), (C("toxic") * 10 + C("quality")).alias("seq"))
    return op.merge_verdicts(r.select("region_id"), v)


@plan("documents", "SELECT doc_id, lang, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS _split FROM documents")
def j11_union_with_split(d: DataFrame) -> DataFrame:
    d = d.select("doc_id", "lang")
    return op.union_with_split({"test": d.filter("doc_id % 10 = 0"), "train": d.filter("doc_id % 10 <> 0")})


@plan("kg_nodes kg_edges", "SELECT e.id, e.type, e.src, a.name AS src_name, e.dst, b.name AS dst_name FROM kg_edges e JOIN kg_nodes a ON e.src = a.id JOIN kg_nodes b ON e.dst = b.id ORDER BY e.id LIMIT 100")
def j12_triples(n: DataFrame, e: DataFrame) -> DataFrame:
    return op.triples(n, e)


@plan("kg_edges", "SELECT type, dst AS neighbour, 'out' AS direction FROM kg_edges WHERE src = 'n3' UNION ALL SELECT type, src, 'in' FROM kg_edges WHERE dst = 'n3'")
def j13_neighbours(e: DataFrame) -> DataFrame:
    return op.neighbours(e, "n3")


@plan("patch_series", "WITH d AS (SELECT DISTINCT patch_id, date_trunc('day', ts) AS date FROM patch_series) SELECT d.patch_id, CAST(d.date AS TIMESTAMP) AS date, max(p.ts) AS ts FROM d LEFT JOIN patch_series p ON p.patch_id = d.patch_id AND p.ts <= d.date GROUP BY 1, 2")
def j14_as_of(p: DataFrame) -> DataFrame:
    dates = p.select("patch_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("date")).distinct()
    return op.as_of(p.select("patch_id", "ts"), dates, "patch_id", "ts", "date")


@plan("pixels", "WITH g AS (SELECT dense_rank() OVER (ORDER BY lat DESC) - 1 AS row, dense_rank() OVER (ORDER BY lon) - 1 AS col, red FROM pixels) SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, red FROM g")
def w01_grid_index(p: DataFrame) -> DataFrame:
    return wop.grid_index(p, "red", C("ts"))


@plan("pixels", "SELECT count(DISTINCT lon) AS nx, count(DISTINCT lat) AS ny, round_even((max(lon) - min(lon)) / (count(DISTINCT lon) - 1), 6) AS dx, round_even(min(lat) - (max(lat) - min(lat)) / (count(DISTINCT lat) - 1) / 2, 6) AS bottom FROM pixels")
def w02_grid_resolution(p: DataFrame) -> DataFrame:
    return wop.grid_resolution(p).select("nx", "ny", r6("dx").alias("dx"), r6("bottom").alias("bottom"))


BIN = "b AS (SELECT scene, CAST(red / 100 AS INT) AS bin, count(*) AS cnt FROM (SELECT scene, floor(red / 100) * 100 AS red FROM pixels) GROUP BY 1, 2)"


def bins_of(p: DataFrame) -> DataFrame:
    return p.groupBy("scene", F.floor(C("red") / 100).cast("int").alias("bin")).agg(F.count("*").alias("cnt"))


@plan("pixels", f"WITH {BIN} SELECT scene, bin, round_even(coalesce(sum(cnt) OVER (PARTITION BY scene ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (sum(cnt) OVER (PARTITION BY scene) + 1.0E0), 6) AS cdf FROM b")
def w03_cumulative_exclusive(p: DataFrame) -> DataFrame:
    return wop.cumulative(bins_of(p), ["scene"], "bin", "cnt", False, 1.0).select("scene", "bin", r6("cdf").alias("cdf"))


@plan("pixels", f"WITH {BIN} SELECT scene, bin, round_even(sum(cnt) OVER (PARTITION BY scene ORDER BY bin) * 1.0E0 / sum(cnt) OVER (PARTITION BY scene), 6) AS cdf FROM b")
def w04_cumulative_inclusive(p: DataFrame) -> DataFrame:
    return wop.cumulative(bins_of(p), ["scene"], "bin", "cnt", True).select("scene", "bin", r6("cdf").alias("cdf"))


def hits_sql(thresholds: str) -> str:
    """CTEs up to hits (thr, a): a prediction stands for its best box of its label; the first prediction of a box counts."""
    return f"""{IOU_SQL}, s AS (SELECT a, b, inter * 1.0E0 / (sa + sb - inter) AS iou FROM i JOIN boxes_pred p ON p.box_id = a JOIN boxes_gt g ON g.box_id = b WHERE p.label = g.label AND inter > 0),
  thrs AS (SELECT unnest([{thresholds}]) AS thr), p1 AS (SELECT thr, a, b FROM s CROSS JOIN thrs WHERE iou >= thr QUALIFY row_number() OVER (PARTITION BY thr, a ORDER BY iou DESC, b) = 1),
  hits AS (SELECT thr, min(a) AS a FROM p1 GROUP BY thr, b)"""


RUN = f"{hits_sql('0.75E0')}, m AS (SELECT label, box_id, score, box_id IN (SELECT a FROM hits) AS tp FROM boxes_pred), r AS (SELECT *, CAST(sum(CAST(tp AS INT)) OVER w AS BIGINT) AS tps, CAST(sum(1 - CAST(tp AS INT)) OVER w AS BIGINT) AS fps FROM m WINDOW w AS (PARTITION BY label ORDER BY score DESC, box_id ROWS UNBOUNDED PRECEDING))"


def flagged(p: DataFrame, g: DataFrame) -> DataFrame:
    """Predictions with a flag whether they are right at an IoU of 0.75."""
    from ..operators.boxes import true_positives

    hits = true_positives(p, g, [0.75]).select("box_id", F.lit(True).alias("tp"))
    return p.select("label", "box_id", "score").join(hits, "box_id", "left").withColumn("tp", F.coalesce("tp", F.lit(False)))


def running(p: DataFrame, g: DataFrame) -> DataFrame:
    return wop.running_matches(flagged(p, g), ["label"], [F.desc("score"), C("box_id")])


@plan("boxes_pred boxes_gt", f"WITH {RUN} SELECT label, box_id, tps, fps FROM r")
def w05_running_matches(p: DataFrame, g: DataFrame) -> DataFrame:
    return running(p, g).select("label", "box_id", "tps", "fps")


@plan("boxes_pred boxes_gt", f"WITH {RUN}, q AS (SELECT *, tps * 1.0E0 / (tps + fps) AS precision FROM r) SELECT label, box_id, round_even(max(precision) OVER (PARTITION BY label ORDER BY score DESC, box_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS envelope FROM q")
def w06_precision_envelope(p: DataFrame, g: DataFrame) -> DataFrame:
    q = running(p, g).withColumn("precision", C("tps") / (C("tps") + C("fps")))
    return wop.envelope(q, ["label"], [F.desc("score"), C("box_id")], "precision").select("label", "box_id", r6("envelope").alias("envelope"))


@plan("patch_series", "SELECT patch_id, ts, round_even(value - lag(value) OVER w, 6) AS delta, round_even(value - first_value(value) OVER w, 6) AS from_first, round_even((value - first_value(value) OVER w) * 100.0E0 / nullif(abs(first_value(value) OVER w), 0), 4) AS pct FROM (SELECT patch_id, ts, max(value) AS value FROM patch_series GROUP BY 1, 2) WINDOW w AS (PARTITION BY patch_id ORDER BY ts)")
def w07_phase_change(p: DataFrame) -> DataFrame:
    one = p.groupBy("patch_id", "ts").agg(F.max("value").alias("value"))
    return wop.phase_change(one, "patch_id", "ts", "value").select("patch_id", "ts", r6("delta").alias("delta"), r6("from_first").alias("from_first"), F.bround("pct", 4).alias("pct"))


@plan("conversations", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def w08_conversation_window(c: DataFrame) -> DataFrame:
    return wop.most_recent(c.select("conv_id", "turn"), "conv_id", C("turn"), 6)


@plan("regions", "SELECT region_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY bx + bw / 2.0E0, region_id) AS INT) AS rank FROM regions")
def w09_component_order(r: DataFrame) -> DataFrame:
    return wop.top_k(r, ["image_id"], [C("bx") + C("bw") / 2.0, C("region_id")], 1 << 30).select("region_id", "rank")


@plan("boxes_pred", "SELECT image_id, box_id, CAST(rank AS INT) AS rank FROM (SELECT image_id, box_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS rank FROM boxes_pred) WHERE rank <= 5")
def w10_top_k(p: DataFrame) -> DataFrame:
    return wop.top_k(p, ["image_id"], [F.desc("score"), C("box_id")], 5).select("image_id", "box_id", "rank")


@plan("kg_nodes", "SELECT id, label, name FROM kg_nodes ORDER BY id LIMIT 100")
def w11_limit(n: DataFrame) -> DataFrame:
    return n.orderBy("id").limit(100)


@plan("patch_series", "WITH t AS (SELECT patch_id, phase, ts, lead(phase) OVER (PARTITION BY patch_id ORDER BY ts, phase) AS next FROM patch_series) SELECT phase, next, count(*) AS n FROM t WHERE next IS NOT NULL GROUP BY 1, 2 ORDER BY 1, 2")
def w12_state_transitions(p: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    t = p.withColumn("next", F.lead("phase").over(Window.partitionBy("patch_id").orderBy("ts", "phase")))
    return t.filter("next is not null").groupBy("phase", "next").agg(F.count("*").alias("n")).orderBy("phase", "next")


@plan("orders", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) UNION ALL SELECT 'left', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) UNION ALL SELECT 'any', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def w13_set_operations(o: DataFrame) -> DataFrame:
    a, b = o.filter("o_orderkey % 2 = 0").select("o_custkey"), o.filter("o_orderkey % 3 = 0").select("o_custkey")
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n(a.intersect(b), "both").union(n(a.subtract(b), "left")).union(n(a.unionByName(b).distinct(), "any"))


@plan("embeddings", "WITH s AS (SELECT vec_id, k AS class_id, embedding[k + 1] AS score FROM (SELECT *, unnest(range(10)) AS k FROM embeddings)) SELECT vec_id, CAST(class_id AS INT) AS class_id, round_even(CAST(score AS DOUBLE), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class_id) AS rn FROM s) WHERE rn = 1")
def w14_top_class(e: DataFrame) -> DataFrame:
    s = e.select("vec_id", F.posexplode(F.slice("embedding", 1, 10)).alias("class_id", "score"))
    return wop.top_class(s, "vec_id", "class_id", "score").withColumn("score", r6(C("score").cast("double")))
