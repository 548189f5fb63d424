"""Plans of annotation and evaluation operators (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..operators import area_scores
from ..operators import boxes as op
from .joins import IOU_SQL, RUN, flagged, hits_sql
from .registry import plan

C = F.col


def r6(c):
    return F.bround(c, 6)


def corners() -> dict:
    return {c: C(c) for c in op.SIDES}


@plan("boxes_gt", "SELECT box_id, (x1 + x2) / 2.0E0 AS cx, (y1 + y2) / 2.0E0 AS cy, x2 - x1 AS w, y2 - y1 AS h FROM boxes_gt")
def e01_box_formats(b: DataFrame) -> DataFrame:
    c = bx.to_centre(corners())
    return b.select("box_id", *(v.alias(k) for k, v in c.items()))


TH = "CAST(least(greatest(round_even({v} * 1000.0E0 / {s}, 0), 0.0E0), 1000.0E0) AS INT)"


@plan("boxes_gt", "SELECT box_id, " + ", ".join(f"{TH.format(v=v, s=s)} AS {v}" for v, s in (("x1", 960), ("y1", 540), ("x2", 960), ("y2", 540))) + f" FROM boxes_gt WHERE {TH.format(v='x2', s=960)} > {TH.format(v='x1', s=960)} AND {TH.format(v='y2', s=540)} > {TH.format(v='y1', s=540)}")
def e02_box_to_thousand(b: DataFrame) -> DataFrame:
    size = {"x1": 960, "y1": 540, "x2": 960, "y2": 540}
    return b.select("box_id", *(bx.to_thousand(C(k), F.lit(s)).alias(k) for k, s in size.items())).filter("x2 > x1 and y2 > y1")


@plan("boxes_gt", "SELECT image_id, label, min(x1) AS x1, min(y1) AS y1, max(x1) AS x2, max(y1) AS y2 FROM boxes_gt WHERE x1 <= 640 AND y1 <= 640 GROUP BY 1, 2")
def e03_segments_to_boxes(b: DataFrame) -> DataFrame:
    inside = b.filter("x1 <= 640 and y1 <= 640")
    pts = inside.groupBy("image_id", "label").agg(F.collect_list("x1").alias("xs"), F.collect_list("y1").alias("ys"))
    return pts.select("image_id", "label", F.array_min("xs").alias("x1"), F.array_min("ys").alias("y1"), F.array_max("xs").alias("x2"), F.array_max("ys").alias("y2"))


def paired(p: DataFrame, g: DataFrame) -> DataFrame:
    return p.select("box_id", *(C(c).cast("double").alias(f"{c}_a") for c in op.SIDES)).join(g.select("box_id", *(C(c).cast("double").alias(f"{c}_b") for c in op.SIDES)), "box_id")


@plan(
    "boxes_pred boxes_gt",
    """WITH v AS (SELECT a.box_id, a.x1 * 1.0E0 AS a1, a.y1 * 1.0E0 AS a2, a.x2 * 1.0E0 AS a3, a.y2 * 1.0E0 AS a4, b.x1 * 1.0E0 AS b1, b.y1 * 1.0E0 AS b2, b.x2 * 1.0E0 AS b3, b.y2 * 1.0E0 AS b4 FROM boxes_pred a JOIN boxes_gt b USING (box_id)),
    i AS (SELECT *, greatest(0, least(a3, b3) - greatest(a1, b1)) * greatest(0, least(a4, b4) - greatest(a2, b2)) AS it, greatest(a3, b3) - least(a1, b1) AS cw, greatest(a4, b4) - least(a2, b2) AS ch FROM v),
    u AS (SELECT *, (a3 - a1) * (a4 - a2 + 1e-7) + (b3 - b1) * (b4 - b2 + 1e-7) - it + 1e-7 AS un, cw * cw + ch * ch + 1e-7 AS far, (pow(b1 + b3 - a1 - a3, 2) + pow(b2 + b4 - a2 - a4, 2)) / 4 AS near,
      4 / pow(pi(), 2) * pow(atan((b3 - b1) / (b4 - b2 + 1e-7)) - atan((a3 - a1) / (a4 - a2 + 1e-7)), 2) AS v FROM i)
    SELECT box_id, round_even(it / un, 5) AS iou, round_even(it / un - (cw * ch + 1e-7 - un) / (cw * ch + 1e-7), 5) AS giou, round_even(it / un - near / far, 5) AS diou, round_even(it / un - (near / far + v * v / (v - it / un + (1 + 1e-7))), 5) AS ciou, round_even(it / ((b3 - b1) * (b4 - b2) + 1e-7), 5) AS ioa FROM u""",
)
def e04_iou_variants(p: DataFrame, g: DataFrame) -> DataFrame:
    return paired(p, g).select("box_id", *(F.bround(bx.iou_variant(op.side("a"), op.side("b"), k), 5).alias(k) for k in ("iou", "giou", "diou", "ciou", "ioa")))


@plan("boxes_pred")
def e05_area_nms(p: DataFrame) -> DataFrame:
    return op.area_nms(p).select("image_id", "label", "box_id")


@plan("boxes_pred")
def e06_score_nms(p: DataFrame) -> DataFrame:
    return op.score_nms(p).select("image_id", "label", "box_id", "score")


@plan("boxes_pred boxes_gt")
def e07_greedy_match(p: DataFrame, g: DataFrame) -> DataFrame:
    return op.greedy_match(p, g, 0.5)


@plan("boxes_pred boxes_gt", f"WITH {hits_sql('0.75E0')}, c AS (SELECT g.label, (SELECT count(*) FROM hits JOIN boxes_pred p ON p.box_id = a WHERE p.label = g.label) AS tp, (SELECT count(*) FROM boxes_pred p WHERE p.label = g.label) AS np, count(*) AS ng FROM boxes_gt g GROUP BY 1), r AS (SELECT label, tp, np - tp AS fp, ng - tp AS fn, CASE WHEN np = 0 THEN 0 ELSE tp * 1.0E0 / np END AS p, CASE WHEN ng = 0 THEN 0 ELSE tp * 1.0E0 / ng END AS r FROM c) SELECT label, tp, fp, fn, round_even(p, 6) AS precision, round_even(r, 6) AS recall, round_even(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM r")
def e08_precision_recall(p: DataFrame, g: DataFrame) -> DataFrame:
    c = flagged(p, g).groupBy("label").agg(F.count_if("tp").alias("tp"), F.count_if(~C("tp")).alias("fp"))
    c = g.groupBy("label").agg(F.count("*").alias("n_gt")).join(c, "label", "left").na.fill(0, ["tp", "fp"]).withColumn("fn", C("n_gt") - C("tp"))
    return c.select("label", "tp", "fp", "fn", *(r6(v).alias(k) for k, v in op.precision_recall(C("tp"), C("fp"), C("fn")).items()))


AP = f"WITH {RUN}, t AS (SELECT label, count(*) AS n_gt FROM boxes_gt GROUP BY 1), q AS (SELECT r.label, r.score, r.box_id, tps * 1.0E0 / n_gt AS recall, tps * 1.0E0 / (tps + fps) AS precision FROM r JOIN t USING (label)), e AS (SELECT *, max(precision) OVER (PARTITION BY label ORDER BY score DESC, box_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS top, coalesce(lag(recall) OVER (PARTITION BY label ORDER BY score DESC, box_id), 0) AS before FROM q)"


@plan("boxes_pred boxes_gt", f"{AP} SELECT label, round_even(sum(top * (recall - before)), 6) AS ap FROM e GROUP BY 1")
def e09_average_precision(p: DataFrame, g: DataFrame) -> DataFrame:
    flags = flagged(p, g)
    totals = g.groupBy("label").agg(F.count("*").alias("n_gt"))
    return op.average_precision(flags, totals, ["label"], [F.desc("score"), C("box_id")]).withColumn("ap", r6("ap"))


@plan("boxes_pred boxes_gt")
def e10_interpolated_precision(p: DataFrame, g: DataFrame) -> DataFrame:
    flags = flagged(p, g)
    totals = g.groupBy("label").agg(F.count("*").alias("n_gt"))
    return op.interpolated_precision(flags, totals, ["label"], [F.desc("score"), C("box_id")]).withColumn("ap", r6("ap"))


THRESHOLDS = [x / 100 for x in range(50, 100, 5)]


@plan(
    "boxes_pred boxes_gt",
    f"""WITH {hits_sql(', '.join(f'{t}E0' for t in THRESHOLDS))},
    f AS (SELECT p.label, thrs.thr, p.box_id, p.score, hits.a IS NOT NULL AS tp FROM boxes_pred p CROSS JOIN thrs LEFT JOIN hits ON hits.a = p.box_id AND hits.thr = thrs.thr), n AS (SELECT label, count(*) AS n_gt FROM boxes_gt GROUP BY 1),
    r AS (SELECT f.*, n_gt, sum(CAST(tp AS INT)) OVER w AS tps, count(*) OVER w AS n FROM f JOIN n USING (label) WINDOW w AS (PARTITION BY label, thr ORDER BY score DESC, box_id ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT label, thr, tps * 1.0E0 / n_gt AS recall, max(tps * 1.0E0 / n) OVER (PARTITION BY label, thr ORDER BY score DESC, box_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS top, coalesce(lag(tps * 1.0E0 / n_gt) OVER (PARTITION BY label, thr ORDER BY score DESC, box_id), 0) AS before FROM r)
    SELECT label, round_even(avg(ap), 6) AS map FROM (SELECT label, thr, sum(top * (recall - before)) AS ap FROM e GROUP BY 1, 2) GROUP BY 1""",
)
def e11_mean_average_precision(p: DataFrame, g: DataFrame) -> DataFrame:
    hits = op.true_positives(p, g, THRESHOLDS).withColumn("tp", F.lit(True))
    flags = p.select("label", "box_id", "score").withColumn("thr", F.explode(F.array(*map(F.lit, THRESHOLDS)))).join(hits, ["thr", "box_id"], "left").withColumn("tp", F.coalesce("tp", F.lit(False)))
    totals = g.groupBy("label").agg(F.count("*").alias("n_gt")).withColumn("thr", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    ap = op.average_precision(flags, totals, ["label", "thr"], [F.desc("score"), C("box_id")])
    return ap.groupBy("label").agg(r6(F.avg("ap")).alias("map"))


@plan("boxes_pred boxes_gt")
def e17_area_scores(p: DataFrame, g: DataFrame) -> DataFrame:
    return area_scores.area_scores(p, g).select("label", "area", "thr", "n_gt", *(r6(c).alias(c) for c in ("ap", "recall_1", "recall_10", "recall_100")))


@plan("boxes_pred boxes_gt")
def e17_area_summary(p: DataFrame, g: DataFrame) -> DataFrame:
    return area_scores.area_summary(area_scores.area_scores(p, g)).withColumn("value", r6("value"))


BEST = f"""WITH {IOU_SQL}, s AS (SELECT *, inter * 1.0E0 / (sa + sb - inter) AS iou FROM i), p1 AS (SELECT a, b, iou FROM s JOIN boxes_pred p ON p.box_id = s.a WHERE iou > 0.45 AND p.score > 0.25 QUALIFY row_number() OVER (PARTITION BY a ORDER BY iou DESC, b) = 1),
  m AS (SELECT a, b FROM p1 QUALIFY row_number() OVER (PARTITION BY b ORDER BY iou DESC, a) = 1)"""


@plan("boxes_pred boxes_gt", f"{BEST} SELECT gt_label, pred_label, count(*) AS n FROM (SELECT g.label AS gt_label, p.label AS pred_label FROM m JOIN boxes_pred p ON p.box_id = a JOIN boxes_gt g ON g.box_id = b UNION ALL SELECT label, 'background' FROM boxes_gt WHERE box_id NOT IN (SELECT b FROM m) UNION ALL SELECT 'background', label FROM boxes_pred WHERE score > 0.25 AND box_id NOT IN (SELECT a FROM m)) GROUP BY 1, 2")
def e12_detection_confusion(p: DataFrame, g: DataFrame) -> DataFrame:
    return op.detection_confusion(p, g)


@plan("boxes_pred boxes_gt")
def e12_greedy_confusion(p: DataFrame, g: DataFrame) -> DataFrame:
    return op.greedy_confusion(p, g)


@plan("boxes_pred boxes_gt", f"{BEST} SELECT round_even(avg(inter * 1.0E0 / (sa + sb - inter)), 6) AS mean_iou, count(*) AS n FROM m JOIN i USING (a, b)")
def e13_mean_matched_iou(p: DataFrame, g: DataFrame) -> DataFrame:
    slim = lambda df: op.first_copies(df.select("image_id", "box_id", *op.SIDES), ["image_id"])
    matched = op.best_pairs(op.iou_pairs(slim(p.filter("score > 0.25")), slim(g), ["image_id"]), 0.45)
    return matched.agg(r6(F.avg("iou")).alias("mean_iou"), F.count("*").alias("n"))


CLS = "WITH k AS (SELECT unnest(range(5)) AS cls), c AS (SELECT cls, (SELECT count(*) FROM pixels WHERE gt_class = cls AND pred_class = cls) AS tp, (SELECT count(*) FROM pixels WHERE gt_class = cls) AS g, (SELECT count(*) FROM pixels WHERE pred_class = cls) AS p FROM k)"


@plan("pixels", f"{CLS} SELECT CAST(cls AS INT) AS cls, tp, g, p, round_even(CASE WHEN g + p - tp = 0 THEN 0 ELSE tp * 1.0E0 / (g + p - tp) END, 6) AS iou, round_even(tp * 1.0E0 / greatest(g, 1), 6) AS accuracy FROM c")
def e14_pixel_confusion(p: DataFrame) -> DataFrame:
    return op.class_iou(p, "gt_class", "pred_class", 5).select("cls", "tp", "g", "p", r6("iou").alias("iou"), r6("accuracy").alias("accuracy"))


@plan("pixels", f"{CLS} SELECT CAST(cls AS INT) AS cls, round_even((tp + 1e-5) / (p + 1e-5), 6) AS precision, round_even((tp + 1e-5) / (g + 1e-5), 6) AS recall, round_even((5 * tp + 1e-5) / (4 * g + p + 1e-5), 6) AS f FROM c")
def e15_smooth_scores(p: DataFrame) -> DataFrame:
    return op.class_iou(p, "gt_class", "pred_class", 5, 1e-5, 2.0).select("cls", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f").alias("f"))


@plan("documents", "SELECT doc_id + (SELECT CAST(min(doc_id) = 0 AS BIGINT) FROM documents) AS doc_id, lang FROM documents")
def e20_reindex_ids(d: DataFrame) -> DataFrame:
    return op.reindex_ids(d.select("doc_id", "lang"), "doc_id")


@plan("boxes_gt", "SELECT image_id AS video, CAST(i AS INT) AS frame, box_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS area FROM (SELECT *, unnest(range(3)) AS i FROM boxes_gt) WHERE (box_id + i) % 3 <> 0")
def e21_video_frames(b: DataFrame) -> DataFrame:
    box = F.struct("x1", "y1", (C("x2") - C("x1")).alias("w"), (C("y2") - C("y1")).alias("h"))
    frames = F.array(*(F.when((C("box_id") + i) % 3 != 0, box) for i in range(3)))
    rows = b.select(C("image_id").alias("video"), "box_id", F.posexplode(frames).alias("frame", "b")).filter("b is not null and not (b.w = 0 and b.h = 0)")
    return rows.select("video", "frame", "box_id", "b.x1", "b.y1", "b.w", "b.h", (C("b.w") * C("b.h")).alias("area"))


@plan("boxes_pred", "WITH w AS (SELECT *, box_id % 4 AS worker FROM boxes_pred), f AS (SELECT image_id, label, min(worker) AS worker FROM w GROUP BY 1, 2) SELECT image_id, box_id, CAST(rank AS INT) AS rank, round_even(score, 5) AS score FROM (SELECT w.*, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS rank FROM w JOIN f USING (image_id, label, worker)) WHERE rank <= 5")
def e22_first_worker_top(p: DataFrame) -> DataFrame:
    out = op.first_worker_top(p.withColumn("worker", C("box_id") % 4), 5)
    return out.select("image_id", "box_id", "rank", F.bround("score", 5).alias("score"))


@plan("boxes_gt")
def e23_anchor_clusters(b: DataFrame) -> DataFrame:
    return op.best_possible_recall(b, op.anchors(b, 9))


@plan("boxes_gt", "SELECT box_id, CAST(greatest((x1 + x2) / 2.0E0 - ((x2 - x1) * 1.2E0 + 3) / 2, 0) AS DOUBLE) AS px1, CAST(least((x1 + x2) / 2.0E0 + ((x2 - x1) * 1.2E0 + 3) / 2, 960) AS DOUBLE) AS px2 FROM boxes_gt")
def e24_padded_crop(b: DataFrame) -> DataFrame:
    c = bx.to_centre(corners())
    half = (c["w"] * 1.2 + 3) / 2
    return b.select("box_id", F.greatest(c["cx"] - half, F.lit(0.0)).alias("px1"), F.least(c["cx"] + half, F.lit(960.0)).alias("px2"))


@plan("boxes_gt", "SELECT CAST(floor(image_id / 4) AS BIGINT) AS mosaic, box_id, round_even(least(greatest((x1 / 1000.0E0 + image_id % 4 % 2) / 2, 0), 1), 6) AS cx, round_even(least(greatest((y1 / 1000.0E0 + floor(image_id % 4 / 2)) / 2, 0), 1), 6) AS cy FROM boxes_gt")
def e25_mosaic(b: DataFrame) -> DataFrame:
    rows = b.select(C("image_id").alias("image_no"), "box_id", (C("x1") / 1000).alias("cx"), (C("y1") / 1000).alias("cy"), ((C("x2") - C("x1")) / 1000).alias("w"), ((C("y2") - C("y1")) / 1000).alias("h"))
    return op.mosaic(rows, 1.0).select("mosaic", "box_id", r6("cx").alias("cx"), r6("cy").alias("cy"))


@plan("pixels", "WITH i AS (SELECT scene, gt_class AS a, pred_class AS b, count(*) AS inter FROM pixels GROUP BY 1, 2, 3) SELECT scene AS image_id, a AS mask_a, b AS mask_b, round_even(inter * 1.0E0 / ((SELECT count(*) FROM pixels p WHERE p.scene = i.scene AND p.gt_class = a) + (SELECT count(*) FROM pixels p WHERE p.scene = i.scene AND p.pred_class = b) - inter), 6) AS iou FROM i")
def e26_mask_iou(p: DataFrame) -> DataFrame:
    a, b = (p.select(C("scene").alias("image_id"), C(c).alias("mask"), "x", "y") for c in ("gt_class", "pred_class"))
    return op.mask_iou(a, b).select("image_id", "mask_a", "mask_b", r6("iou").alias("iou"))


@plan("pixels", "SELECT scene, gt_class, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM pixels GROUP BY 1, 2")
def e27_masks_to_boxes(p: DataFrame) -> DataFrame:
    return op.masks_to_boxes(p, ["scene", "gt_class"])


@plan("boxes_pred boxes_gt", f"WITH {IOU_SQL}, s AS (SELECT a, b, inter * 1.0E0 / (sa + sb - inter) AS iou FROM i JOIN boxes_pred p ON p.box_id = a JOIN boxes_gt g ON g.box_id = b WHERE p.label = g.label), t AS (SELECT unnest([0.5E0, 0.75E0, 0.9E0]) AS thr), p1 AS (SELECT thr, a, b FROM s CROSS JOIN t WHERE iou >= thr QUALIFY row_number() OVER (PARTITION BY thr, a ORDER BY iou DESC, b) = 1), m AS (SELECT thr, a FROM p1 QUALIFY row_number() OVER (PARTITION BY thr, b ORDER BY a) = 1) SELECT thr, count(*) AS tp FROM m GROUP BY 1")
def e29_true_positive_flags(p: DataFrame, g: DataFrame) -> DataFrame:
    return op.true_positives(p, g, [0.5, 0.75, 0.9]).groupBy("thr").agg(F.count("*").alias("tp"))
