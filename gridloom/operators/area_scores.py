"""Average precision and recall of boxes by area range and number of detections, by the published COCO rule.

Detections only compete for a truth box that they overlap, so matching is solved in every connected group of overlapping boxes:
a task holds boxes that touch, not an image. Precision needs running counts over all detections of a label in score order; they
come from the counts of score buckets before a row and a window inside its bucket.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .assign import grouped, mark_lone
from .boxes import SIDES, iou_pairs
from .rounds import Rounds

# fixed values of the rule
AREAS = {"all": (0.0, 1e10), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, 1e10)}
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
MOST = (1, 10, 100)
BUCKETS = 1000


def in_range(area: Column, name: Column) -> Column:
    lo, hi = (F.create_map(*(x for k, v in AREAS.items() for x in (F.lit(k), F.lit(v[i]))))[name] for i in (0, 1))
    return (area >= lo) & (area <= hi)


def _match(frame: pd.DataFrame) -> pd.DataFrame:
    """Each detection by score takes the best free truth box; one inside the area range goes before any outside, later ones win ties."""
    order = frame.drop_duplicates("a").sort_values(["score", "a"], ascending=[False, True])["a"].tolist()
    near = {a: list(zip(g["b"], g["iou"], g["gt_area"])) for a, g in frame.sort_values("b").groupby("a")}
    rows = []
    for name, (lo, hi) in AREAS.items():
        for t in THRESHOLDS:
            used: set = set()
            for a in order:
                free = [(lo <= size <= hi, iou, b) for b, iou, size in near[a] if iou >= t and b not in used]
                if free:
                    inside, _, b = max(free)
                    used.add(b)
                    rows.append((a, name, t, inside))
    return pd.DataFrame(rows, columns=["box_id", "area", "thr", "inside"])


def area_scores(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """(label, area, thr, n_gt, ap, recall_1, recall_10, recall_100) for the labels and area ranges with truth boxes.

    pred (image_id, label, box_id, x1, y1, x2, y2, score), gt without a score; ids are unique. The 100 best detections of an image and
    label count. A detection matched to a truth box outside the range, or unmatched and outside itself, is neither right nor wrong.
    Equal scores follow image and box id. Rows with a null id, label, score or side do not count.
    """
    named = ["image_id", "label", "box_id", *SIDES]
    size = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("double")
    truth = gt.select(*named, size.alias("size")).dropna()
    rank = F.row_number().over(Window.partitionBy("image_id", "label").orderBy(F.desc("score"), "box_id"))
    rounds = Rounds(pred.sparkSession, "area-scores")
    found = rounds.keep(pred.select(*named, "score", size.alias("size")).dropna().withColumn("rank", rank).filter(F.col("rank") <= MOST[-1]), "detections")
    pairs = iou_pairs(found.select(*named, "score"), truth.select(*named, "size"), ["image_id", "label"]).filter(F.col("iou") >= THRESHOLDS[0])
    pairs = pairs.select(F.col("box_id_a").cast("long").alias("a"), F.col("box_id_b").cast("long").alias("b"), F.col("score_a").cast("double").alias("score"), F.col("size_b").alias("gt_area"), F.col("iou").cast("double"))
    pairs = rounds.keep(mark_lone(pairs), "pairs")
    levels = lambda df: df.withColumn("area", F.explode(F.array(*map(F.lit, AREAS))))
    steps = lambda df: df.withColumn("thr", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    hits = grouped(pairs.filter("not lone").drop("lone"), rounds).groupBy("component").applyInPandas(_match, "box_id long, area string, thr double, inside boolean")
    hits = hits.union(steps(levels(pairs.filter("lone"))).filter("iou >= thr").select(F.col("a").alias("box_id"), "area", "thr", in_range(F.col("gt_area"), F.col("area"))))

    keys = ["label", "area", "thr"]
    totals = steps(levels(truth).filter(in_range(F.col("size"), F.col("area"))).groupBy("label", "area").agg(F.count("*").alias("n_gt")))
    rows = steps(levels(found)).join(hits, ["box_id", "area", "thr"], "left").filter(F.coalesce("inside", in_range(F.col("size"), F.col("area"))))
    rows = rows.select(*keys, "image_id", "box_id", "rank", "score", F.floor(F.col("score") * BUCKETS).alias("bucket"), F.col("inside").isNotNull().cast("long").alias("tp"))
    rows = rounds.keep(rows, "rows")

    sums = rows.groupBy(*keys, "bucket").agg(F.sum("tp").alias("tp0"), F.count("*").alias("n0"))
    ahead = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "bucket", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("tp0", "n0")))
    inner = Window.partitionBy(*keys, "bucket").orderBy(F.desc("score"), "image_id", "box_id").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({"tps": F.sum("tp").over(inner), "n": F.count("*").over(inner)}).filter("tp = 1").join(sums, [*keys, "bucket"]).join(totals, keys)
    # of the 101 points of recall, a row reaches those up to k; a point takes the best precision of all rows that reach it
    tops = run.select(*keys, F.floor((F.col("tps") + F.col("tp0")) * 100 / F.col("n_gt")).alias("k"), ((F.col("tps") + F.col("tp0")) / (F.col("n") + F.col("n0"))).alias("p")).groupBy(*keys, "k").agg(F.max("p").alias("p"))
    up = Window.partitionBy(*keys).orderBy("k")
    down = Window.partitionBy(*keys).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    points = tops.withColumns({"best": F.max("p").over(down), "new": F.col("k") - F.coalesce(F.lag("k").over(up), F.lit(-1))})
    ap = points.groupBy(*keys).agg((F.sum(F.col("best") * F.col("new")) / 101).alias("ap"))
    recall = rows.groupBy(*keys).agg(*(F.sum(F.when(F.col("rank") <= m, F.col("tp"))).alias(f"_{m}") for m in MOST))
    out = totals.join(ap, keys, "left").join(recall, keys, "left")
    return out.select(*keys, "n_gt", F.coalesce("ap", F.lit(0.0)).alias("ap"), *(F.coalesce(F.col(f"_{m}") / F.col("n_gt"), F.lit(0.0)).alias(f"recall_{m}") for m in MOST))


def area_summary(scores: DataFrame) -> DataFrame:
    """(metric, value): AP, AP_50, AP_75, AP by area, AR by number of detections, AR by area; means over labels and thresholds, -1 without truth."""
    whole, last = F.col("area") == "all", f"recall_{MOST[-1]}"
    mean = {"AP": F.when(whole, F.col("ap")), "AP_50": F.when(whole & (F.col("thr") == 0.5), F.col("ap")), "AP_75": F.when(whole & (F.col("thr") == 0.75), F.col("ap"))}
    mean |= {f"AP_{a}": F.when(F.col("area") == a, F.col("ap")) for a in list(AREAS)[1:]}
    mean |= {f"AR_at_{m}": F.when(whole, F.col(f"recall_{m}")) for m in MOST}
    mean |= {f"AR_{a}": F.when(F.col("area") == a, F.col(last)) for a in list(AREAS)[1:]}
    row = scores.agg(*(F.coalesce(F.avg(c), F.lit(-1.0)).alias(k) for k, c in mean.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in mean))).alias("m")).select("m.*")
