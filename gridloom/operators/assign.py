"""Optimal one-to-one assignment of overlapping boxes or masks, and what is measured with it.

The sum of IoU is largest when it is largest in every connected group of overlapping pairs, so groups are found over the pairs
first and each is solved by itself: a task holds one group of objects that touch, not an image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames
from .boxes import iou_pairs
from .rounds import Rounds, components_of

#: Pairs of a frame that a task takes at once; frames of more pairs are cut into connected groups by rounds first.
FRAME = 10_000


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total gain, by shortest augmenting paths over reduced costs."""
    if gain.shape[0] > gain.shape[1]:
        return [(b, a) for a, b in assignment(gain.T)]
    n, m = gain.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        best, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, via, base = start, -1, 0.0
        while True:
            cost = base - gain[row] - row_price[row] - column_price
            closer = ~done & (cost < best)
            best[closer], back[closer] = cost[closer], via
            via = int(np.where(done, np.inf, best).argmin())
            base = best[via]
            done[via] = True
            if owner[via] < 0:
                break
            row = int(owner[via])
        # prices move by what the path has saved, then the path's columns change hands
        passed = np.flatnonzero(done & (owner >= 0))
        row_price[start] += base
        row_price[owner[passed]] += base - best[passed]
        column_price[passed] -= base - best[passed]
        while via >= 0:
            before = int(back[via])
            owner[via] = start if before < 0 else owner[before]
            via = before
    return [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]


def _solve(frame: pd.DataFrame) -> pd.DataFrame:
    left, a = np.unique(frame["a"], return_inverse=True)
    right, b = np.unique(frame["b"], return_inverse=True)
    gain = np.zeros((len(left), len(right)))
    gain[a, b] = frame["iou"]
    rows = [(left[i], right[j], gain[i, j]) for i, j in assignment(gain) if gain[i, j] > 0]
    return pd.DataFrame(rows, columns=["a", "b", "iou"]).astype({"a": "int64", "b": "int64", "iou": "float64"})


def _labels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The connected group of each pair, as the least code that its ends reach; codes of both sides are apart."""
    least = np.arange(max(a.max(), b.max()) + 1)
    while True:
        low = np.minimum(least[a], least[b])
        after = least.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == least).all():
            return least[a]
        least = after


def _solve_frames(rows: pd.DataFrame) -> pd.DataFrame:
    """The assignment of whole frames, connected group by connected group."""
    left, a = np.unique(rows["a"].to_numpy(), return_inverse=True)
    right, b = np.unique(rows["b"].to_numpy(), return_inverse=True)
    gain = rows["iou"].to_numpy()
    label = _labels(a, b + len(left))
    order = np.argsort(label, kind="stable")
    starts = np.flatnonzero(np.diff(label[order], prepend=-1))
    taken = []
    for at in np.split(order, starts[1:]):
        if len(at) == 1:
            taken.append(at)
            continue
        x, i = np.unique(a[at], return_inverse=True)
        y, j = np.unique(b[at], return_inverse=True)
        dense, row = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)), dtype=np.int64)
        dense[i, j], row[i, j] = gain[at], at
        taken.append(np.array([row[p, q] for p, q in assignment(dense) if dense[p, q] > 0], dtype=np.int64))
    at = np.concatenate(taken)
    return pd.DataFrame({"a": left[a[at]], "b": right[b[at]], "iou": gain[at]})


def _stream_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames that come one after the other, those of a batch at once; the last frame waits for the rest of it."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        frame = rows["_frame"].to_numpy()
        others = np.flatnonzero(frame != frame[-1])
        cut = others[-1] + 1 if len(others) else 0
        if cut:
            yield _solve_frames(rows.iloc[:cut])
        held = rows.iloc[cut:]
    if held is not None and len(held):
        yield _solve_frames(held)


def mark_lone(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with ``lone``: neither side occurs in another pair, so the pair is a group by itself and needs no search."""
    n = lambda c: F.count("*").over(Window.partitionBy(c))
    return pairs.withColumn("_a", n("a")).withColumn("lone", (F.col("_a") == 1) & (n("b") == 1)).drop("_a")


def grouped(pairs: DataFrame, rounds: Rounds) -> DataFrame:
    """Pairs (a, b, ...) with the connected group ``component`` they belong to; ids of the two sides may clash."""
    groups = components_of(pairs.select((F.col("a") * 2).alias("a"), (F.col("b") * 2 + 1).alias("b")), rounds)
    return pairs.join(groups.filter("node % 2 = 0").select(F.expr("node div 2").alias("a"), "component"), "a")


def optimal_pairs(pairs: DataFrame, frame: list[str] | None = None, most: int = FRAME) -> DataFrame:
    """(a, b, iou) of the assignment with the largest sum of IoU, from pairs of ids with their IoU over 0.

    ``frame`` names columns that tell apart frames which no box is in two of: those of ``most`` pairs or fewer are dealt whole to the tasks, which
    find the connected groups themselves; only larger ones are cut by rounds over all pairs.
    """
    rounds = Rounds(pairs.sparkSession, "assign")
    if frame:
        # frames that share a hash are solved together, which changes nothing: their boxes don't touch
        slim = pairs.filter("iou > 0").select(*(F.col(c).cast(k).alias(c) for c, k in (("a", "long"), ("b", "long"), ("iou", "double"))), F.xxhash64(*frame).alias("_frame"))
        dealt = rounds.keep(slim.withColumn("_n", F.count("*").over(Window.partitionBy("_frame"))), "frames")
        parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        small = dealt.filter(F.col("_n") <= most).drop("_n").repartition(parts, "_frame").sortWithinPartitions("_frame", "a", "b")
        solved = small.mapInPandas(_stream_frames, "a long, b long, iou double")
        pairs = dealt.filter(F.col("_n") > most)
        if pairs.isEmpty():
            return solved
    pairs = rounds.keep(mark_lone(pairs.select("a", "b", "iou").filter("iou > 0")), "pairs")
    rows = grouped(pairs.filter("not lone").drop("lone"), rounds)
    alone = pairs.filter("lone").select(*(F.col(c).cast(k) for c, k in (("a", "long"), ("b", "long"), ("iou", "double"))))
    out = alone.union(rows.groupBy("component").applyInPandas(_solve, "a long, b long, iou double"))
    return solved.union(out) if frame else out


def optimal_boxes(pred: DataFrame, gt: DataFrame, keys: list[str], most: int = frames.MOST) -> DataFrame:
    """(a, b, iou) of the assignment with the largest sum of IoU of boxes (box_id, x1..y2) of equal ``keys``.

    Only boxes are shuffled: a frame of ``most`` boxes or fewer is one task's, which assigns kinds of equal boxes. Pairs of larger frames are written and cut into connected groups.
    """
    columns = [*keys, "box_id", *frames.SIDES]
    small, truth, large = frames.split_frames(pred.select(*columns), gt.select(*columns), keys, most)
    out = frames.match_frames(small, truth, keys, frames.optimal)
    return out.union(optimal_pairs(iou_pairs(*large, keys).select(F.col("box_id_a").alias("a"), F.col("box_id_b").alias("b"), "iou"))) if large else out


def associate(pairs: DataFrame, detections: DataFrame, tracks: DataFrame, threshold: float = 0.5, threshold_track: float = 0.5, least_new: float = 0.0, chosen: DataFrame | None = None) -> dict[str, DataFrame]:
    """Detections (image_id, box_id, score) against tracks (image_id, box_id), with all their overlapping pairs (a, b, iou), and ``chosen``, their assignment where it is known.

    ``matched``: assigned pairs over the track threshold. ``over``: all pairs over the threshold. ``new``: detections without such a
    pair and with the least score, and every detection of an image without tracks. ``unmatched``: tracks not matched, in images that have detections.
    """
    matched = (optimal_pairs(pairs) if chosen is None else chosen).filter(F.col("iou") >= threshold_track)
    over = pairs.filter(F.col("iou") >= threshold).select("a", "b", "iou")
    seen = detections.select("image_id").distinct()
    new = new_detections(over, detections, tracks, least_new)
    unmatched = tracks.join(matched.select(F.col("b").alias("box_id")), "box_id", "left_anti").join(seen, "image_id", "left_semi")
    return {"matched": matched, "over": over, "new": new, "unmatched": unmatched}


def new_detections(over: DataFrame, detections: DataFrame, tracks: DataFrame, least_new: float = 0.0) -> DataFrame:
    """Detections that stand in no pair of ``over`` (a, ...) and have the least score, and every detection of an image without tracks."""
    tracked = tracks.select("image_id").distinct().withColumn("_some", F.lit(True))
    free = detections.join(over.select(F.col("a").alias("box_id")).distinct(), "box_id", "left_anti")
    return free.join(tracked, "image_id", "left").filter(F.col("_some").isNull() | (F.col("score") >= least_new)).drop("_some")


def presence_counts(pairs: DataFrame | None, pred: DataFrame, gt: DataFrame, images: DataFrame, least: float = 0.5, thresholds: tuple[float, ...] = (0.5,), chosen: DataFrame | None = None) -> DataFrame:
    """(image_id, n_dt, n_gt, thr, tp, fp, fn) of every image: predictions of at least the score ``least``, assigned by the largest sum of IoU.

    ``chosen`` is that assignment of the sure predictions, where it is known; ``pairs`` isn't read then.
    """
    sure = pred.filter(F.col("score") >= least)
    n = lambda df, name: df.groupBy("image_id").agg(F.count("*").alias(name))
    base = images.select("image_id").join(n(sure, "n_dt"), "image_id", "left").join(n(gt, "n_gt"), "image_id", "left").na.fill(0, ["n_dt", "n_gt"]).withColumn("thr", F.explode(F.array(*map(F.lit, thresholds))))
    if chosen is None:
        chosen = optimal_pairs(pairs.join(sure.select(F.col("box_id").alias("a")), "a", "left_semi"))
    chosen = chosen.join(sure.select(F.col("box_id").alias("a"), "image_id"), "a")
    hits = chosen.withColumn("thr", F.explode(F.array(*map(F.lit, thresholds)))).filter("iou >= thr").groupBy("image_id", "thr").agg(F.count("*").alias("tp"))
    out = base.join(hits, ["image_id", "thr"], "left").na.fill(0, ["tp"])
    return out.select("image_id", "n_dt", "n_gt", "thr", "tp", (F.col("n_dt") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))


def presence_scores(counts: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Per threshold: image-level counts, their Matthews correlation, the micro F1 of images with truth, and the product of both."""
    some_dt, some_gt = F.col("n_dt") > 0, F.col("n_gt") > 0
    c = counts.groupBy("thr").agg(
        F.count_if(some_dt & some_gt).alias("il_tp"), F.count_if(~some_dt & ~some_gt).alias("il_tn"), F.count_if(some_dt & ~some_gt).alias("il_fp"), F.count_if(~some_dt & some_gt).alias("il_fn"),
        *(F.sum(F.when(some_gt, F.col(k))).alias(k) for k in ("tp", "fp", "fn")),
    )
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + eps), F.col("tp") / (F.col("tp") + F.col("fn") + eps)
    a, b, x, y = (F.col(f"il_{k}").cast("double") for k in ("tp", "tn", "fp", "fn"))
    mcc = F.coalesce(F.try_divide(a * b - x * y, F.sqrt((a + x) * (a + y) * (b + x) * (b + y))), F.lit(0.0))
    return c.withColumns({"micro_f1": 2 * p * r / (p + r + eps), "mcc": mcc}).withColumn("cgf1", F.col("micro_f1") * F.col("mcc"))
