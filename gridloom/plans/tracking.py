"""Plans of tracking accuracy (E18, E19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tracking as op
from ..operators.boxes import iou_pairs
from .registry import plan

C = F.col


def overlaps(truth: DataFrame, found: DataFrame) -> DataFrame:
    box = ["seq", "frame", "det", "x1", "y1", "x2", "y2"]
    return iou_pairs(truth.select(box), found.select(box), ["seq", "frame"]).select(C("det_a").alias("a"), C("det_b").alias("b"), C("iou").alias("sim"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.bround(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes))


@plan("track_truth track_found")
def e18_hota(g: DataFrame, p: DataFrame) -> DataFrame:
    return rounded(op.hota(g, p, overlaps(g, p)))


@plan("track_truth track_found")
def e19_teta(g: DataFrame, p: DataFrame) -> DataFrame:
    return rounded(op.teta(g, p, overlaps(g, p)))
