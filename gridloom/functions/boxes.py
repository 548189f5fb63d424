"""Column functions on boxes and regions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_or_more(c: Column) -> Column:
    return F.greatest(c, F.lit(0))


def intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return zero_or_more(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * zero_or_more(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))


def area(b: dict[str, Column]) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """0 where the union is empty."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.coalesce(F.try_divide(both * 1.0, union), F.lit(0.0))


def iou_variant(a: dict[str, Column], b: dict[str, Column], kind: str = "iou", eps: float = 1e-7) -> Column:
    """iou, giou, diou, ciou or ioa (over the area of ``b``), with eps in the denominators."""
    both = intersection(a, b)
    if kind == "ioa":
        return both / (area(b) + eps)
    w1, h1, w2, h2 = a["x2"] - a["x1"], a["y2"] - a["y1"] + eps, b["x2"] - b["x1"], b["y2"] - b["y1"] + eps
    union = w1 * h1 + w2 * h2 - both + eps
    base = both / union
    if kind == "iou":
        return base
    cw, ch = F.greatest(a["x2"], b["x2"]) - F.least(a["x1"], b["x1"]), F.greatest(a["y2"], b["y2"]) - F.least(a["y1"], b["y1"])
    if kind == "giou":
        hull = cw * ch + eps
        return base - (hull - union) / hull
    far = cw * cw + ch * ch + eps
    dx, dy = b["x1"] + b["x2"] - a["x1"] - a["x2"], b["y1"] + b["y2"] - a["y1"] - a["y2"]
    near = (dx * dx + dy * dy) / 4
    if kind == "diou":
        return base - near / far
    if kind == "ciou":
        v = 4 / math.pi**2 * F.pow(F.atan(w2 / h2) - F.atan(w1 / h1), F.lit(2))
        return base - (near / far + v * v / (v - base + (1 + eps)))
    raise ValueError(f"unknown kind {kind}")


def size_iou(w1: Column, h1: Column, w2: Column, h2: Column, eps: float = 1e-7) -> Column:
    both = F.least(w1, w2) * F.least(h1, h2)
    return both / (w1 * h1 + w2 * h2 - both + eps)


def to_centre(b: dict[str, Column]) -> dict[str, Column]:
    return {"cx": (b["x1"] + b["x2"]) / 2, "cy": (b["y1"] + b["y2"]) / 2, "w": b["x2"] - b["x1"], "h": b["y2"] - b["y1"]}


def to_corners(b: dict[str, Column]) -> dict[str, Column]:
    return {"x1": b["cx"] - b["w"] / 2, "y1": b["cy"] - b["h"] / 2, "x2": b["cx"] + b["w"] / 2, "y2": b["cy"] + b["h"] / 2}


def to_thousand(v: Column, size: Column) -> Column:
    """0..1000 with half-even rounding and clamping."""
    return F.least(F.greatest(F.bround(v * 1000.0 / size, 0), F.lit(0.0)), F.lit(1000.0)).cast("int")


def location_word(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Word of a region's place in its image."""
    dx, dy = x + w / 2 - width / 2, y + h / 2 - height / 2
    near = F.greatest(width, height) * 0.1
    # The eight directions counter-clockwise from the right.
    names = ["right", "top-right", "top", "top-left", "left", "bottom-left", "bottom", "bottom-right"]
    turn = F.pmod(F.bround(F.atan2(-dy, dx) / (math.pi / 4), 0).cast("int"), F.lit(8))
    return F.when((F.abs(dx) < near) & (F.abs(dy) < near), "center").otherwise(F.get(F.array(*map(F.lit, names)), turn))


def oriented_box(cx: Column, cy: Column, w: Column, h: Column, angle: Column, width: Column, height: Column) -> Column:
    """Normalised struct with the longer side first (angle turned by 90 when sides swap)."""
    swap = w < h
    return F.struct(
        F.bround(cx / width, 6).alias("cx"), F.bround(cy / height, 6).alias("cy"), F.bround(F.greatest(w, h) / width, 6).alias("w"),
        F.bround(F.least(w, h) / height, 6).alias("h"), F.bround(F.when(swap, angle + 90).otherwise(angle), 2).alias("angle"),
    )


def crop_side(v: Column, w: Column, top: Column) -> tuple[Column, Column]:
    return F.greatest(v, F.lit(0)), F.least(v + w, top)
