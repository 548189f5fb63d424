"""Hard-negative mining by slot-decomposed selection.

Rows score against an anchor by the inner product of their integer components. An anchor's positives are its best ``positives``
rows of the same label; each positive opens a window of scores, from ``low`` to ``high`` % of its own, and the best ``negatives``
rows of another label inside the window are wanted. The windows of one anchor overlap. Their upper limits, in descending order,
split the scores into disjoint slots; a row falls into one slot at most. Combiners keep the best ``negatives`` of each slot; a window's
answer is the merge of the slots from its own limit down, cut at its lower limit.

Anchors and rows meet in cells: each anchor block with each row shard, both of bounded size, joined by an equal cell key. So no
task holds more than a block and a shard, nothing is broadcast, and what leaves a cell is bounded by its anchors. Shards are dealt by position, so a
repeated row or label can't fill one.

Rows with a null id, a null label, a null vector or a null or non-finite component take no part. An empty table has no result. Vectors
of different lengths are compared on their common components. Rows with the anchor's own id are neither its positives nor its
negatives; other rows count each for itself, repeated ones too. Anchor rows that are equal in id, label and vector give one set of results. A
negative score opens no window. Ties go to the smaller id. Scores must fit in 64 bits, or the job fails. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Anchors of a block, rows of a shard, and rows scored at once in a cell.
BLOCK, SHARD, STEP = 4096, 32_768, 1024


def matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return exact.astype(np.int64)  # fails where a score needs more than 64 bits


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest allowed scores of each row, ties to the left, in no order."""
    m = score.shape[1]
    if int(np.abs(score).max(initial=0)) < (1 << 62) // max(1, m):
        key = np.where(allowed, score * m + np.arange(m - 1, -1, -1), np.iinfo(np.int64).min)
        at = np.argpartition(key, m - k, axis=1)[:, m - k :] if m > k else np.broadcast_to(np.arange(m), score.shape)
    else:
        order = np.argsort(np.where(allowed, ~score, np.iinfo(np.int64).max), axis=1, kind="stable")
        at = order[:, :k]
    row = np.repeat(np.arange(len(score)), at.shape[1])
    col = at.ravel()
    keep = allowed[row, col]
    return row[keep], col[keep]


def _cell(slots: bool, k: int):
    """The best k rows of each slot of each anchor; without ``slots`` the best k of the anchor's label, as slot 0."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = rows.sort_values("id", kind="stable")
        width = max((len(v) for part in (anchors["vec"], rows["vec"]) for v in part), default=0)
        a, a_id, a_label = matrix(anchors["vec"].tolist(), width), anchors["id"].to_numpy(), anchors["label"].to_numpy()
        tag = anchors["tag"].to_numpy()
        if slots and len(anchors):
            most = max(len(x) for x in anchors["limits"])
            upper = np.full((len(anchors), most + 1), np.iinfo(np.int64).min)
            for i, (x, least) in enumerate(zip(anchors["limits"], anchors["least"], strict=True)):
                upper[i, : len(x)] = x
                upper[i, len(x)] = least - 1
        ids, labels, vectors = rows["id"].to_numpy(), rows["label"].to_numpy(), rows["vec"].tolist()
        for at in range(0, len(rows) if len(anchors) else 0, STEP):
            b_id, b_label = ids[at : at + STEP], labels[at : at + STEP]
            score = products(a, matrix(vectors[at : at + STEP], width))
            other = a_id[:, None] != b_id[None, :]
            same = a_label[:, None] == b_label[None, :]
            kinds = [(j, other & ~same & (score <= upper[:, j, None]) & (score > upper[:, j + 1, None])) for j in range(most)] if slots else [(0, other & same)]
            for j, allowed in kinds:
                i, c = best(score, allowed, k)
                out.append((a_id[i], tag[i], np.full(len(i), j), b_id[c], score[i, c]))
        names = ["anchor", "tag", "slot", "other", "score"]
        if not out:
            return pd.DataFrame({c: np.empty(0, dtype=np.int64) for c in names})
        found = pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))
        found = found.sort_values(["anchor", "tag", "slot", "score", "other"], ascending=[True, True, True, False, True])
        return found[found.groupby(["anchor", "tag", "slot"]).cumcount() < k]

    return run


FOUND = "anchor long, tag long, slot long, other long, score long"
KEY = ["anchor", "tag"]


def of_percent(score: str, percent: int) -> Column:
    """floor(score * percent / 100) of a score that isn't negative, without overflow."""
    return F.expr(f"{score} div 100") * percent + F.floor((F.col(score) % 100) * percent / 100)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchor`` is a condition on the rows.

    Components become floor(scale * x) first.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    inf = F.lit(float("inf"))
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != inf))
    valid = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    valid = valid.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), whole.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    n, many = valid.agg(F.count("*"), F.count_if("is_anchor")).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-many // block))
    each = valid.select("id", "label", "vec", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("s"))
    each = each.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = valid.filter("is_anchor").select("id", "label", "vec").dropDuplicates().withColumn("tag", F.xxhash64("label", "vec"))
    asked = scratch.keep(asked.withColumn("b", F.pmod(F.xxhash64("id", "tag"), F.lit(blocks)).cast("int")), "anchors")

    def meet(these: DataFrame, slots: bool, k: int) -> DataFrame:
        dealt = these.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        cells = dealt.groupBy("b", "s").cogroup(each.groupBy("b", "s")).applyInPandas(_cell(slots, k), FOUND)
        order = Window.partitionBy(*KEY, "slot").orderBy(F.desc("score"), "other")
        return cells.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)

    # positives, and the limits of the windows that they open
    found = meet(asked, False, positives).filter("score >= 0")
    found = found.select(*KEY, F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), of_percent("score", high).alias("limit"), (F.col("score") - of_percent("score", 100 - low)).alias("least"))
    found = scratch.keep(found, "positives")
    limits = found.groupBy(*KEY).agg(F.sort_array(F.collect_set("limit"), asc=False).alias("limits"), F.min("least").alias("least"))
    wanted = asked.join(limits.withColumnRenamed("anchor", "id"), ["id", "tag"])
    # the best of each slot; slots are disjoint, so a window's answer is what comes first from its limit down
    tops = meet(wanted, True, negatives).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), F.col("other").alias("id")))).alias("tops"))
    under = F.slice(F.filter("tops", lambda t: -t["down"] <= F.col("limit")), 1, negatives)
    inside = F.filter(under, lambda t: -t["down"] >= F.col("least"))
    picked = found.join(tops, KEY).select("anchor", "positive_id", "positive_score", F.posexplode(inside).alias("at", "t"))
    return picked.select(F.col("anchor").alias("anchor_id"), "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.id").alias("negative_id"), "positive_score", (-F.col("t.down")).alias("negative_score"))
