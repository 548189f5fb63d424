"""Tracking accuracy: higher-order scores of detection and association, and scores that tell location, association and class apart.

Truth and tracker detections are tables (seq, frame, track, det, cls) with a det number of its own each, and their overlapping pairs are a table
(a, b, sim) of det numbers. What a pair of tracks shares over a whole sequence is summed over these pairs first; it weights the assignment of every frame,
which is solved frame by frame in groups of objects that touch. All thresholds follow from one assignment, as counts by the number of
thresholds that a match passes; no step loops over frames or thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .assign import optimal_pairs
from .rounds import Rounds

EPS = 2.220446049250313e-16
#: Thresholds of the two families, in hundredths.
HOTA_ALPHAS = tuple(range(5, 100, 5))
TETA_ALPHAS = tuple(range(0, 100, 5))
CLASS_ALPHAS = tuple(range(50, 100, 5))


def named(pairs: DataFrame, truth: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Pairs with their frame, and the truth's and the tracker's tracks; both sides have the columns ``by``."""
    a = truth.select(*by, "frame", F.col("det").alias("a"), F.col("track").alias("gt"))
    b = found.select(*by, F.col("det").alias("b"), F.col("track").alias("tk"))
    return pairs.select("a", "b", "sim").filter("sim > 0").join(a, "a").join(b, [*by, "b"])


def aligned(pairs: DataFrame, truth: DataFrame, found: DataFrame, by: list[str], rounds: Rounds) -> DataFrame:
    """(by, gt, tk, m, n_gt, n_tk, score): overlap that two tracks share, summed over their sequence, and its share of both tracks' detections."""
    # a detection's pairs are all in its frame, so one dealing by frames serves both sides
    total = lambda side: F.sum("sim").over(Window.partitionBy(*by, "frame", side))
    soft = pairs.repartition(*by, "frame").withColumn("soft", F.col("sim") / (total("a") + total("b") - F.col("sim")))
    shared = soft.groupBy(*by, "gt", "tk").agg(F.sum("soft").alias("m"))
    count = lambda df, name, n: df.groupBy(*by, F.col("track").alias(name)).agg(F.count("*").alias(n))
    both = shared.join(count(truth, "gt", "n_gt"), [*by, "gt"]).join(count(found, "tk", "n_tk"), [*by, "tk"])
    return rounds.keep(both.withColumn("score", F.col("m") / (F.col("n_gt") + F.col("n_tk") - F.col("m"))), "aligned")


def matched(pairs: DataFrame, tracks: DataFrame, by: list[str], rounds: Rounds) -> DataFrame:
    """The pairs of the assignment with the largest sum of track score times similarity, frame by frame."""
    weighted = pairs.join(tracks.select(*by, "gt", "tk", "score"), [*by, "gt", "tk"])
    chosen = optimal_pairs(weighted.select(*by, "frame", "a", "b", (F.col("score") * F.col("sim")).alias("iou")), [*by, "frame"])
    return rounds.keep(pairs.join(chosen.select("a", "b"), ["a", "b"]), "matched")


def passed(sim: Column, alphas: tuple[int, ...]) -> Column:
    """How many of the ascending thresholds a similarity reaches."""
    return sum((F.when(sim >= a / 100 - EPS, 1).otherwise(0) for a in alphas), F.lit(0))


def over_thresholds(rows: DataFrame, by: list[str], alphas: tuple[int, ...], sums: dict[str, Column]) -> DataFrame:
    """(by, alpha, sums) over the rows that reach each threshold; rows are summed by the number of thresholds they reach, then dealt to these."""
    levels = rows.withColumn("_k", passed(F.col("sim"), alphas)).filter("_k > 0").groupBy(*by, "_k").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    each = levels.withColumn("alpha", F.explode(F.slice(F.array(*map(F.lit, alphas)), 1, F.col("_k"))))
    return each.groupBy(*by, "alpha").agg(*(F.sum(n).alias(n) for n in sums))


def association(hits: DataFrame, tracks: DataFrame, by: list[str], alphas: tuple[int, ...], extra: dict[str, Column] | None = None) -> DataFrame:
    """(by, alpha, tp, ass, ass_re, ass_pr): hits, and the sums over hits of what their two tracks have in common."""
    extra = extra or {}
    c = over_thresholds(hits, [*by, "gt", "tk"], alphas, {"n": F.lit(1), **extra})
    c = c.join(tracks.select(*by, "gt", "tk", "n_gt", "n_tk"), [*by, "gt", "tk"])
    n = F.col("n")
    return c.groupBy(*by, "alpha").agg(
        F.sum("n").alias("tp"), F.sum(n * n / F.greatest(F.lit(1), F.col("n_gt") + F.col("n_tk") - n)).alias("ass"),
        F.sum(n * n / F.col("n_gt")).alias("ass_re"), F.sum(n * n / F.col("n_tk")).alias("ass_pr"), *(F.sum(k).alias(k) for k in extra),
    )


def share(x: Column, *rest: Column) -> Column:
    """x of x and the rest together, 0 where there is nothing."""
    return x / F.greatest(F.lit(1), sum(rest, x))


def with_total(rows: DataFrame, key: str, by: list[str], fields: list[str]) -> DataFrame:
    """Rows and, with a null key, their sums over all keys."""
    whole = rows.groupBy(*by).agg(*(F.sum(f).alias(f) for f in fields)).withColumn(key, F.lit(None).cast(rows.schema[key].dataType))
    return rows.select(key, *by, *fields).union(whole.select(key, *by, *fields))


def hota(truth: DataFrame, found: DataFrame, pairs: DataFrame, alphas: tuple[int, ...] = HOTA_ALPHAS) -> DataFrame:
    """(seq, alpha, tp, fn, fp, hota, det_a, det_re, det_pr, ass_a, ass_re, ass_pr, loc_a, owta) of each sequence and threshold (in hundredths).

    The null sequence combines all, weighted by true positives. A sequence without truth or without detections has no hits.
    """
    rounds = Rounds(truth.sparkSession, "hota")
    by = ["seq"]
    known = rounds.keep(named(pairs, truth, found, by), "pairs")
    tracks = aligned(known, truth, found, by, rounds)
    hits = matched(known, tracks, by, rounds)
    scored = association(hits, tracks, by, alphas, {"loc": F.col("sim")})
    n = lambda df, name: df.groupBy("seq").agg(F.count("*").alias(name))
    base = n(truth, "n_gt").join(n(found, "n_tk"), "seq", "full").na.fill(0, ["n_gt", "n_tk"]).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    fields = ["tp", "ass", "ass_re", "ass_pr", "loc", "n_gt", "n_tk"]
    rows = with_total(base.join(scored, ["seq", "alpha"], "left").na.fill(0, fields), "seq", ["alpha"], fields)
    tp, fn, fp = F.col("tp"), F.col("n_gt") - F.col("tp"), F.col("n_tk") - F.col("tp")
    hit = F.greatest(F.lit(1), tp)
    empty = F.when(F.col("seq").isNull(), 0.0).otherwise(1.0)
    out = rows.select("seq", "alpha", tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), share(tp, fn, fp).alias("det_a"), share(tp, fn).alias("det_re"), share(tp, fp).alias("det_pr"), *((F.col(c) / hit).alias(to) for c, to in (("ass", "ass_a"), ("ass_re", "ass_re"), ("ass_pr", "ass_pr"))), F.when(tp > 0, F.col("loc") / hit).otherwise(empty).alias("loc_a"))
    return out.withColumns({"hota": F.sqrt(F.col("det_a") * F.col("ass_a")), "owta": F.sqrt(F.col("det_re") * F.col("ass_a"))})


def teta(truth: DataFrame, found: DataFrame, pairs: DataFrame, cluster: float = 0.5, false_from: float = 0.5, exclusive: bool = True) -> DataFrame:
    """(cls, alpha, loc_tp, loc_fn, loc_fp, cls_tp, cls_fn, cls_fp, loc_a, assoc_a, cls_a, teta) of each class of the truth and threshold, over all sequences.

    Truth is not exhaustive: a detection counts only when it lies in the cluster of a truth box of the class (similarity of ``cluster``), and the other
    detections of its track with it. A detection in a cluster that matches nothing is false from the similarity ``false_from`` on. With ``exclusive``
    detections that are assigned to truth of another class leave a class's clusters. Class counts run over the thresholds from 50 on, their shares are
    averaged over these, and a match of the wrong class is a false one of the class that it claims. At threshold 0 also pairs without overlap match, as
    many as can, in order of their tracks. The null class averages the classes.
    Truth without a class is left out.
    """
    rounds = Rounds(truth.sparkSession, "teta")
    kinds = truth.select("cls").distinct().withColumn("kind", F.row_number().over(Window.orderBy("cls")) - 1)  # a row a class
    kinds = rounds.keep(kinds, "kinds")
    many = max(1, kinds.count())
    truth = truth.join(F.broadcast(kinds), "cls").select("kind", "seq", "frame", "track", "det", "cls")
    near = pairs.filter(F.col("sim") >= cluster).select("a", "b").join(truth.select(F.col("det").alias("a"), "kind"), "a")
    inside = near.select("kind", "b").distinct()
    if exclusive:
        every = truth.select("seq", "frame", "track", "det")
        dets = found.join(_tracks_of(near.select("b").distinct(), found, []), ["seq", "track"], "left_semi")
        known = rounds.keep(named(pairs, every, dets, ["seq"]), "all-pairs")
        whole = matched(known, aligned(known, every, dets, ["seq"], rounds), ["seq"], rounds).filter(F.col("sim") >= 0.5 - EPS)
        owner = whole.select("a", "b").join(truth.select(F.col("det").alias("a"), F.col("kind").alias("owner")), "a").select("b", "owner")
        inside = inside.join(owner, "b", "left").filter("owner is null or owner = kind").select("kind", "b")
    inside = rounds.keep(inside, "inside")
    # each class has its own copy of the tracks that its clusters hold; det numbers are made distinct by class
    tracked = rounds.keep(found.join(_tracks_of(inside, found, ["kind"]), ["seq", "track"]).withColumn("own", F.col("det")).withColumn("det", F.col("det") * many + F.col("kind")), "tracked")
    by = ["kind", "seq"]
    met = pairs.join(truth.select(F.col("det").alias("a"), "kind"), "a").select("a", (F.col("b") * many + F.col("kind")).alias("b"), "sim")
    known = rounds.keep(named(met, truth, tracked, by), "pairs")
    tracks = aligned(known, truth, tracked, by, rounds)
    hits = matched(known, tracks, by, rounds)
    claims = hits.join(tracked.select(F.col("det").alias("b"), F.col("cls").alias("claim")), "b").join(F.broadcast(kinds), "kind")
    # threshold 0: what is left of both sides of a frame pairs off in order
    order = Window.partitionBy("kind", "seq", "frame").orderBy("track")
    left_a = truth.join(hits.select(F.col("a").alias("det")), "det", "left_anti").select(*by, "frame", F.row_number().over(order).alias("nth"), F.col("track").alias("gt"), F.col("det").alias("a"))
    left_b = tracked.join(hits.select(F.col("b").alias("det")), "det", "left_anti").select(*by, "frame", F.row_number().over(order).alias("nth"), F.col("track").alias("tk"), F.col("det").alias("b"))
    loose = left_a.join(left_b, [*by, "frame", "nth"]).select(*by, "gt", "tk", "a", "b", F.lit(0.0).alias("sim"))
    all_hits = rounds.keep(hits.select(loose.columns).union(loose), "hits")
    counts = lambda df, name, n: df.groupBy(*by, F.col("track").alias(name)).agg(F.count("*").alias(n))
    sizes = all_hits.select(*by, "gt", "tk").distinct().join(counts(truth, "gt", "n_gt"), [*by, "gt"]).join(counts(tracked, "tk", "n_tk"), [*by, "tk"])
    # sequences without detections in a cluster count their truth as missed; those without truth of the class count nothing
    scored = association(all_hits, sizes, by, TETA_ALPHAS).groupBy("kind", "alpha").agg(*(F.sum(c).alias(c) for c in ("tp", "ass")))
    seen = tracked.join(inside.select("kind", F.col("b").alias("own")), ["kind", "own"], "left_semi")
    strong = known.filter(F.col("sim") >= false_from).select("b").distinct()
    blamed = seen.join(strong.withColumnRenamed("b", "det"), "det", "left_semi").join(truth.select("kind", "seq", "frame").distinct(), ["kind", "seq", "frame"], "left_semi")
    blamed = blamed.select("kind", "det").join(all_hits.select(F.col("b").alias("det"), F.col("sim").alias("best")), "det", "left")
    # a blamed detection is false at the thresholds that its own match doesn't reach
    excused = over_thresholds(blamed.filter("best is not null").withColumn("sim", F.col("best")), ["kind"], TETA_ALPHAS, {"excused": F.lit(1)})
    blame = blamed.groupBy("kind").agg(F.count("*").alias("blamed"))
    right = over_thresholds(claims.filter("claim = cls"), ["kind"], CLASS_ALPHAS, {"cls_tp": F.lit(1)})
    wrong = over_thresholds(claims.filter("claim is null or claim <> cls"), ["kind"], CLASS_ALPHAS, {"cls_fn": F.lit(1)})
    false = over_thresholds(claims.filter("claim <> cls").select("claim", "sim"), ["claim"], CLASS_ALPHAS, {"cls_fp": F.lit(1)})
    false = false.join(F.broadcast(kinds.withColumnRenamed("cls", "claim")), "claim").select("kind", "alpha", "cls_fp")
    base = truth.groupBy("kind").agg(F.count("*").alias("n_gt")).join(F.broadcast(kinds), "kind").withColumn("alpha", F.explode(F.array(*map(F.lit, TETA_ALPHAS))))
    for part in (scored, excused, right, wrong, false):
        base = base.join(part, ["kind", "alpha"], "left")
    base = base.join(blame, "kind", "left").na.fill(0, ["tp", "ass", "excused", "blamed", "cls_tp", "cls_fn", "cls_fp"])
    tp, fn, fp = F.col("tp"), F.col("n_gt") - F.col("tp"), F.col("blamed") - F.col("excused")
    high = F.when(F.col("alpha") >= 50, share(F.col("cls_tp"), F.col("cls_fn"), F.col("cls_fp")))
    rows = base.select("cls", "alpha", tp.alias("loc_tp"), fn.alias("loc_fn"), fp.alias("loc_fp"), "cls_tp", "cls_fn", "cls_fp", share(tp, fn, fp).alias("loc_a"), (F.col("ass") / F.greatest(F.lit(1), tp)).alias("assoc_a"), F.avg(high).over(Window.partitionBy("cls")).alias("cls_a"))
    rows = rounds.keep(rows.withColumn("teta", (F.col("loc_a") + F.col("assoc_a") + F.col("cls_a")) / 3), "rows")
    sums, means = ["loc_tp", "loc_fn", "loc_fp", "cls_tp", "cls_fn", "cls_fp"], ["loc_a", "assoc_a", "cls_a", "teta"]
    whole = rows.groupBy("alpha").agg(*(F.sum(c).alias(c) for c in sums), *(F.avg(c).alias(c) for c in means)).withColumn("cls", F.lit(None).cast(rows.schema["cls"].dataType))
    return rows.union(whole.select(rows.columns))


def _tracks_of(dets: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """(by, seq, track) of the tracks that hold one of the detections (by, b)."""
    return dets.join(found.select("seq", "track", F.col("det").alias("b")), "b").select(*by, "seq", "track").distinct()
