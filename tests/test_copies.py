"""Large groups of copies and large numbers: the same results, with each kind of shape worked on once."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.operators import boxes, joins, stats


def test_style_ignores_the_words_that_are_put_in(spark):
    from gridloom.plans import curate

    words = ["whole lower east", None, "overall urban", "expansion", "type of change", "changed region"]
    q = spark.createDataFrame([(i, j, w) for i in range(6) for j, w in enumerate(words * 6)], "sample_id long, item_no int, question string")
    styles, tasks = [s for _, _, s in curate.STYLED], [t for _, t in curate.ASKED]
    assert all(r.style == styles[(r.sample_id * 7 + r.item_no) % len(styles)] for r in curate.d12_question_style(q).collect())
    assert all(r.task == tasks[(r.sample_id * 7 + r.item_no) % len(tasks)] for r in curate.d11_task_of_question(q).collect())


def test_batches_and_scenes_of_one_box(spark):
    points = spark.createDataFrame([(i, 95.0 + i % 7, 30.0 + i % 3) for i in range(600)], "seq long, lon double, lat double")
    scenes = [(i // 2, 94.0 + i % 5, 29.0, 95.5 + i % 5, 31.0, None if i % 31 == 0 else i % 9 * 10) for i in range(400)]
    table = spark.createDataFrame(scenes, "scene_id long, min_lon double, min_lat double, max_lon double, max_lat double, cloud_pct int")
    got = {r.batch: r for r in stats.batch_coverage(points, table, 5, [20, 50]).collect()}
    assert len(got) == 120
    for b, r in got.items():
        lon, lat = [95.0 + i % 7 for i in range(b * 5, b * 5 + 5)], [30.0 + i % 3 for i in range(b * 5, b * 5 + 5)]
        met = [c for _, x1, y1, x2, y2, c in scenes if x1 <= max(lon) and x2 >= min(lon) and y1 <= max(lat) and y2 >= min(lat)]
        cloud = sorted(c for c in met if c is not None)
        middle = (cloud[(len(cloud) - 1) // 2] + cloud[len(cloud) // 2]) / 2
        assert (r.n_scenes, r.below_20, r.below_50, r.cloud_lo, r.cloud_hi, r.cloud_median) == (len(met), sum(c < 20 for c in cloud), sum(c < 50 for c in cloud), cloud[0], cloud[-1], middle)
        assert r.cloud_mean == pytest.approx(sum(cloud) / len(cloud))


def test_blend_of_far_rows(spark):
    from gridloom.plans import stats as plans

    p = spark.createDataFrame([(0, 60000, 1.0), (1, 60001, 2.0)], "x int, y int, red double")
    assert [(r.ty, r.last) for r in plans.a23_weighted_blend(p).collect()] == [(30000, 2.0)]


def rects(spark, n, seed, copies):
    rnd = random.Random(seed)
    kinds = [(float(x), float(y), float(x + rnd.randint(2, 30)), float(y + rnd.randint(2, 30))) for x, y in ((rnd.randint(0, 90), rnd.randint(0, 90)) for _ in range(n))]
    rows = [(i, *k) for i, k in enumerate(kinds * copies)]
    return rows, spark.createDataFrame(rows, "fid long, x1 double, y1 double, x2 double, y2 double")


def lattice(rows):
    return {(x, y) for _, x1, y1, x2, y2 in rows for x in range(int(x1), int(x2)) for y in range(int(y1), int(y2))}


def ringed(df):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return df.select("fid", F.array(F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))).alias("rings"))


def test_each_kind_of_polygon_is_swept_once(spark):
    from gridloom.operators import overlay
    from gridloom.operators.rounds import Rounds

    (a, t), (b, m) = rects(spark, 5, 1, 6), rects(spark, 4, 2, 7)
    covered = lattice(b)
    for rule, op in (("clip", overlay.clip), ("erase", overlay.erase)):
        want = {r[0]: len(lattice([r]) & covered if rule == "clip" else lattice([r]) - covered) for r in a}
        got = {r.fid: r.area for r in op(ringed(t), ringed(m), 64.0).select("fid", "area").collect()}
        plain = {r.fid: r.area for r in op(ringed(t), ringed(m), 64.0, False).collect()}
        assert got == plain == {k: v for k, v in want.items() if v}
    line = t.select("fid", F.lit("LineString").alias("type"), F.array(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y1").alias("y")))).alias("rings"))
    areas = {r.fid: r.area for r in overlay.buffer_areas(line, 2.0, 8, 64.0).collect()}
    assert areas == {r[0]: pytest.approx((r[3] - r[1]) * 4 + 64 * math.sin(math.pi / 16)) for r in a}
    assert overlay._kinds(ringed(t), Rounds(spark, "kinds"))[0].count() == 5


def test_union_area_of_copies_and_cells(spark):
    from gridloom.operators import vector

    rows, t = rects(spark, 12, 3, 5)
    df = t.withColumn("kind", F.when(F.col("fid") % 12 < 6, "a"))  # a null key too
    want = {"a": len(lattice([r for r in rows if r[0] % 12 < 6])), None: len(lattice([r for r in rows if r[0] % 12 >= 6]))}
    for cell in (None, 16.0):
        got = {r["kind"]: r["area"] for r in vector.union_area(df, "kind", cell).collect()}
        assert got["a"] == want["a"]
    rows_b, m = rects(spark, 4, 4, 5)
    got = {r.fid: r.area for r in vector.clip_boxes_to(t, m).collect()}
    assert got == {r[0]: n for r in rows if (n := len(lattice([r]) & lattice(rows_b)))}


def test_pairs_of_copies_meet_once(spark):
    (a, t), (b, m) = rects(spark, 6, 5, 4), rects(spark, 6, 6, 3)
    made = []
    meet = lambda x, y: made.append((x.count(), y.count())) or joins.box_candidates(x, y, 16.0)
    want = sorted((p[0], q[0]) for p, q in itertools.product(a, b) if p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4])
    assert sorted(map(tuple, joins.copies_met(t, m, [], meet).select("fid_a", "fid_b").collect())) == want
    assert made == [(6, 6)]


def test_first_copies_give_the_matches_of_all(spark):
    rnd = random.Random(7)
    kinds = [(rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(5, 20), rnd.randint(5, 20)) for _ in range(8)]
    rows = [(i, i % 2, "ab"[rnd.randint(0, 1)], x, y, x + w, y + h, 0.9) for i, (x, y, w, h) in enumerate(kinds * 5)]
    names = "box_id long, image_id long, label string, x1 int, y1 int, x2 int, y2 int, score double"
    pred, gt = spark.createDataFrame(rows, names), spark.createDataFrame([(r[0] + 100, *r[1:2], "ab"[rnd.randint(0, 1)], *r[3:]) for r in rows[::-1]], names)
    got = {(r.gt_label, r.pred_label): r.n for r in boxes.detection_confusion(pred, gt).collect()}
    plain = boxes.best_pairs(boxes.iou_pairs(pred, gt, ["image_id"]), 0.45).collect()
    want = Counter((r.label_b, r.label_a) for r in plain)
    assert {k: n for k, n in got.items() if "background" not in k} == want
    assert sum(n for (g, p), n in got.items() if p == "background") == len(rows) - len(plain)


def test_copies_of_vertices_see_what_their_place_sees(spark):
    from gridloom.operators import visibility

    places = [(0.0, 0.0), (10.0, 0.0), (0.0, 6.0)]
    v = spark.createDataFrame([(i, *places[i % 3]) for i in range(9)], "vid long, x double, y double")
    wall = spark.createDataFrame([([[{"x": x, "y": y} for x, y in ((4.0, -1.0), (5.0, -1.0), (5.0, 1.0), (4.0, 1.0))]],)] * 4, "rings array<array<struct<x: double, y: double>>>")
    got = sorted((r.src, r.dst, r.w) for r in visibility.visibility_graph(v, wall, 100.0, 8.0).collect())
    hidden = {0, 1}
    want = sorted((i, j, math.hypot(places[i % 3][0] - places[j % 3][0], places[i % 3][1] - places[j % 3][1])) for i in range(9) for j in range(9) if i != j and {i % 3, j % 3} != hidden)
    assert got == want


def test_square_tiles_are_not_shuffled(spark):
    from gridloom.operators import grid

    rows = [(1, 100, 300), (1, 100, 300), (2, 129, 128), (3, 0, 5), (4, None, 260)]
    out = grid.tiles(spark.createDataFrame(rows, "scene_id long, w int, h int"), 128, 100, "square")
    starts = lambda side: sorted({max(min(p, side - 128), 0) for p in range(0, max(side, 1), 100)}) if side is not None else [0]
    want = sorted((i, x, y) for i, w, h in set(rows) for x in starts(w) for y in starts(h))
    assert sorted(map(tuple, out.select("scene_id", "x0", "y0").collect())) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # distinct rows come before tiles (plans are written from the end)


def test_search_holds_few_scores_and_rows(spark):
    import tracemalloc

    import numpy as np
    import pandas as pd

    from gridloom.operators import retrieve

    rng = np.random.default_rng(1)
    unit = lambda n: [x / np.linalg.norm(x) for x in rng.normal(size=(n, 4))]
    block = pd.DataFrame({"vec_id": np.arange(4000), "v": unit(4000), "far": 0.1})
    asked = pd.DataFrame({"query_id": np.arange(4000), "q": unit(4000), "within": 3.0, "gap": 0.0})
    tracemalloc.start()
    got = retrieve._best(3)(asked, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 12000 and peak < 120e6
    best = np.round(np.stack(asked["q"]) @ np.stack(block["v"]).T, 9).max(axis=1)
    assert (got.groupby("query_id")["score"].max().to_numpy() == best).all()
    centres = np.stack(unit(64))
    frames = list(retrieve._reached(centres, np.full(64, 2.0), 1)(iter([asked.assign(h=0)])))
    assert sum(map(len, frames)) == 4000 * 64 and max(map(len, frames)) <= retrieve.ROWS


def test_copies_of_segments_are_tested_once(spark):
    from gridloom.operators import vector

    places = [(0.0, 0.0, 10.0, 0.0), (0.0, 5.0, 10.0, 5.0), (2.0, -4.0, 2.0, 4.0)]
    rows = [(i, *places[i % 3]) for i in range(30)] + [(99, None, 0.0, 1.0, 1.0)]
    wall = spark.createDataFrame([(4.0, -1.0, 5.0, 1.0)] * 20, "x1 double, y1 double, x2 double, y2 double")
    out = vector.visible(spark.createDataFrame(rows, "sid long, ax double, ay double, bx double, by double"), wall, 8.0)
    assert sorted(r.sid for r in out.collect()) == [i for i in range(30) if i % 3] + [99]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.rindex("Generate")  # boxes are made distinct before they are dealt to cells


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_confusion_pairs_kinds(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    shapes = [(float(x), float(y), float(x + 10), float(y + 10)) for x, y in ((rnd.randint(0, 5), rnd.randint(0, 5)) for _ in range(6))]  # many equal IoUs
    ids = rnd.sample(range(1000), 80)
    rows = [[(i, 0, rnd.choice("ab"), *rnd.choice(shapes)) for i in part] for part in (ids[:35], ids[35:])]
    pred, gt = (spark.createDataFrame(r, "box_id long, image_id long, label string, x1 double, y1 double, x2 double, y2 double") for r in rows)
    w = lambda p, q, i: max(0.0, min(p[i + 2], q[i + 2]) - max(p[i], q[i]))
    both = lambda p, q: w(p, q, 3) * w(p, q, 4)
    pairs = sorted(((both(p, q) / (200 - both(p, q)), p, q) for p in rows[0] for q in rows[1]), key=lambda t: (t[0], t[1][0], t[2][0]), reverse=True)
    used, want = set(), Counter()
    for v, p, q in pairs:
        if v >= 0.4 and not {(0, p[0]), (1, q[0])} & used:
            used |= {(0, p[0]), (1, q[0])}
            want[q[2], p[2]] += 1
    want.update((("background", p[2]) for p in rows[0] if (0, p[0]) not in used))
    want.update(((q[2], "background") for q in rows[1] if (1, q[0]) not in used))
    met, pair = [], boxes.iou_pairs
    monkeypatch.setattr(boxes, "iou_pairs", lambda a, b, on: met.append((a.count(), b.count())) or pair(a, b, on))
    assert {(r.gt_label, r.pred_label): r.n for r in boxes.greedy_confusion(pred, gt, 0.4).collect()} == want
    assert met[0] == tuple(len({r[3:] for r in side}) for side in rows)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_match_in_tasks_is_as_by_rounds(spark, seed, monkeypatch):
    """E07 wrote every pair of copies in each round; now a frame's kinds are paired in its task, and no round is written."""
    pred, gt = (boxes_of(spark, seed + k, 90) for k in (0, 50))
    rounds = sorted(map(tuple, boxes.greedy_match(pred, gt, 0.3, most=0).collect()))
    some = sorted(map(tuple, boxes.greedy_match(pred, gt, 0.3, most=50).collect()))
    monkeypatch.setattr(boxes, "Rounds", None)
    assert sorted(map(tuple, boxes.greedy_match(pred, gt, 0.3).collect())) == rounds == some and sum(r[2] is not None for r in rounds) > 20


def boxes_of(spark, seed, n):
    rnd = random.Random(seed)
    places = [(rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(4, 20), rnd.randint(4, 20)) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        x, y, w, h = rnd.choice(places)
        rows.append((i, rnd.randint(0, 1), rnd.choice("ab"), x, y, x + w, y + h))
    return spark.createDataFrame(rows, "box_id long, image_id long, label string, x1 long, y1 long, x2 long, y2 long")


@pytest.mark.parametrize("seed", range(3))
def test_optimal_boxes_of_copies(spark, seed, monkeypatch):
    """E28, E16: the pairs of all boxes were written in rounds; now a frame's kinds are assigned in its task, with the same sum."""
    from gridloom.operators import assign

    pred, gt = (boxes_of(spark, seed + k, 60) for k in (0, 50))
    pairs = boxes.iou_pairs(pred, gt, ["image_id"]).selectExpr("box_id_a AS a", "box_id_b AS b", "iou")
    every = {(r.a, r.b): r.iou for r in pairs.collect()}
    want = assign.optimal_pairs(pairs).agg({"iou": "sum"}).first()[0]
    large = assign.optimal_boxes(pred, gt, ["image_id"], most=0).agg({"iou": "sum"}).first()[0]
    monkeypatch.setattr(assign, "Rounds", None)
    got = [tuple(r) for r in assign.optimal_boxes(pred, gt, ["image_id"]).collect()]
    assert all(every[a, b] == iou for a, b, iou in got)
    assert len({a for a, _, _ in got}) == len({b for _, b, _ in got}) == len(got) > 20
    assert abs(sum(x[2] for x in got) - want) < 1e-9 and abs(large - want) < 1e-9


def test_presence_writes_no_pairs(spark, monkeypatch):
    """E16 wrote the pairs of its sure boxes and their groups in rounds; now images are assigned in the tasks."""
    from gridloom.operators import assign
    from gridloom.plans import assign as plans

    gt, pred = boxes_of(spark, 1, 200), boxes_of(spark, 2, 200).withColumn("score", F.lit(0.99))
    monkeypatch.setattr(assign, "Rounds", None)
    assert [(r.thr, r.il_tp, r.il_tn, r.il_fp, r.il_fn) for r in plans.e16_presence(pred, gt).orderBy("thr").collect()] == [(0.5, 2, 0, 0, 0), (0.75, 2, 0, 0, 0)]
    truth = gt.filter("box_id % 5 = 0")
    images = gt.select("image_id").distinct()
    counts = assign.presence_counts(None, pred, truth, images, 0.98, (0.1,), assign.optimal_boxes(pred, truth, ["image_id"]))
    monkeypatch.undo()
    pairs = boxes.iou_pairs(pred, truth, ["image_id"]).selectExpr("box_id_a AS a", "box_id_b AS b", "iou")
    total = lambda df: df.agg({"n_dt": "sum"}).first()[0]
    assert counts.agg({"tp": "sum"}).first()[0] > 0 and total(counts) == total(assign.presence_counts(pairs, pred, truth, images, 0.98, (0.1,)))
