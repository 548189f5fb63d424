"""Hand-worked cases and invariants of operators that SQL doesn't express."""

import itertools
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import pixel as px
from gridloom.operators import boxes, cleaning, curate, grid


MAP = ["1100", "0010", "2001", "2211"]


def pixels(spark, rows=MAP):
    return spark.createDataFrame([(x, y, int(c)) for y, row in enumerate(rows) for x, c in enumerate(row)], "x int, y int, v int")


def flood(rows, reach8=True):
    cells = {(x, y): c for y, row in enumerate(rows) for x, c in enumerate(row)}
    out = {}
    for start in sorted(cells, key=lambda p: (p[1], p[0])):
        if start in out:
            continue
        todo = [start]
        while todo:
            p = todo.pop()
            if p in out:
                continue
            out[p] = start[1] * 2**31 + start[0]
            for dx, dy in itertools.product((-1, 0, 1), repeat=2):
                q = (p[0] + dx, p[1] + dy)
                if q in cells and cells[q] == cells[p] and (reach8 or dx == 0 or dy == 0):
                    todo.append(q)
    return out


def spiral(n):
    grid_ = [["0"] * n for _ in range(n)]
    x, y, dx, dy = 0, 0, 1, 0
    grid_[0][0] = "1"
    while True:
        ahead, two = (x + dx, y + dy), (x + 2 * dx, y + 2 * dy)
        free = 0 <= ahead[0] < n and 0 <= ahead[1] < n and not (0 <= two[0] < n and 0 <= two[1] < n and grid_[two[1]][two[0]] == "1")
        if not free:
            dx, dy = -dy, dx
            two = (x + 2 * dx, y + 2 * dy)
            if not (0 <= two[0] < n and 0 <= two[1] < n) or grid_[two[1]][two[0]] == "1":
                return ["".join(r) for r in grid_]
            continue
        x, y = ahead
        grid_[y][x] = "1"


STRIPE = ["010"] * 1000
COMB = ["1" * 61] + ["10" * 30 + "1"] * 40
RANDOM = ["".join(random.Random(seed).choices("0012", k=70)) for seed in range(50)]


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize(("rows", "tile"), [(MAP, 2), (MAP, 256), (STRIPE, 16), (spiral(41), 8), (COMB, 7), (RANDOM, 9), (RANDOM, 64)], ids=["map2", "map", "stripe", "spiral", "comb", "random9", "random64"])
def test_components(spark, rows, tile, connectivity):
    got = {(r.x, r.y): r.component for r in grid.components(pixels(spark, rows), "v", connectivity, tile).collect()}
    assert got == flood(rows, connectivity == 8)


def test_components_of_moved_and_repeated_pixels(spark):
    rows = [(x - 300, y - 5, 1) for x in range(600) for y in (0, 2)] + [(0, 3, 1), (0, 3, 1), (7, 90, None)]
    got = {(r.x, r.y): r.component for r in grid.components(spark.createDataFrame(rows, "x int, y int, v int"), "v", 8, 64).collect()}
    assert set(got.values()) == {-5 * 2**31 - 300, -3 * 2**31 - 300, 3 * 2**31} and (7, 90) not in got


def test_shortest_paths_of_a_long_chain_and_a_negative_circle(spark):
    from gridloom.operators import vector

    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(12)], "src long, dst long, w double")
    got = {r.node: r.dist for r in vector.shortest_paths(chain, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {i: float(i) for i in range(13)}
    with pytest.raises(ValueError, match="negative"):
        vector.shortest_paths(spark.createDataFrame([(0, 1, -1.0), (1, 0, 0.5)], "src long, dst long, w double"), spark.createDataFrame([(0,)], "node long"))


def test_boxes_of_all_sizes_meet(spark):
    from gridloom.operators import joins

    rnd = random.Random(3)

    def some(n):
        out = []
        for i in range(n):
            side = 2.0 ** rnd.randint(0, 14)
            x, y = rnd.uniform(-9000, 9000), rnd.uniform(-9000, 9000)
            out.append((i, i % 2, x, y, x + rnd.uniform(0, side), y + rnd.uniform(0, side)))
        return out

    a, b = some(80), some(90)
    want = {(p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5]}
    schema = "fid int, image int, x1 double, y1 double, x2 double, y2 double"
    got = [(r.fid_a, r.fid_b) for r in joins.box_candidates(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 50.0, ["image"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_small_components_take_the_ring_majority(spark):
    out = {(r.x, r.y): r.v for r in grid.replace_small(pixels(spark, ["111", "121", "111"]), "v", 2).collect()}
    assert set(out.values()) == {1}


def test_holes(spark):
    out = {(r.x, r.y): r.v for r in grid.fill_holes(pixels(spark, ["3333", "3003", "3333", "0333"]), "v", 3).collect()}
    assert out[1, 1] == 3 and out[0, 3] == 0


def frame(spark, rows):
    return spark.createDataFrame(rows, "box_id long, image_id long, label string, x1 long, y1 long, x2 long, y2 long, score double")


def test_suppression_is_idempotent_and_separate(spark):
    rows = [(i, i % 2, "a", 3 * i, 0, 3 * i + 20, 20 + i, i / 50) for i in range(40)]
    once = boxes.score_nms(frame(spark, rows), 0.0, 0.45)
    kept = once.collect()
    assert {r.box_id for r in boxes.score_nms(once, -1.0, 0.45).collect()} == {r.box_id for r in kept}
    for a, b in itertools.combinations(kept, 2):
        if a.image_id == b.image_id:
            w, h = max(0, min(a.x2, b.x2) - max(a.x1, b.x1)), max(0, min(a.y2, b.y2) - max(a.y1, b.y1))
            union = (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - w * h
            assert w * h / union <= 0.45


def test_greedy_match_uses_each_box_once(spark):
    pred = frame(spark, [(1, 1, "a", 0, 0, 10, 10, 0.9), (2, 1, "a", 0, 0, 10, 11, 0.8), (3, 1, "b", 0, 0, 10, 10, 0.7)])
    gt = frame(spark, [(7, 1, "a", 0, 0, 10, 10, 1.0)])
    got = {r.box_id: r.gt_id for r in boxes.greedy_match(pred, gt, 0.5).collect()}
    assert got == {1: 7, 2: None, 3: None}


def test_interpolated_precision_of_perfect_and_empty(spark):
    flags = spark.createDataFrame([("p", 1, True), ("p", 2, True), ("q", 1, False)], "label string, n int, tp boolean")
    totals = spark.createDataFrame([("p", 2), ("q", 1)], "label string, n_gt int")
    ap = {r.label: r.ap for r in boxes.interpolated_precision(flags, totals, ["label"], [F.col("n")]).collect()}
    assert ap["p"] == pytest.approx(0.995, abs=0.01) and ap["q"] == pytest.approx(0.0, abs=0.01)


def test_reflectance_round_trip(spark):
    df = spark.range(50, 3000, 50).withColumn("v", F.col("id").cast("double"))
    out = df.select("v", px.rgb_to_reflectance(px.reflectance_to_rgb(F.col("v"))).alias("b")).collect()
    assert all(abs(r.v - r.b) < 40 for r in out)


def test_gauss_kruger_known_points(spark):
    # On the central meridian at the equator, and the length of a meridian quarter degree by the series itself.
    df = spark.createDataFrame([(500000.0, 0.0), (500000.0, 3320113.0)], "e double, n double")
    lon, lat = px.gauss_kruger_inverse(F.col("e"), F.col("n"))
    a, b = df.select(lon.alias("lon"), lat.alias("lat")).collect()
    assert (a.lon, a.lat) == (96.0, 0.0)
    assert b.lon == 96.0 and abs(b.lat - 30.0) < 1e-3


def test_failed_batches_are_reported(spark):
    def scorer(part):
        if (part["id"] > 3).any():
            raise ValueError("no answer")
        return part["id"] * 2

    out = {r.id: (r.result, r.error) for r in curate.score_batches(spark.range(6).coalesce(1), scorer, batch=2, retries=1).collect()}
    assert out[0] == ("0", None) and out[5][0] is None and "no answer" in out[5][1]


@pytest.mark.parametrize("rule", curate.SPLIT_RULES)
@pytest.mark.parametrize("n", [3, 7, 10, 100])
def test_split_rules_add_up(rule, n):
    assert sum(curate.SPLIT_RULES[rule](n)) == n


def test_preprocess_empty(spark):
    empty = spark.createDataFrame([], "lon double, lat double, band_2 double, band_3 double")
    assert cleaning.preprocess(empty).count() == 0


def test_simplify_and_validity(spark):
    from gridloom.operators import shapes

    line = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0], [0.0, 0.01, 0.0, 5.0])], "fid long, xs array<double>, ys array<double>")
    assert [list(r.xs) for r in shapes.simplify(line, "fid", 0.5).collect()] == [[0.0, 2.0, 3.0]]
    square, bow = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], [(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)]
    rows = [(k, i, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for k, ring in ((1, square), (2, bow), (3, square[:-1])) for i, (a, b) in enumerate(itertools.pairwise(ring))]
    edges = spark.createDataFrame(rows, "fid long, no int, x1 double, y1 double, x2 double, y2 double")
    assert {r.fid for r in shapes.invalid_rings(edges, "fid").collect()} == {2, 3}


def test_sources(spark, tmp_path):
    from gridloom.sources import tables

    (tmp_path / "a.csv").write_bytes("lon,name\n1,水深\n".encode())
    (tmp_path / "b.csv").write_bytes("lon,name\n2,水深\n".encode("gbk"))
    (tmp_path / "c.csv").write_bytes(b"lon,name\n3,\xff\xff\xff\n")
    out, rejects = tables.read_table(spark, str(tmp_path))
    assert {(r.lon, r.name) for r in out.collect()} == {(1, "水深"), (2, "水深")} and rejects.count() == 1
    voc = "<annotation><size><width>9</width><height>8</height></size><object><name>x</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>5</xmax><ymax>4</ymax></bndbox></object><object><name>y</name><bndbox><xmin>5</xmin><ymin>1</ymin><xmax>5</xmax><ymax>4</ymax></bndbox></object></annotation>"
    assert [r.label for r in tables.boxes_from_voc(spark.createDataFrame([(voc,)], "t string"), "t").collect()] == ["x"]
    shape = '{"shapes":[{"label":"road","shape_type":"polygon","points":[[0,0],[1,1]]},{"label":"road","shape_type":"line","points":[]}]}'
    assert [r.class_id for r in tables.features_from_labelme(spark.createDataFrame([(shape,)], "t string"), "t", {"road": 2}).collect()] == [2]


def test_sinks_and_readers_round_trip(spark, tmp_path):
    from gridloom.sources import tables

    rows = spark.createDataFrame([(1, 2.0, "a"), (2, 1.123456789, "b")], "id int, v double, mask string")
    tables.write_csv(rows.select("mask", "id", "v"), f"{tmp_path}/csv", 4, last="mask")
    back = spark.read.csv(f"{tmp_path}/csv", header=True)
    assert back.columns == ["id", "v", "mask"] and {tuple(r) for r in back.collect()} == {("1", "2.0000", "a"), ("2", "1.1235", "b")}
    tables.write_stats(rows, f"{tmp_path}/stats")
    assert tables.read_json(spark, f"{tmp_path}/stats").count() == 2
    (tmp_path / "lines.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "array.json").write_text(json.dumps([{"a": 3}, {"a": 4}, {"a": 5}]))
    assert tables.read_json(spark, f"{tmp_path}/lines.jsonl").count() == 2 and tables.read_json(spark, f"{tmp_path}/array.json", lines=False).count() == 3
    (tmp_path / "docs/deep").mkdir(parents=True)
    (tmp_path / "docs/a.md").write_text("# one\nline")
    (tmp_path / "docs/deep/b.md").write_text("二")
    (tmp_path / "docs/c.txt").write_text("no")
    assert {r.text for r in tables.read_documents(spark, [f"{tmp_path}/docs"]).collect()} == {"# one\nline", "二"}
    with pytest.raises(ValueError, match="no documents"):
        tables.read_documents(spark, [f"{tmp_path}/docs"], "*.rst")
    tables.write_coco(rows.select("id"), rows.select("id", "v"), rows.select("mask"), f"{tmp_path}/coco")
    assert [spark.read.json(f"{tmp_path}/coco/{n}").count() for n in ("images", "annotations", "categories")] == [2, 2, 2]
    pixels = rows.select(*(F.lit(1.0).alias(c) for c in tables.ORDINARY_COLUMNS))
    pixels.write.parquet(f"{tmp_path}/pixels")
    assert tables.read_pixels(spark, f"{tmp_path}/pixels").count() == 2
    with pytest.raises(ValueError, match="missing columns: longitude"):
        tables.read_pixels(spark, _without(pixels, tmp_path))
    with pytest.raises(ValueError, match="unknown format"):
        tables.write_features(rows, f"{tmp_path}/x", "id", "shp")


def _without(pixels, tmp_path):
    pixels.drop("longitude").write.parquet(f"{tmp_path}/less")
    return f"{tmp_path}/less"


def test_feature_collections_are_json(spark, tmp_path):
    from gridloom.sources import tables

    df = spark.createDataFrame([(i, '{"type":"MultiPoint","coordinates":[[1,2.5],[-3e1,4]]}', {"k": str(i)}) for i in range(5)], "id int, geometry string, properties map<string,string>").repartition(3)
    tables.write_features(df, f"{tmp_path}/g", "id", "geojson")
    files = [json.loads(p.read_text()) for p in (tmp_path / "g").glob("part-*")]
    assert all(f["type"] == "FeatureCollection" for f in files) and sorted(x["properties"]["k"] for f in files for x in f["features"]) == list("01234")
    tables.write_features(df, f"{tmp_path}/c", "id", "csv")
    assert spark.read.csv(f"{tmp_path}/c", header=True).select("geometry_wkt").distinct().collect()[0][0] == "MULTIPOINT (1 2.5, -30.0 4)"


def test_recursive_chunks(spark):
    from gridloom.operators import retrieve

    texts = ["one two three", "p1 word word\n\np2 word\n\n" + "long " * 30, "".join(chr(97 + i % 26) for i in range(95)), "".join(f"{chr(97 + i % 26)}。" for i in range(40)), "", "   ", None, "\n".join(f"line {i:02d} words" for i in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in sorted(retrieve.recursive_chunks(df, "id", "text", 40, 10).collect(), key=lambda r: (r.id, r.chunk_no)):
        got.setdefault(r.id, []).append(r.chunk)
    assert got[0] == ["one two three"] and got[1][0] == "p1 word word\n\np2 word" and got[2][0] == texts[2][:40]
    assert set(got) == {0, 1, 2, 3, 7} and all(0 < len(c) <= 40 for cs in got.values() for c in cs)
    for i, cs in got.items():
        at = 0
        for c in cs:  # chunks follow each other in the text and leave out white space alone
            found = texts[i].find(c, max(0, at - 12))
            assert found >= 0 and not texts[i][at:found].strip()
            at = max(at, found + len(c))
        assert not texts[i][at:].strip()
    assert got[7][:2] == ["line 00 words\nline 01 words", "line 02 words\nline 03 words"]


def test_failed_vectors_keep_their_old_values(spark):
    from gridloom.operators import retrieve

    def embed(part):
        if (part["id"] == 3).any():
            raise ValueError("down")
        return "[" + part["id"].astype(str) + "]"

    store = spark.createDataFrame([(1, [9.0]), (3, [9.0])], "id int, vector array<double>")
    out, failed = retrieve.upsert_vectors(store, spark.createDataFrame([(1,), (2,), (3,)], "id int").coalesce(1), "id", embed, batch=1, retries=1)
    assert {r.id: list(r.vector) for r in out.collect()} == {1: [1.0], 2: [2.0], 3: [9.0]}
    assert [(r.id, "down" in r.error) for r in failed.collect()] == [(3, True)]


def test_new_snapshot_is_read(spark, tmp_path):
    from gridloom.streaming import files

    for n, rows in enumerate([[(1, 5), (2, 5)], [(1, 7)]]):
        spark.createDataFrame(rows, "k int, at int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = files.read_drops(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
        files.upsert_latest(stream, ["k"], "at", f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    assert {tuple(r) for r in files.newest(spark, f"{tmp_path}/out").select("k", "at").collect()} == {(1, 7), (2, 5)}


def brute_iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def some_boxes(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rnd.randint(0, 60), rnd.randint(0, 60)
        out.append((i, i % 2, "ab"[rnd.random() < 0.5], x, y, x + rnd.randint(5, 40), y + rnd.randint(5, 40), rnd.randint(0, 99) / 100))
    return out


def test_area_suppression_and_greedy_confusion_by_brute_force(spark):
    pred, gt = some_boxes(1, 60), some_boxes(2, 50)
    kept = []
    for p in sorted(pred, key=lambda p: (-(p[5] - p[3]) * (p[6] - p[4]), p[0])):
        if all(q[1:3] != p[1:3] or brute_iou(p[3:7], q[3:7]) < 0.5 for q in kept):
            kept.append(p)
    assert {r.box_id for r in boxes.area_nms(frame(spark, pred)).collect()} == {p[0] for p in kept}
    want = Counter()
    for image in (0, 1):
        pairs = sorted(((brute_iou(p[3:7], g[3:7]), p[0], g[0], p, g) for p in pred for g in gt if p[1] == g[1] == image), key=lambda x: (-x[0], -x[1], -x[2]))
        used_p, used_g = set(), set()
        for iou, i, j, p, g in pairs:
            if iou >= 0.3 and i not in used_p and j not in used_g:
                used_p.add(i)
                used_g.add(j)
                want[g[2], p[2]] += 1
        want.update(("background", p[2]) for p in pred if p[1] == image and p[0] not in used_p)
        want.update((g[2], "background") for g in gt if g[1] == image and g[0] not in used_g)
    assert {(r.gt_label, r.pred_label): r.n for r in boxes.greedy_confusion(frame(spark, pred), frame(spark, gt), 0.3).collect()} == want


def test_anchors_cover_their_boxes(spark):
    rows = [(i, 0, "a", 0, 0, w, h, 1.0) for i, (w, h) in enumerate([(10, 10), (11, 9), (100, 20), (98, 22), (40, 90), (41, 92)] * 5)]
    sizes = boxes.anchors(frame(spark, rows), 3)
    assert [tuple(round(x, 6) for x in s) for s in sizes] == [(10.5, 9.5), (99.0, 21.0), (40.5, 91.0)] and boxes.best_possible_recall(frame(spark, rows), sizes).first().bpr == 1.0


def test_instance_changes_and_rejections_do_something(spark):
    from gridloom.plans import grid as plans
    from gridloom.plans.fixtures import view

    pixels, regions = (view(spark, "/root/testdata/sf0.001", n) for n in ("pixels", "regions"))
    assert plans.m05_instance_changes(pixels).filter("changed").count() > 0
    before = pixels.filter("gt_class > 0").count()
    assert 0 < before - plans.m10_remove_rejected(pixels, regions).filter("v > 0").count() < before


@pytest.mark.parametrize("seed", range(4))
def test_assignment_is_optimal(seed):
    import numpy as np

    from gridloom.operators import assign

    rng = np.random.default_rng(seed)
    gain = rng.random((rng.integers(1, 6), rng.integers(1, 6))) * (rng.random((1, 1)) < 2)
    got = assign.assignment(gain)
    wide = gain if gain.shape[0] <= gain.shape[1] else gain.T
    best = max(sum(wide[i, j] for i, j in enumerate(way)) for way in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
    assert len(got) == min(gain.shape) and len({a for a, _ in got}) == len({b for _, b in got}) == len(got) and abs(sum(gain[i, j] for i, j in got) - best) < 1e-9


def test_association_of_detections_and_tracks(spark):
    from gridloom.operators import assign

    pairs = spark.createDataFrame([(1, 10, 0.9), (2, 10, 0.8), (2, 11, 0.7), (3, 12, 0.4)], "a long, b long, iou double")
    det = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.9), (1, 4, 0.1), (2, 5, 0.1)], "image_id long, box_id long, score double")
    trk = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (3, 13)], "image_id long, box_id long")
    out = {k: sorted(map(tuple, v.collect())) for k, v in assign.associate(pairs, det, trk, 0.5, 0.5, 0.5).items()}
    assert out["matched"] == [(1, 10, 0.9), (2, 11, 0.7)] and len(out["over"]) == 3
    assert [r[:2] for r in out["new"]] == [(1, 3), (2, 5)] and out["unmatched"] == [(1, 12)]
    counts = assign.presence_counts(pairs, det, trk, spark.createDataFrame([(1,), (2,), (3,), (4,)], "image_id long"), 0.5)
    row = assign.presence_scores(counts).first()
    assert (row.il_tp, row.il_tn, row.il_fp, row.il_fn, row.tp, row.fp, row.fn) == (1, 2, 0, 1, 2, 1, 2)


def brute_area_scores(pred, gt, area, t, most):
    """{label: (ap, recall)} by the rule's own loops over images."""
    from gridloom.operators.area_scores import AREAS

    lo, hi = AREAS[area]
    size = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    out = {}
    for label in {g["label"] for g in gt}:
        rows, n_gt = [], sum(g["label"] == label and lo <= size(g) <= hi for g in gt)
        for image in sorted({b["image_id"] for b in pred + gt}):
            mine = lambda bs: [b for b in bs if (b["label"], b["image_id"]) == (label, image)]
            truth = sorted(mine(gt), key=lambda g: (not lo <= size(g) <= hi, g["box_id"]))
            used = set()
            for d in sorted(mine(pred), key=lambda d: (-d["score"], d["box_id"]))[:most]:
                best, at = t, None
                for g in truth:
                    ignored = not lo <= size(g) <= hi
                    if g["box_id"] in used:
                        continue
                    if at and lo <= size(at) <= hi and ignored:
                        break
                    iou = brute_iou([d[k] for k in ("x1", "y1", "x2", "y2")], [g[k] for k in ("x1", "y1", "x2", "y2")])
                    if iou >= best:
                        best, at = iou, g
                if at:
                    used.add(at["box_id"])
                if lo <= size(at or d) <= hi:
                    rows.append((-d["score"], image, d["box_id"], at is not None))
        if not n_gt:
            continue
        tp, curve = 0, []
        for n, row in enumerate(sorted(rows), 1):
            tp += row[3]
            curve.append((tp, tp / n))
        ap = sum(max([p for hit, p in curve if hit * 100 >= k * n_gt], default=0.0) for k in range(101)) / 101
        out[label] = (ap, tp / n_gt)
    return out


def test_area_scores_by_brute_force(spark):
    from gridloom.operators import area_scores as op

    rng = random.Random(5)
    gt, pred = [], []
    for i in range(150):
        x, y, w, h = rng.randrange(300), rng.randrange(300), rng.choice([12, 30, 34, 60, 97, 130]), rng.choice([12, 30, 34, 60, 97, 130])
        gt.append({"image_id": i % 4, "label": "abc"[i % 3], "box_id": i, "x1": x, "y1": y, "x2": x + w, "y2": y + h})
        for k in range(rng.randrange(4)):
            b = [x + rng.randrange(-3, 4), y + rng.randrange(-3, 4), x + w + rng.randrange(-3, 4), y + h + rng.randrange(-3, 4)]
            pred.append({"image_id": i % 4, "label": "abc"[i % 3] if rng.random() < 0.9 else "d", "box_id": 10 * i + k, "score": rng.randrange(20) / 20, **dict(zip(("x1", "y1", "x2", "y2"), b))})
    kinds = "image_id long, label string, box_id long, x1 int, y1 int, x2 int, y2 int"
    frames = spark.createDataFrame([tuple(b[c] for c in ("image_id", "label", "box_id", "x1", "y1", "x2", "y2", "score")) for b in pred] + [(0, "a", None, 1, 1, 5, 5, 0.9)], kinds + ", score double"), spark.createDataFrame([tuple(b.values()) for b in gt], kinds)
    scores = op.area_scores(*frames)
    got = {(r.label, r.area, r.thr): r for r in scores.collect()}
    for area in op.AREAS:
        for t in (0.5, 0.75, 0.9):
            want = {m: brute_area_scores(pred, gt, area, t, m) for m in op.MOST}
            assert {k[0] for k in got if k[1:] == (area, t)} == set(want[100])
            for label, (ap, recall) in want[100].items():
                row = got[label, area, t]
                assert abs(row.ap - ap) < 1e-9 and abs(row.recall_100 - recall) < 1e-9
                # fewer detections take the same matches
                assert row.recall_1 <= row.recall_10 <= row.recall_100 and abs(row.recall_1 - want[1][label][1]) < 1e-9
    summary = {r.metric: r.value for r in op.area_summary(scores).collect()}
    assert abs(summary["AP"] - sum(r.ap for k, r in got.items() if k[1] == "all") / sum(k[1] == "all" for k in got)) < 1e-9
    none = op.area_summary(op.area_scores(frames[0], frames[1].limit(0)))
    assert {r.value for r in none.collect()} == {-1.0} and len(summary) == 12


def test_blocked_search_is_exact(spark):
    from gridloom.operators import retrieve

    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 8))
    rows = [(i, (middles[i % 12] + 0.05 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(5)] + [(2000, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "prompt_id")
    known = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v]
    want = set()
    for i, x in known:
        if i % 20 == 0:
            best = sorted((-round(float(x @ y), 9), j) for j, y in known)[:4]
            want |= {(i, j, r) for r, (_, j) in enumerate(best, 1)}
    for sizes in ({}, {"centres": 9, "block": 10, "chunk": 7}, {"centres": 1}):
        assert {(r.query_id, r.vec_id, r.rank) for r in retrieve.vector_top_k(vectors, queries, **sizes).collect()} == want
    assert retrieve.vector_top_k(vectors.limit(0), queries).count() == 0
    # clusters far from a query are not searched
    middle = np.stack([known[i][1] for i in range(12)])
    reached = next(retrieve._reached(middle, np.full(12, 0.1), 1)(iter([__import__("pandas").DataFrame({"query_id": [0], "q": [known[12][1]], "h": [0], "within": [0.2]})])))
    assert 1 <= len(reached) < 12
