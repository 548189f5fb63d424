"""Polygon overlay against exact sums on lattices, point sampling and inclusion-exclusion."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import overlay

SCHEMA = "fid long, kind string, rings array<array<struct<x: double, y: double>>>"


def inside(x, y, rings):
    """Even-odd rule, of a point or of arrays of points."""
    x, y = np.asarray(x), np.asarray(y)
    hits = np.zeros(x.shape, dtype=int)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if ay != by:
                hits += ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return hits % 2 == 1


def star(rnd, cx, cy, r, n):
    """A simple polygon, mostly concave."""
    turns = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + rnd.uniform(0.3, 1) * r * math.cos(t), cy + rnd.uniform(0.3, 1) * r * math.sin(t)) for t in turns]


def box(x1, y1, x2, y2):
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]


def shapes(seed, n):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        x, y, r = rnd.uniform(-10, 20), rnd.uniform(-10, 20), rnd.uniform(2, 9)
        rings = [star(rnd, x, y, r, rnd.randint(3, 12))]
        if rnd.random() < 0.5:
            rings.append(star(rnd, x, y, r / 4, 5))
        out.append(rings)
    return out


def by_sampling(test, lo=-22.0, hi=32.0, n=900):
    """Area where the test holds, on a lattice of points."""
    at = lo + (np.arange(n) + 0.5) * (hi - lo) / n
    return float(test(*np.meshgrid(at, at)).mean()) * (hi - lo) ** 2


def any_of(x, y, polygons):
    return np.logical_or.reduce([inside(x, y, q) for q in polygons])


def as_rings(rings):
    return [[(p["x"], p["y"]) for p in r] for r in rings]


def size(rings):
    return sum(overlay.ring_size(r) for r in rings)


@pytest.mark.parametrize("cell", [100.0, 7.0])
def test_clip_and_erase_any_shape(spark, cell):
    targets, masks = shapes(1, 6), shapes(2, 6)
    t = spark.createDataFrame([(i, f"k{i}", r) for i, r in enumerate(targets)] + [(90, "none", [box(500.0, 500.0, 501.0, 502.0)]), (91, "null", None), (92, "empty", []), (93, "flat", [[(0.0, 0.0), (5.0, 0.0)]])], SCHEMA)
    m = spark.createDataFrame([(i, "m", r) for i, r in enumerate(masks)], SCHEMA)
    clipped = {r.fid: r for r in overlay.clip(t, m, cell).collect()}
    erased = {r.fid: r for r in overlay.erase(t, m, cell).collect()}
    for i, rings in enumerate(targets):
        whole = by_sampling(lambda x, y, rings=rings: inside(x, y, rings))
        both = clipped[i].area if i in clipped else 0.0
        rest = erased[i].area if i in erased else 0.0
        want = by_sampling(lambda x, y, rings=rings: inside(x, y, rings) & any_of(x, y, masks))
        assert abs(both - want) < 0.3 and abs(both + rest - whole) < 0.3
        for r in (clipped.get(i), erased.get(i)):
            if r:
                assert r.kind == f"k{i}" and math.isclose(size(as_rings(r.rings)), r.area, rel_tol=1e-6, abs_tol=1e-6)
    # rings enclose what they should
    rnd = random.Random(3)
    for _ in range(1500):
        i, x, y = rnd.randrange(6), rnd.uniform(-15, 25), rnd.uniform(-15, 25)
        a, b = inside(x, y, targets[i]), any(inside(x, y, q) for q in masks)
        assert (i in clipped and inside(x, y, as_rings(clipped[i].rings))) == (a and b)
        assert (i in erased and inside(x, y, as_rings(erased[i].rings))) == (a and not b)
    assert erased[90].area == 2 and 90 not in clipped and not {91, 92, 93} & {*erased, *clipped}


def test_cells_do_not_change_results(spark):
    targets, masks = shapes(5, 5), shapes(6, 5)
    t, m = (spark.createDataFrame([(i, "k", r) for i, r in enumerate(x)], SCHEMA) for x in (targets, masks))
    found = [{r.fid: (r.area, sorted(round(overlay.ring_size(x), 6) for x in as_rings(r.rings))) for r in overlay.erase(t, m, cell).collect()} for cell in (200.0, 11.0, 3.3)]
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        for i, (area, rings) in other.items():
            assert math.isclose(area, found[0][i][0], rel_tol=1e-9) and np.allclose(rings, found[0][i][1], atol=1e-5)


def test_shared_edges_holes_and_corners(spark):
    t = spark.createDataFrame([(1, "a", [box(0.0, 0.0, 10.0, 10.0), box(4.0, 4.0, 6.0, 6.0)]), (2, "b", [box(10.0, 0.0, 20.0, 10.0)]), (3, "c", [[(0.0, 20.0), (5.0, 25.0), (0.0, 30.0), (-5.0, 25.0)]])], SCHEMA)
    m = spark.createDataFrame([(1, "m", [box(0.0, 0.0, 5.0, 10.0)]), (2, "m", [box(5.0, 0.0, 10.0, 10.0)]), (3, "m", [box(0.0, 20.0, 5.0, 30.0)])], SCHEMA)
    for cell in (64.0, 5.0, 4.0):
        clipped = {r.fid: r for r in overlay.clip(t, m, cell).collect()}
        assert {i: r.area for i, r in clipped.items()} == {1: 96.0, 3: 25.0}
        assert sorted(len(r) for r in clipped[1].rings) == [4, 4] and sorted(overlay.ring_size(r) for r in as_rings(clipped[1].rings)) == [-4.0, 100.0]
        assert [sorted(r) for r in as_rings(clipped[3].rings)] == [[(0.0, 20.0), (0.0, 30.0), (5.0, 25.0)]]
        erased = {r.fid: r.area for r in overlay.erase(t, m, cell).collect()}
        assert erased == {2: 100.0, 3: 25.0}


def test_dissolve_is_inclusion_exclusion(spark):
    polygons = shapes(8, 4)
    df = spark.createDataFrame([(i, "ab"[i % 2] if i < 4 else None, r) for i, r in enumerate(polygons)], SCHEMA)
    one = lambda group: overlay.sweep(*stacked(group), "union", (-60.0, -60.0, 60.0, 60.0))[0]
    got = {r.kind: r.area for r in overlay.dissolve(df, ["kind"], 6.0).collect()}
    for k in "ab":
        group = [r for i, r in enumerate(polygons) if "ab"[i % 2] == k]
        both = overlay.clip(df.filter(f"fid = {'ab'.index(k)}"), df.filter(f"fid = {'ab'.index(k) + 2}"), 9.0).collect()
        want = sum(one([r]) for r in group) - sum(r.area for r in both)
        assert math.isclose(got[k], want, rel_tol=1e-9)
    rings = overlay.dissolved_rings(df, ["kind"], 6.0).collect()
    for k in "ab":
        assert math.isclose(sum(size(as_rings(r.rings)) for r in rings if r.kind == k), got[k], rel_tol=1e-6)


def stacked(group):
    rows, poly = [], []
    for i, rings in enumerate(group):
        for ring in rings:
            for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
                lo, hi = sorted((a, b), key=lambda p: p[1])
                if lo[1] < hi[1]:
                    rows.append((*lo, *hi))
                    poly.append(i)
    return np.array(rows), np.array(poly), np.zeros(len(rows), dtype=bool)


def test_one_key_is_split_over_cells(spark):
    df = spark.range(400).selectExpr("id fid", "'one' kind", "(id % 20) * 1.0D x", "floor(id / 20) * 1.0D y")
    ring = F.array(*(F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in ((0, 0), (1.5, 0), (1.5, 1.5), (0, 1.5))))
    df = df.select("fid", "kind", F.array(ring).alias("rings"))
    dealt = overlay.in_cells(df, ["kind"], 4.0)
    assert dealt.groupBy("cx", "cy").count().agg(F.max("count")).first()[0] < 60
    assert [tuple(r) for r in overlay.dissolve(df, ["kind"], 4.0).collect()] == [("one", 20.5**2)]
    outline = overlay.dissolved_rings(df, ["kind"], 4.0).collect()
    assert [sorted(as_rings(r.rings)[0]) for r in outline] == [[(0.0, 0.0), (0.0, 20.5), (20.5, 0.0), (20.5, 20.5)]]


def distance(x, y, line):
    best = np.full(x.shape, math.inf)
    for (ax, ay), (bx, by) in itertools.pairwise(line):
        t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0, 1)
        best = np.minimum(best, np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    return best


def test_buffers_by_distance_sampling(spark):
    line, ring = [(0.0, 0.0), (6.0, 2.0), (5.0, 8.0), (9.0, 9.0)], star(random.Random(4), 3, 3, 6, 7)
    rows = [(1, "LineString", [line]), (2, "Polygon", [ring]), (3, "Point", [[(2.0, 2.0)]])]
    df = spark.createDataFrame(rows, "fid long, type string, rings array<array<struct<x: double, y: double>>>")
    pieces = overlay.buffered(df, F.lit(1.5), 16)
    near = {1: lambda x, y: distance(x, y, line) <= 1.5, 2: lambda x, y: inside(x, y, [ring]) | (distance(x, y, [*ring, ring[0]]) <= 1.5), 3: lambda x, y: np.hypot(x - 2, y - 2) <= 1.5}
    got = {r.fid: r.area for r in overlay.dissolve(pieces, ["fid"], 5.0).collect()}
    assert math.isclose(got[3], 32 * math.sin(2 * math.pi / 64) * 1.5**2, rel_tol=1e-9)
    for i, test in near.items():
        assert abs(got[i] - by_sampling(test, -6, 14)) < 0.01 * got[i]
    whole = [r.area for r in overlay.dissolve(pieces, [], 5.0).collect()]
    assert abs(whole[0] - by_sampling(lambda x, y: np.logical_or.reduce([f(x, y) for f in near.values()]), -6, 14)) < 0.01 * whole[0]


def test_visibility_past_obstacles(spark):
    from gridloom.operators import vector, visibility

    shapes_ = [(1, "Polygon", [box(2.0, -5.0, 4.0, 5.0)]), (2, "Polygon", [[(6.0, 0.0), (8.0, 3.0), (10.0, 0.0), (8.0, 1.5)]]), (3, "LineString", [[(5.0, 6.0), (5.0, 9.0)]]), (4, "Point", [[(0.0, 3.0)]])]
    df = spark.createDataFrame(shapes_, "fid long, type string, rings array<array<struct<x: double, y: double>>>")
    obstacles = visibility.obstacle_rings(df, 0.5, 0.25, 4.0).cache()
    assert obstacles.count() == 4
    rnd = random.Random(8)
    points = [(0.0, 0.0), (12.0, 0.0), (2.0, 5.0), (4.0, 5.0), (2.0, -5.0), (4.0, -5.0)] + [(rnd.uniform(-3, 13), rnd.uniform(-8, 10)) for _ in range(25)]
    vertices = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "vid long, x double, y double")
    polygons = [as_rings(r.rings) for r in obstacles.collect()]
    t = (np.arange(4000) + 0.5) / 4000

    def blocked(a, b):
        x, y = a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])
        return any(0.002 < inside(x, y, q).mean() < 0.998 for q in polygons)

    for cell in (3.0, 40.0):
        got = {(r.src, r.dst) for r in visibility.visibility_graph(vertices, obstacles, 12.5, cell).collect()}
        for (i, a), (j, b) in itertools.combinations(enumerate(points), 2):
            if math.dist(a, b) <= 12.5 and len({*a} & {*b} & {2.0, 4.0, 5.0, -5.0}) == 0:
                assert ((i, j) in got) == (not blocked(a, b)) and ((j, i) in got) == ((i, j) in got), (a, b)
    # along a side of an obstacle is free, through it is not
    assert {(2, 3), (3, 5), (4, 5)} <= got and (0, 1) not in got
    graph = visibility.visibility_graph(vertices.filter("vid < 6"), obstacles, 30.0, 3.0)
    way = {r.node: r.dist for r in vector.shortest_paths(graph, spark.createDataFrame([(0,)], "node long")).collect()}
    assert math.isclose(way[1], math.dist((0, 0), (2, -5)) + 2 + math.dist((4, -5), (12, 0)), rel_tol=1e-9)
