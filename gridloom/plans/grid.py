"""Plans of neighbourhood and region operators (N, C) and of score maps (M)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..operators import grid as op
from ..operators import scores as sc
from ..operators import shapes
from ..operators import stats
from .registry import plan

C = F.col


def r6(c):
    return F.bround(c, 6)


BIN = "SELECT x, y, CASE WHEN gt_class IN (1, 2) THEN 1 ELSE 0 END AS v FROM pixels"


def binary(p: DataFrame) -> DataFrame:
    return p.select("x", "y", F.when(C("gt_class").isin(1, 2), 1).otherwise(0).alias("v"))


def near(agg: str, k: int = 1, src: str = BIN, col: str = "v") -> str:
    return f"(SELECT a.x, a.y, {agg} AS {col} FROM ({src}) a JOIN ({src}) b ON b.x BETWEEN a.x - {k} AND a.x + {k} AND b.y BETWEEN a.y - {k} AND a.y + {k} GROUP BY a.x, a.y)"


EXT = "SELECT scene_id, CAST(cloud_pct * 5 + 1 AS INT) AS w, CAST(scene_id % 300 + 1 AS INT) AS h FROM scenes"


def extents(s: DataFrame) -> DataFrame:
    return s.select("scene_id", (C("cloud_pct") * 5 + 1).cast("int").alias("w"), (C("scene_id") % 300 + 1).cast("int").alias("h"))


@plan("scenes", f"SELECT scene_id, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0 FROM (SELECT *, unnest(range(0, h - 64 + 1, 50)) AS y0 FROM (SELECT *, unnest(range(0, w - 64 + 1, 50)) AS x0 FROM ({EXT})))")
def n01_sliding_windows(s: DataFrame) -> DataFrame:
    return op.windows(extents(s), 64, 50).select("scene_id", "x0", "y0")


@plan("scenes", f"SELECT scene_id, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0 FROM (SELECT *, unnest(range(0, h, 100)) AS y0 FROM (SELECT *, unnest(range(0, w, 100)) AS x0 FROM ({EXT})))")
def n02_padded_tiles(s: DataFrame) -> DataFrame:
    return op.tiles(extents(s), 128, 100).select("scene_id", "x0", "y0")


@plan("scenes", f"SELECT DISTINCT scene_id, CAST(greatest(least(x0, w - 128), 0) AS INT) AS x0, CAST(greatest(least(y0, h - 128), 0) AS INT) AS y0 FROM (SELECT *, unnest(range(0, h, 128)) AS y0 FROM (SELECT *, unnest(range(0, w, 128)) AS x0 FROM ({EXT})))")
def n03_edge_aligned_tiles(s: DataFrame) -> DataFrame:
    return op.tiles(extents(s), 128, 128, "square").select("scene_id", "x0", "y0")


@plan("pixels", "SELECT x, y, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0 FROM pixels CROSS JOIN (SELECT unnest(range(0, 100 - 40 + 1, 30)) AS x0) CROSS JOIN (SELECT unnest(range(0, (SELECT CAST(max(y) AS BIGINT) FROM pixels) + 1 - 40 + 1, 30)) AS y0) WHERE x >= x0 AND x < x0 + 40 AND y >= y0 AND y < y0 + 40")
def n04_covering_tiles(p: DataFrame) -> DataFrame:
    return op.covering_tiles(p.select("x", "y"), 40, 30)


@plan("pixels", "SELECT x // 8 AS tx, y // 8 AS ty, max(gt_class) > 0 AS labelled, count(*) FILTER (gt_class = 3) AS n3, min(gt_class) = max(gt_class) AS single FROM pixels GROUP BY 1, 2")
def n05_tile_presence(p: DataFrame) -> DataFrame:
    return p.groupBy(F.floor(C("x") / 8).cast("int").alias("tx"), F.floor(C("y") / 8).cast("int").alias("ty")).agg((F.max("gt_class") > 0).alias("labelled"), F.count_if(C("gt_class") == 3).alias("n3"), (F.min("gt_class") == F.max("gt_class")).alias("single"))


@plan("pixels", f"SELECT x, y, v FROM {near('max(b.v)')}")
def n06_dilate(p: DataFrame) -> DataFrame:
    return op.dilate(binary(p), "v")


@plan("pixels", f"SELECT x, y, v FROM {near('max(b.v)', src='SELECT x, y, v FROM ' + near('min(b.v)'))}")
def n06_open(p: DataFrame) -> DataFrame:
    return op.opened(binary(p), "v")


@plan("pixels", f"SELECT x, y, v FROM {near('median(b.v)')}")
def n07_median_filter(p: DataFrame) -> DataFrame:
    return op.median_filter(binary(p), "v")


G = op.gaussian_kernel(3, 1.0)


@plan("pixels", f"WITH k AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b}, {w!r}E0)' for a, b, w in G)}) t(dx, dy, w)), p AS ({BIN}) SELECT a.x, a.y, round_even(sum(p.v * w), 6) AS v FROM p a CROSS JOIN k JOIN p ON p.x = a.x - dx AND p.y = a.y - dy GROUP BY 1, 2")
def n08_gaussian(p: DataFrame) -> DataFrame:
    return op.gaussian(binary(p), "v", 3, 1.0).withColumn("v", r6("v"))


SOB = "WITH k AS (SELECT * FROM (VALUES (-1, -1, 1, 1), (-1, 0, 2, 0), (-1, 1, 1, -1), (0, -1, 0, 2), (0, 0, 0, 0), (0, 1, 0, -2), (1, -1, -1, 1), (1, 0, -2, 0), (1, 1, -1, -1)) t(dx, dy, wx, wy))"


@plan("pixels", f"{SOB}, p AS (SELECT x, y, red / 20 AS v FROM pixels) SELECT a.x, a.y, round_even(least(sqrt(pow(sum(p.v * wx), 2) + pow(sum(p.v * wy), 2)), 255.0E0), 6) AS sobel FROM p a CROSS JOIN k JOIN p ON p.x = a.x - dx AND p.y = a.y - dy GROUP BY 1, 2")
def n09_sobel(p: DataFrame) -> DataFrame:
    return op.sobel(p.select("x", "y", (C("red") / 20).alias("v")), "v").withColumn("sobel", r6("sobel"))


@plan("pixels", f"SELECT a.x, a.y, CAST(count(*) FILTER (a.v <> b.v) > 0 AS INT) AS edge FROM ({BIN}) a JOIN ({BIN}) b ON b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 4 GROUP BY 1, 2")
def n10_boundary_band(p: DataFrame) -> DataFrame:
    return op.boundary_band(binary(p), "v", 2)


@plan("pixels", f"SELECT x, y, edge FROM {near('CAST(count(DISTINCT b.v) > 1 AND max(b.v) > 0 AS INT)', src='SELECT x, y, gt_class AS v FROM pixels', col='edge')}")
def n11_class_edges(p: DataFrame) -> DataFrame:
    return op.class_edges(p.select("x", "y", C("gt_class").alias("v")), "v")


#: Labels of components in DuckDB: each pixel takes the least label of a neighbour of its value until none changes.
def parts(source: str, name: str = "k", reach8: bool = True) -> str:
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0) and (reach8 or dx == 0 or dy == 0)]
    moves = ", ".join(f"({dx}, {dy})" for dx, dy in steps)
    return f"""{name}(x, y, v, c) USING KEY (x, y) AS (SELECT x, y, v, CAST(y AS BIGINT) * 2147483648 + x AS c FROM ({source})
  UNION SELECT n.x, n.y, n.v, min(p.c) FROM {name} p CROSS JOIN (VALUES {moves}) s(dx, dy) JOIN recurring.{name} n ON n.x = p.x + s.dx AND n.y = p.y + s.dy AND n.v = p.v AND n.c > p.c GROUP BY n.x, n.y, n.v)"""


GT = "SELECT x, y, gt_class AS v FROM pixels"
RING = "SELECT DISTINCT o.c AS of, n.x, n.y, n.v, n.c FROM {k} o CROSS JOIN (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) s(dx, dy) JOIN {k} n ON n.x = o.x + s.dx AND n.y = o.y + s.dy AND n.c <> o.c"


def replaced(k: str, least: int) -> str:
    return f"""SELECT x, y, coalesce(b.v, {k}.v) AS v FROM {k} LEFT JOIN (SELECT r.of, r.v FROM ({RING.format(k=k)}) r JOIN (SELECT c, any_value(v) AS own FROM {k} GROUP BY c HAVING count(*) < {least}) s ON s.c = r.of AND s.own <> r.v
  GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY r.of ORDER BY count(*) DESC, r.v) = 1) b ON b.of = {k}.c"""


def filled(k: str, most: int) -> str:
    return f"""SELECT x, y, coalesce(b.v, {k}.v) AS v FROM {k} LEFT JOIN (SELECT r.of, min(r.v) AS v FROM ({RING.format(k=k)}) r JOIN (SELECT c FROM {k} WHERE v = 0 GROUP BY c
  HAVING count(*) <= {most} AND min(x) > (SELECT min(x) FROM {k}) AND max(x) < (SELECT max(x) FROM {k}) AND min(y) > (SELECT min(y) FROM {k}) AND max(y) < (SELECT max(y) FROM {k})) h ON h.c = r.of
  WHERE r.v <> 0 GROUP BY r.of HAVING count(DISTINCT r.v) = 1) b ON b.of = {k}.c"""


@plan("pixels", f"WITH RECURSIVE {parts(GT)} SELECT x, y, v, c AS component FROM k")
def c01_components(p: DataFrame) -> DataFrame:
    return op.components(p.select("x", "y", C("gt_class").alias("v")), "v")


@plan("pixels", f"WITH RECURSIVE {parts(GT)} SELECT c AS component, any_value(v) AS v, count(*) AS area, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, round_even(avg(x), 6) AS cx, round_even(avg(y), 6) AS cy FROM k GROUP BY c")
def a18_component_statistics(p: DataFrame) -> DataFrame:
    """Area, bounds and centroid of every connected region."""
    rows = op.components(p.select("x", "y", C("gt_class").alias("v")), "v")
    centre = lambda c: F.bround(F.avg(c), 6)
    return rows.groupBy("component").agg(F.first("v").alias("v"), F.count("*").alias("area"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), centre("x").alias("cx"), centre("y").alias("cy"))


@plan("pixels", f"WITH RECURSIVE {parts(BIN)} SELECT x, y, CASE WHEN count(*) OVER (PARTITION BY c) < 4 THEN 0 ELSE v END AS v FROM k")
def c02_remove_small(p: DataFrame) -> DataFrame:
    return op.remove_small(binary(p), "v", 4)


@plan("pixels", f"WITH RECURSIVE {parts(BIN, reach8=False)} {filled('k', 5)}")
def c03_fill_holes(p: DataFrame) -> DataFrame:
    return op.fill_holes(binary(p), "v", 5)


@plan("pixels", f"WITH RECURSIVE {parts(GT)} {replaced('k', 4)}")
def c04_replace_small(p: DataFrame) -> DataFrame:
    return op.replace_small(p.select("x", "y", C("gt_class").alias("v")), "v", 4)


SMOOTH = "SELECT x, y, v FROM (SELECT a.x, a.y, b.gt_class AS v, count(*) AS n FROM pixels a CROSS JOIN (VALUES (-1), (0), (1)) i(dx) CROSS JOIN (VALUES (-1), (0), (1)) j(dy) JOIN pixels b ON b.x = a.x + dx AND b.y = a.y + dy GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY n DESC, v) = 1"


@plan("pixels", f"WITH RECURSIVE {parts(SMOOTH, 'k1')}, r AS ({replaced('k1', 4)}), {parts('SELECT * FROM r', 'k2', False)} {filled('k2', 5)}")
def c05_clean_map(p: DataFrame) -> DataFrame:
    return op.clean_map(p.select("x", "y", C("gt_class").alias("v")), "v", 3, 4, 5)


@plan("regions", "WITH d AS (SELECT region_id, bx + bw / 2.0E0 - img_w / 2.0E0 AS dx, bv + bh / 2.0E0 - img_h / 2.0E0 AS dy FROM regions) SELECT region_id, CASE WHEN abs(dx) < 51.2 AND abs(dy) < 51.2 THEN 'center' ELSE ['right', 'top-right', 'top', 'top-left', 'left', 'bottom-left', 'bottom', 'bottom-right'][CAST((CAST(round_even(atan2(-dy, dx) / (pi() / 4), 0) AS INT) + 8) % 8 AS INT) + 1] END AS word FROM d")
def c06_location_word(r: DataFrame) -> DataFrame:
    return r.select("region_id", bx.location_word(C("bx"), C("bv"), C("bw"), C("bh"), C("img_w"), C("img_h")).alias("word"))


@plan("regions", "SELECT region_id, round_even((bx + bw / 2.0E0) / img_w, 6) AS cx, round_even(greatest(bw, bh) * 1.0E0 / img_w, 6) AS w, CASE WHEN bw < bh THEN 105.0E0 ELSE 15.0E0 END AS angle FROM regions")
def c07_oriented_box(r: DataFrame) -> DataFrame:
    o = bx.oriented_box(C("bx") + C("bw") / 2.0, C("bv") + C("bh") / 2.0, C("bw"), C("bh"), F.lit(15.0), C("img_w"), C("img_h"))
    return r.select("region_id", o.alias("o")).select("region_id", "o.cx", "o.w", "o.angle")


@plan("regions", "SELECT region_id, greatest(bx - 20, 0) AS x1, least(bx + bw, 400) AS x2 FROM regions WHERE least(bx + bw, 400) - greatest(bx - 20, 0) >= 10")
def c08_crop_box(r: DataFrame) -> DataFrame:
    lo, hi = bx.crop_side(C("bx") - 20, C("bw") + 20, F.lit(400))
    return r.select("region_id", lo.alias("x1"), hi.alias("x2")).filter("x2 - x1 >= 10")


SIDES = "(VALUES (0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)) s(dx, dy, ax, ay, bx, bv)"


@plan("pixels", f"WITH RECURSIVE {parts('SELECT * FROM (' + BIN + ') WHERE v = 1')} SELECT k.c AS component, k.x + ax AS x1, k.y + ay AS y1, k.x + bx AS x2, k.y + bv AS y2 FROM k CROSS JOIN {SIDES} LEFT JOIN k o ON o.x = k.x + dx AND o.y = k.y + dy WHERE o.c IS NULL OR o.c <> k.c")
def c09_boundary_edges(p: DataFrame) -> DataFrame:
    return op.boundary_edges(op.components(binary(p).filter("v = 1"), "v"), [])


@plan("rect_targets", "SELECT fid, fid % 4 AS class_id, CAST(ring AS INT) AS ring, CASE WHEN ring = 0 AND fid % 3 > 0 THEN 5 ELSE 4 END AS n_points, CASE ring WHEN 0 THEN x1 ELSE x1 + 1 END AS first_x, CASE WHEN ring = 1 THEN 3 + sqrt(5.0E0) WHEN fid % 3 > 0 THEN 2 * (x2 - x1 + y2 - y1) ELSE (x2 - x1) + (y2 - y1) + sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) END AS length FROM rect_targets, (SELECT unnest([0, 1]) AS ring) r WHERE ring = 0 OR fid % 2 = 0")
def c11_rings_to_lines(t: DataFrame) -> DataFrame:
    """Boxes and triangles, every second one with a hole; rings are closed where they aren't."""
    at = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    box = F.array(at("x1", "y1"), at("x2", "y1"), at("x2", "y2"), at("x1", "y2"))
    outer = F.when(C("fid") % 3 > 0, F.concat(box, F.slice(box, 1, 1))).otherwise(F.slice(box, 1, 3))
    hole = F.array(at("x1 + 1", "y1 + 1"), at("x1 + 2", "y1 + 1"), at("x1 + 2", "y1 + 3"))
    rings = F.when(C("fid") % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    lines = shapes.rings_to_lines(t.select("fid", (C("fid") % 4).alias("class_id"), rings.alias("rings")))
    p, n = C("line"), F.size("line")
    length = F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(0.0), lambda s, i: s + F.hypot(F.get(p, i + 1)["x"] - F.get(p, i)["x"], F.get(p, i + 1)["y"] - F.get(p, i)["y"]))
    return lines.select("fid", "class_id", "ring", n.alias("n_points"), F.get(p, F.lit(0))["x"].alias("first_x"), length.alias("length"))


@plan("pixels rect_masks", "SELECT p.x, p.y, coalesce(max_by(m.fid, m.fid), 0) AS burnt FROM pixels p LEFT JOIN rect_masks m ON p.x + 0.5 > m.x1 AND p.x + 0.5 < m.x2 AND p.y + 0.5 > m.y1 AND p.y + 0.5 < m.y2 GROUP BY 1, 2")
def c12_rasterise(p: DataFrame, m: DataFrame) -> DataFrame:
    from ..operators.joins import points_in_polygons

    corners = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    shapes = m.withColumn("ring", F.array(*(F.struct(C(a).alias("x"), C(b).alias("y")) for a, b in corners)))
    hits = points_in_polygons(p.select("x", "y", (C("x") + 0.5).alias("px"), (C("y") + 0.5).alias("py")), shapes, 50.0)
    return p.select("x", "y").join(hits.groupBy("x", "y").agg(F.max("fid").alias("burnt")), ["x", "y"], "left").na.fill(0, ["burnt"])


@plan("pixels", "SELECT x, y FROM pixels WHERE x >= 10 AND x < 40 AND y >= 5 AND y < 30")
def c13_crop_by_extent(p: DataFrame) -> DataFrame:
    return p.select("x", "y").filter("x >= int(10.7) and x < int(40.9) and y >= int(5.2) and y < int(30.1)")


@plan("part", "SELECT p_partkey AS no, p_size AS width, CAST(coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM part")
def c14_mosaic_offsets(p: DataFrame) -> DataFrame:
    return op.mosaic_offsets(p.select(C("p_partkey").alias("no"), C("p_size").alias("width")))


@plan("pixels", "SELECT CAST(vx AS INT) AS vx, CAST(vy AS INT) AS vy, variant, CAST(sum(gt_class) AS BIGINT) AS s FROM (SELECT gt_class, unnest(range(8)) AS variant, unnest([x, y, 99 - x, 99 - y, 99 - x, y, x, 99 - y]) AS vx, unnest([y, 99 - x, 99 - y, x, y, x, 99 - y, 99 - x]) AS vy FROM pixels) GROUP BY 1, 2, 3")
def c15_dihedral(p: DataFrame) -> DataFrame:
    return op.dihedral(p.select("x", "y", "gt_class"), 100).groupBy("vx", "vy", C("variant").cast("long").alias("variant")).agg(F.sum("gt_class").alias("s"))


SCORES = "SELECT x, y, CAST(red % 4 AS INT) AS class_id, (green % 100) / 100.0E0 AS score FROM pixels UNION ALL SELECT x, y, CAST(blue % 4 AS INT), (swir2 % 100) / 100.0E0 FROM pixels"


def scores(p: DataFrame) -> DataFrame:
    one = p.select("x", "y", (C("red") % 4).cast("int").alias("class_id"), ((C("green") % 100) / 100).alias("score"))
    return one.union(p.select("x", "y", (C("blue") % 4).cast("int"), (C("swir2") % 100) / 100))


@plan("pixels", f"SELECT g.x, g.y, CAST(g.k AS INT) AS class_id, coalesce(s.score, 0.0E0) AS score FROM (SELECT x, y, unnest(range(5)) AS k FROM pixels) g LEFT JOIN (SELECT x, y, class_id, max(score) AS score FROM ({SCORES}) GROUP BY 1, 2, 3) s ON s.x = g.x AND s.y = g.y AND s.class_id = g.k")
def m01_class_scores(p: DataFrame) -> DataFrame:
    return sc.class_scores(scores(p), p.sparkSession.range(5).select(C("id").cast("int").alias("class_id")))


@plan("pixels", f"SELECT x, y, CASE WHEN score < 0.3 THEN 0 ELSE class_id END AS class_id, score FROM ({SCORES}) QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY score DESC, class_id) = 1")
def m02_discrete(p: DataFrame) -> DataFrame:
    return sc.discrete(scores(p), 0.3)


OTSU = """WITH b AS (SELECT scene, min(red) AS lo, max(red) AS hi FROM pixels GROUP BY 1), h AS (SELECT scene, least(floor((red - lo) / (hi - lo) * 256), 255) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM pixels JOIN b USING (scene) GROUP BY 1, 2),
m AS (SELECT scene, bin, n, lo + (bin + 0.5) * (hi - lo) / 256 AS mid FROM h), c AS (SELECT *, sum(n) OVER w AS n0, sum(n * mid) OVER w AS s0, sum(n) OVER (PARTITION BY scene) AS nt, sum(n * mid) OVER (PARTITION BY scene) AS st FROM m WINDOW w AS (PARTITION BY scene ORDER BY bin))
SELECT scene, round_even(mid, 4) AS threshold FROM c WHERE nt > n0 QUALIFY row_number() OVER (PARTITION BY scene ORDER BY round_even(n0 * (nt - n0) * pow(s0 / n0 - (st - s0) / (nt - n0), 2), 3) DESC, bin) = 1"""


ENERGY = "SELECT x, y, gt_class AS class_id, greatest((red % 100) / 100.0E0, (green % 100) / 100.0E0) * abs((green % 100) / 100.0E0 - (red % 100) / 100.0E0) * ((blue % 100) / 100.0E0) AS energy FROM pixels"
LIMITS = OTSU.replace("pixels", "e").replace("red", "energy").replace("scene", "class_id").replace("round_even(mid, 4)", "mid")


@plan("pixels", f"WITH e AS ({ENERGY}), t AS ({LIMITS}) SELECT x, y, max(class_id) AS class_id FROM e JOIN t USING (class_id) WHERE energy > greatest(threshold, 0.01E0) GROUP BY 1, 2")
def m03_change_energy(p: DataFrame) -> DataFrame:
    rows = p.select("x", "y", "gt_class", ((C("red") % 100) / 100).alias("s1"), ((C("green") % 100) / 100).alias("s2"), ((C("blue") % 100) / 100).alias("feature"))
    return sc.change_energy(rows.withColumnRenamed("gt_class", "class_id"))


@plan("pixels", OTSU)
def m04_otsu(p: DataFrame) -> DataFrame:
    return sc.otsu(p, "red", ["scene"]).withColumn("threshold", F.bround("threshold", 4))


def changed(own: str, other: str, k: str) -> str:
    wide = f"SELECT a.x, a.y, max(CAST(b.{other} > 0 AS INT)) AS cover FROM two a JOIN two b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY 1, 2"
    return f"SELECT x, y FROM (SELECT k.x, k.y, avg(cover) OVER (PARTITION BY c) AS share, count(*) OVER (PARTITION BY c) AS area FROM {k} k JOIN ({wide}) w ON w.x = k.x AND w.y = k.y) WHERE share < 0.6 AND area >= 3"


TWO = "two AS (SELECT x, y, CASE WHEN gt_class = 1 THEN 1 ELSE 0 END AS t1, CASE WHEN pred_class = 1 AND x % 7 > 1 THEN 1 ELSE 0 END AS t2 FROM pixels)"


@plan("pixels", f"WITH RECURSIVE {TWO}, {parts('SELECT x, y, 1 AS v FROM two WHERE t1 > 0', 'ka')}, {parts('SELECT x, y, 1 AS v FROM two WHERE t2 > 0', 'kb')}, h AS ({changed('t1', 't2', 'ka')} UNION {changed('t2', 't1', 'kb')}) SELECT two.x, two.y, h.x IS NOT NULL AS changed FROM two LEFT JOIN h ON h.x = two.x AND h.y = two.y")
def m05_instance_changes(p: DataFrame) -> DataFrame:
    two = p.select("x", "y", F.when(C("gt_class") == 1, 1).otherwise(0).alias("t1"), F.when((C("pred_class") == 1) & (C("x") % 7 > 1), 1).otherwise(0).alias("t2"))
    return sc.instance_changes(two, 1, 0.6, 3)


REJECTED = "SELECT region_id AS instance, CAST(1 + region_id % 3 AS INT) AS class_id, 1 + region_id % 9 AS area, bx % 90 AS x1, bv % 90 AS y1, bx % 90 + 8 AS x2, bv % 90 + 6 AS y2, region_id % 4 <> 0 AS keep FROM regions"


@plan("pixels regions", f"""WITH RECURSIVE b AS (SELECT * FROM ({REJECTED}) WHERE NOT keep), s AS (SELECT instance AS i, area, x, y FROM pixels JOIN b ON x >= x1 AND x < x2 AND y >= y1 AND y < y2 AND gt_class = class_id),
  k(i, x, y, area, c) USING KEY (i, x, y) AS (SELECT i, x, y, area, CAST(y AS BIGINT) * 2147483648 + x FROM s UNION SELECT n.i, n.x, n.y, n.area, min(p.c) FROM k p CROSS JOIN (SELECT * FROM (VALUES (-1), (0), (1)) a(dx) CROSS JOIN (VALUES (-1), (0), (1)) e(dy)) JOIN recurring.k n ON n.i = p.i AND n.x = p.x + dx AND n.y = p.y + dy AND n.c > p.c GROUP BY n.i, n.x, n.y, n.area),
  z AS (SELECT i, c FROM k GROUP BY i, c, area QUALIFY row_number() OVER (PARTITION BY i ORDER BY abs(count(*) - area), c) = 1)
  SELECT x, y, CASE WHEN (x, y) IN (SELECT (k.x, k.y) FROM k JOIN z ON z.i = k.i AND z.c = k.c) THEN 0 ELSE gt_class END AS v FROM pixels""")
def m10_remove_rejected(p: DataFrame, r: DataFrame) -> DataFrame:
    k = C("region_id")
    boxes = r.select(k.alias("instance"), (1 + k % 3).cast("int").alias("class_id"), (1 + k % 9).alias("area"), (C("bx") % 90).alias("x1"), (C("bv") % 90).alias("y1"), (C("bx") % 90 + 8).alias("x2"), (C("bv") % 90 + 6).alias("y2"), (k % 4 != 0).alias("keep"))
    return sc.remove_rejected(p.select("x", "y", C("gt_class").alias("v")), boxes)


@plan("pixels", "SELECT x, y, CASE WHEN gt_class <> 0 AND pred_class <> 0 THEN gt_class ELSE 0 END AS v FROM pixels")
def m06_agreement(p: DataFrame) -> DataFrame:
    return sc.agreement(p.select("x", "y", C("gt_class").alias("v")), p.select("x", "y", C("pred_class").alias("v")))


@plan("pixels", "SELECT x, y, CAST(CASE WHEN (red % 100) / 100.0E0 > 0.7 THEN 0 WHEN (green % 100) / 100.0E0 > 0.49 THEN 1 WHEN (blue % 100) / 100.0E0 > 0.343 THEN 2 END AS INT) AS pass FROM pixels WHERE (red % 100) / 100.0E0 > 0.7 OR (green % 100) / 100.0E0 > 0.49 OR (blue % 100) / 100.0E0 > 0.343")
def m07_multipass(p: DataFrame) -> DataFrame:
    rows = p.select("x", "y", F.posexplode(F.array(*((C(b) % 100) / 100 for b in ("red", "green", "blue")))).alias("pass", "score"))
    return sc.multipass(rows, 1, coverage=float("inf"), gain=0.0)


OWNED = "SELECT x, y, CASE WHEN (red % 100) / 100.0E0 > 0.7 THEN 0 WHEN (green % 100) / 100.0E0 > 0.49 THEN 1 WHEN (blue % 100) / 100.0E0 > 0.343 THEN 2 END AS pass FROM pixels"


@plan("pixels", f"""WITH o AS (SELECT * FROM ({OWNED}) WHERE pass IS NOT NULL), s AS (SELECT pass, count(*) * 1.0E0 / (SELECT count(*) FROM pixels) AS part FROM o GROUP BY 1),
  r AS (SELECT pass, coalesce(sum(part) OVER w, 0) AS before, coalesce(bool_or(part < 0.001) OVER w, false) AS small FROM s WINDOW w AS (ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT x, y, CAST(pass AS INT) AS pass FROM o SEMI JOIN (SELECT pass FROM r WHERE before < 0.6 AND NOT small) USING (pass)""")
def m07_multipass_stops(p: DataFrame) -> DataFrame:
    """The first two passes cover over 60 % of the pixels, so the third doesn't run."""
    rows = p.select("x", "y", F.posexplode(F.array(*((C(b) % 100) / 100 for b in ("red", "green", "blue")))).alias("pass", "score"))
    return sc.multipass(rows, p.count(), coverage=0.6)


INST = "SELECT region_id AS instance, region_id % 4 AS target, k AS class_id, bw AS w, bh AS h, ((region_id * 7 + k * 13) % 50) / 50.0E0 AS score FROM (SELECT *, unnest(range(4)) AS k FROM regions)"


@plan("regions", f"WITH b AS ({INST}), t AS (SELECT *, max(score) OVER (PARTITION BY instance) AS top, rank() OVER (PARTITION BY instance ORDER BY score DESC) AS rank FROM b) SELECT instance, target, round_even(score, 4) AS score, round_even(score / nullif(top, 0), 4) AS relative, CAST(rank AS INT) AS rank, rank = 1 AS top1, score / nullif(top, 0) >= 0.5 AS keep FROM t WHERE class_id = target")
def m08_verification(r: DataFrame) -> DataFrame:
    k = r.select(C("region_id").alias("instance"), (C("region_id") % 4).alias("target"), C("bw").alias("w"), C("bh").alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("class_id"))
    return sc.verification(k.withColumn("score", (C("instance") * 7 + C("class_id") * 13) % 50 / 50))


@plan("regions", "SELECT region_id, CASE WHEN region_id % 10 >= 6 OR region_id % 7 = 0 THEN region_id % 2 = 0 ELSE region_id % 3 = 0 END AS new_keep FROM regions")
def m09_verdict_policy(r: DataFrame) -> DataFrame:
    rows = r.select("region_id", (C("region_id") % 10 / 10).alias("score"), (C("region_id") % 2 == 0).alias("keep"), (C("region_id") % 3 == 0).alias("verdict"), F.when(C("region_id") % 7 == 0, "timeout").alias("error"))
    return sc.verdict_policy(rows, "uncertain", 0.6).select("region_id", "new_keep")


PALETTE = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0)]


@plan("pixels", "SELECT x, y, CAST(list_position(d, list_min(d)) - 1 AS INT) AS class_id FROM (SELECT x, y, [" + ", ".join(f"pow(red % 256 - {r}, 2) + pow(green % 256 - {g}, 2) + pow(blue % 256 - {b}, 2)" for r, g, b in PALETTE) + "] AS d FROM pixels)")
def m11_nearest_colour(p: DataFrame) -> DataFrame:
    rgb = p.select("x", "y", (C("red") % 256).alias("r"), (C("green") % 256).alias("g"), (C("blue") % 256).alias("b"))
    return sc.nearest_colour(rgb, PALETTE).select("x", "y", "class_id")


@plan("nation", "SELECT n_nationkey AS class_id, n_name AS name, unnest([n_name, lower(n_name)]) AS synonym FROM nation WHERE n_nationkey > 0")
def m12_class_list(n: DataFrame) -> DataFrame:
    lines = n.select(C("n_nationkey").alias("line_no"), F.concat("n_name", F.lit(", "), F.lower("n_name")).alias("line"))
    return sc.class_list(lines, True)


@plan("scenes", f"SELECT DISTINCT scene_id, CAST(greatest(least(x0, w - 96), 0) AS INT) AS x0, CAST(greatest(least(y0, h - 96), 0) AS INT) AS y0 FROM (SELECT *, unnest(range(0, h, 64)) AS y0 FROM (SELECT *, unnest(range(0, w, 64)) AS x0 FROM ({EXT})))")
def m13_clamped_windows(s: DataFrame) -> DataFrame:
    return op.tiles(extents(s), 96, 64, "square").select("scene_id", "x0", "y0")


@plan("pixels", "SELECT x, y, gt_class AS v FROM pixels")
def m14_augmentation_vote(p: DataFrame) -> DataFrame:
    """Eight variants of each 100 x 100 tile are made and undone, then the majority of each pixel taken: the undone copies agree."""
    v = op.dihedral(p.select("x", (C("y") % 100).alias("y"), F.floor(C("y") / 100).cast("int").alias("tile"), "gt_class"), 100)
    a, b, n = C("vx"), C("vy"), F.lit(99)
    back = [(a, b), (n - b, a), (n - a, n - b), (b, n - a), (n - a, b), (b, a), (a, n - b), (n - b, n - a)]
    pair = F.get(F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in back)), C("variant"))
    undone = v.select(pair.alias("p"), "tile", C("gt_class").alias("v")).select("p.x", (C("p.y") + 100 * C("tile")).alias("y"), "v")
    return stats.majority(undone, ["x", "y"], "v").drop("votes")
