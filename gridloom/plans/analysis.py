"""Plans of vector (V), graph (G), retrieval (R), temporal (T) and stream (X) operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as px
from ..functions import sql as sf
from ..functions import text as tx
from ..operators import graph as gr
from ..operators import joins as jn
from ..operators import overlay as ov
from ..operators import retrieve as rt
from ..operators import shapes as sh
from ..operators import temporal as tm
from ..operators import vector as vc
from ..operators import visibility as vs
from ..operators import windows as wd
from ..streaming import files as st
from .curate import COS
from .pixels import NDVI_SQL, NDWI_SQL
from .registry import plan
from .stats import NBR_SQL

C = F.col


def r6(c):
    return F.bround(c, 6)


def ring():
    return F.array(*(F.struct(C(a).alias("x"), C(b).alias("y")) for a, b in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))))


@plan("rect_targets", "SELECT count(*) AS original, count(*) FILTER (kind NOT IN ('BUILDING', 'MACHINERY')) AS valid, count(*) FILTER (kind = 'BUILDING') AS unsupported, count(*) FILTER (kind = 'MACHINERY') AS closed_lines FROM rect_targets")
def v01_validate(t: DataFrame) -> DataFrame:
    kind = F.when(C("kind") == "BUILDING", "GeometryCollection").when(C("kind") == "MACHINERY", "LineString").otherwise("Polygon")
    return vc.validate(t.select(kind.alias("type"), F.concat(ring(), F.slice(ring(), 1, 1)).alias("points")))


@plan("rect_targets", "SELECT fid, count(*) AS n, sum(x) AS sx FROM (SELECT fid, unnest([x1, x2, x2, x1]) AS x FROM rect_targets) GROUP BY 1")
def v03_flatten(t: DataFrame) -> DataFrame:
    return t.select("fid", F.explode(F.flatten(F.array(ring()))).alias("p")).groupBy("fid").agg(F.count("*").alias("n"), F.sum("p.x").alias("sx"))


@plan("rect_targets", "SELECT fid, round_even(x1 * 1609.344E0 / 111320.0E0, 6) AS miles, round_even(x1 * 0.3048E0 / 111320.0E0, 6) AS feet, round_even(x1 * 0.621371E0, 6) AS km_to_miles FROM rect_targets")
def v04_distance_units(t: DataFrame) -> DataFrame:
    return t.select("fid", r6(vc.to_degrees(C("x1"), "miles")).alias("miles"), r6(vc.to_degrees(C("x1"), "feet")).alias("feet"), r6(vc.from_km(C("x1"), "miles")).alias("km_to_miles"))


@plan("rect_targets", "SELECT fid, round_even(20 * sin(2 * pi() / 40) * (x2 - x1) * (x2 - x1), 4) AS area FROM rect_targets")
def v05_point_buffer(t: DataFrame) -> DataFrame:
    b = t.select("fid", vc.point_buffer(C("x1"), C("y1"), C("x2") - C("x1"), 10).alias("ring"))
    return b.select("fid", F.bround(vc.ring_area(C("ring")), 4).alias("area"))


CUT = """p AS (SELECT t.fid, greatest(t.x1, m.x1) AS x1, greatest(t.y1, m.y1) AS y1, least(t.x2, m.x2) AS x2, least(t.y2, m.y2) AS y2 FROM rect_targets t JOIN rect_masks m ON t.x1 < m.x2 AND m.x1 < t.x2 AND t.y1 < m.y2 AND m.y1 < t.y2),
c AS (SELECT DISTINCT fid, x, y FROM (SELECT fid, y1, y2, unnest(range(CAST(x1 AS BIGINT), CAST(x2 AS BIGINT))) AS x, unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT))) AS dummy FROM p), LATERAL (SELECT unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT))) AS y) WHERE x IS NOT NULL), a AS (SELECT fid, count(*) * 1.0E0 AS area FROM c GROUP BY 1)"""


@plan("rect_targets rect_masks", f"WITH {CUT} SELECT fid, area FROM a")
def v07_clip(t: DataFrame, m: DataFrame) -> DataFrame:
    return vc.clip_boxes_to(t.drop("kind"), m.drop("kind"))


@plan("rect_targets rect_masks", f"WITH {CUT} SELECT fid, (x2 - x1) * (y2 - y1) - coalesce(area, 0) AS area FROM rect_targets LEFT JOIN a USING (fid) WHERE (x2 - x1) * (y2 - y1) - coalesce(area, 0) > 0")
def v08_erase(t: DataFrame, m: DataFrame) -> DataFrame:
    return vc.erase_boxes(t.drop("kind"), m.drop("kind"))


@plan("rect_targets", "SELECT kind, count(*) * 1.0E0 AS area FROM (SELECT DISTINCT kind, x, y FROM (SELECT kind, y1, y2, unnest(range(CAST(x1 AS BIGINT), CAST(x2 AS BIGINT))) AS x FROM rect_targets), LATERAL (SELECT unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT))) AS y)) GROUP BY 1")
def v09_merged_area(t: DataFrame) -> DataFrame:
    return vc.union_area(t, "kind", 64.0)


@plan("rect_targets", "SELECT fid, (x2 - x1) * (y2 - y1) AS area, 2 * (x2 - x1 + y2 - y1) AS length FROM rect_targets")
def v10_area_length(t: DataFrame) -> DataFrame:
    length = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda s, i: s + F.hypot(F.get(ring(), (i + 1) % 4)["x"] - F.get(ring(), i)["x"], F.get(ring(), (i + 1) % 4)["y"] - F.get(ring(), i)["y"]))
    return t.select("fid", vc.ring_area(ring()).alias("area"), length.alias("length"))


@plan("samples", "SELECT seq, sub, round_even(2 * 6371.0E0 * asin(sqrt(pow(sin(radians(30.0E0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(30.0E0)) * pow(sin(radians(95.0E0 - lon) / 2), 2))), 4) AS km FROM samples")
def v11_haversine(s: DataFrame) -> DataFrame:
    line = F.array(F.struct(C("lon").alias("x"), C("lat").alias("y")), F.struct(F.lit(95.0).alias("x"), F.lit(30.0).alias("y")))
    return s.select("seq", "sub", F.bround(vc.haversine_km(line), 4).alias("km"))


@plan("kg_edges", "WITH RECURSIVE e AS (SELECT src, dst FROM kg_edges UNION ALL SELECT dst, src FROM kg_edges), r AS (SELECT 'r1' AS node, 0 AS d UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON e.src = r.node WHERE r.d < 3) SELECT 'r1' AS source, node, CAST(min(d) AS DOUBLE) AS dist FROM r GROUP BY 2")
def v13_shortest_paths(e: DataFrame) -> DataFrame:
    both = e.select("src", "dst", F.lit(1.0).alias("w")).union(e.select("dst", "src", F.lit(1.0)))
    return vc.shortest_paths(both, e.sparkSession.createDataFrame([("r1",)], "node string")).select("source", "node", "dist")


@plan("rect_targets", "SELECT fid, round_even(x1 / 7.0E0, 2) AS km, round_even(x1 / 7.0E0 / 5 * 60, 6) AS minutes FROM rect_targets")
def v14_path_report(t: DataFrame) -> DataFrame:
    km, minutes = vc.path_report(C("x1") / 7.0, 5)
    return t.select("fid", km.alias("km"), r6(minutes).alias("minutes"))


@plan("kg_nodes", "SELECT id, label, name FROM kg_nodes WHERE label = 'supplier' ORDER BY id LIMIT 100")
def g01_nodes(n: DataFrame) -> DataFrame:
    return gr.nodes_of(n, "supplier")


@plan("kg_nodes", "SELECT id, label, name FROM kg_nodes WHERE label = 'nation' AND name = (SELECT min(n_name) FROM nation) ORDER BY id LIMIT 1")
def g02_node_by_property(n: DataFrame) -> DataFrame:
    first = n.filter("label = 'nation'").agg(F.min("name")).first()[0]
    return gr.node_by_property(n, "nation", "name", first)


@plan("kg_edges", "SELECT type, dst AS neighbour, 'out' AS direction FROM kg_edges WHERE src = 's1' UNION ALL SELECT type, src, 'in' FROM kg_edges WHERE dst = 's1'")
def g03_relationships(e: DataFrame) -> DataFrame:
    return jn.neighbours(e, "s1", "any")


@plan("kg_edges", "SELECT 2 AS hops, CONCAT('s1>n', CAST(s_nationkey AS VARCHAR), '>r', CAST(n_regionkey AS VARCHAR)) AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1")
def g04_paths(e: DataFrame) -> DataFrame:
    goal = e.filter("src = 's1'").select(C("dst").alias("n")).join(e, C("n") == C("src")).select("dst").first()[0]
    return gr.paths_between(e, "s1", goal, 2)


@plan("kg_nodes kg_edges", "SELECT type, count(*) AS n FROM kg_edges GROUP BY 1")
def g05_overview(n: DataFrame, e: DataFrame) -> DataFrame:
    return e.groupBy("type").agg(F.count("*").alias("n"))


@plan("kg_nodes kg_edges", "SELECT b.name, count(*) AS n FROM kg_nodes a JOIN kg_edges e ON e.src = a.id JOIN kg_nodes b ON b.id = e.dst WHERE a.label = 'customer' GROUP BY 1")
def g06_pattern(n: DataFrame, e: DataFrame) -> DataFrame:
    return gr.pattern(n, e, "SELECT b.name, count(*) AS n FROM {nodes} a JOIN {edges} e ON e.src = a.id JOIN {nodes} b ON b.id = e.dst WHERE a.label = 'customer' GROUP BY b.name")


@plan("events", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def g07_temporal_text(e: DataFrame) -> DataFrame:
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@plan("documents", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_no, CAST(length(substr(text, s + 1, 1000)) AS INT) AS n FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1 - 200, 0) + 1, 800)) AS s FROM documents)")
def r01_chunks(d: DataFrame) -> DataFrame:
    return rt.chunks(d, "doc_id", "text").select("doc_id", "chunk_no", F.length("chunk").alias("n"))


@plan("documents")
def r01_recursive_chunks(d: DataFrame) -> DataFrame:
    return rt.recursive_chunks(d, "doc_id", "text")


@plan("documents", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0E0 * length(text) ELSE -1.0E0 END AS first, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS n FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def r07_upsert_vectors(d: DataFrame) -> DataFrame:
    store = d.filter("doc_id % 2 = 0").select("doc_id", F.array(F.lit(-1.0)).alias("vector"))
    fresh = d.filter("doc_id % 3 = 0").select("doc_id", F.length("text").alias("n"))
    out, _ = rt.upsert_vectors(store, fresh, "doc_id", lambda f: "[" + f["n"].astype(str) + ", 0.5]")
    return out.select("doc_id", F.get("vector", F.lit(0)).alias("first"), F.size("vector").alias("n"))


TOP = f"s AS (SELECT p.prompt_id AS query_id, e.vec_id, round_even({COS}, 9) AS score FROM embeddings e CROSS JOIN query_vectors p), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"


@plan("embeddings query_vectors", f"WITH {TOP} SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round_even(score, 6) AS score FROM h WHERE rank <= 4")
def r02_vector_top_k(e: DataFrame, p: DataFrame) -> DataFrame:
    return rt.vector_top_k(e, p).withColumn("score", r6("score"))


@plan("embeddings query_vectors", f"WITH {TOP}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec_id % 17 DESC, rank) AS new_rank FROM h WHERE rank <= 10) SELECT query_id, vec_id, CAST(new_rank AS INT) AS new_rank FROM t WHERE new_rank <= 4")
def r03_rerank(e: DataFrame, p: DataFrame) -> DataFrame:
    return rt.rerank(rt.vector_top_k(e, p, 10), C("vec_id") % 17, 4).select("query_id", "vec_id", "new_rank")


@plan("embeddings query_vectors", f"WITH {TOP} SELECT query_id, string_agg(printf('[%d] doc%d (score %.3f)', rank, vec_id, score), chr(10) ORDER BY rank) AS context FROM h WHERE rank <= 4 GROUP BY 1")
def r04_context(e: DataFrame, p: DataFrame) -> DataFrame:
    return rt.context(rt.vector_top_k(e, p), F.concat(F.lit("doc"), C("vec_id").cast("string")))


@plan("documents", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CONCAT('knowledge/', source, '.md') ELSE CONCAT(source, '.md') END AS short FROM documents")
def r05_short_source(d: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/data/"), F.when(C("doc_id") % 2 == 0, "knowledge/").otherwise("other/"), C("source"), F.lit(".md"))
    return d.select("doc_id", tx.short_source(path).alias("short"))


@plan("documents", "SELECT doc_id, CASE WHEN length(text) > 300 THEN CONCAT(substr(text, 1, 300), '...') ELSE text END AS preview FROM documents")
def r06_preview(d: DataFrame) -> DataFrame:
    return d.select("doc_id", tx.preview(C("text")).alias("preview"))


@plan("pixels", f"SELECT x, y, round_even(pre - post, 6) AS dnbr, round_even((pre - post) / nullif(sqrt(abs(pre)), 0), 4) AS rdnbr FROM (SELECT x, y, {NBR_SQL} AS pre, CASE WHEN red + green = 0 THEN NULL ELSE (red - green) / (red + green) END AS post FROM pixels)")
def t01_dnbr(p: DataFrame) -> DataFrame:
    pre, post = px.nbr(C("nir"), C("swir2")), px.nbr(C("red"), C("green"))
    return p.select("x", "y", r6(tm.dnbr(pre, post)).alias("dnbr"), F.bround(tm.rdnbr(pre, post), 4).alias("rdnbr"))


@plan("patch_series", "SELECT patch_id, phase, round_even(m - first_value(m) OVER (PARTITION BY patch_id ORDER BY phase), 6) AS change FROM (SELECT patch_id, phase, avg(value) AS m FROM patch_series GROUP BY 1, 2)")
def t02_phase_change(p: DataFrame) -> DataFrame:
    m = p.groupBy("patch_id", "phase").agg(F.avg("value").alias("m"))
    return wd.phase_change(m, "patch_id", "phase", "m").select("patch_id", "phase", r6("from_first").alias("change"))


@plan("patch_series", "SELECT patch_id, CASE WHEN s > 0 THEN 'recovery' WHEN s < 0 THEN 'degradation' ELSE 'stable' END AS reading FROM (SELECT patch_id, regr_slope(value, epoch(ts) / 86400.0) AS s FROM patch_series GROUP BY 1)")
def t03_trend(p: DataFrame) -> DataFrame:
    return tm.trend(p, "patch_id", "ts", "value").select("patch_id", "reading")


@plan("patch_series", "SELECT patch_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS period, count(value) AS n, round_even(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM patch_series GROUP BY 1, 2")
def t04_rollup(p: DataFrame) -> DataFrame:
    out = tm.rollup_by_grain(p, "patch_id", "ts", "value", "month")
    return out.withColumns({"mean": r6("mean"), "period": C("period").cast("timestamp_ntz")})


STATE = f"CASE WHEN v BETWEEN 0.4 AND 0.6 AND b > 0.27 THEN 'baseline' WHEN v < 0.2 AND b < -0.25 THEN 'disturbed' WHEN v IS NOT NULL AND b IS NOT NULL THEN 'recovering' END AS state FROM (SELECT x, y, {NDVI_SQL} AS v, {NBR_SQL} AS b FROM pixels)"


@plan("pixels", f"SELECT x, y, {STATE}")
def t05_patch_state(p: DataFrame) -> DataFrame:
    return p.select("x", "y", tx.patch_state(px.ndvi(C("red"), C("nir")), px.nbr(C("nir"), C("swir2"))).alias("state"))


@plan("pixels", f"SELECT x, y, CASE WHEN v > 0.4 AND w < 0 THEN 'dense plants' WHEN v < 0.2 AND w > 0.1 THEN 'water' WHEN v < 0.2 AND b < -0.1 THEN 'burnt or bare' WHEN v IS NOT NULL THEN 'mixed' END AS reading FROM (SELECT x, y, {NDVI_SQL} AS v, {NDWI_SQL} AS w, {NBR_SQL} AS b FROM pixels)")
def t06_paired_reading(p: DataFrame) -> DataFrame:
    return p.select("x", "y", tx.paired_reading(px.ndvi(C("red"), C("nir")), px.ndwi(C("green"), C("nir")), px.nbr(C("nir"), C("swir2"))).alias("reading"))


@plan("pixels", f"SELECT state, count(*) AS n FROM (SELECT x, y, {STATE}) GROUP BY 1")
def t07_state_counts(p: DataFrame) -> DataFrame:
    return t05_patch_state(p).groupBy("state").agg(F.count("*").alias("n"))


@plan("events", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(value) AS n, round_even(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def x03_daily_statistics(e: DataFrame) -> DataFrame:
    out = st.daily_statistics(e, "ts", "value")
    return out.withColumns({"mean": r6("mean"), "day": C("day").cast("timestamp_ntz")})


def _part(d: str, p: str, a: str, b: str, low: bool) -> str:
    flat = f"CASE WHEN {p} > {a} AND {p} < {b} THEN 0.0E0 ELSE 2.0E0 END" if low else "1.0E0"
    return f"CASE WHEN {d} = 0 THEN {flat} ELSE {'least' if low else 'greatest'}(({a} - {p}) / nullif({d}, 0), ({b} - {p}) / nullif({d}, 0)) END"


T0 = f"greatest({_part('bx - ax', 'ax', 'm.x1', 'm.x2', True)}, {_part('bv - av', 'av', 'm.y1', 'm.y2', True)}, 0.0E0)"
T1 = f"least({_part('bx - ax', 'ax', 'm.x1', 'm.x2', False)}, {_part('bv - av', 'av', 'm.y1', 'm.y2', False)}, 1.0E0)"


@plan("rect_targets rect_masks", f"WITH s AS (SELECT fid AS sid, x1 AS ax, y1 AS av, x2 + 20 AS bx, y2 - 35 AS bv FROM rect_targets) SELECT sid FROM s WHERE NOT EXISTS (SELECT 1 FROM rect_masks m WHERE {T0} < {T1})")
def v12_visible(t: DataFrame, m: DataFrame) -> DataFrame:
    s = t.select(C("fid").alias("sid"), C("x1").alias("ax"), C("y1").alias("ay"), (C("x2") + 20).alias("bx"), (C("y2") - 35).alias("by"))
    return vc.visible(s, m, 50.0).select("sid")


def rings(*points: tuple[str, str]) -> Column:
    """One ring of the points (SQL of x, SQL of y)."""
    return F.array(F.array(*(F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in points)))


BOX = (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))
#: A diamond in the box's middle, as wide as high.
DIAMOND = (("x1", "y1 + 4"), ("x1 + 4", "y1"), ("x1 + 8", "y1 + 4"), ("x1 + 4", "y1 + 8"))


def boxes(t: DataFrame) -> DataFrame:
    return t.select("fid", "kind", rings(*BOX).alias("rings"))


@plan("rect_targets rect_masks", f"WITH {CUT} SELECT fid, kind, area FROM a JOIN rect_targets USING (fid)")
def v07_clip_polygons(t: DataFrame, m: DataFrame) -> DataFrame:
    return ov.clip(boxes(t), boxes(m), 64.0, False).select("fid", "kind", "area")


@plan("rect_targets rect_masks", f"WITH {CUT} SELECT fid, kind, (x2 - x1) * (y2 - y1) - coalesce(area, 0) AS area FROM rect_targets LEFT JOIN a USING (fid) WHERE (x2 - x1) * (y2 - y1) - coalesce(area, 0) > 0")
def v08_erase_polygons(t: DataFrame, m: DataFrame) -> DataFrame:
    return ov.erase(boxes(t), boxes(m), 64.0, False).select("fid", "kind", "area")


# Diamonds whose corners lie on the lattice: quarter cells, cut by both diagonals of each lattice square, are wholly in or out.
QUARTERS = "SELECT unnest([0.5E0, 0.25E0, 0.75E0, 0.5E0]) AS qx, unnest([0.25E0, 0.5E0, 0.5E0, 0.75E0]) AS qy"


@plan("rect_targets", f"WITH d AS (SELECT kind, x1 + 4 AS cx, y1 + 4 AS cy, unnest(range(-4, 4)) AS i FROM rect_targets), e AS (SELECT kind, cx, cy, i, unnest(range(-4, 4)) AS j FROM d), q AS ({QUARTERS}), c AS (SELECT DISTINCT kind, cx + i + qx AS x, cy + j + qy AS y FROM e CROSS JOIN q WHERE abs(i + qx) + abs(j + qy) < 4) SELECT kind, count(*) * 0.25E0 AS area FROM c GROUP BY 1")
def v09_dissolve_diamonds(t: DataFrame) -> DataFrame:
    return ov.dissolve(t.select("kind", rings(*DIAMOND).alias("rings")), ["kind"], 64.0)


@plan("rect_targets", "SELECT kind, count(*) * 1.0E0 AS area FROM (SELECT DISTINCT kind, x, y FROM (SELECT kind, y1, y2, unnest(range(CAST(x1 AS BIGINT), CAST(x2 AS BIGINT))) AS x FROM rect_targets), LATERAL (SELECT unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT))) AS y)) GROUP BY 1")
def v09_dissolve_rings(t: DataFrame) -> DataFrame:
    """The area that the outlines enclose equals that of the union."""
    outlines = ov.dissolved_rings(boxes(t), ["kind"], 64.0).select("kind", F.explode("rings").alias("ring"))
    n = F.size("ring")
    each = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + F.get("ring", i)["x"] * F.get("ring", (i + 1) % n)["y"] - F.get("ring", (i + 1) % n)["x"] * F.get("ring", i)["y"])
    return outlines.groupBy("kind").agg(F.sum(each / 2).alias("area"))


CHORDS = "16 * 2 * 2 * sin(pi() / 16)"


@plan("rect_targets", f"SELECT fid, round_even((x2 - x1) * 4 + {CHORDS}, 4) AS area FROM rect_targets")
def v06_line_buffer(t: DataFrame) -> DataFrame:
    line = t.select("fid", F.lit("LineString").alias("type"), rings(("x1", "y1"), ("x2", "y1")).alias("rings"))
    return ov.buffer_areas(line, 2.0, 8, 64.0).select("fid", F.bround("area", 4).alias("area"))


@plan("rect_targets", f"SELECT fid, round_even((x2 - x1) * (y2 - y1) + 4 * (x2 - x1 + y2 - y1) + {CHORDS}, 4) AS area FROM rect_targets")
def v06_polygon_buffer(t: DataFrame) -> DataFrame:
    shape = t.select("fid", F.lit("Polygon").alias("type"), rings(*BOX).alias("rings"))
    return ov.buffer_areas(shape, 2.0, 8, 64.0).select("fid", F.bround("area", 4).alias("area"))


def ring_edges(t: DataFrame, corners: Column) -> DataFrame:
    """Edges (fid, no, x1, y1, x2, y2) between the corners, the last to the first."""
    each = t.select("fid", F.posexplode(corners).alias("no", "a"), corners.alias("ring"))
    b = F.get("ring", F.pmod(C("no") + 1, F.size("ring")))
    return each.select("fid", "no", C("a.x").alias("x1"), C("a.y").alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


@plan("rect_targets", "SELECT fid FROM rect_targets WHERE fid % 7 = 0 OR fid % 11 = 0")
def v02_ring_validity(t: DataFrame) -> DataFrame:
    """Every seventh ring has two corners swapped and crosses itself, every eleventh lacks its last edge."""
    a, b, c, d = (F.struct(C(x).alias("x"), C(y).alias("y")) for x, y in BOX)
    edges = ring_edges(t, F.when(C("fid") % 7 == 0, F.array(a, c, b, d)).otherwise(F.array(a, b, c, d)))
    return sh.invalid_rings(edges.filter("fid % 11 <> 0 or no < 3"), "fid", 16.0)


@plan("rect_targets", "SELECT fid, CASE WHEN fid % 5 > 2 THEN 4 ELSE 3 END AS n_points FROM rect_targets")
def c10_simplify(t: DataFrame) -> DataFrame:
    """A bend of ``fid % 5`` off the straight line goes up to a tolerance of 2, one of 50 stays."""
    line = t.select("fid", F.array("x1", (C("x1") + C("x2")) / 2, "x2", C("x2") + 1).alias("xs"), F.array("y1", C("y1") + C("fid") % 5, "y1", C("y1") + 50).alias("ys"))
    return sh.simplify(line, "fid", 2.0).select("fid", F.size("xs").alias("n_points"))


@plan("pixels", f"SELECT x, y, round_even({NDVI_SQL}, 6) AS v, round_even(2 * 6371.0E0 * asin(sqrt(pow(sin(radians(30.0E0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(30.0E0)) * pow(sin(radians(100.0E0 - lon) / 2), 2))), 4) AS km, round_even(4.0E0 / (16 + (x + 4) * 4 - 4), 6) AS iou FROM pixels")
def sql_functions(p: DataFrame) -> DataFrame:
    """Column functions called by name in SQL text."""
    sf.register(p.sparkSession)
    return p.sparkSession.sql("SELECT x, y, bround(ndvi(red, nir), 6) AS v, bround(haversine_km(lon, lat, 100.0, 30.0), 4) AS km, bround(box_iou(0, 0, 4, 4, 3, 0, x + 7, 4), 6) AS iou FROM {p}", p=p)


SEEN = f"""v AS (SELECT fid * 4 + k AS vid, CASE WHEN k IN (0, 3) THEN x1 ELSE x2 END AS x, CASE WHEN k IN (0, 1) THEN y1 ELSE y2 END AS y FROM rect_masks CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) n),
  s AS (SELECT a.vid AS a, b.vid AS b, a.x AS ax, a.y AS av, b.x AS bx, b.y AS bv, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS w FROM v a JOIN v b ON a.vid < b.vid WHERE abs(a.x - b.x) <= 120 AND abs(a.y - b.y) <= 120)"""


@plan("rect_masks", f"WITH {SEEN} SELECT a, b, round_even(w, 6) AS w FROM s WHERE w <= 120 AND w > 0 AND NOT EXISTS (SELECT 1 FROM rect_masks m WHERE {T0} < {T1} AND NOT (ax BETWEEN m.x1 AND m.x2 AND bx BETWEEN m.x1 AND m.x2 AND av BETWEEN m.y1 AND m.y2 AND bv BETWEEN m.y1 AND m.y2))")
def v12_visibility_graph(m: DataFrame) -> DataFrame:
    """Corners of the masks that see each other past the masks, up to a distance of 120."""
    corners = F.array(*(F.struct(C(x).alias("x"), C(y).alias("y")) for x, y in BOX))
    vertices = m.select("fid", F.posexplode(corners).alias("k", "p")).select((C("fid") * 4 + C("k")).alias("vid"), "p.x", "p.y")
    graph = vs.visibility_graph(vertices, m.select(rings(*BOX).alias("rings")), 120.0, 50.0)
    return graph.filter("src < dst and w > 0").select(C("src").alias("a"), C("dst").alias("b"), r6("w").alias("w"))
