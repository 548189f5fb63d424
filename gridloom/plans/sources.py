"""Plans of sources and sinks (S) that work on columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rounds import shared_folder
from ..sources import tables as io
from .registry import plan

C = F.col


def new_folder(df: DataFrame, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(df.sparkSession)}/gridloom-{name}-{uuid.uuid4().hex[:12]}"


@plan("documents", "SELECT doc_id, printf('样本%d', doc_id) AS name, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 = 1 THEN source END AS src FROM documents")
def s01_read_table(d: DataFrame) -> DataFrame:
    """Delimited files of two encodings and different columns, found by a glob and united by name."""
    out, spark = new_folder(d, "tables"), d.sparkSession
    rows = d.select("doc_id", F.format_string("样本%d", "doc_id").alias("name"), "lang", C("source").alias("src"))
    rows.filter("doc_id % 2 = 0").drop("src").write.csv(f"{out}/utf", header=True)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows.filter("doc_id % 2 = 1").drop("lang").write.csv(f"{out}/other", header=True, encoding="gbk")
    back, rejects = io.read_table(spark, f"{out}/*/*.csv")
    return back.select(C("doc_id").cast("long").alias("doc_id"), "name", "lang", "src").join(rejects.select(F.lit(None).cast("long").alias("doc_id")), "doc_id", "left_anti")


@plan("documents", "SELECT doc_id, lang, n_chars FROM documents")
def s04_json_lines(d: DataFrame) -> DataFrame:
    out = new_folder(d, "lines")
    d.select("doc_id", "lang", "n_chars").write.json(out)
    return io.read_json(d.sparkSession, out).select("doc_id", "lang", C("n_chars").cast(d.schema["n_chars"].dataType).alias("n_chars"))


@plan("documents", "SELECT CAST(doc_id AS VARCHAR) AS line, lang FROM documents")
def s06_document_files(d: DataFrame) -> DataFrame:
    """Whole files of a folder tree; a file a language, cut into its lines again."""
    out = new_folder(d, "corpus")
    d.select(C("doc_id").cast("string").alias("value"), "lang").write.partitionBy("lang").text(out)
    files = io.read_documents(d.sparkSession, [out], "*.txt")
    lines = files.select(F.regexp_extract("source", "lang=([^/]*)/", 1).alias("lang"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter("line <> ''").select("line", "lang")


@plan("boxes_gt", "SELECT image_id, label, CAST(x1 AS INT) AS x1, CAST(y2 AS INT) AS y2, 1000 AS width FROM boxes_gt")
def s07_boxes_from_voc(b: DataFrame) -> DataFrame:
    """A box and an empty one of each annotation; the empty ones go."""
    shape = "<object><name>%s</name><bndbox><xmin>%d</xmin><ymin>%d</ymin><xmax>%d</xmax><ymax>%d</ymax></bndbox></object>"
    xml = F.format_string(f"<annotation><size><width>1000</width><height>900</height></size>{shape}{shape}</annotation>", "label", "x1", "y1", "x2", "y2", F.lit("none"), "x1", "y1", "x1", "y2")
    return io.boxes_from_voc(b.select("image_id", xml.alias("t")), "t").select("image_id", "label", "x1", "y2", "width")


@plan("rect_targets", "SELECT fid, CASE WHEN fid % 2 = 0 THEN 'lava' ELSE 'dolomite' END AS label, CASE WHEN fid % 2 = 0 THEN 1 ELSE 2 END AS class_id, 4 AS n_points, x2 AS third_x FROM rect_targets")
def s09_features_from_labelme(t: DataFrame) -> DataFrame:
    """Polygons only: the other shapes of a file are skipped."""
    points = "[[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f]]"
    text = F.format_string('{"shapes":[{"label":"%s","shape_type":"polygon","points":' + points + '},{"label":"line","shape_type":"line","points":[[0,0],[1,1]]}]}', F.when(C("fid") % 2 == 0, "lava").otherwise("dolomite"), "x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")
    out = io.features_from_labelme(t.select("fid", text.alias("t")), "t", {"lava": 1, "dolomite": 2})
    return out.select("fid", "label", "class_id", F.size("points").alias("n_points"), C("points")[2][0].alias("third_x"))


@plan("pixels", "SELECT lon AS longitude, lat AS latitude, red, green, blue, nir FROM pixels")
def s10_read_pixels(p: DataFrame) -> DataFrame:
    out = new_folder(p, "pixels")
    p.select(C("lon").alias("longitude"), C("lat").alias("latitude"), "red", "green", "blue", "nir", "scene").write.parquet(out)
    return io.read_pixels(p.sparkSession, out).select(*io.ORDINARY_COLUMNS)


@plan("pixels", "SELECT CAST(x AS VARCHAR) AS x, CAST(y AS VARCHAR) AS y, printf('%.6f', red) AS red, CAST(water_mask AS VARCHAR) AS water_mask, printf('%.6f', nir) AS nir FROM pixels")
def s11_write_csv(p: DataFrame) -> DataFrame:
    """Fixed decimals as text, the mask column last."""
    out = new_folder(p, "csv")
    io.write_csv(p.select("x", "water_mask", "y", "red", "nir"), out, last="water_mask", most_rows=5000)
    back = p.sparkSession.read.csv(out, header=True)
    return back.select("x", "y", "red", "nir", C(back.columns[-1]).alias("water_mask"))


@plan("pixels", "SELECT scene, count(*) AS n, max(red) AS hi FROM pixels GROUP BY 1")
def s13_write_stats(p: DataFrame) -> DataFrame:
    out = new_folder(p, "stats")
    io.write_stats(p.groupBy("scene").agg(F.count("*").alias("n"), F.max("red").alias("hi")), out)
    return io.read_json(p.sparkSession, out).select(C("scene").cast("int").alias("scene"), "n", "hi")


@plan("boxes_gt", "SELECT box_id AS id, image_id, label AS name, x2 - x1 AS w FROM boxes_gt")
def s14_write_coco(b: DataFrame) -> DataFrame:
    """Three line files, joined by id when they are read."""
    out = new_folder(b, "coco")
    names = b.select(C("label").alias("name")).distinct().select(F.xxhash64("name").alias("id"), "name")
    io.write_coco(b.select(C("image_id").alias("id")).distinct(), b.select(C("box_id").alias("id"), "image_id", F.xxhash64("label").alias("category_id"), (C("x2") - C("x1")).alias("w")), names, out)
    part = lambda name: io.read_json(b.sparkSession, f"{out}/{name}")
    rows = part("annotations").join(part("categories").withColumnRenamed("id", "category_id"), "category_id").join(part("images").withColumnRenamed("id", "image_id"), "image_id")
    return rows.select("id", "image_id", "name", "w")


@plan("documents", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 = 1 THEN source END AS source FROM documents")
def s02_union_files(d: DataFrame) -> DataFrame:
    return io.union_files([d.filter("doc_id % 2 = 0").select("doc_id", "lang"), d.filter("doc_id % 2 = 1").select("doc_id", "source")])


@plan("documents", "SELECT doc_id FROM documents WHERE NOT contains(CONCAT(source, '_', lang, '.csv'), 'src1') AND NOT contains(CONCAT(source, '_', lang, '.csv'), '_de')")
def s03_exclude_paths(d: DataFrame) -> DataFrame:
    named = d.select("doc_id", F.concat(F.lit("/in/src1/"), "source", F.lit("_"), "lang", F.lit(".csv")).alias("path"))
    return io.exclude_paths(named, "path", ["src1", "_de"]).select("doc_id")


@plan("rect_targets", "SELECT fid, CASE WHEN fid % 3 = 0 THEN 'Polygon' ELSE 'Point' END AS geometry_type, kind FROM rect_targets WHERE fid % 5 <> 0")
def s05_features_from_geojson(t: DataFrame) -> DataFrame:
    kind = F.when(C("fid") % 5 == 0, "GeometryCollection").when(C("fid") % 3 == 0, "Polygon").otherwise("Point")
    feature = F.format_string('{"type":"Feature","geometry":{"type":"%s","coordinates":[1,2]},"properties":{"kind":"%s"}}', kind, C("kind"))
    text = F.when(C("fid") % 2 == 0, feature).otherwise(F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}")))
    return io.features_from_geojson(t.select("fid", text.alias("g")), "g").select("fid", "geometry_type", C("properties")["kind"].alias("kind"))


@plan("boxes_gt", "SELECT box_id, CASE WHEN box_id % 4 < 2 THEN CASE box_id % 4 WHEN 0 THEN 'pipe' ELSE 'crack' END ELSE CAST(box_id % 4 AS VARCHAR) END AS label, x1 / 1000.0E0 AS cx FROM boxes_gt WHERE box_id % 7 <> 0")
def s08_boxes_from_yolo(b: DataFrame) -> DataFrame:
    line = F.when(C("box_id") % 7 == 0, "bad line").otherwise(F.concat_ws(" ", (C("box_id") % 4).cast("string"), (C("x1") / 1000).cast("string"), F.lit("0.5"), F.lit("0.1"), F.lit("0.1")))
    return io.boxes_from_yolo(b.select("box_id", F.concat(line, F.lit("\nx 1")).alias("t")), "t", ["pipe", "crack"]).select("box_id", "label", "cx")


FEATURES = "SELECT fid, kind, CASE WHEN fid % 2 = 0 THEN 'even' END AS extra, CASE WHEN fid % 3 = 0 THEN 'Point' ELSE 'Polygon' END AS geometry_type, CASE WHEN fid % 3 = 0 THEN printf('POINT (%d %d)', CAST(x1 AS INT), CAST(y1 AS INT)) ELSE printf('POLYGON ((%d %d, %d %d, %d %d, %d %d))', CAST(x1 AS INT), CAST(y1 AS INT), CAST(x2 AS INT), CAST(y1 AS INT), CAST(x2 AS INT), CAST(y2 AS INT), CAST(x1 AS INT), CAST(y1 AS INT)) END AS geometry_wkt FROM rect_targets"


def features(t: DataFrame) -> DataFrame:
    n = [C(c).cast("int") for c in ("x1", "y1", "x2", "y2")]
    shape = F.when(C("fid") % 3 == 0, F.format_string('{"type":"Point","coordinates":[%d, %d]}', *n[:2])).otherwise(F.format_string('{"type":"Polygon","coordinates":[[[%d,%d],[%d,%d],[%d,%d,7.5],[%d,%d]]]}', n[0], n[1], n[2], n[1], n[2], n[3], n[0], n[1]))
    own = F.create_map(F.lit("fid"), C("fid").cast("string"), F.lit("kind"), C("kind"))
    return t.select("fid", shape.alias("geometry"), F.when(C("fid") % 2 == 0, F.map_concat(own, F.create_map(F.lit("extra"), F.lit("even")))).otherwise(own).alias("properties"))


@plan("rect_targets", FEATURES)
def s12_features_csv(t: DataFrame) -> DataFrame:
    return io.features_csv(features(t), "fid").withColumn("fid", C("fid").cast("long"))


@plan("rect_targets", FEATURES)
def s12_features_geojson(t: DataFrame) -> DataFrame:
    """Written as collections, read back by the feature source."""
    out = f"{shared_folder(t.sparkSession)}/gridloom-features-{uuid.uuid4().hex[:12]}"
    io.write_features(features(t), out, "fid", "geojson")
    back = io.features_from_geojson(t.sparkSession.read.text(out, wholetext=True), "value")
    return back.select(C("properties")["fid"].cast("long").alias("fid"), C("properties")["kind"].alias("kind"), F.try_element_at("properties", F.lit("extra")).alias("extra"), "geometry_type", io.wkt_of(C("geometry")).alias("geometry_wkt"))


@plan("documents", "SELECT doc_id, lang, n_chars FROM documents")
def x05_append_records(d: DataFrame) -> DataFrame:
    """Two flushes to one folder, read back whole."""
    out = f"{shared_folder(d.sparkSession)}/gridloom-records-{uuid.uuid4().hex[:12]}"
    for part in (d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1")):
        io.append_records(part.select("doc_id", "lang", "n_chars"), out)
    return d.sparkSession.read.schema(d.select("doc_id", "lang", "n_chars").schema).json(out)


@plan("boxes_gt", """SELECT image_id, CONCAT('{"id":', CAST(image_id AS VARCHAR), ',"conversations":[{"from":"user","value":"find"},{"from":"assistant","value":"<obj>[', string_agg(printf('{\\"label\\":\\"%s\\",\\"bbox\\":[%d,%d,%d,%d]}', label, x1, y1, x2, y2), ',' ORDER BY box_id), ']</obj>"}]}') AS record FROM boxes_gt GROUP BY 1""")
def s15_conversation_rows(b: DataFrame) -> DataFrame:
    return io.conversation_rows(b, "find")
