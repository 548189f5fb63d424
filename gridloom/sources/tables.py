"""Sources and sinks: delimited tables, JSON, features, annotations, COCO and conversation rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8", "gbk", "gb18030")
GEOMETRIES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
ORDINARY_COLUMNS = ["longitude", "latitude", "red", "green", "blue", "nir"]


def probe_encodings(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """(path, encoding): the first encoding that decodes each whole file, null for rejects."""

    def probe(frames):
        for frame in frames:
            found = []
            for data in frame["content"]:
                name = None
                for e in encodings:
                    try:
                        bytes(data).decode(e)
                        name = e
                        break
                    except UnicodeDecodeError:
                        continue
                found.append(name)
            yield frame[["path"]].assign(encoding=found)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(probe, "path string, encoding string")


def read_table(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> tuple[DataFrame, DataFrame]:
    """All readable files by column name with a ``source`` column, and the rejects. One pass per encoding found."""
    probed = probe_encodings(spark, path, encodings)
    rejects = probed.filter("encoding is null").select("path")
    out = None
    for e in encodings:
        names = [r["path"] for r in probed.filter(F.col("encoding") == e).select("path").collect()]  # file names only
        if names:
            if e != "utf-8" and spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
                # Spark reads these only with the JVM's charsets allowed, when the rows are read too: it has to stay set for the session
                spark.conf.set("spark.sql.legacy.javaCharsets", "true")
            part = spark.read.csv(names, header=True, inferSchema=True, encoding=e).withColumn("source", F.col("_metadata.file_path"))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no readable table in {path}")
    return out, rejects


def union_files(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def exclude_paths(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Rows whose file name holds none of the words."""
    name = F.regexp_extract(column, "[^/]*$", 0)
    hit = F.lit(False)
    for w in words:
        hit = hit | name.contains(w)
    return df.filter(~hit)


def read_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Line files (blank lines are skipped) or one array a file."""
    return spark.read.json(path, multiLine=not lines)


FEATURE = "struct<type:string,features:array<struct<geometry:string,properties:map<string,string>>>,geometry:string,properties:map<string,string>>"


def features_from_geojson(df: DataFrame, column: str) -> DataFrame:
    """One row a feature of a collection or single feature; unsupported types and null geometries go."""
    parsed = df.withColumn("_g", F.from_json(column, FEATURE))
    one = F.array(F.struct(F.col("_g.geometry").alias("geometry"), F.col("_g.properties").alias("properties")))
    rows = parsed.withColumn("_f", F.explode(F.when(F.col("_g.type") == "FeatureCollection", F.col("_g.features")).otherwise(one)))
    out = rows.select(*df.columns, F.col("_f.geometry").alias("geometry"), F.col("_f.properties").alias("properties"))
    return out.withColumn("geometry_type", F.get_json_object("geometry", "$.type")).filter(F.col("geometry_type").isin(*GEOMETRIES))


def read_documents(spark: SparkSession, folders: list[str], pattern: str = "*.md") -> DataFrame:
    """(source, text) of all files below the folders; no file at all is an error."""
    df = spark.read.text(folders, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    if df.isEmpty():
        raise ValueError("no documents")
    return df


VOC = "struct<size:struct<width:int,height:int>,object:array<struct<name:string,bndbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>>>>"


def boxes_from_voc(df: DataFrame, column: str) -> DataFrame:
    """Boxes of VOC annotation text; only boxes with an area stay."""
    x = df.withColumn("_x", F.from_xml(column, VOC)).select(*[c for c in df.columns if c != column], F.col("_x.size.width").alias("width"), F.col("_x.size.height").alias("height"), F.explode("_x.object").alias("o"))
    out = x.select(*[c for c in x.columns if c != "o"], F.col("o.name").alias("label"), F.col("o.bndbox.xmin").alias("x1"), F.col("o.bndbox.ymin").alias("y1"), F.col("o.bndbox.xmax").alias("x2"), F.col("o.bndbox.ymax").alias("y2"))
    return out.filter("x2 > x1 and y2 > y1")


def boxes_from_yolo(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Boxes of label lines; short or non-numeric lines are skipped, unknown ids keep their number as the label."""
    parts = df.withColumn("_l", F.explode(F.split(column, "\n"))).withColumn("_p", F.split(F.trim("_l"), r"\s+")).filter(F.size("_p") >= 5)
    number = lambda i: F.get("_p", F.lit(i)).try_cast("double")
    rows = parts.select(*[c for c in df.columns if c != column], *(number(i).alias(n) for i, n in enumerate(("cls", "cx", "cy", "w", "h")))).dropna(subset=["cls", "cx", "cy", "w", "h"])
    cls = F.col("cls").cast("int")
    return rows.withColumn("label", F.coalesce(F.when(cls >= 0, F.get(F.array(*map(F.lit, names)), cls)), cls.cast("string")))


def features_from_labelme(df: DataFrame, column: str, classes: dict[str, int]) -> DataFrame:
    """Polygons of annotation JSON with their class ids; an unknown label is an error."""
    shape = "struct<shapes:array<struct<label:string,shape_type:string,points:array<array<double>>>>>"
    s = df.withColumn("_s", F.explode(F.from_json(column, shape)["shapes"])).filter("_s.shape_type = 'polygon'")
    known = F.create_map(*(x for k, v in classes.items() for x in (F.lit(k), F.lit(v))))
    label = F.col("_s.label")
    cls = F.when(F.map_contains_key(known, label), F.try_element_at(known, label)).otherwise(F.raise_error(F.concat(F.lit("unknown label "), label)).cast("int"))
    return s.select(*[c for c in df.columns if c != column], label.alias("label"), cls.alias("class_id"), F.col("_s.points").alias("points"))


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    missing = [c for c in ORDINARY_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def fixed_decimals(df: DataFrame, decimals: int = 6, last: str | None = None) -> DataFrame:
    """Doubles with fixed decimals, the mask column last."""
    order = [c for c in df.columns if c != last] + ([last] if last else [])
    kinds = dict(df.dtypes)
    return df.select(*(F.bround(c, decimals).cast(f"decimal(38,{decimals})").alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in order))


def write_csv(df: DataFrame, path: str, decimals: int = 6, last: str | None = None, most_rows: int = 1_000_000) -> None:
    fixed_decimals(df, decimals, last).write.option("maxRecordsPerFile", most_rows).csv(path, header=True)


def wkt_of(geometry: Column) -> Column:
    """WKT of a GeoJSON geometry text; a third coordinate is left out."""
    number = r"\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*"
    kind, places = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    pairs = F.regexp_replace(places, rf"\[{number},{number}(?:,{number})?\]", "$1 $2")
    body = F.regexp_replace(F.translate(pairs, "[]", "()"), r"\s*,\s*", ", ")
    return F.concat(F.upper(kind), F.lit(" "), F.when(kind == "Point", F.concat(F.lit("("), body, F.lit(")"))).otherwise(body))


def features_csv(df: DataFrame, order: str, geometry: str = "geometry", properties: str = "properties") -> DataFrame:
    """One column a property, in the order in which the names are first seen (rows by ``order``), then geometry type and WKT."""
    seen = df.select(order, F.posexplode(F.map_keys(properties)).alias("_at", "_name")).groupBy("_name").agg(F.min(F.struct(order, "_at")).alias("_first"))
    names = [r["_name"] for r in seen.orderBy("_first").collect()]  # column names
    return df.select(*(F.try_element_at(properties, F.lit(n)).alias(n) for n in names), F.get_json_object(geometry, "$.type").alias("geometry_type"), wkt_of(F.col(geometry)).alias("geometry_wkt"))


def collections(df: DataFrame, geometry: str = "geometry", properties: str = "properties") -> DataFrame:
    """Lines of text that make each partition a feature collection."""
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.coalesce(F.to_json(properties), F.lit("{}")), F.lit("}"))

    def wrap(frames):
        between = '{"type":"FeatureCollection","features":['
        for frame in frames:
            if len(frame):
                lines = frame["value"].tolist()
                yield pd.DataFrame({"value": [f"{between}{lines[0]}", *(f",{x}" for x in lines[1:])]})
                between = ","
        yield pd.DataFrame({"value": ["]}" if between == "," else f"{between}]}}"]})

    return df.select(feature.alias("value")).mapInPandas(wrap, "value string")


def write_features(df: DataFrame, path: str, order: str, fmt: str, geometry: str = "geometry", properties: str = "properties") -> None:
    """CSV with WKT, or GeoJSON: every file is a feature collection."""
    if fmt == "csv":
        features_csv(df, order, geometry, properties).write.csv(path, header=True)
    elif fmt in ("geojson", "json"):
        collections(df, geometry, properties).write.text(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def append_records(df: DataFrame, folder: str) -> None:
    """Adds rows to a folder of JSON lines; files are added whole, none is written again."""
    df.write.mode("append").json(folder)


def write_stats(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """Three line files; a reader joins them by id."""
    for name, df in (("images", images), ("annotations", annotations), ("categories", categories)):
        df.write.json(f"{path}/{name}")


def conversation_rows(boxes: DataFrame, question: str) -> DataFrame:
    """(image_id, record): a user turn and an assistant turn that lists the boxes of one image, ``[]`` for none."""
    box = F.when(F.col("x1").isNotNull(), F.format_string('{"label":"%s","bbox":[%d,%d,%d,%d]}', "label", "x1", "y1", "x2", "y2"))
    g = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("box_id", box.alias("b")))).alias("bs"))
    answer = F.concat(F.lit("<obj>["), F.array_join(F.filter(F.transform("bs", lambda s: s["b"]), lambda b: b.isNotNull()), ","), F.lit("]</obj>"))
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    return g.select("image_id", F.to_json(F.struct(F.col("image_id").alias("id"), F.array(turn("user", F.lit(question)), turn("assistant", answer)).alias("conversations"))).alias("record"))
