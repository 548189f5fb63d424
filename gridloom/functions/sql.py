"""The column functions as functions of Spark SQL, so that plain SQL text can call them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import boxes as bx
from . import pixel as px


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    return 2 * 6371.0 * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))


def box_iou(x1a: Column, y1a: Column, x2a: Column, y2a: Column, x1b: Column, y1b: Column, x2b: Column, y2b: Column) -> Column:
    names = ("x1", "y1", "x2", "y2")
    return bx.iou(dict(zip(names, (x1a, y1a, x2a, y2a), strict=True)), dict(zip(names, (x1b, y1b, x2b, y2b), strict=True)))


#: Name -> (column function, names of its double arguments).
FUNCTIONS = {
    "ndvi": (px.ndvi, ("red", "nir")),
    "ndwi": (px.ndwi, ("green", "nir")),
    "nbr": (px.nbr, ("nir", "swir2")),
    "box_iou": (box_iou, ("x1a", "y1a", "x2a", "y2a", "x1b", "y1b", "x2b", "y2b")),
    "haversine_km": (haversine_km, ("lon1", "lat1", "lon2", "lat2")),
}


def statement(spark: SparkSession, name: str) -> str:
    """CREATE TEMPORARY FUNCTION of a column function; its body is the SQL of the column that the function makes of its arguments, as Spark resolves it."""
    make, arguments = FUNCTIONS[name]
    row = spark.range(0).select(*(F.lit(None).cast("double").alias(a) for a in arguments))
    made = row.select(make(*(F.col(a) for a in arguments)).cast("double").alias("made"))
    body = made._jdf.queryExecution().analyzed().expressions().head().child().sql()
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{a} DOUBLE' for a in arguments)}) RETURNS DOUBLE RETURN {body}"


def register(spark: SparkSession) -> None:
    """Make all functions known to the session. Their bodies are expressions, so plans that call them have no Python."""
    for name in FUNCTIONS:
        spark.sql(statement(spark, name))
