"""File-drop streams over the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_drops(spark: SparkSession, folder: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they are dropped; progress is kept by the sink's checkpoint."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(folder)


def write_append(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append sink that handles all that is there and stops."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def drop_repeats(df: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def daily_statistics(df: DataFrame, ts: str, value: str, delay: str = "1 day") -> DataFrame:
    """Running statistics of each day, for streams (append mode) and batches alike."""
    src = df.withWatermark(ts, delay) if df.isStreaming else df
    g = src.groupBy(F.window(ts, "1 day").alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return g.select(F.col("w.start").alias("day"), "n", "mean", "lo", "hi")


def keep_daily_statistics(df: DataFrame, ts: str, value: str, folder: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """The running statistics as a stream: every batch adds the days that it changes, under its number; ``newest_days`` reads the last of each.

    Days stay in Spark's state until the watermark has passed them; rows that come later than ``delay`` are dropped.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/v={number}")

    return daily_statistics(df, ts, value, delay).writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_days(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows.groupBy("day").agg(F.max_by(F.struct("n", "mean", "lo", "hi"), "v").alias("_r")).select("day", "_r.*")


#: Buckets of a snapshot; its manifest has a row for each.
BUCKETS = 64


def upsert_latest(df: DataFrame, keys: list[str], order: str, folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps a snapshot of the last row of each key, in buckets by the hash of the key.

    A batch merges only the buckets that its keys fall into, writes them under its number and then a manifest (bucket, v) that tells each bucket's
    newest files; other buckets' files stay as they are. A batch that runs again writes the same.
    """
    rest = [c for c in df.columns if c not in keys]

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # BUCKETS at most
        known = manifest(spark, folder, number)
        old = [f"{folder}/rows/v={known[b]}/bucket={b}" for b in touched if b in known]
        if old:
            before = spark.read.option("basePath", f"{folder}/rows").schema(batch.schema).parquet(*old)
            batch = batch.unionByName(before.select(batch.columns))
        last = batch.groupBy(*keys, "bucket").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*", "bucket")
        last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows/v={number}")
        now = {**known, **dict.fromkeys(touched, number)}
        spark.createDataFrame(sorted(now.items()), "bucket int, v long").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest/v={number}")

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, int]:
    """Bucket -> number of the batch that wrote it last, of the newest manifest (before a batch's own number)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(f.getPath().getName()[2:]) for f in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if files.exists(path) else []
    found = [n for n in found if before is None or n < before]
    if not found:
        return {}
    return {r["bucket"]: r["v"] for r in spark.read.schema("bucket int, v long").json(f"{folder}/manifest/v={max(found)}").collect()}


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot that the newest manifest lists."""
    paths = [f"{folder}/rows/v={v}/bucket={b}" for b, v in manifest(spark, folder).items()]
    return spark.read.option("basePath", f"{folder}/rows").parquet(*paths).drop("v", "bucket")
