"""Dataset curation: splits, sampling, label resolution, release tables, histogram matching, scoring surface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import placed, running_sums
from .rounds import Rounds

#: Count rules of the exact splits: (train, validation, test) from the number of rows.
SPLIT_RULES: dict[str, Callable[[int], tuple[int, int, int]]] = {
    "truncate": lambda n: (int(n * 0.7), int(n * 0.2), n - int(n * 0.7) - int(n * 0.2)),
    "round": lambda n: (n - round(n * 0.2) - round(n * 0.1), round(n * 0.2), round(n * 0.1)),
    "test_first": lambda n: (n - int(n * 0.1) - int(n * 0.2), int(n * 0.2), int(n * 0.1)),
    "holdout": lambda n: (int(n * 0.8), min(max(1, (n - int(n * 0.8)) // 2), max(1, n - 1)), n - int(n * 0.8) - min(max(1, (n - int(n * 0.8)) // 2), max(1, n - 1))),
    "test_least_one": lambda n: (n - max(1, int(n * 0.1)) - int(n * 0.2), int(n * 0.2), max(1, int(n * 0.1))),
    "half_up": lambda n: (n - max(1, int(0.2 * n + 0.5)), max(1, int(0.2 * n + 0.5)), 0),
    "thirds": lambda n: (n // 3, n // 3, n // 3) if n % 3 == 0 else (round(n * 0.7), max(1, round(n * 0.2)), n - round(n * 0.7) - max(1, round(n * 0.2))),
}


def seeded_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def exact_split(df: DataFrame, key: str, rule: str = "truncate", seed: int = 42, buckets: int = 256) -> DataFrame:
    """Exact counts in hash order. Ranks come from bucket offsets, so no single task sorts all rows."""
    hashed = df.withColumn("_h", seeded_order(key, seed)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_m"))
    offsets = sizes.select("_b", (F.sum("_m").over(Window.orderBy("_b")) - F.col("_m")).alias("_o"))  # 256 rows
    n = df.count()
    train, val, _ = SPLIT_RULES[rule](n)
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) + F.col("_o")
    out = hashed.join(F.broadcast(offsets), "_b").withColumn("_r", rank)
    return out.withColumn("split", F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + val, "val").otherwise("test")).drop("_h", "_b", "_o", "_r")


def bucket_split(df: DataFrame, key: str, weights: tuple[float, float, float] = (0.9, 0.1, 0.0), seed: int = 0) -> DataFrame:
    """Independent split by hash thresholds."""
    u = F.conv(F.substring(seeded_order(key, seed), 1, 8), 16, 10).cast("double") / 2.0**32
    return df.withColumn("split", F.when(u < weights[0], "train").when(u < weights[0] + weights[1], "val").otherwise("test"))


def sample_per_split(df: DataFrame, split: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows of each split in seeded order. Each of 64 parts of a split keeps its first ones before they meet."""
    order = [seeded_order(key, seed), F.col(key)]
    part = F.pmod(F.xxhash64(seeded_order(key, seed)), F.lit(64))
    first = df.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy(split, "_part").orderBy(*order))).filter(F.col("_n") <= n)
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(split).orderBy(*order))).filter(F.col("_n") <= n).drop("_n", "_part")


def oversample(df: DataFrame, rare: Column, variants: int = 7, augmented: Column | None = None) -> DataFrame:
    """Older augmented rows go; rows of the rare class get numbered variants besides themselves (variant 0)."""
    base = df.filter(~augmented) if augmented is not None else df
    return base.withColumn("variant", F.explode(F.when(rare, F.sequence(F.lit(0), F.lit(variants))).otherwise(F.array(F.lit(0)))))


def disagreements(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))


def coco_tables(regions: DataFrame, classes: DataFrame) -> DataFrame:
    """Annotations with running ids over images then regions; background and unknown classes are skipped; boxes truncate."""
    rows = regions.join(classes, "class_name")
    per_image = rows.groupBy("image_id").agg(F.count("*").alias("_m"))
    base = running_sums(placed(per_image, ["image_id"], Rounds(regions.sparkSession, "coco")), [], {"_end": "_m"}).select("image_id", (F.col("_end") - F.col("_m")).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("region_id")) + F.col("_o")
    return rows.join(base, "image_id").select(rank.cast("long").alias("id"), "image_id", "category_id", "region_id", F.col("bx").cast("int").alias("x"), F.col("bv").cast("int").alias("y"), F.col("bw").cast("int").alias("w"), F.col("bh").cast("int").alias("h"), (F.col("bw") * F.col("bh")).alias("area"))


def release_rows(qa: DataFrame, split: str, task: Column) -> DataFrame:
    """Question and answer rows; empty ones are skipped, path slashes turn."""
    keep = (F.length(F.trim("question")) > 0) & (F.length(F.trim("answer")) > 0)
    path = F.replace(F.concat(F.lit("images/"), F.col("sample_id").cast("string"), F.lit(".png")), F.lit("/"), F.lit("\\"))
    return qa.filter(keep).select("sample_id", "item_no", "type", path.alias("path"), F.lit(split).alias("split"), task.alias("task"), F.length("question").alias("n_question"), F.length("answer").alias("n_answer"))


def validate_batches(qa: DataFrame, least: int) -> DataFrame:
    """Per sample: counts by type and the rules that are broken."""
    kinds = ("qa", "mcq", "caption")
    c = qa.groupBy("sample_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds), F.count_if(F.length(F.trim("answer")) == 0).alias("n_empty"))
    rules = F.array(F.when(F.col("n") < least, F.lit("too_few")), *(F.when(F.col(f"n_{k}") == 0, F.lit(f"no_{k}")) for k in kinds), F.when(F.col("n_empty") > 0, F.lit("empty_answer")))
    return c.withColumn("broken", F.array_join(F.array_compact(rules), ","))


def clean_verdicts(df: DataFrame, valid: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Region id from a number or the first digits of the text; ids must exist; unknown classes become ''."""
    found = F.coalesce(F.expr("try_cast(raw_id as bigint)"), F.expr("try_cast(nullif(regexp_extract(raw_id, '[0-9]+', 0), '') as bigint)"))
    out = df.withColumn("region_id", found).join(valid, "region_id", "left_semi")
    return out.withColumn("verdict", F.when(F.col("verdict").isin(*classes), F.col("verdict")).otherwise(""))


def score_batches(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], batch: int = 50, retries: int = 2) -> DataFrame:
    """Adds ``result`` and ``error``. A failing batch is tried again, then reported row by row and not fatal."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch].copy()
                error = None
                for _ in range(retries + 1):
                    try:
                        part["result"], error = scorer(part).astype(str).to_numpy(), None
                        break
                    except Exception as e:  # the scorer is the user's
                        error = f"{type(e).__name__}: {e}"
                if error is not None:
                    part["result"] = None
                part["error"] = error
                yield part

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, result string, error string")


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def voted_class(images: DataFrame, prompts: DataFrame, key: str = "vec_id") -> DataFrame:
    """Per class the best cosine over its prompts, then the best class. The prompt table is a fixed small set of class names."""
    p = prompts.groupBy("class_id").agg(F.collect_list(unit(F.col("embedding"))).alias("vs"))
    rows = images.select(key, unit(F.col("embedding")).alias("u")).crossJoin(F.broadcast(p))
    scored = rows.select(key, "class_id", F.array_max(F.transform("vs", lambda v: dot(F.col("u"), v))).alias("score"))
    return scored.groupBy(key).agg(F.max_by(F.col("class_id"), F.struct(F.bround("score", 9), -F.col("class_id"))).alias("class_id"), F.max("score").alias("score"))


def change_record(df: DataFrame) -> DataFrame:
    """JSON record with the optional fields only where present."""
    return df.select("region_id", F.to_json(F.struct("image_id", "t1_class", "t2_class", F.bround("confidence", 4).alias("confidence")), {"ignoreNullFields": "true"}).alias("record"))


def scaled_cdf(hist: DataFrame) -> DataFrame:
    """(band, bin, s): exclusive cumulative counts scaled by 255, the last bin by 256; bin 0 counts once."""
    h = hist.withColumn("cnt", F.when(F.col("bin") == 0, F.lit(1)).otherwise(F.col("cnt")))
    w = Window.partitionBy("band").orderBy("bin")
    run = F.coalesce(F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total, last = F.sum("cnt").over(Window.partitionBy("band")), F.max("bin").over(Window.partitionBy("band"))
    return h.select("band", "bin", (run * F.when(F.col("bin") == last, 256.0).otherwise(255.0) / total).alias("s"))


def nearest_mapping(src: DataFrame, dest: DataFrame) -> DataFrame:
    """Each destination bin to the source bin of nearest cumulative share, the lowest of ties. Bins are a fixed number a band."""
    a, b = scaled_cdf(src).select("band", F.col("bin").alias("from_bin"), F.col("s").alias("sa")), scaled_cdf(dest).select("band", F.col("bin").alias("to_bin"), F.col("s").alias("sb"))
    return b.join(a, "band").groupBy("band", "to_bin").agg(F.min_by("from_bin", F.struct(F.bround(F.abs(F.col("sa") - F.col("sb")), 9), F.col("from_bin"))).alias("from_bin"))


def group_mapping(src: DataFrame, dest: DataFrame, scale: int) -> DataFrame:
    """(band, from_bin, to_bin): source bins between two nearest matches share the destination bins between them, linearly.

    Each destination bin has its nearest source bin; a nearest bin 0 counts as the one before. Where that changes, a group ends: the source
    bins since the last group fall on the destination bins since the last group. Bins past the last group go to the top, others to 0.
    """
    near = nearest_mapping(src, dest).select("band", F.col("to_bin").alias("x"), F.nullif("from_bin", F.lit(0)).alias("y"))
    w = Window.partitionBy("band").orderBy("x")  # a fixed number of bins a band
    near = near.withColumn("y", F.coalesce(F.last("y", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    ends = near.withColumn("_was", F.lag("y", 1, 0).over(w)).filter(F.col("y") != F.col("_was"))
    ends = ends.select("band", "x", "y", F.coalesce(F.lag("x").over(w) + 1, F.lit(0)).alias("x0"), F.coalesce(F.lag("y").over(w) + 1, F.lit(0)).alias("y0"))
    slope = (F.col("y") - F.col("y0")) / (F.col("x") - F.col("x0") + 1e-7)
    even = F.bround((F.col("i") - (F.col("y") - slope * F.col("x"))) / (slope + 1e-7) + 0.5, 9)
    rows = ends.filter("y0 <= y").withColumn("i", F.explode(F.sequence("y0", "y")))
    value = F.when(F.col("y") == F.col("y0"), (F.col("x0") + F.col("x")) / 2 + 0.5).when(F.col("x0") == F.col("x"), F.col("x").cast("double")).otherwise(even)
    found = rows.select("band", "i", value.cast("int").alias("v")).groupBy("band", "i").agg(F.max("v").alias("v"))
    bins = near.groupBy("band").agg(F.max("y").alias("_top")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(scale - 1))))
    rest = F.when(F.col("i") > F.col("_top"), scale - 1).otherwise(0)
    return bins.join(found, ["band", "i"], "left").select("band", F.col("i").alias("from_bin"), F.least(F.coalesce("v", rest), F.lit(scale - 1)).alias("to_bin"))


def merge_lists(df: DataFrame, main: str, typed: dict[str, str]) -> DataFrame:
    """One row an ``item`` of the main list, then of the typed lists in their order; items of those without a type get the list's."""
    given = lambda c, kind: F.transform(F.coalesce(c, F.array()), lambda x: x.withField("type", F.coalesce(x["type"], F.lit(kind))))
    lists = [F.coalesce(main, F.array()), *(given(F.col(c), k) for c, k in typed.items())]
    rest = [c for c in df.columns if c not in (main, *typed)]
    return df.select(*rest, F.explode(F.concat(*lists)).alias("item"))


def apply_mapping(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapped values by band; 0 is never remapped. A mapping has a fixed number of bins a band."""
    out = df.join(mapping.select("band", F.col("to_bin").alias("v"), F.col("from_bin").alias("_m")), ["band", "v"], "left")
    return out.withColumn("v", F.when(F.col("v") == 0, 0).otherwise(F.coalesce("_m", "v"))).drop("_m")


def interpolated_mapping(src: DataFrame, ref: DataFrame) -> DataFrame:
    """(value, mapped): source values take the reference value at the same cumulative share, linearly in between and flat outside.

    Both distributions are swept once in order of their share.
    """
    def cdf(df: DataFrame) -> DataFrame:
        g = df.groupBy("v").agg(F.count("*").alias("n"))
        return g.select("v", (F.sum("n").over(Window.orderBy("v")) / F.sum("n").over(Window.partitionBy())).alias("q"))  # distinct values only

    a, b = cdf(src).select("q", F.lit(None).cast("double").alias("rv"), F.col("v").alias("sv")), cdf(ref).select("q", F.col("v").cast("double").alias("rv"), F.lit(None).cast(src.schema["v"].dataType).alias("sv"))
    both = a.union(b)
    w = Window.orderBy("q", F.col("sv").isNotNull())
    point = F.when(F.col("rv").isNotNull(), F.struct("q", "rv"))
    lo = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumns({"lo": lo, "hi": hi}).filter("sv is not null")
    at = F.when(F.col("lo").isNull(), F.col("hi.rv")).when(F.col("hi").isNull() | (F.col("hi.q") == F.col("lo.q")), F.col("lo.rv"))
    return rows.select(F.col("sv").alias("value"), at.otherwise(F.col("lo.rv") + (F.col("q") - F.col("lo.q")) * (F.col("hi.rv") - F.col("lo.rv")) / (F.col("hi.q") - F.col("lo.q"))).alias("mapped"))


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.filter(F.col(key).isNotNull()).select(key), key, "left_anti")
