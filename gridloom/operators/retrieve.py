"""Chunking, vector search, reranking and context text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curate import score_batches, unit
from .rounds import Rounds


def chunks(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Fixed stride chunks of each whole text."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1 - overlap, F.lit(0)), F.lit(stride))
    return df.filter(F.length(text) > 0).select(key, text, F.posexplode(starts).alias("chunk_no", "_s")).select(key, "chunk_no", F.substring(F.col(text), F.col("_s") + 1, F.lit(size)).alias("chunk"))


def packed(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring parts joined up to ``size`` characters; each chunk begins with the last parts before it, ``overlap`` characters at most."""
    held: list[str] = []
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            yield "".join(held)
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    if held:
        yield "".join(held)


def cut_text(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[str]:
    """Parts at the first separator that occurs (it begins the part after it), longer ones cut again by the separators after that."""
    at = next((i for i, s in enumerate(separators) if s and s in text), len(separators) - 1)
    mark = separators[at]
    first, *more = text.split(mark) if mark else ["", *text]
    parts = [p for p in (first, *(mark + x for x in more)) if p]
    short: list[str] = []
    for part in parts:
        if len(part) < size:
            short.append(part)
            continue
        yield from packed(short, size, overlap)
        short = []
        if at + 1 < len(separators):
            yield from cut_text(part, size, overlap, separators[at + 1 :])
        else:
            yield part
    yield from packed(short, size, overlap)


def recursive_chunks(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", "。", " ", "")) -> DataFrame:
    """(key, chunk_no, chunk): chunks of whole paragraphs, lines, sentences or words of each text, ``size`` characters at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[text], strict=True):
                found = [c for c in (x.strip() for x in cut_text(t, size, overlap, separators)) if c]
                rows += [(k, i, c) for i, c in enumerate(found)]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return df.filter(F.length(text) > 0).select(key, text).mapInPandas(run, f"`{key}` {kind}, chunk_no int, chunk string")


def upsert_vectors(store: DataFrame, fresh: DataFrame, key: str, embed: Callable[[pd.DataFrame], pd.Series], batch: int = 50, retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """The store (key, vector) with the fresh rows' vectors put in, and the rows of failed batches (key, error), whose old vectors stay.

    ``embed`` gives a JSON list of numbers for each row of a batch.
    """
    made = score_batches(fresh, embed, batch, retries)
    done = made.filter(F.col("error").isNull()).select(key, F.from_json("result", "array<double>").alias("vector"))
    return store.join(done.select(key), key, "left_anti").unionByName(done), made.filter(F.col("error").isNotNull()).select(key, "error")


#: Centres that vectors gather around (a bounded sample goes to the driver), vectors of a block and queries of a chunk, on average.
CENTRES, BLOCK, CHUNK = 256, 4096, 4096
#: Scores that a task holds at a time, and rows of a query and a centre.
SCORES, ROWS = 1 << 21, 1 << 15
#: Distances are compared with this slack, so rounding never skips a block.
SLACK = 1e-6


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 1))


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all unit vectors of a from all of b."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def _gathered(centres: np.ndarray):
    """Each vector's nearest centre and its distance."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                far = _far(_stacked(frame["v"]), centres)
                near = far.argmin(axis=1)
                yield pd.DataFrame({"centre": near.astype(np.int64), "h": frame["h"], "vec_id": frame["vec_id"], "v": frame["v"], "far": far[np.arange(len(far)), near]})

    return run


def _reached(centres: np.ndarray, radius: np.ndarray, chunks_: int):
    """The centres that may hold a vector nearer to a query than ``within``; without one the nearest that has vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            step = max(1, ROWS // len(centres))  # a query may reach all centres, so its vector goes out that often
            for part in (frame.iloc[n : n + step] for n in range(0, len(frame), step)):
                far = np.where(radius < 0, np.inf, _far(_stacked(part["q"]), centres))
                within = part["within"].to_numpy()
                hit = far - radius <= within[:, None] + SLACK
                hit[np.isnan(within)] = far[np.isnan(within)] == far[np.isnan(within)].min(axis=1, keepdims=True)
                i, c = np.nonzero(hit & np.isfinite(far))
                yield pd.DataFrame({"centre": c.astype(np.int64), "chunk": part["h"].to_numpy()[i] % chunks_, "query_id": part["query_id"].to_numpy()[i], "q": part["q"].to_numpy()[i], "within": within[i], "gap": far[i, c]})

    return run


def _best(k: int):
    """The k best vectors of a block for each query whose reach it is in."""

    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if len(block):
            queries = queries[~(queries["gap"] - block["far"].max() > queries["within"] + SLACK)]
        if not len(queries) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        block = block.sort_values("vec_id", kind="stable")
        v, ids = _stacked(block["v"]), block["vec_id"].to_numpy()
        step = max(1, SCORES // len(v))
        found = []
        for part in (queries.iloc[n : n + step] for n in range(0, len(queries), step)):
            score = np.round(_stacked(part["q"]) @ v.T, 9)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(part)), top.shape[1])
            found.append(pd.DataFrame(dict(zip(names, (part["query_id"].to_numpy()[row], ids[top.ravel()], score[row, top.ravel()]), strict=True))))
        return pd.concat(found, ignore_index=True)

    return run


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 4, least: float | None = None, centres: int = CENTRES, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k largest cosines, ties to the smaller id; exact.

    Vectors gather in blocks around centres. A query searches its nearest centre's blocks first; with the k-th score found there it needs only
    blocks that can hold a nearer vector: by the triangle inequality those whose centre is no farther than that distance and their radius
    together. Blocks and chunks of queries meet in cells of bounded size, and only k rows a query leave a cell. Vectors that are null are left out.
    """
    rounds = Rounds(vectors.sparkSession, "search")
    v = vectors.filter(F.col("embedding").isNotNull()).select("vec_id", unit(F.col("embedding")).alias("v"), F.abs(F.xxhash64("vec_id") % (1 << 40)).alias("h"))
    q = queries.filter(F.col("embedding").isNotNull()).select(F.col("prompt_id").alias("query_id"), unit(F.col("embedding")).alias("q"), F.abs(F.xxhash64("prompt_id") % (1 << 40)).alias("h"))
    sample = v.orderBy("h", "vec_id").limit(centres).collect()
    scheme = "query_id {}, vec_id {}, score double".format(*(df.schema[c].dataType.simpleString() for df, c in ((q, "query_id"), (v, "vec_id"))))
    if not sample:
        return vectors.sparkSession.createDataFrame([], f"{scheme}, rank int")
    middle = np.array([r["v"] for r in sample])
    chunks_ = max(1, -(-q.count() // chunk))
    kind = v.schema["vec_id"].dataType.simpleString()
    blocks = rounds.keep(v.mapInPandas(_gathered(middle), f"centre long, h long, vec_id {kind}, v array<double>, far double"), "blocks")
    radius, splits = np.full(len(middle), -1.0), [1] * len(middle)
    for r in blocks.groupBy("centre").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row a centre
        radius[r["centre"]], splits[r["centre"]] = r["far"], -(-r["n"] // block)
    parts = F.get(F.array(*(F.lit(n).cast("long") for n in splits)), F.col("centre").cast("int"))  # of a centre's own vectors
    blocks = blocks.withColumn("part", F.col("h") % parts).drop("h")
    asked = f"centre long, chunk long, query_id {q.schema['query_id'].dataType.simpleString()}, q array<double>, within double, gap double"

    def search(these: DataFrame, but: DataFrame | None) -> DataFrame:
        reach = these.mapInPandas(_reached(middle, radius, chunks_), asked)
        if but is not None:
            reach = reach.join(but, ["query_id", "centre"], "left_anti")
        cells = reach.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        spread = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks_ - 1).cast("long"))))
        keys = ["centre", "part", "chunk"]
        found = cells.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(_best(k), scheme)
        return top_of(found)

    def top_of(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    first = q.withColumn("within", F.lit(None).cast("double"))
    near = rounds.keep(first.mapInPandas(_reached(middle, radius, chunks_), asked).select("query_id", "centre"), "near")
    start = rounds.keep(search(first, None).drop("rank"), "first")
    # the distance of the k-th vector found; with fewer found anything may be nearer (unit vectors are 2 apart at most)
    bound = start.groupBy("query_id").agg(F.when(F.count("*") == k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score")))).otherwise(3.0).alias("within"))
    rest = search(q.join(bound, "query_id", "left").withColumn("within", F.coalesce("within", F.lit(3.0))), near)
    out = top_of(start.union(rest.drop("rank")))
    return out if least is None else out.filter(F.col("score") >= least)


def rerank(hits: DataFrame, second: Column, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("second"), "rank")
    return hits.withColumn("second", second).withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k)


def context(hits: DataFrame, source: Column) -> DataFrame:
    """Numbered source lines of each query, in rank order."""
    line = F.format_string("[%d] %s (score %.3f)", F.col("rank"), source, F.col("score"))
    g = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("ls"))
    return g.select("query_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("context"))
