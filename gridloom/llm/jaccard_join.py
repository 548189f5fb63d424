"""N-gram Jaccard join by T-occurrence search over inverted lists.

Every document is a set of distinct word shingles. Two documents link when
``100 * |A & B| >= percent * |A | B|``, so each link needs a known number T of shared shingles.
DivideSkip splits a document's inverted lists in two. Here:

* a counting pass over all documents finds the longest lists; shingles are ordered (long last, then hash);
* documents post the first ``n - ceil(percent * n) + 1`` shingles of that order; the shuffle's sort
  merges the short lists, and pairs that can't reach T even if every skipped list held both are dropped;
* the long lists are skipped in the merge and binary-probed: candidates are verified on their whole sorted sets.

Documents with equal sets are one class from the start. Lists longer than ``short_list`` (large groups
of near copies) are searched from one pivot a list; what is still apart after that is
compared pair by pair across components, so no link between components is lost.

Null and empty texts, and texts without words, have an empty set and link with nothing. A null id has a
null component. Repeated rows give equal rows. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import Scratch, chunks, connected_components, map_exact
from .counting import PACKED, RUN_KEYS, frequent, packed, segment_bits

#: Long lists known to the tasks: the most frequent shingles, 8 bytes each. Shingles beyond it only cost time.
MOST_LONG = 500_000
#: Candidate ids up to this number (16 bytes each) are broadcast to the texts; more of them meet the texts in a shuffle.
BROADCAST_IDS = 500_000


def _runs(width: int, bits: int):
    """Packed runs of all shingles of each document; a shingle sends one entry a run, however many documents have it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            for part in chunks(frame, "text"):
                held += hashing.shingle_sets(part["text"].tolist(), width)
                size += sum(len(s) for s in held[-len(part) :])
                if size >= RUN_KEYS:
                    yield packed(np.concatenate(held).view(np.uint64), bits)
                    held, size = [], 0
        if size:
            yield packed(np.concatenate(held).view(np.uint64), bits)

    return run


def long_lists(docs: DataFrame, width: int, short_list: int, chars: int, scratch: Scratch) -> np.ndarray:
    """Fingerprints (sorted int64) of the shingles in more than ``short_list`` documents, the ``MOST_LONG`` longest at most."""
    bits = segment_bits(chars / 5)
    runs = docs.select("text").mapInPandas(_runs(width, bits), PACKED)
    found = scratch.keep(frequent(runs, short_list + 1).withColumnRenamed("n", "df"), "long")
    steps = sorted(found.groupBy(F.floor(F.log2("df") * 4).alias("step")).count().collect(), reverse=True)
    total, least = 0, None
    for step, n in steps:
        if total + n > MOST_LONG:
            break
        total, least = total + n, step
    rows = found.filter(F.floor(F.log2("df") * 4) >= least).select("mark").toArrow() if least is not None else None
    marks = np.sort(rows["mark"].to_numpy()) if rows is not None and rows.num_rows else np.empty(0, dtype=np.int64)
    return np.append(np.int64(bits), marks)


def _prefixes(width: int, percent: int, long_marks):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, marks = int(long_marks.value[0]), long_marks.value[1:]
        for frame in frames:
            for part in chunks(frame, "text"):
                out = []
                for doc, s in zip(part["id"], hashing.shingle_sets(part["text"].tolist(), width), strict=True):
                    n = len(s)
                    if not n:
                        out.append((doc, 0, 0, 0, None, 0, 0))
                        continue
                    u = s.view(np.uint64)
                    sums = hashing.mix(u ^ np.uint64(0x5851F42D4C957F2D))
                    key = (int(u.sum()) & (2**64 - 1), int(sums.sum()) & (2**64 - 1))
                    mark = ((u >> np.uint64(64 - bits)).astype(np.int64) << 32) | (u >> np.uint64(32 - bits)).astype(np.uint32).astype(np.int64)
                    late = np.zeros(n, dtype=bool)
                    if len(marks):
                        at = np.minimum(np.searchsorted(marks, mark), len(marks) - 1)
                        late = marks[at] == mark
                    order = np.concatenate((s[~late], s[late]))
                    p = n - (-(-percent * n // 100)) + 1
                    last = p - 1
                    out.append((doc, n, *(k - 2**64 if k >= 2**63 else k for k in key), order[:p], int(late.sum() + last >= n), int(order[last])))
                yield pd.DataFrame(out, columns=["id", "n", "k1", "k2", "prefix", "late", "last"])

    return run


PREFIX = "n long, k1 long, k2 long, prefix array<long>, late int, last long"


def _search(short_list: int, percent: int):
    """Over postings sorted by shingle: the pairs of each short list (kind 0), the members of each long one (kind 1)."""

    def pairs(s: np.ndarray, doc: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        at = np.concatenate(([0], np.flatnonzero(np.diff(s)) + 1)) if len(s) else np.empty(0, dtype=np.int64)
        size = np.diff(np.append(at, len(s)))
        a, b, kind = [], [], []
        for m in range(2, short_list + 1):
            first = at[size == m]
            if not len(first):
                continue
            i, j = np.triu_indices(m, 1)
            x, y = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            ok = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            x, y = doc[x[ok]], doc[y[ok]]
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
            kind.append(np.zeros(len(x), dtype=np.int32))
        if (big := size > short_list).any():
            rows = np.repeat(big, size)
            a.append(s[rows])
            b.append(doc[rows])
            kind.append(np.ones(int(rows.sum()), dtype=np.int32))
        return pd.DataFrame({"kind": np.concatenate(kind), "a": np.concatenate(a), "b": np.concatenate(b)}) if a else pd.DataFrame({"kind": [], "a": [], "b": []}).astype({"kind": "int32", "a": "int64", "b": "int64"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        spilled = None  # the shingle of a list whose members are passed on as they come
        for frame in frames:
            if spilled is not None:
                same = (frame["s"] == spilled).to_numpy()
                if same.any():
                    yield pd.DataFrame({"kind": np.int32(1), "a": frame["s"][same], "b": frame["id"][same]})
                    frame = frame[~same]
                if not len(frame):
                    continue
                spilled = None
            whole = pd.concat([*rest, frame], ignore_index=True) if rest else frame.reset_index(drop=True)
            tail = whole["s"].to_numpy() == whole["s"].iloc[-1]
            cut = len(whole) - int(tail.sum())
            if len(whole) - cut > short_list:
                yield pairs(whole["s"].to_numpy(), whole["id"].to_numpy(), whole["n"].to_numpy())
                spilled, rest = whole["s"].iloc[-1], []
            else:
                head = whole.iloc[:cut]
                if cut:
                    yield pairs(head["s"].to_numpy(), head["id"].to_numpy(), head["n"].to_numpy())
                rest = [whole.iloc[cut:]]
        for whole in rest:
            yield pairs(whole["s"].to_numpy(), whole["id"].to_numpy(), whole["n"].to_numpy())

    return run


def _sets(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in chunks(frame, "text"):
                yield pd.DataFrame({"id": part["id"].to_numpy(), "data": [s.tobytes() for s in hashing.shingle_sets(part["text"].tolist(), width)]})

    return run


def _probe(percent: int):
    """Binary probes of the shorter sorted set in the longer one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ok = []
            for x, y in zip(frame["x"], frame["y"], strict=True):
                x, y = np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield frame.loc[np.array(ok, dtype=bool), ["a", "b"]]

    return run


def verified(sets: DataFrame, pairs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The linked ones of the pairs (a, b), on whole sets (id, data)."""
    left, right = sets.select(F.col("id").alias("a"), F.col("data").alias("x")), sets.select(F.col("id").alias("b"), F.col("data").alias("y"))
    pairs = pairs.select("a", "b").distinct()
    return scratch.keep(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(_probe(percent), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, short_list: int = 32) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``; component_id is the smallest id that links reach."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    marks = spark.sparkContext.broadcast(long_lists(docs, width, short_list, chars, scratch))
    every = scratch.keep(map_exact(docs, ["id"], _prefixes(width, percent, marks), PREFIX), "prefixes")
    classes = every.filter("n > 0 and id is not null").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"))
    classes = scratch.keep(classes, "classes")
    reps = every.join(classes.select(F.col("rep").alias("id"), "n", "k1", "k2"), ["id", "n", "k1", "k2"], "left_semi").dropDuplicates(["id"])
    posts = reps.select(F.explode("prefix").alias("s"), "id", "n")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.keep(posts.repartition(parts, "s").sortWithinPartitions("s").mapInPandas(_search(short_list, percent), "kind int, a long, b long"), "found")
    skipped = found.filter("kind = 1").select(F.col("a").alias("s"), F.col("b").alias("id"))
    merged = found.filter("kind = 0").groupBy("a", "b").agg(F.count("*").alias("c"))
    meta = every.filter("n > 0 and id is not null").select("id", "n", F.size("prefix").alias("p"), "late", "last").dropDuplicates(["id"])
    meta = scratch.keep(meta.join(skipped.groupBy("id").agg(F.count("*").alias("skips")), "id", "left").na.fill(0, ["skips"]), "meta")
    # what a pair can share at most: short lists merged (c), lists skipped, and what lies past the sooner prefix
    a, b = (meta.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "p", "late", "last", "skips"))) for side in "ab")

    def reach(c: Column, skips: Column) -> Column:
        past = F.when(F.struct("late_a", "last_a") <= F.struct("late_b", "last_b"), F.col("n_a") - F.col("p_a")).otherwise(F.col("n_b") - F.col("p_b"))
        most = F.least(c + skips + past, F.col("n_a"), F.col("n_b"))
        return (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))

    likely = scratch.keep(merged.join(a, "a").join(b, "b").filter(reach(F.col("c"), F.least("skips_a", "skips_b"))).select("a", "b"), "likely")
    of = lambda comps, c: comps.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    # a pair of long lists alone: the lists it shares are counted exactly
    longs = scratch.keep(skipped.groupBy("id").agg(F.sort_array(F.collect_set("s")).alias("longs")).join(meta, "id"), "longs")
    la, lb = (longs.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "p", "late", "last", "skips", "longs"))) for side in "ab")
    both = F.array_intersect("longs_a", "longs_b")
    # whole sets of all documents that any pair may need, made again from the texts
    ids = likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).union(longs.select("id")).distinct()
    ids = scratch.keep(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    sets = scratch.keep(docs.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInPandas(_sets(width), "id long, data binary").dropDuplicates(["id"]), "sets")
    # the smallest partner of each document first, and each long list from its smallest member; that joins most of what links
    pivot = skipped.groupBy("s").agg(F.min("id").alias("a"))
    stars = skipped.join(pivot, "s").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    stars = stars.join(la, "a").join(lb, "b").filter(reach(F.size(both), F.lit(0))).select("a", "b")
    links = verified(sets, likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(stars), percent, scratch)
    comps = scratch.keep(connected_components(links, scratch), "components")
    # then all that may still join two components, each pair from the first list that it shares
    apart = likely.join(of(comps, "a"), "a", "left").join(of(comps, "b"), "b", "left").filter("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
    members = skipped.join(comps.withColumnRenamed("node", "id"), "id", "left").select("s", "id", F.coalesce("component", "id").alias("c"))
    mixed = members.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("s")
    members = members.join(mixed, "s", "left_semi")
    x = members.select(F.col("s").alias("sa"), F.col("id").alias("a"), F.col("c").alias("ca")).join(la, "a")
    y = members.select(F.col("s").alias("sb"), F.col("id").alias("b"), F.col("c").alias("cb")).join(lb, "b")
    cross = x.join(y, (F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & reach(F.lit(0), F.least("skips_a", "skips_b")) & (F.array_min(both) == F.col("sa")) & reach(F.size(both), F.lit(0))).select("a", "b")
    more = verified(sets, apart.union(cross), percent, scratch)
    if not more.isEmpty():
        comps = scratch.keep(connected_components(links.union(more), scratch), "components")
    out = every.join(classes, ["n", "k1", "k2"], "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "rep", "id")).otherwise(F.col("id")).alias("component_id"))
