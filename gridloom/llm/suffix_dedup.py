"""Repeated-substring removal by two-stage suffix sorting.

A byte is removed when a ``length``-byte string that covers it also starts anywhere else, in the same
document or another. Suffix sorting all bytes would ship each suffix's text; two-stage sorting needs only some
suffixes sorted directly:

* in each ``length``-byte window, the suffix whose ``gram``-byte head is smallest (by hash, leftmost on ties)
  is an anchor: smaller than its successors within the window. Equal windows have their anchor at the same place;
* suffixes at anchors with equal heads are sorted directly, and adjacent common prefixes computed;
* all other suffixes are induced: a suffix one byte to the left is ordered by that byte and by the order of
  its successor, so stable bucket scans to the left give the order of each window's start, and
  the common prefix of neighbours follows from the successors' (range minimum).

Anchors whose head occurs once are dropped before any text moves. Copies of whole documents are one
document in the search; they are known to be repeated as a whole.

Anchors of one head are sorted together, so a head at very many places is dealt out first: places with equal surroundings are one
place, and the windows that start a to b bytes left of an anchor share the bytes between the last start and the first end, by
which they are told apart. The range a to b is quartered until each part is small (see ``_deal``).

Null and empty texts have no bytes. Texts shorter than ``length`` keep all bytes. Repeated rows count as copies
(each is a place where a string starts). A null id is a document like any other. Only id and text columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import Scratch, chunks, map_exact

#: Anchors sorted at once in a task.
BATCH_ANCHORS = 20_000
#: A head with more anchors is dealt out by the bytes around them.
HEAD_ANCHORS = 1_000


def anchors(raw: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, position, head hash, most left, least left) of each anchor; windows start most..least bytes left of it."""
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    n = len(data)
    empty = np.empty(0, dtype=np.int64)
    if n < length:
        return empty, empty, empty, empty, empty
    sums = hashing.prefix_sums(data)
    at = np.arange(n - gram + 1)
    head = hashing.spans(sums, at, at + gram)
    bits = max(8, int(n).bit_length())
    key = (head >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    width = length - gram + 1
    pad = -len(key) % width
    grid = np.concatenate((key, np.full(pad, 2**64 - 1, dtype=np.uint64))).reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.concatenate([np.arange(b, b + s - length + 1) for b, s in zip(begin, sizes, strict=True) if s >= length] or [empty])
    if not len(starts):
        return empty, empty, empty, empty, empty
    best = np.minimum(right[starts], left[starts + width - 1]) & np.uint64((1 << bits) - 1)
    best = best.astype(np.int64)
    doc = np.searchsorted(begin, starts, side="right") - 1
    edge = np.flatnonzero((np.diff(best) != 0) | (np.diff(doc) != 0))
    first, last = np.concatenate(([0], edge + 1)), np.concatenate((edge, [len(best) - 1]))
    where = best[first]
    return doc[first], where - begin[doc[first]], head[where].view(np.int64), where - starts[first], where - starts[last]


def _heads(length: int, gram: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in chunks(frame, "text"):
                raw = [(t or "").encode() for t in part["text"]]
                doc, _, head, _, _ = anchors(raw, length, gram)
                yield pd.DataFrame({"h": head, "key": part["key"].to_numpy()[doc]})

    return run


def _contexts(length: int, gram: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in chunks(frame, "text"):
                raw = [(t or "").encode() for t in part["text"]]
                keys, wanted = part["key"].tolist(), [set(np.asarray(h).tolist()) for h in part["heads"]]
                rows = [(h, keys[d], int(p), int(far), int(near), raw[d][p - far : p + length - near]) for d, p, h, far, near in zip(*(x.tolist() for x in anchors(raw, length, gram)), strict=True) if h in wanted[d]]
                yield pd.DataFrame(rows, columns=["h", "key", "pos", "far", "near", "ctx"])

    return run


CONTEXT = "h long, key string, pos long, far int, near int, ctx binary"


def _phrases(length: int):
    """Anchors with equal surroundings in a document (a phrase said over and over) are one row; the bytes that they cover are rows without ctx, from pos to stop."""
    same = ["h", "key", "far", "near", "ctx"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            again = frame[frame.duplicated(same, keep=False)]
            yield frame[~frame.duplicated(same)].assign(stop=0)
            if len(again):
                spans = pd.DataFrame({"key": again["key"], "pos": again["pos"] - again["far"], "stop": again["pos"] - again["near"] + length}).sort_values(["key", "pos"])
                # spans that meet are one
                most = spans.groupby("key")["stop"].cummax()
                new = (spans["key"] != spans["key"].shift()) | (spans["pos"] > most.shift())
                yield spans.groupby(new.cumsum()).agg({"key": "first", "pos": "min", "stop": "max"}).assign(h=0, far=0, near=0, ctx=None)

    return run


def _deal(scratch: Scratch, rows: DataFrame, length: int, most: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(anchors whose ``h`` has at most ``most`` rows, spans found on the way, tables that both read) of the anchors ``rows`` of common heads.

    Rows with the same h and surroundings show that all their windows are repeated; one of them stays, for others to meet.
    If an h still has too many rows, the range of starts is quartered: equal windows that start a to b bytes left of their
    anchors have the same bytes from a left of it on, ``length - (b - a)`` of them. A part of one start is one window, which is one row.
    """
    rows = rows.withColumns({"a": F.lit(0), "b": F.lit(length - 1)})
    ready, spans, tables = [], [], []
    for _ in range(1 + ((length - 1).bit_length() + 1) // 2):
        name = F.concat(*(F.concat(F.col(c).cast("string"), F.lit(",")) for c in ("h", "far", "near")))
        named = rows.withColumns({"body": F.sha2(F.concat(F.encode(name, "utf-8"), "ctx"), 256), "place": F.xxhash64("key", "pos")})
        equal = scratch.keep(named.groupBy("body").agg(F.count("*").alias("n"), F.min("place").alias("first")).filter("n > 1"), "equal")
        wide = F.broadcast(equal.filter(F.col("n") > most))  # so no task gets all rows of one body
        rest = named.join(wide, "body", "left_anti").join(equal.filter(F.col("n") <= most), "body", "left")
        told = scratch.keep(named.join(wide, "body").unionByName(rest), "told")
        scratch.drop(equal, rows)
        tables.append(told)
        spans.append(told.filter("n is not null").select("key", (F.col("pos") - F.col("far")).alias("start"), (F.col("pos") - F.col("near") + length).alias("stop")))
        told = told.filter("n is null or place = first").select("h", "key", "pos", "far", "near", "ctx", "a", "b")
        big = scratch.keep(told.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("h"), "big")
        ready.append(told.join(F.broadcast(big), "h", "left_anti"))
        if big.isEmpty():
            break
        step = F.ceil((F.col("b") - F.col("a") + 1) / 4).cast("int")
        quarters = F.array(*(F.struct((F.col("a") + i * step).alias("a"), F.least("b", F.col("a") + (i + 1) * step - 1).alias("b")) for i in range(4)))
        rows = told.join(F.broadcast(big), "h").withColumn("part", F.explode(quarters)).withColumns({"a": F.col("part.a"), "b": F.col("part.b")})
        rows = rows.withColumns({"from": F.greatest("near", "a"), "to": F.least("far", "b")}).filter("from <= to")
        rows = rows.withColumn("ctx", F.expr(f"substring(ctx, far - to + 1, to + {length} - from)"))
        rows = rows.withColumn("h", F.xxhash64("h", "a", F.expr(f"substring(ctx, to - a + 1, {length} - (b - a))")))
        rows = scratch.keep(rows.select("h", "key", "pos", F.col("to").alias("far"), F.col("from").alias("near"), "ctx", "a", "b"), "quarters")
    else:
        ready.append(rows)  # only if hashes clash
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return union(ready).drop("a", "b"), union(spans), tables


def repeated_windows(h: np.ndarray, ctx: list[bytes], far: np.ndarray, near: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(anchor, d1, d2): the windows that start d1..d2 bytes left of that anchor occur at another anchor too."""
    n = len(h)
    span = length + 0
    right = np.zeros((n, span), dtype=np.uint8)
    left = np.zeros((n, int(far.max()) + 1), dtype=np.uint8)
    for i, c in enumerate(ctx):
        x = np.frombuffer(c, dtype=np.uint8)
        f = int(far[i])
        right[i, : len(x) - f] = x[f:]
        left[i, :f] = x[:f][::-1]
    size = np.array([len(c) for c in ctx]) - far
    # stage 1: sort the anchors' suffixes directly, then adjacent common prefixes
    order = np.argsort(right.view(f"S{span}").ravel(), kind="stable")
    order = order[np.argsort(h[order], kind="stable")]
    other = right[order[1:]] != right[order[:-1]]
    same = np.where(other.any(axis=1), other.argmax(axis=1), span)
    same = np.minimum(same, np.minimum(size[order[1:]], size[order[:-1]]))
    group = np.concatenate(([0], np.cumsum(np.diff(h[order]) != 0)))
    lcp = np.concatenate(([0], np.where(np.diff(group) == 0, same, 0)))
    # stage 2: induce the suffixes d bytes to the left
    found_i: list[np.ndarray] = []
    found_d: list[np.ndarray] = []
    for d in range(int(far.max()) + 1):
        after = np.append(lcp[1:], 0)
        best = np.maximum(lcp, after)
        hit = order[(best >= length - d) & (near[order] <= d) & (d <= far[order])]
        if len(hit):
            found_i.append(hit)
            found_d.append(np.full(len(hit), d))
        keep = (far[order] > d) & (best >= length - far[order])
        if not keep.any():
            break
        old = np.flatnonzero(keep)
        kept = order[old]
        byte = left[kept, d]
        key = group[old] * 256 + byte
        if (np.diff(key) < 0).any():
            by = np.argsort(key, kind="stable")
            old, kept, key = old[by], kept[by], key[by]
        joined = np.diff(key) == 0
        new = np.zeros(len(old), dtype=np.int64)
        a, b = old[:-1][joined], old[1:][joined]
        value = lcp[b].copy()
        far_apart = np.flatnonzero(b - a > 1)
        if len(far_apart):
            pairs = np.column_stack((a[far_apart] + 1, b[far_apart] + 1)).ravel()
            value[far_apart] = np.minimum.reduceat(np.append(lcp, 0), pairs)[::2]
        new[1:][joined] = value
        order, lcp, group = kept, new, np.concatenate(([0], np.cumsum(~joined)))
    if not found_i:
        return []
    i, d = np.concatenate(found_i), np.concatenate(found_d)
    by = np.lexsort((d, i))
    i, d = i[by], d[by]
    edge = np.flatnonzero((np.diff(i) != 0) | (np.diff(d) != 1))
    first, last = np.concatenate(([0], edge + 1)), np.concatenate((edge, [len(i) - 1]))
    return list(zip(i[first].tolist(), d[first].tolist(), d[last].tolist(), strict=True))


def _induce(length: int):
    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        runs = repeated_windows(frame["h"].to_numpy(), frame["ctx"].tolist(), frame["far"].to_numpy(), frame["near"].to_numpy(), length)
        key, pos = frame["key"].tolist(), frame["pos"].tolist()
        return pd.DataFrame([(key[i], pos[i] - d2, pos[i] - d1 + length) for i, d1, d2 in runs], columns=["key", "start", "stop"]).astype({"start": "int64", "stop": "int64"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0
        for frame in frames:
            held.append(frame)
            count += len(frame)
            if count < BATCH_ANCHORS:
                continue
            whole = pd.concat(held, ignore_index=True)
            h = whole["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            for a in range(0, cut, BATCH_ANCHORS):
                lo, hi = (int(np.searchsorted(h, h[a])) if a else 0), min(cut, a + BATCH_ANCHORS)
                hi = int(np.searchsorted(h, h[hi])) if hi < cut else cut
                if hi > lo:
                    yield solve(whole.iloc[lo:hi])
            held = [whole.iloc[cut:]]
            count = 0 if cut == 0 and count < 10 * BATCH_ANCHORS else len(held[0])
        if held:
            whole = pd.concat(held, ignore_index=True)
            if len(whole):
                yield solve(whole)

    return run


def _cut(text: str | None, spans) -> tuple[int, int, int, str]:
    raw = (text or "").encode()
    mark = np.zeros(len(raw) + 1, dtype=np.int32)
    for s in spans:
        mark[s["start"]] += 1
        mark[s["stop"]] -= 1
    gone = np.cumsum(mark[:-1]) > 0
    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
    edges = np.diff(np.concatenate(([0], gone.astype(np.int8))))
    return len(raw), int(gone.sum()), int((edges == 1).sum()), kept


def _results(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for text, spans, whole in zip(frame["text"], frame["spans"], frame["whole"], strict=True):
            if whole:
                n = len((text or "").encode())
                rows.append((n, n, 1, b""))
            elif spans is None or not len(spans):
                raw = (text or "").encode()
                rows.append((len(raw), 0, 0, raw))
            else:
                rows.append(_cut(text, spans))
        # code points left: bytes that don't continue one
        left = [int((np.frombuffer(r[3], dtype=np.uint8) & 0xC0 != 0x80).sum()) for r in rows]
        yield pd.DataFrame({"id": frame["id"], "n_bytes": [r[0] for r in rows], "n_removed": [r[1] for r in rows], "n_spans": [r[2] for r in rows], "kept": [r[3] for r in rows], "n_chars_left": left})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 32, head_anchors: int = HEAD_ANCHORS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept BINARY, n_chars_left) for each row of ``docs``; code points are counted in what is kept."""
    scratch = Scratch(docs.sparkSession, "suffix")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("key"))
    found = scratch.keep(docs.filter(F.octet_length("text") >= length).select("key", "text").mapInPandas(_heads(length, gram), "h long, key string"), "heads")
    # a head counts once a place; copies of a text are one document here
    firsts = docs.filter(F.octet_length("text") >= length).groupBy("key").agg(F.count("*").alias("copies"))
    firsts = scratch.keep(firsts, "texts")
    places = found.join(firsts, "key").groupBy("h", "key").agg((F.count("*") / F.first("copies")).alias("n"))
    places = scratch.keep(places, "places")
    scratch.drop(found)
    shared = scratch.keep(places.groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 2"), "shared")
    common = F.broadcast(shared.filter(F.col("n") > head_anchors).select("h"))
    rare = shared.filter(F.col("n") <= head_anchors).select("h")
    heads = places.join(common, "h", "left_anti").join(rare, "h").unionByName(places.join(common, "h")).groupBy("key").agg(F.collect_list("h").alias("heads"))
    one = docs.select("key", "text")
    many = firsts.filter(F.col("copies") > head_anchors).select("key")
    if not many.isEmpty():  # one of very many copies is chosen before the shuffle
        many = F.broadcast(many)
        one = one.join(many, "key", "left_anti").unionByName(one.join(many, "key").groupBy("key").agg(F.first("text").alias("text")))
    texts = one.join(heads, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("heads").alias("heads"))
    near, known = texts.mapInPandas(_contexts(length, gram), CONTEXT), None
    tables = [places, shared]
    if not shared.filter(F.col("n") > head_anchors).isEmpty():
        near = scratch.keep(near, "contexts")
        rows = scratch.keep(near.join(common, "h").mapInPandas(_phrases(length), f"{CONTEXT}, stop long"), "phrases")
        dealt, known, told = _deal(scratch, rows.filter("ctx is not null").drop("stop"), length, head_anchors)
        known = known.unionByName(rows.filter("ctx is null").select("key", F.col("pos").alias("start"), "stop"))
        tables += [near, rows, *told]
        near = near.join(common, "h", "left_anti").unionByName(dealt)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = near.repartition(parts, "h").sortWithinPartitions("h").mapInPandas(_induce(length), "key string, start long, stop long")
    runs = runs if known is None else runs.unionByName(known)
    spans = runs.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    marks = firsts.join(spans, "key", "left").select("key", (F.col("copies") > 1).alias("whole"), F.when(F.col("copies") == 1, F.col("spans")).alias("spans")).filter("whole or spans is not null")
    marks = scratch.keep(marks, "marks")
    scratch.drop(*tables)
    out = docs.join(marks, "key", "left").select("id", "text", "spans", F.coalesce("whole", F.lit(False)).alias("whole"))
    out = map_exact(out, ["id"], _results, "n_bytes long, n_removed long, n_spans long, kept binary, n_chars_left long")
    return out.withColumnRenamed("id", id_col)
