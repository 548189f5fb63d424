"""Substring dedup by recompression.

A text's words are symbols. A round replaces maximal runs of one symbol, and pairs of a left and a right symbol, by a new symbol;
which symbols are left and which right changes with the round. A new symbol's name is a 64-bit fingerprint of what it replaces, so
names are the same in all documents and no round needs a table of names. Whether two neighbours join depends on the two
alone. So of two equal windows of words the symbols differ only next to the windows' ends: in each round the part that is
sure to be equal loses one symbol at each end. The first symbol of that part in the last round that leaves it one is the
window's anchor: equal windows have the same anchor at the same place.

* Rounds run over whole texts, and give every window its anchor;
* anchors that occur in documents of different ids reveal where a repeat may be; all other windows are done;
* windows of revealed anchors are told apart by the anchor's name and place and a fingerprint of all their words. The least id of each is
  found by a grouped minimum, and windows of larger ids are repeats: their words go.

Copies of whole texts are one text in the search; the copies of larger ids go as a whole. Hot windows are combined before
they are shuffled and joined back by a join that can be split, so no group meets in one task.

Null and empty texts have no words. Texts with fewer words than a window keep all. A null id counts as the largest one (2**63 - 1), and
documents of one id never remove each other's words. Repeated rows give equal rows. Only the id and text columns are read. Words are told apart
by 64-bit fingerprints, windows by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .bloom import bloom_of
from .common import Scratch, chunks, map_exact

#: Ranges of removed words up to this number (about 50 bytes each) are broadcast to the texts; more meet them in a shuffle.
BROADCAST_RANGES = 500_000
LAST = 2**63 - 1


def anchors(words: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, anchor name, anchor's place) of each window of ``length`` words within the texts that ``bounds`` tell apart."""
    sizes = np.diff(bounds)
    windows = np.concatenate([np.arange(b, b + s - length + 1) for b, s in zip(bounds, sizes, strict=False) if s >= length] or [np.empty(0, dtype=np.int64)])
    name, place = np.zeros(len(windows), dtype=np.uint64), np.zeros(len(windows), dtype=np.int64)
    sym, start = words, np.arange(len(words))
    first = np.zeros(len(words) + 1, dtype=bool)
    first[bounds] = True
    # the sure part of a window is x..y-1, in symbols
    act, x, y, turn = np.arange(len(windows)), windows, windows + length, 0
    while len(act):
        left = (hashing.mix(sym ^ np.uint64((turn + 1) * 0x9FB21C651E98DF25 % 2**64)) & np.uint64(1)).astype(bool)
        head = np.ones(len(sym), dtype=bool)
        head[1:] = (sym[1:] != sym[:-1]) & ~(left[:-1] & ~left[1:]) | first[start[1:]]
        at = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        x2, y2 = group[x] + 1, group[y - 1]
        over = y2 <= x2
        name[act[over]], place[act[over]] = sym[x[over]], start[x[over]]
        act, x, y = act[~over], x2[~over], y2[~over]
        count = np.diff(np.append(at, len(sym)))
        folded = np.add.reduceat(sym * hashing.powers(hashing.BASE, int(count.max()))[np.arange(len(sym)) - at[group]], at)
        sym, start = np.where(count > 1, hashing.mix(folded + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), sym[at]), start[at]
        turn += 1
    return windows, name, place


def fingerprints(words: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of all words of each window."""
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * hashing.powers(hashing.BASE, len(words)), out=sums[1:])
    return hashing.mix((sums[windows + length] - sums[windows]) * hashing.powers(hashing.INVERSE, len(sums))[windows])


def _parsed(frames: Iterator[pd.DataFrame], length: int):
    """(part, words, bounds, windows, names, places, text of each window) of each chunk."""
    for frame in frames:
        for part in chunks(frame, "text"):
            words, bounds = hashing.word_hashes(part["text"].tolist(), lower=False)
            windows, name, place = anchors(words, bounds, length)
            yield part, words, bounds, windows, name, place, np.searchsorted(bounds, windows, side="right") - 1


def _names(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _, _, _, name, _, doc in _parsed(frames, length):
            new = np.ones(len(name), dtype=bool)
            new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
            yield pd.DataFrame({"name": name[new].view(np.int64), "ord": part["ord"].to_numpy()[doc[new]]})

    return run


def _windows(length: int, shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for part, words, bounds, windows, name, place, doc in _parsed(frames, length):
            ok = known.has(name) if known is not None else np.ones(len(name), dtype=bool)
            windows, name, place, doc = windows[ok], name[ok], place[ok], doc[ok]
            anchor = hashing.mix(name + (place - windows).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            prints = fingerprints(words, windows, length)
            ids, texts = part["ord"].to_numpy()[doc], part["v"].to_numpy()[doc]
            yield pd.DataFrame({"anchor": anchor.view(np.int64), "print": prints.view(np.int64), "ord": ids, "v": texts, "pos": (windows - bounds[doc]).astype(np.int32)})

    return run


def ranges(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The ranges [start, stop) that windows of ``length`` at the sorted ``starts`` cover."""
    edge = np.flatnonzero(np.diff(starts) > length)
    first, last = np.concatenate(([0], edge + 1)), np.concatenate((edge, [len(starts) - 1]))
    return [(int(a), int(b) + length) for a, b in zip(starts[first], starts[last], strict=True)]


def _covered(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["ord", "v"]].assign(spans=[ranges(np.sort(np.asarray(p)), length) for p in frame["starts"]])

    return run


def _kept(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in chunks(frame, "text"):
                rows = []
                for text, spans, whole in zip(part["text"], part["spans"], part["whole"], strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    n = len(words)
                    cut = [(0, n)] if whole and n >= length else [] if spans is None else [(s["start"], s["stop"]) for s in spans]
                    for a, b in reversed(cut):
                        del words[a:b]
                    rows.append((n, n - len(words), cut, b" ".join(words).decode("utf-8", "surrogatepass")))
                out = pd.DataFrame(rows, columns=["n_words", "n_removed", "spans", "kept"])
                out.insert(0, "id", part["id"].to_numpy())
                yield out

    return run


SPANS = "array<struct<start: int, stop: int>>"


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) of each row: word ranges removed, and the other words joined by a space."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "recompression")
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("text"))
    # a row is named by its id, and by its text only where an id has several
    shared_ids = scratch.keep(docs.groupBy("ord").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo <> hi").select("ord", F.lit(True).alias("several")), "ids")
    few = shared_ids.count() <= BROADCAST_RANGES
    docs = docs.join(F.broadcast(shared_ids) if few else shared_ids, "ord", "left").select("id", "ord", F.when(F.col("several"), F.col("v")).otherwise(0).alias("v"), "text")
    # copies of whole texts, but for those of the least id
    keys = docs.filter("text is not null").select("ord", "v", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    twice = keys.groupBy("t1", "t2").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).filter("lo < hi").drop("hi")
    copies = scratch.keep(keys.join(twice, ["t1", "t2"]).filter("ord > lo").select("ord", "v").distinct(), "copies")
    few = copies.count() <= BROADCAST_RANGES
    texts = docs.join(F.broadcast(copies) if few else copies, ["ord", "v"], "left_anti").select("ord", "v", "text")
    # anchors in documents of different ids
    names = texts.select("ord", "text").mapInPandas(_names(length), "name long, ord long")
    shared = scratch.keep(names.groupBy("name").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).filter("lo < hi").select("name"), "shared")
    known = spark.sparkContext.broadcast(bloom_of(shared, "name"))
    windows = scratch.keep(texts.mapInPandas(_windows(length, known), "anchor long, print long, ord long, v long, pos int"), "windows")
    least = windows.groupBy("anchor", "print").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).filter("lo < hi").drop("hi")
    again = windows.join(least, ["anchor", "print"]).filter("ord > lo").select("ord", "v", "pos").distinct()
    starts = again.groupBy("ord", "v").agg(F.collect_list("pos").alias("starts"))
    marks = starts.mapInPandas(_covered(length), f"ord long, v long, spans {SPANS}").select("*", F.lit(False).alias("whole"))
    marks = scratch.keep(marks.union(copies.select("ord", "v", F.lit(None).cast(SPANS), F.lit(True))), "marks")
    scratch.drop(windows, shared)
    few = (marks.agg(F.sum(F.lit(1) + F.coalesce(F.size("spans"), F.lit(0)))).first()[0] or 0) <= BROADCAST_RANGES
    out = docs.join(F.broadcast(marks) if few else marks, ["ord", "v"], "left").select("id", "text", "spans", F.coalesce("whole", F.lit(False)).alias("whole"))
    return map_exact(out, ["id"], _kept(length), f"n_words long, n_removed long, spans {SPANS}, kept string").withColumnRenamed("id", id_col)
