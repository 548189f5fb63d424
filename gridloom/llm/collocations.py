"""Phrase collocations from count streams in prefix and suffix order.

Three streams hold the exact counts of frequent words, word pairs and word triples of each language. They are made in sorted runs
inside tasks, merged by sums. In prefix order (by the first words) a phrase stands next to its beginning, in suffix order (by the last words)
next to its end; merge joins that walk two streams in lockstep give the left and right counts of every cut and, from the triples that start or end with
a pair, the extension counts. No table of counts is looked up by hashing.

A phrase can't be frequent unless its parts are. So pairs are counted only of frequent words, and triples only of frequent pairs: a first pass
counts words; a second counts fingerprints of pairs, packed to 4 bytes; a third counts the pairs and triples that are left as they are. Between
passes the frequent ones travel as a Bloom filter of bounded size. Filters only spare work: all results are decided by the exact counts of the third pass.

Text is lower-cased in A-Z and cut at ``.,;:!?`` and line breaks into pieces, these at spaces and tabs into words. A null text has no words, a
null language is ``und`` (together with documents of that language). Texts may have any length; repeated rows count again. An empty table gives no
rows. Only the text and language columns are read. Words of a language are told apart by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .bloom import bloom_of
from .common import Scratch, chunks
from .counting import PACKED, RUN_KEYS, frequent, marks, packed, segment_bits

BREAKS = np.zeros(256, dtype=bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
GAPS = BREAKS.copy()
GAPS[[0x20, 0x09]] = True
#: Characters handled at once, and shards of a language in the first step of ranking.
CHARS, SHARDS = 2_000_000, 64


def tokens(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(name, text, piece, begin, end) of each word, and the bytes that they are cut from; names differ between languages."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in part["text"]]
    data = hashing.LOWER[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
    gap = GAPS[data]
    before = np.concatenate(([True], gap[:-1]))
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right")
    names = hashing.mix(hashing.spans(hashing.prefix_sums(data), start, end) + part["key"].to_numpy().view(np.uint64)[doc])
    return names, doc, np.cumsum(BREAKS[data])[start], start, end, data.tobytes()


def _words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part in chunks(frame, "text", CHARS):
            names, doc, _, start, end, data = tokens(part)
            found, at, n = np.unique(names, return_index=True, return_counts=True)
            words = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            yield pd.DataFrame({"lang": part["lang"].to_numpy()[doc[at]], "word": words, "w": found.view(np.int64), "n": n})


def pair_keys(names: np.ndarray) -> np.ndarray:
    return hashing.mix(names[:-1] * np.uint64(hashing.BASE) + names[1:])


def _pairs(bits: int, known):
    """Packed runs of the pairs of frequent words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            for part in chunks(frame, "text", CHARS):
                names, _, piece, _, _, _ = tokens(part)
                ok = known.value.has(names) if known.value is not None else np.ones(len(names), dtype=bool)
                held.append(pair_keys(names)[ok[1:] & ok[:-1] & (piece[1:] == piece[:-1])])
                size += len(held[-1])
                if size >= RUN_KEYS:
                    yield packed(np.concatenate(held), bits)
                    held, size = [], 0
        if size:
            yield packed(np.concatenate(held), bits)

    return run


def combined(parts: list[tuple[np.ndarray, ...]]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct tuples of all parts in prefix order, and their counts."""
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at].view(np.int64) for c in columns], np.diff(np.append(at, len(order)))


def _phrases(bits: int, known):
    """Combined runs of the frequent pairs, and of the triples of two of them; a pair has no third word."""

    def rows(two: list, three: list) -> Iterator[pd.DataFrame]:
        for parts in (two, three):
            if parts:
                columns, n = combined(parts)
                yield pd.DataFrame({"w1": columns[0], "w2": columns[1], "w3": columns[2] if len(columns) > 2 else pd.array([None] * len(n), dtype="Int64"), "n": n})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        two, three, size = [], [], 0
        for frame in frames:
            for part in chunks(frame, "text", CHARS):
                names, _, piece, _, _, _ = tokens(part)
                ok = piece[1:] == piece[:-1]
                if known.value is not None:
                    ok &= known.value.has(marks(pair_keys(names), bits))
                at = np.flatnonzero(ok)
                two.append((names[at], names[at + 1]))
                at = np.flatnonzero(ok[1:] & ok[:-1])
                three.append((names[at], names[at + 1], names[at + 2]))
                size += len(two[-1][0])
                if size >= RUN_KEYS:
                    yield from rows(two, three)
                    two, three, size = [], [], 0
        yield from rows(two, three)

    return run


def exact_score(left: str, right: str) -> Column:
    """floor(1000000 a^2 / (left * right)) in decimals of 38 digits, exact for counts below 10**15."""
    wide = "cast({} as decimal(16,0))".format
    above = f"cast(1000000 * cast({wide('a')} * {wide('a')} as decimal(31,0)) as decimal(38,0))"
    return F.expr(f"cast({above} div ({wide(left)} * {wide(right)}) as long)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two and three words.

    A phrase of fewer than ``least`` occurrences is none; one that is part of a longer phrase with ``inside`` % of its occurrences goes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("lang"))
    # first stream: words
    every = scratch.keep(docs.mapInPandas(_words, "lang string, word string, w long, n long").groupBy("lang", "word", "w").agg(F.sum("n").alias("f")), "words")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = scratch.keep(every.filter(F.col("f") >= least), "frequent-words")
    # pairs that may be frequent
    size = every.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    bits = segment_bits(size)
    pairs = frequent(docs.mapInPandas(_pairs(bits, spark.sparkContext.broadcast(bloom_of(words, "w"))), PACKED), least)
    known = spark.sparkContext.broadcast(bloom_of(scratch.keep(pairs.select("mark"), "marks"), "mark"))
    # second and third stream: pairs and triples with their exact counts
    runs = docs.mapInPandas(_phrases(bits, known), "w1 long, w2 long, w3 long, n long")
    phrases = scratch.keep(runs.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("a")).filter(F.col("a") >= least), "phrases")
    one = words.select("w", "f")
    two, three = phrases.filter("w3 is null").drop("w3"), phrases.filter("w3 is not null")

    def beside(stream: DataFrame, counts: DataFrame, on: list[str], name: str) -> DataFrame:
        """The stream with the count of the part in ``on``, by walking both in the order of that part."""
        key = counts.columns[:-1]
        side = counts.select(*(F.col(k).alias(o) for k, o in zip(key, on, strict=True)), F.col(counts.columns[-1]).alias(name))
        return stream.join(side.hint("merge"), on)

    two = beside(beside(two, one, ["w1"], "l1"), one, ["w2"], "r1")
    pair = phrases.filter("w3 is null").select("w1", "w2", "a")
    # prefix order: the triples that start with a pair; suffix order: those that end with it
    starts = three.groupBy("w1", "w2").agg(F.max("a").alias("longer_after"))
    ends = three.groupBy(F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("longer_before"))
    two = two.join(starts.hint("merge"), ["w1", "w2"], "left").join(ends.hint("merge"), ["w1", "w2"], "left")
    longer = F.greatest(F.coalesce("longer_after", F.lit(0)), F.coalesce("longer_before", F.lit(0)))
    two = two.filter(100 * longer < inside * F.col("a")).select("w1", "w2", F.lit(None).cast("long").alias("w3"), "a", "l1", "r1", F.lit(None).cast("long").alias("l2"), F.lit(None).cast("long").alias("r2"))
    three = beside(beside(beside(beside(three, pair, ["w1", "w2"], "l2"), pair, ["w2", "w3"], "r1"), one, ["w1"], "l1"), one, ["w3"], "r2")
    found = two.union(three.select(two.columns))
    cuts = found.select("*", exact_score("l1", "r1").alias("s1"), exact_score("l2", "r2").alias("s2"))
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    cuts = cuts.select("w1", "w2", "w3", "a", *(F.when(second, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(name) for c, name in (("l", "l"), ("r", "r"), ("s", "score"))))
    named = cuts.join(words.select(F.col("w").alias("w1"), "lang", F.col("word").alias("t1")).hint("merge"), "w1")
    named = named.join(words.select(F.col("w").alias("w2"), F.col("word").alias("t2")).hint("merge"), "w2")
    named = named.join(words.select(F.col("w").alias("w3"), F.col("word").alias("t3")).hint("merge"), "w3", "left")
    named = scratch.keep(named.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", "l", "r", "score"), "phrases")
    # each shard's first ones, then each language's of those
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shard = F.pmod(F.xxhash64("phrase"), F.lit(SHARDS))
    first = named.withColumn("shard", shard).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "shard").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
