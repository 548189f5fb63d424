"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Items are short, documents long: over a whole document an item's Jaccard similarity is near zero and MinHash bands
would miss it. So the search runs on windows, and the items are partitioned by size. In the partition with window
length w the MinHash (least hash of w consecutive shingles) of one of the item's windows equals that of a window of the
document if a run of w shingles is left intact. That holds for substituted and inserted words, but not for any layout
(a doubled word, overlapping excerpts), so every item is also probed by single shingles: a document that lacks at most
q - need of an item's q shingles has one of any q - need + 1 of them. The ones in the fewest items are taken. Documents
emit each window MinHash and each shingle once, items theirs; equal values make a candidate; it is verified by exact
containment of the shingles' words. A partition of window length w serves all items with w(q) >= w, w a power of two.

Documents of fewer shingles than any item needs are skipped. Items or documents with fewer than ``width`` words, null or empty ones
match nothing. Repeated items give a row each. Rows with a null id are searched like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Item MinHashes with their items, candidate pairs, and the items' shingles are each broadcast up to this many numbers of 8 bytes; more of them are shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-cased words of a text; an empty array for a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+", -1), "")


def shingle_hashes(tokens: Column, width: int) -> Column:
    """Hashes of the word shingles in text order."""
    hashed = lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(width)))
    return F.when(F.size(tokens) >= width, F.transform(F.sequence(F.lit(0), F.size(tokens) - width), hashed)).otherwise(F.array().cast("array<long>"))


def shingle_texts(tokens: Column, width: int) -> Column:
    """Distinct word shingles as text."""
    joined = lambda i: F.concat_ws(" ", F.slice(tokens, i + 1, width))
    return F.when(F.size(tokens) >= width, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(tokens) - width), joined))).otherwise(F.array().cast("array<string>"))


def with_windows(df: DataFrame, hashes: str, lengths: list[int]) -> DataFrame:
    """Adds w1, w2, w4, ...: the MinHash of each run of that many consecutive shingles (of all, where there are fewer).

    Doubling: the least of 2k consecutive values is the lesser of two leasts of k. Each step is a column of
    its own, so no step is computed twice. (``explode`` of such a column would place a filter below these steps and
    repeat them in it, so callers use ``explode_outer``.)
    """
    df, k = df.withColumn("w1", F.col(hashes)), 1
    while k < max(lengths):
        w, rest = F.col(f"w{k}"), F.size(f"w{k}") - k
        df = df.withColumn(f"w{2 * k}", F.when(rest > 0, F.zip_with(F.slice(w, F.lit(1), rest), F.slice(w, F.lit(k + 1), rest), lambda a, b: F.least(a, b))).otherwise(w))
        k *= 2
    return df


def intact_run(q: int, percent: int, width: int) -> int:
    """The longest run of shingles that substitutions and insertions leave of q when percent % are kept.

    A change inside breaks ``width - 1`` shingles in a row at least (an insertion) and adds one run.
    """
    kept = -(-percent * q // 100)
    return -(-kept // ((q - kept) // max(1, width - 1) + 1))


def single_probes(items: DataFrame, percent: int) -> DataFrame:
    """(item, h): so many shingle hashes of each item that a document with percent % of its shingles has one of them.

    ``items`` have no repeated shingle; shingles in the fewest items come first.
    """
    each = items.select("item", "hashes", "q", F.explode("hashes").alias("h"))
    ranked = each.join(each.groupBy("h").agg(F.count("*").alias("n")), "h").groupBy("item", "hashes", "q").agg(F.sort_array(F.collect_set(F.struct("n", "h"))).alias("by"))
    most = F.floor(F.col("q") * (100 - percent) / 100).cast("int") + 1  # q - ceil(percent % of q) + 1
    return ranked.select("item", F.explode_outer(F.slice("by", F.lit(1), most)["h"]).alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(id, item, n_item, n_shared) of the pairs with ``100 * n_shared >= percent * n_item``, shingles counted once."""
    items = items.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("tokens")).filter(F.size("tokens") >= width)
    items = items.withColumn("shingles", shingle_texts(F.col("tokens"), width)).withColumn("hashes", shingle_hashes(F.col("tokens"), width))
    # an item that repeats a shingle may lose more places than shingles: it counts as one shingle a run
    items = items.withColumn("q", F.when(F.size("shingles") == F.size("hashes"), F.size("shingles")).otherwise(-F.size("shingles")))
    sizes = [r["q"] for r in items.select("q").distinct().collect()]
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not sizes:
        return docs.select(F.col("id").alias(id_col), F.lit(None).cast(items.schema["item"].dataType).alias(item_col), F.lit(0).alias("n_item"), F.lit(0).alias("n_shared")).limit(0)
    # size partitions: the largest power of two within the intact run; single shingles are always emitted
    length_of = {q: 1 << (intact_run(q, percent, width).bit_length() - 1) if q > 0 else 1 for q in sizes}
    lengths = sorted({1, *length_of.values()})
    least_of = {n: min(-(-percent * abs(q) // 100) for q in sizes if length_of[q] == n or n == 1) for n in lengths}
    part = F.lit(lengths[0])
    for n in lengths[1:]:
        part = F.when(F.col("q").isin([q for q in sizes if length_of[q] == n]), n).otherwise(part)
    items = items.withColumn("part", part)

    def keyed(n: int, of: str | None = None) -> Column:  # values of different partitions don't meet
        return F.transform(of or f"w{n}", lambda h: h.bitwiseXOR(F.lit((n * 0x1E3779B97F4A7C15) % 2**63))) if n != lengths[-1] else F.col(of or f"w{n}")

    # the partition of length 1 has all its shingles there already
    wanted = single_probes(items.filter(F.col("part") > 1), percent).groupBy("item").agg(F.collect_set("h").alias("some"))
    wanted = wanted.select("item", F.explode_outer(keyed(1, "some")).alias("h"))
    for n in lengths:
        wanted = wanted.union(with_windows(items.filter(F.col("part") == n), "hashes", [n]).select("item", F.explode_outer(keyed(n)).alias("h")))
    wanted = wanted.groupBy("h").agg(F.collect_set("item").alias("items"))
    hashed = docs.select("id", F.xxhash64("text").alias("v"), words(F.col("text")).alias("tokens")).select("id", "v", shingle_hashes(F.col("tokens"), width).alias("hashes"))
    hashed = with_windows(hashed, "hashes", lengths)
    # too short a document has no window in a partition
    sets = [F.when(F.size("hashes") >= least_of[n], F.array_distinct(keyed(n))).otherwise(F.array().cast("array<long>")) for n in lengths]
    probes = hashed.select("id", "v", F.explode_outer(F.concat(*sets)).alias("h"))
    wide = wanted.agg(F.coalesce(F.sum(F.size("items") + 2), F.lit(0))).first()[0]  # repeated items make long lists
    hits = probes.join(F.broadcast(wanted) if wide <= BROADCAST_ROWS else wanted.hint("merge"), "h")
    pairs = hits.select(F.col("id").alias("of"), F.col("v").alias("w"), F.explode("items").alias("item")).distinct()
    likely = Scratch(docs.sparkSession, "contained").keep(pairs.groupBy("of", "w").agg(F.collect_set("item").alias("found")), "likely")
    few = likely.agg(F.coalesce(F.sum(F.size("found") + 2), F.lit(0))).first()[0] <= BROADCAST_ROWS
    found = docs.withColumn("v", F.xxhash64("text")).join(F.broadcast(likely) if few else likely, F.col("id").eqNullSafe(F.col("of")) & (F.col("v") == F.col("w")))
    found = found.select("id", words(F.col("text")).alias("tokens"), "found").select("id", shingle_texts(F.col("tokens"), width).alias("has"), F.explode("found").alias("item"))
    small = items.select("item", F.col("shingles").alias("needs"))
    heavy = small.agg(F.coalesce(F.sum(5 * F.size("needs") + 2), F.lit(0))).first()[0]  # a shingle is about five numbers long
    exact = found.join(F.broadcast(small) if heavy <= BROADCAST_ROWS else small, "item").select("id", "item", F.size("needs").alias("n_item"), F.size(F.array_intersect("has", "needs")).alias("n_shared"))
    return exact.filter(100 * F.col("n_shared") >= percent * F.col("n_item")).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_item", "n_shared")
