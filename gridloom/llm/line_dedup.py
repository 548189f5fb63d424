"""Line dedup by a log-template tree.

A line descends a tree of fixed depth: its token count, then its leading tokens; tokens with a digit are variable
fields from the start. Within a leaf a token that is frequent at its place (in ``min_docs`` distinct texts) is a
constant, any other a variable field ``<*>``. The constants with their places are the line's template, if they are
at least ``similarity`` % of its tokens. A template that recurs in ``min_docs`` distinct texts is boilerplate: its
lines are dropped, but for the first in order of (document, line) when ``keep_first``. Unlike a tree
grown line by line, the result depends on no order, so leaves are counted by grouped sums and no group is gathered.

A line of ``long_tokens`` tokens is boilerplate from ``long_docs`` distinct texts on, and its whole masked
line is a template too, so a passage is found whatever else is in its leaf (0: no such rule). A line also has the template of
its relative constants: tokens in ``share`` % of the texts of their leaf at least, and in two (0: no such templates). A field of few
values stays a field there at every size of the corpus. A line goes if one of its templates recurs and it isn't the first
of that one; the lines that share templates keep one at least.

Texts, leaves, bodies, tokens at their places and templates are told apart by 64-bit hashes: of n of them a share of about n / 2**64 meets another one, so at 10**12
lines a line in twenty million may be taken for another's copy.

Copies of one whole text count as one text, so a group of copies doesn't make its own lines boilerplate.
Lines of fewer than ``min_tokens`` tokens always stay. Null texts stay null; empty texts and lines stay. A document whose
lines all go keeps an empty text. Rows with a null id or repeated rows are treated by their own text. All columns of
the input are kept as they are, whatever their names; only the text changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FIELD = "<*>"
#: Recurring templates up to this number (about 50 bytes each) are broadcast to the lines; more meet them in a shuffle.
BROADCAST_TEMPLATES = 200_000
#: Leaves that recur (8 bytes each) are broadcast to the lines up to this number, so that no line is shuffled to be dropped.
BROADCAST_LEAVES = 3_000_000
#: The same for the leaves with their number of texts (about 50 bytes each).
BROADCAST_TOTALS = 1_000_000


def masked(tokens: Column) -> Column:
    """Tokens with variable fields masked."""
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))


def masked_line(tokens: Column) -> Column:
    """All tokens masked, joined by blanks. A field begins after a blank only, so a token without a digit is looked at once."""
    return F.regexp_replace(F.array_join(tokens, " "), "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)


def lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """(id, v, at, raw, leaf) of each line of min_tokens tokens or more; v is the hash of the whole text.

    Only the leading tokens are masked here; the others are once their leaf is known to recur. Spaces are made blanks in the whole text first,
    since a split at one blank needs no pattern.
    """
    blanks = F.regexp_replace("text", r"[\x09\x0B-\x0D]", " ")
    out = docs.select("id", "v", F.posexplode_outer(F.split(blanks, "\n", -1)).alias("at", "line"))
    out = out.select("id", "v", "at", F.array_remove(F.split("line", " ", -1), "").alias("raw")).filter(F.size("raw") >= max(min_tokens, 1))
    return out.select("id", "v", "at", "raw", F.xxhash64(F.size("raw"), masked(F.slice("raw", 1, depth))).alias("leaf"))


def recurring_lines(docs: DataFrame, scratch: Scratch, depth: int, min_tokens: int, min_docs: int, similarity: int, keep_first: bool, long_tokens: int = 0, long_docs: int = 2, share: int = 0) -> DataFrame:
    """(id, v, gone) with the places of the lines to drop, written to ``scratch``. ``docs`` has id, text and v."""
    every = lines(docs, depth, min_tokens)
    need = F.when(F.col("size") >= long_tokens, min(long_docs, min_docs)).otherwise(min_docs) if long_tokens else F.lit(min_docs)
    # leaves that many distinct texts reach; a text counts once
    seen = every.select("leaf", "v", F.size("raw").alias("size")).distinct().groupBy("leaf", "size").agg(F.count("*").alias("n")).filter(F.col("n") >= need).select("leaf")
    seen = scratch.keep(seen, "leaves")
    n_leaves = seen.count()
    kept = every.join(F.broadcast(seen) if n_leaves <= BROADCAST_LEAVES else seen, "leaf", "left_semi").select("id", "v", "at", "leaf", F.size("raw").alias("size"), masked_line(F.col("raw")).alias("line"))
    kept = scratch.keep(kept.withColumn("body", F.xxhash64("line")), "lines")
    # distinct bodies with the number of texts that have them; a body is in one leaf
    bodies = kept.select("body", "v").distinct().groupBy("body").agg(F.count("*").alias("n"))
    bodies = scratch.keep(bodies.join(kept.groupBy("body").agg(F.first("leaf").alias("leaf"), F.first("size").alias("size"), F.first("line").alias("line")), "body"), "bodies")
    total = bodies.groupBy("leaf").agg(F.sum("n").alias("total"))
    tokens = F.split("line", " ", -1)
    # a token at its place in a leaf is one hash from here on, so shuffles carry no text
    keys = F.filter(F.transform(tokens, lambda t, i: F.when(t != FIELD, F.xxhash64("leaf", i, t))), lambda k: k.isNotNull())
    counts = bodies.join(F.broadcast(total) if n_leaves <= BROADCAST_TOTALS else total, "leaf").select("n", "total", F.explode(keys).alias("key"))
    counts = counts.groupBy("key").agg(F.sum("n").alias("m"), F.first("total").alias("total")).filter("m >= 2" if min_docs > 1 else "true")

    # both kinds of constants in one pass over the places: frequent in all texts, and in a share of the leaf's
    relative = (F.col("m") >= 2) & (100 * F.col("m") >= share * F.col("total")) if share else F.lit(False)
    known = counts.select("key", (F.col("m") >= min_docs).alias("plain"), relative.alias("relative")).filter("plain or relative")
    constant = bodies.select("body", F.explode(keys).alias("key")).join(known, "key")
    # a set of constants is told by the XOR of its hashes and its size
    of = lambda kind: (F.bit_xor(F.when(F.col(kind), F.col("key"))).alias(kind), F.count_if(F.col(kind)).alias(f"n_{kind}"))
    forms = bodies.select("body", "leaf", "size").join(constant.groupBy("body").agg(*of("plain"), *of("relative")), "body")
    enough = lambda kind, *mark: F.when((F.col(f"n_{kind}") > 0) & (100 * F.col(f"n_{kind}") >= similarity * F.col("size")), F.xxhash64("leaf", kind, f"n_{kind}", *mark))
    forms = forms.select("body", "size", F.explode(F.array(enough("plain"), enough("relative", F.lit("share")))).alias("template")).filter("template is not null")
    if long_tokens:
        fixed = F.size(F.filter(tokens, lambda t: t != FIELD))
        whole = bodies.filter((F.col("size") >= long_tokens) & (100 * fixed >= similarity * F.col("size")))
        forms = forms.union(whole.select("body", "size", F.xxhash64("body", F.lit("whole")).alias("template")))
    matched = scratch.keep(kept.select("id", "v", "at", "body").join(forms, "body").select("id", "v", "at", "size", "template"), "matched")
    often = matched.select("template", "size", "v").distinct().groupBy("template", "size").agg(F.count("*").alias("n")).filter(F.col("n") >= need).drop("size")
    often = often.join(matched.groupBy("template").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "v", "at")).alias("first")), "template")
    often = scratch.keep(often, "often")
    gone = matched.join(F.broadcast(often) if often.count() <= BROADCAST_TEMPLATES else often, "template")
    if keep_first:
        gone = gone.filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("v") == F.col("first.v")) & (F.col("at") == F.col("first.at"))))
    gone = scratch.keep(gone.groupBy("id", "v").agg(F.collect_set("at").alias("gone")), "gone")
    scratch.drop(seen, kept, bodies, matched, often)
    return gone


def drop_template_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, min_tokens: int = 4, min_docs: int = 10, similarity: int = 60, keep_first: bool = True, long_tokens: int = 20, long_docs: int = 2, share: int = 20) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped from the text."""
    scratch = Scratch(docs.sparkSession, "lines")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("v"))
    gone = recurring_lines(slim, scratch, depth, min_tokens, min_docs, similarity, keep_first, long_tokens, long_docs, share)
    marks = gone.select(F.col("id").alias("_line_id"), F.col("v").alias("_line_v"), F.col("gone").alias("_line_gone"))
    out = docs.join(marks, docs[id_col].eqNullSafe(marks["_line_id"]) & (F.xxhash64(docs[text_col]) == marks["_line_v"]), "left")
    split = F.split(docs[text_col], "\n", -1)
    rest = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(marks["_line_gone"], i)), "\n")
    text = F.when(marks["_line_gone"].isNull(), docs[text_col]).otherwise(rest)
    return out.select(*((text.alias(c) if c == text_col else docs[c]) for c in docs.columns))
