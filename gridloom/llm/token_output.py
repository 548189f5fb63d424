"""Token-id output: Re-Pair grammar compression per shard, with random access.

Documents are encoded by the tokenizers library, range-sorted by id and written in shards. In each file frequent
pairs of neighbouring ids are replaced by new symbols, again and again, until no pair occurs ``LEAST_PAIR`` times: a round counts
the pairs, takes those with at least half the largest count as rules and replaces them, the more frequent one where
two overlap, from left to right in runs of one pair. A file stores the rules, their expansion lengths, an
index of documents (first symbol, first id) and the symbols, so one document is decoded from its own symbols.

File format, little-endian: 8 bytes ``GLRP0002``; int64 documents, rules, symbols, base (first rule's symbol); then int64 doc
ids, int64 first symbols (documents + 1), int64 first ids (documents + 1); int32 left and right of
each rule; int32 expansion lengths; symbols of three bytes; and the CRC-32 of all before. The manifest has each file's size and CRC-32 as well;
a file that differs from either is refused.

Null and empty texts have only the end id. Null document ids are not allowed in a sorted file: such rows are written first, with
the smallest id value, and read back as null. Repeated ids keep one entry a row. Files appear under final names only when whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import Scratch, chunks, offsets
from .files import Committed, read_bytes

MAGIC = b"GLRP0002"
NULL_ID = np.iinfo(np.int64).min
#: Ids of a file at most (unless one document has more).
FILE_IDS = 2_000_000
#: Code points below this need no composing; kinds of characters; words that a worker remembers (about 40 bytes each).
PLAIN = 0x250
GAP, LETTER, DIGIT, OTHER, WHOLE = range(5)
KNOWN_WORDS = 1_000_000
#: Occurrences of a pair in a file that make it a rule. A rule takes 12 bytes and saves 3 an occurrence, so fewer than 5 don't pay.
LEAST_PAIR = 8


class LibraryIds:
    """Ids of texts by the tokenizers library, which encodes each distinct word that a task meets once.

    Words are found on arrays of code points: runs of letters, single digits, runs of anything else that is no white space, as the
    tokenizer file splits lower-cased text. The library tells each character's kind. That holds below ``PLAIN``, where nothing composes; texts
    with any other character, an apostrophe (it may begin a word's ending) or the first character of a special token go through the library whole.
    Words are told apart by 64-bit hashes of their letters and length.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        suffix = self.library.model.end_of_word_suffix
        self.closes = np.zeros(self.size, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        marks = {"'", *(t.content[0] for t in self.library.get_added_tokens_decoder().values())}
        found = [(WHOLE, 0) if chr(c) in marks else self.kind_of(chr(c)) for c in range(PLAIN)]
        self.kind = np.array([*(k for k, _ in found), WHOLE], dtype=np.uint8)
        self.lower = np.array([*(c for _, c in found), 0], dtype=np.uint32)
        self.forget()

    def kind_of(self, c: str) -> tuple[int, int]:
        """How the tokenizer file takes a character, and what it becomes, asked of the library itself."""
        c = self.library.normalizer.normalize_str(c)
        split = lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text))
        if len(c) != 1 or self.library.normalizer.normalize_str(c) != c:
            return WHOLE, 0
        if not split(c):
            return GAP, 32
        if split(f"x{c}x") == 1:
            return LETTER, ord(c)
        if split(f"x{c}x") != 3 or split(f"!{c}!") not in (1, 3):
            return WHOLE, 0
        return OTHER if split(f"!{c}!") == 1 else DIGIT, ord(c)

    def forget(self) -> None:
        self.keys, self.first, self.length = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype=np.int32)

    def learn(self, keys: np.ndarray, letters: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Encode new words (sorted by key), many in one text with spaces between them."""
        size = stop - start
        text = np.full(int(size.sum()) + len(size), 32, dtype="<u4")
        ends = np.cumsum(size + 1)
        text[spread(ends - size - 1, size)] = letters[spread(start, size)]
        whole, some = text.tobytes().decode("utf-32-le", "surrogatepass"), range(0, len(size), 2000)
        edges = [0, *ends.tolist()]
        parts = [whole[edges[a] : edges[min(a + 2000, len(size))]] for a in some]
        flat = np.concatenate([np.array(e.ids, dtype=np.int32) for e in self.library.encode_batch_fast(parts, add_special_tokens=False)])
        count = np.diff(np.flatnonzero(self.closes[flat]), prepend=-1)  # a word's last id has the suffix
        if len(count) != len(size):
            count = np.concatenate([np.bincount(np.array(e.word_ids), minlength=min(2000, len(size) - a)) for a, e in zip(some, self.library.encode_batch(parts, add_special_tokens=False), strict=True)])
        if len(count) != len(size) or int(count.sum()) != len(flat):
            raise ValueError("the tokenizer file splits words in another way")
        at = np.searchsorted(self.keys, keys)
        self.first = np.insert(self.first, at, len(self.flat) + np.cumsum(count) - count)
        self.keys, self.length = np.insert(self.keys, at, keys), np.insert(self.length, at, count)
        self.flat = np.concatenate((self.flat, flat))

    def encode_texts(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        data = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        narrow = np.minimum(data, PLAIN).astype(np.uint16)
        kind, letters = self.kind[narrow], self.lower[narrow]
        bounds = np.cumsum([len(t) + 1 for t in texts])
        whole = set(np.unique(np.searchsorted(bounds, np.flatnonzero(kind == WHOLE), side="right")).tolist())
        edge = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))))
        solid = kind[edge] != GAP
        start, stop = edge[solid], np.append(edge[1:], len(data))[solid]
        keys, at, which = np.unique(hashing.spans(hashing.prefix_sums(letters), start, stop), return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN_WORDS:
            self.forget()
        where = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[where] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            self.learn(keys[new], letters, start[at[new]], stop[at[new]])
        where = np.searchsorted(self.keys, keys)[which]
        size = self.length[where]
        ids = self.flat[spread(self.first[where], size)]
        ends = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, bounds)].tolist()
        mark = np.array([end], dtype=np.int32)
        slow = dict(zip(sorted(whole), self.library.encode_batch_fast([texts[i] for i in sorted(whole)], add_special_tokens=False), strict=True))
        return [np.array([*slow[i].ids, end], dtype=np.int32) if i in slow else np.concatenate((ids[a:b], mark)) for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), then those of first[1] and so on."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _winners(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which pairs at the sorted places ``at`` are replaced: every other one in a run of one pair, else the lower rank of two that overlap."""
    near = np.diff(at) == 1
    same = near & (rank[1:] == rank[:-1])
    if same.any():
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        offset = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        kept = np.flatnonzero(offset % 2 == 0)
        inner = _winners(at[kept], rank[kept])
        return kept[inner]
    lost = np.zeros(len(at), dtype=bool)
    lost[1:] |= near & (rank[:-1] < rank[1:])
    lost[:-1] |= near & (rank[1:] < rank[:-1])
    return np.flatnonzero(~lost)


def _apart(pairs: np.ndarray) -> np.ndarray:
    """Marks pairs, in their order, that share no symbol with one marked before. Doubled symbols give way to all others: half their places overlap."""
    left, right = (pairs >> np.uint64(32)).tolist(), (pairs & np.uint64(0xFFFFFFFF)).tolist()
    used: set[int] = set()
    out = np.zeros(len(pairs), dtype=bool)
    for doubled in (False, True):
        for i, (a, b) in enumerate(zip(left, right, strict=True)):
            if (a == b) == doubled and a not in used and b not in used:
                out[i] = True
                used.update((a, b))
    return out


def re_pair(ids: np.ndarray, cuts: np.ndarray, base: int, least: int = LEAST_PAIR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first symbol of each document and the end, left, right); pairs never cross the document starts ``cuts``.

    A pair of old symbols never gets more frequent. So once the goal is ``least``, only places beside new symbols,
    and those that lost to an overlapping pair, can still be replaced (``live``).
    """
    seq = ids.astype(np.uint32)
    firsts = np.unique(cuts[cuts < len(seq)])
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    top, goal = base, np.iinfo(np.int64).max
    bits = max(10, min(20, len(seq).bit_length()))
    live = None
    while len(seq) > 1:
        if live is None:
            bucket = ((seq[:-1] * np.uint32(0x9E3779B1)) ^ (seq[1:] * np.uint32(0x85EBCA6B))) >> np.uint32(32 - bits)
            bucket[firsts[1:] - 1] = 1 << bits
            # counts in buckets first: only pairs of buckets that are full enough are counted exactly
            filled = np.bincount(bucket, minlength=(1 << bits) + 1)
            filled[1 << bits] = 0
            goal = max(least, int(min(goal, filled.max())) // 4)
            near = np.flatnonzero((filled >= goal)[bucket])
        else:
            near = live
        pair = seq[near].astype(np.uint64) << np.uint64(32) | seq[near + 1]
        found, where, count = np.unique(pair, return_inverse=True, return_counts=True)
        best = np.flatnonzero(count >= goal)
        best = best[np.argsort(-count[best], kind="stable")]
        rule = np.full(len(found), -1, dtype=np.int64)
        rule[best] = np.arange(len(best))
        rank = rule[where]
        near, rank = near[rank >= 0], rank[rank >= 0]
        win = _winners(near, rank)
        # a pair that loses too many places to others is no rule in this round
        good = np.bincount(rank[win], minlength=len(best)) >= least
        win = win[good[rank[win]]]
        if not len(win) and goal > least:
            continue
        if not len(win):
            # pairs that only kept each other from it: the first ones that share no symbol, or none is left
            alone = _apart(found[best])
            near, rank = near[alone[rank]], rank[alone[rank]]
            win = _winners(near, rank)
            good = np.bincount(rank[win], minlength=len(best)) >= least
            win = win[good[rank[win]]]
            if not len(win):
                break
        at = near[win]
        seq[at] = top + (np.cumsum(good) - 1)[rank[win]]
        moved = lambda x: x - np.searchsorted(at, x, side="left")  # noqa: B023, E731  places after the right halves are gone
        firsts = moved(firsts)
        if goal == least:
            lost = np.ones(len(near), dtype=bool)
            lost[win] = False
            lost = near[lost]
            # a place whose left or right half went into another pair is beside the new symbol and comes back as such
            lost = lost[~np.isin(lost, at + 1) & ~np.isin(lost + 1, at)] if len(lost) else lost
            new = moved(at)
            live = np.unique(np.concatenate((moved(lost), new, new - 1)))
        seq = np.delete(seq, at + 1)
        if live is not None:
            live = live[(live >= 0) & (live < len(seq) - 1)]
            live = live[~np.isin(live + 1, firsts)]
        pairs = found[best[good]]
        left.append((pairs >> np.uint64(32)).astype(np.int64))
        right.append((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64))
        top += len(pairs)
    none = np.empty(0, dtype=np.int64)
    return seq, np.append(firsts, len(seq)), np.concatenate(left) if left else none, np.concatenate(right) if right else none


def levels(left: np.ndarray, right: np.ndarray, base: int) -> Iterator[np.ndarray]:
    """The rules in groups whose parts are ids or rules of earlier groups; a rule refers to earlier rules only."""
    depth = np.zeros(len(left) + 1, dtype=np.int64)  # the last stands for ids
    a, b = (np.where(x < base, len(left), x - base) for x in (left, right))
    depth[:-1] = -1
    while (wait := np.flatnonzero(depth[:-1] < 0)).size:
        ready = wait[(depth[a[wait]] >= 0) & (depth[b[wait]] >= 0)]
        yield ready
        depth[ready] = 1


def lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to."""
    size = np.ones(len(left) + 1, dtype=np.int64)
    a, b = (np.where(x < base, len(left), x - base) for x in (left, right))
    for ready in levels(left, right, base):
        size[ready] = size[a[ready]] + size[b[ready]]
    return size[:-1]


class Grammar:
    """Rules with all their expansions side by side, so that symbols expand by one gather."""

    def __init__(self, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, base: int):
        left, right = left.astype(np.int64), right.astype(np.int64)
        self.size = np.concatenate((np.ones(base, dtype=np.int64), sizes.astype(np.int64)))
        self.first = np.cumsum(self.size) - self.size
        self.table = np.empty(int(self.size.sum()), dtype=np.uint32)
        self.table[:base] = np.arange(base)
        for ready in levels(left, right, base):
            for part, skip in ((left[ready], 0), (right[ready], self.size[left[ready]])):
                self.table[spread(self.first[base + ready] + skip, self.size[part])] = self.table[spread(self.first[part], self.size[part])]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.table[spread(self.first[symbols], self.size[symbols])]


def pack(doc_ids: np.ndarray, arrays: list[np.ndarray], base: int) -> bytes:
    sizes = np.array([len(a) for a in arrays], dtype=np.int64)
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    symbols, cuts, left, right = re_pair(np.concatenate(arrays), firsts[:-1], base)
    head = MAGIC + struct.pack("<4q", len(arrays), len(left), len(symbols), base)
    narrow = symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    body = [doc_ids.astype("<i8"), cuts.astype("<i8"), firsts.astype("<i8"), left.astype("<i4"), right.astype("<i4"), lengths(left, right, base).astype("<i4"), narrow]
    data = head + b"".join(x.tobytes() for x in body)
    return data + struct.pack("<I", zlib.crc32(data))


class TokenFile:
    """A file read back. ``tokens(i)`` decodes one document, ``slice(i, a, b)`` a part of it, ``all_tokens()`` all documents at once."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a token file, or a damaged one")
        docs, rules, symbols, self.base = struct.unpack_from("<4q", data, 8)
        at = 40

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.doc_ids, self.cuts, self.firsts = take("<i8", docs), take("<i8", docs + 1), take("<i8", docs + 1)
        self.left, self.right, self.sizes = take("<i4", rules), take("<i4", rules), take("<i4", rules)
        wide = np.zeros((symbols, 4), dtype=np.uint8)
        wide[:, :3] = take("u1", 3 * symbols).reshape(-1, 3)
        self.symbols = wide.view("<u4").ravel()
        self.grammar = Grammar(self.left, self.right, self.sizes, self.base)

    def tokens(self, i: int) -> np.ndarray:
        return self.grammar.expand(self.symbols[self.cuts[i] : self.cuts[i + 1]])

    def all_tokens(self) -> np.ndarray:
        return self.grammar.expand(self.symbols)

    def slice(self, i: int, a: int, b: int) -> np.ndarray:
        """Ids a..b of document i, without expanding what lies outside."""
        part = self.symbols[self.cuts[i] : self.cuts[i + 1]]
        ends = np.cumsum(self.grammar.size[part])
        lo, hi = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b, side="left")) + 1
        skip = a - (int(ends[lo - 1]) if lo else 0)
        return self.grammar.expand(part[lo:hi])[skip : skip + max(0, b - a)]


MANIFEST = "shard int, part int, name string, docs long, ids long, bytes long, crc32 long"


def _write(folder: str, path: str, end: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = library_ids(path)
        shard, part, held, arrays, total = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal part, held, arrays, total
            name = f"tokens-{shard:05d}-{part:05d}.glrp"
            out, data = Committed(folder, name), pack(np.array(held, dtype=np.int64), arrays, encoder.size)
            out.write(data)
            out.commit()
            row = pd.DataFrame([(shard, part, name, len(held), total, out.size, zlib.crc32(data))], columns=[c.split()[0] for c in MANIFEST.split(", ")])
            part, held, arrays, total = part + 1, [], [], 0
            return row

        for frame in frames:
            for rows in chunks(frame, "text"):
                for doc, ids in zip(rows["id"].tolist(), encoder.encode_texts(rows["text"].tolist(), end), strict=True):
                    if total and total + len(ids) > FILE_IDS:
                        yield flush()
                    held.append(doc)
                    arrays.append(ids)
                    total += len(ids)
        if held:
            yield flush()

    return run


def _read(folder: str, with_ids: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, base, size, crc in zip(frame["name"], frame["base"], frame["bytes"], frame["crc32"], strict=True):
                data = read_bytes(folder, name)
                if len(data) != size or zlib.crc32(data) != crc:
                    raise ValueError(f"{name} is not the file of the manifest")
                file = TokenFile(data)
                every, edges = file.all_tokens().astype("<u4"), file.firsts.tolist()
                for a in range(0, len(file.doc_ids), 2000):
                    ids = [every[x:y] for x, y in zip(edges[a : a + 2000], edges[a + 1 : a + 2001], strict=False)]
                    out = pd.DataFrame({"id": file.doc_ids[a : a + 2000].copy(), "start": base + file.firsts[a : a + len(ids)], "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids]})
                    if with_ids:
                        out["ids"] = [x.astype(np.int32) for x in ids]
                    yield out

    return run


def write_tokens(docs: DataFrame, folder: str, scratch: Scratch, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1, shard_chars: int = 12_000_000) -> DataFrame:
    """Write the files in ascending id order and return their manifest with each file's first id position (base)."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID))).alias("id"), F.col(text_col).alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    ranged = texts.repartitionByRange(max(1, -(-chars // shard_chars)), "id").sortWithinPartitions("id", "text")
    manifest = scratch.keep(ranged.mapInPandas(_write(folder, path, end), MANIFEST), "manifest")
    return manifest.join(offsets(manifest, ["shard", "part"], "ids", "base"), ["shard", "part"])


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32 and, if wanted, ids) of every document in the files, which are dealt to as many tasks."""
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = manifest.select("name", "base", "bytes", "crc32")
    out = files.repartition(max(1, manifest.count()), "name").mapInPandas(_read(folder, with_ids), schema)
    return out.withColumn("id", F.when(F.col("id") != int(NULL_ID), F.col("id")))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    scratch = Scratch(docs.sparkSession, "tokens")
    folder = f"{scratch.root}/files"
    return read_tokens(write_tokens(docs, folder, scratch, path, id_col, text_col), folder).withColumnRenamed("id", id_col)
