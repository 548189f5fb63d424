"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The tree's leaves hold (rank, position) of each adjacent pair of a word, its root the least: the leftmost
merge of lowest rank. A merge changes three leaves and their paths to the root; it repeats until
the root is empty. Words of one power-of-two size are encoded together, one numpy row each, so a step of every
word's tree is a few array operations.

White space is dropped by these vocabularies, so a text is cut at white space and each distinct piece
of a task is encoded once. Pieces still follow the file's own normalisation, splitting and special tokens.

Null texts count as empty; empty texts have no ids and decode to the empty string. Length is no limit: a text without any
space is one piece. Repeated rows give equal rows. Only the id and text columns are read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_exact

#: Distinct pieces a worker remembers.
CACHE_PIECES = 200_000
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(more))
        more += b not in plain
    return out


class WordBpe:
    """Encoder and decoder of one tokenizer file with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = max(max(vocab.values()), *(t["id"] for t in data["added_tokens"])) + 1
        self.names = [""] * self.size
        for name, i in vocab.items():
            self.names[i] = name
        for t in data["added_tokens"]:
            self.names[t["id"]] = t["content"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(split["pattern"]["Regex"]).findall
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], dtype=np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in letters], dtype=np.int64)
        self.stride = np.int64(self.size)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.seen: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.words: dict[str, tuple[str, int, str]] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of the pairs, or a value past all ranks."""
        want = a * self.stride + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (a >= 0) & (b >= 0), self.order[at], len(self.keys))

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, a word being the bytes of one pre-token."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.array([len(w) for w in words])
        for power in np.unique(np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)) if len(words) else ():
            rows = np.flatnonzero((np.maximum(sizes, 2) > 1 << (power - 1)) & (np.maximum(sizes, 2) <= 1 << power))
            step = 1 << max(0, 20 - int(power))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                for i, ids in zip(part.tolist(), self._merge([words[i] for i in part], 1 << int(power)), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], width: int) -> list[list[int]]:
        n = len(words)
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        place = np.arange(width)
        sym = self.inner[raw]
        sym[np.arange(n), size - 1] = self.final[raw[np.arange(n), size - 1]]
        sym[place[None, :] >= size[:, None]] = -1
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        after[place[None, :] >= size[:, None] - 1] = width
        none = len(self.keys)
        rank = np.full((n, width), none, dtype=np.int64)
        rank[:, :-1] = self.ranks(sym[:, :-1], sym[:, 1:])
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        tree[:, width:] = np.where(rank < none, rank * width + place, NONE)
        for level in range(width.bit_length() - 2, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            i = root % width
            j = after[live, i]
            sym[live, i] = self.merged[root // width]
            sym[live, j] = -1
            k = after[live, j]
            after[live, i] = k
            inside = k < width
            before[live[inside], k[inside]] = i[inside]
            tree[live, width + j] = NONE
            fresh = np.full(len(live), none, dtype=np.int64)
            fresh[inside] = self.ranks(sym[live[inside], i[inside]], sym[live[inside], k[inside]])
            tree[live, width + i] = np.where(fresh < none, fresh * width + i, NONE)
            h = before[live, i]
            some = h >= 0
            fresh = self.ranks(sym[live[some], h[some]], sym[live[some], i[some]])
            tree[live[some], width + h[some]] = np.where(fresh < none, fresh * width + h[some], NONE)
            for row, leaf in ((live, i), (live, j), (live[some], h[some])):
                node = (width + leaf) >> 1
                while node.size and node[0] >= 1:
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] < NONE]
        here = sym >= 0
        flat, ends = sym[here].tolist(), np.cumsum(here.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def pre_tokens(self, piece: str) -> list[str]:
        """Words of a piece without white space, lower-cased; special tokens stand for themselves."""
        if piece.isascii() and "<|" not in piece:
            return self.words_of(piece.lower())
        if self.special_at and "<|" in piece and (found := self.special_at.search(piece)):
            return [*self.pre_tokens(piece[: found.start()]), found[0], *self.pre_tokens(piece[found.end() :])]
        return self.words_of("".join([c.lower() for c in unicodedata.normalize("NFC", piece)]))

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces not yet known, all at once, and remember (ids, count, decoded) as text."""
        seen, older, words = self.seen, self.older, self.words
        fresh, need = [], set()
        for p in pieces - seen.keys():
            if (known := older.get(p)) is not None:
                seen[p] = known
            else:
                got = self.pre_tokens(p)
                fresh.append((p, got))
                need.update(got)
        new = [w for w in need if w not in words]
        names = self.names
        for w, ids in zip(new, self.encode_words([w.encode("utf-8", "surrogatepass") for w in new]), strict=True):
            if w in self.special:
                ids = [self.special[w]]
            words[w] = (" ".join(map(str, ids)), len(ids), " ".join([names[i] for i in ids]))
        for p, got in fresh:
            if len(got) == 1:
                seen[p] = words[got[0]]
            else:
                parts = [x for w in got if (x := words[w])[1]]
                seen[p] = (" ".join([x[0] for x in parts]), sum([x[1] for x in parts]), " ".join([x[2] for x in parts]))

    def forget(self) -> None:
        if len(self.seen) > CACHE_PIECES:
            self.older, self.seen = self.seen, {}
        if len(self.words) > CACHE_PIECES:
            self.words = {}

    def encode(self, text: str | None) -> list[int]:
        pieces = pieces_of(text)
        self.learn(set(pieces))
        return [int(i) for p in pieces for i in self.seen[p][0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.names[i] for i in ids])


SPACES = {c: " " for c in (*range(0x09, 0x0E), 0x20)}


def pieces_of(text: str | None) -> list[str]:
    """A text cut at white space. Python also cuts at U+001C to U+001F, which are no white space for the tokenizer."""
    if not text:
        return []
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [p for p in text.translate(SPACES).split(" ") if p]
    return text.split()


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _encode(path: str, with_ids: bool):
    def encoded(bpe: WordBpe, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in chunks(frame, "text"):
                split = [pieces_of(t) for t in part["text"]]
                bpe.learn(set().union(*split))
                seen = bpe.seen
                ids, count, decoded = [], [], []
                for pieces in split:
                    if not pieces:
                        parts = ((), (), ())
                    else:
                        parts = tuple(zip(*map(seen.__getitem__, pieces), strict=True))
                        if 0 in parts[1]:  # a piece of nothing that the tokenizer keeps
                            parts = tuple(zip(*(g for g in map(seen.__getitem__, pieces) if g[1]), strict=True)) or ((), (), ())
                    ids.append(" ".join(parts[0]))
                    count.append(sum(parts[1]))
                    decoded.append(" ".join(parts[2]))
                bpe.forget()
                gc.collect(0)
                if with_ids:
                    tokens = [np.array(x.split(" "), dtype=np.int32) if x else np.empty(0, dtype=np.int32) for x in ids]
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "ids": tokens, "n_tokens": count, "decoded": decoded})
                else:
                    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "n_tokens": count, "ids_sha256": [sha(x) for x in ids], "decoded_sha256": [sha(x) for x in decoded]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        gc.disable()  # millions of small tuples, no cycles: the collector would only walk them again and again
        try:
            yield from encoded(bpe, frames)
        finally:
            gc.enable()

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, ids, n_tokens, decoded) of each row, or with ``digests`` (id, n_tokens, ids_sha256, decoded_sha256)."""
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, n_tokens long, decoded string"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_exact(texts, ["id"], _encode(path, not digests), columns).withColumnRenamed("id", id_col)
