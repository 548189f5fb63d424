"""A Bloom filter of 64-bit keys, built by Spark in segments. Its size follows the number of keys, up to a bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing

#: Bits of a segment (as a power of two), bits a key, and segments at most: 64 MB in all, enough for 33,000,000 keys.
SEGMENT_BITS, BITS_A_KEY, MOST_SEGMENTS = 20, 16, 512


class Bloom:
    """``has`` is true for all keys put in and for few others (below 1 % up to the bound)."""

    def __init__(self, bits: np.ndarray, depth: int):
        self.bits, self.depth = bits, depth

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = None
        for at in places(keys, self.depth):
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            out = hit if out is None else out & hit
        return out.astype(bool)


def places(keys: np.ndarray, depth: int) -> list[np.ndarray]:
    """Three bits of each key, all in the key's segment."""
    h = hashing.mix(keys.astype(np.uint64, copy=False))
    top = (h >> np.uint64(64 - depth) << np.uint64(SEGMENT_BITS) if depth else np.zeros(len(h), dtype=np.uint64)).astype(np.int64)
    low = hashing.mix(h + np.uint64(0x632BE59BD9B4E019))
    size = np.uint64((1 << SEGMENT_BITS) - 1)
    return [top + ((low >> np.uint64(21 * i)) & size).astype(np.int64) for i in range(3)]


def bloom_of(keys: DataFrame, column: str) -> Bloom | None:
    """The filter of a (written) table's long column; None where it would pass the bound, so callers go on without a filter."""
    n = keys.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n * BITS_A_KEY / (1 << SEGMENT_BITS))))))
    if 1 << depth > MOST_SEGMENTS:
        return None

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        at = np.concatenate(places(frame["h"].to_numpy().view(np.uint64), depth)) & ((1 << SEGMENT_BITS) - 1)
        bits = np.zeros(1 << SEGMENT_BITS, dtype=np.uint8)
        bits[at] = 1
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    def segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            h = frame["h"].to_numpy()
            yield pd.DataFrame({"segment": places(h.view(np.uint64), depth)[0] >> SEGMENT_BITS, "h": h})

    named = keys.select(F.col(column).alias("h")).mapInPandas(segments, "segment long, h long")
    bits = np.zeros(1 << (depth + SEGMENT_BITS - 3), dtype=np.uint8)
    for row in named.groupBy("segment").applyInPandas(pack, "segment long, bits binary").toLocalIterator():
        at = row["segment"] << (SEGMENT_BITS - 3)
        bits[at : at + (1 << (SEGMENT_BITS - 3))] = np.frombuffer(row["bits"], dtype=np.uint8)
    return Bloom(bits, depth)
