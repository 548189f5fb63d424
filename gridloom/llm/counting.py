"""Counts of 64-bit keys, packed: tasks combine their keys in sorted runs and send segments of runs, not rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Keys that a task holds before it combines them, and bytes of packed keys that one segment gathers on average.
RUN_KEYS, SEGMENT_BYTES = 2_000_000, 16_000_000


def segment_bits(keys: float) -> int:
    """Bits of the segment number for about so many keys in all."""
    return int(min(30, max(6, np.ceil(np.log2(max(1.0, keys * 4 / SEGMENT_BYTES))))))


def marks(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first bits + 32 bits of each key, as integers."""
    return (keys >> np.uint64(32 - bits)).astype(np.int64)


PACKED = "segment long, ones binary, more binary, counts binary"


def packed(keys: np.ndarray, bits: int) -> pd.DataFrame:
    """A combined run: for each segment the marks that occur once, and the other ones with their counts."""
    found, n = np.unique(marks(keys, bits), return_counts=True)
    segment, low, n = found >> 32, (found & 0xFFFFFFFF).astype(np.uint32), n.astype(np.uint32)
    ids, at = np.unique(segment, return_index=True)
    cut = lambda x: np.split(x, at[1:]) if len(ids) else []
    rows = [(low_[n_ == 1].tobytes(), low_[n_ > 1].tobytes(), n_[n_ > 1].tobytes()) for low_, n_ in zip(cut(low), cut(n), strict=True)]
    out = pd.DataFrame(rows, columns=["ones", "more", "counts"])
    out.insert(0, "segment", ids)
    return out


def frequent(runs: DataFrame, least: int) -> DataFrame:
    """(mark, n) of the marks that occur ``least`` times or more. A key sends one entry a run, however often it occurs."""

    def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        once = np.frombuffer(b"".join(frame["ones"]), dtype=np.uint32)
        more, n = (np.frombuffer(b"".join(frame[c]), dtype=np.uint32) for c in ("more", "counts"))
        found, at = np.unique(np.concatenate((once, more)), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate((np.ones(len(once)), n)), minlength=len(found)).astype(np.int64)
        keep = total >= least
        return pd.DataFrame({"mark": (np.int64(key[0]) << 32) | found[keep].astype(np.int64), "n": total[keep]})

    return runs.groupBy("segment").applyInPandas(count, "mark long, n long")
