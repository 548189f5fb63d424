"""Vectorised 64-bit hashes of words, word shingles and byte grams inside a task."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C55  # odd, so powers can be inverted modulo 2**64
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums s with s[j] - s[i] = sum of (byte + 1) * BASE**position over [i, j)."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end)."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^ \\t-\\r]+ of all texts, A-Z lower-cased or not, and where each text's words begin (n + 1 bounds)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    data = LOWER[data] if lower else data
    ends = np.cumsum([len(r) + 1 for r in raw])
    gap = SPACE[data]
    before = np.concatenate(([True], gap[:-1]))
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(gap & ~before)
    bounds = np.concatenate(([0], np.searchsorted(start, ends)))
    return spans(prefix_sums(data), start, end), bounds


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct int64 hashes of each text's word shingles; a shorter text is one shingle, one without words none."""
    words, bounds = word_hashes(texts)
    full = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for i in range(width):
        full = full * np.uint64(BASE) + words[i : i + len(full)]
    full = mix(full)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1].view(np.int64)))
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                with np.errstate(over="ignore"):
                    h = h * np.uint64(BASE) + w
            out.append(mix(np.array([h], dtype=np.uint64)).view(np.int64))
        else:
            out.append(np.empty(0, dtype=np.int64))
    return out
