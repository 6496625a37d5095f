"""Word shingle sets of whole texts as sorted 64-bit hashes, computed with array operations over many texts at a time."""

from __future__ import annotations

import numpy as np

from tracewell.llm.common import resident

_CODES = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)  # odd: powers have inverses modulo 2**64
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse, n of each at least; kept while shingles are asked for."""
    held = resident(__name__, dict)
    if len(held.get("step", ())) < n:
        size = max(n, 5 << 18)
        for name, base in (("step", _STEP), ("back", _BACK)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            held[name] = np.multiply.accumulate(table)
    return held["step"], held["back"]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and the n + 1 offsets of each text's words."""
    n = len(data)
    inside = np.empty(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~_SPACE[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    # a text's start and end also bound words
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    edge = edge[~_SPACE[data[edge]] & ~_SPACE[data[edge - 1]]]
    begins[edge] = True
    ends[edge - 1] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    step, back = _power(n + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_CODES[_LOWER[data]] * step[:n], out=sums[1:])
    hashes = (sums[stops] - sums[starts]) * back[starts]
    return mix(hashes ^ (stops - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text its distinct k-word shingles in ascending order; with fewer than k words the whole sequence is one, without words none."""
    words, at = word_hashes(data, offsets)
    total = len(words)
    grams = np.zeros(max(0, total - k + 1), dtype=np.uint64)
    for i in range(k):
        grams = grams * _STEP + words[i : total - k + 1 + i] if len(grams) else grams
    grams = mix(grams + np.uint64(k))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            keep = np.empty(len(g), dtype=bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g[keep])
        elif b > a:
            h = 0
            for w in words[a:b].tolist():
                h = (h * int(_STEP) + w) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([(h + b - a) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
