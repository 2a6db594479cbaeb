"""64-bit hashes of a text's distinct word shingles, for many texts at a time."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash like a-z
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``width`` words (uint64).

    Words are runs of bytes other than ASCII blanks, A-Z lower-cased. A text with fewer words,
    but not none, has one shingle of all its words; a null text or one without words none.
    A word hashes as a polynomial of its bytes, read off one running sum over all texts.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    joined = np.frombuffer(b" ".join([b"", *raw, b""]), dtype=np.uint8)
    blank = _BLANK[joined]
    first = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    behind = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    up, down = _powers(1 << (len(joined) - 1).bit_length() if len(joined) > 1 else 1)
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[joined] * up[: len(joined)], out=sums[1:])
    words = mix((sums[behind] - sums[first]) * down[first] + (behind - first).astype(np.uint64))
    text_first = np.cumsum([1, *(len(r) + 1 for r in raw)])
    at = np.searchsorted(first, text_first)
    n = max(0, len(words) - width + 1)
    runs = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        runs += words[k : k + n] * _PLACE[k]
    runs = mix(runs)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
