"""Whole-array work on the bytes of many texts at once: words, hashes of spans, sums per text."""

from __future__ import annotations

import sys

import numpy as np

from plywise.llm import common
from plywise.llm.common import mixed

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: dict[str, np.ndarray] = {}

#: Bytes that part words by the contracts: space and 0x09-0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that part tokens of letters and digits; those of characters beyond ASCII belong to tokens.
PUNCTUATION = np.array([not (chr(i).isalnum() and i < 128 or i >= 128) for i in range(256)])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


class SpanHash:
    """64-bit hashes of any spans of ``data``, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers_to(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * up[: len(data)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))


def spans(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that don't part, never across texts, and each text's first run."""
    inside = ~parting[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends = ends & (np.concatenate([~inside[1:], [True]]) | edge[1:]) if len(data) else ends
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of the values from one first to the next; zero where there are none."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[firsts[1:]] - total[firsts[:-1]]


common.shipped(__name__)
assert sys.byteorder == "little"
