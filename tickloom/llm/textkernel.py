"""Vectorised splitting and hashing of UTF-8 texts, used inside Arrow tasks.

Words are runs of characters outside space and \\x09-\\x0D. All bytes of those six characters
are ASCII, so that splitting the UTF-8 bytes and splitting the characters agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LANE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes that are hashed at once; a longer run is hashed in parts, so tables and sums stay this long.
SPAN = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_UP, _DOWN = _powers(_BASE, SPAN + 1), _powers(_INV, SPAN + 1)


def hash_runs(codes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``buf[start:end]``; runs are in order and apart, ``codes`` has a number for each byte."""
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        if b - a <= SPAN:
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(codes[buf[a:b]] * _UP[: b - a], out=sums[1:])
            s = starts[i:j] - a
            out[i:j] = (sums[ends[i:j] - a] - sums[s]) * _DOWN[s]
        else:
            parts = ((k, int((codes[buf[k : min(k + SPAN, b)]] * _UP[: min(SPAN, b - k)]).sum())) for k in range(a, b, SPAN))
            out[i] = sum(v * pow(_BASE, k - a, 1 << 64) for k, v in parts) % (1 << 64)
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


class Block:
    """The bytes of some texts and where their words are. ``bounds[i]:bounds[i + 1]`` are text i's words."""

    def __init__(self, buf: np.ndarray, off: np.ndarray) -> None:
        self.buf, self.off, n = buf, off, len(buf)
        word = ~_SPACE[buf]
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        inner = off[off < n]
        before[inner] = False
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        after[inner[inner > 0] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.bounds = np.searchsorted(self.starts, off)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word, of its A-Z lower-cased bytes if ``lower``."""
        return hash_runs(_BYTE[_LOWER] if lower else _BYTE, self.buf, self.starts, self.ends)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one text's words; of a shorter text, of its whole sequence."""
    if not len(h):
        return h
    if len(h) < k:
        return mix(np.array([np.sum(h * _LANE[: len(h)]) + np.uint64(len(h))], np.uint64))
    n = len(h) - k + 1
    out = h[:n] * _LANE[0]
    for i in range(1, k):
        out = out + h[i : i + n] * _LANE[i]
    return mix(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offsets; null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole rows of about ``most`` bytes; a longer text is one run."""
    buf, off = utf8(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
