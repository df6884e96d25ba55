"""Words of a column of texts as arrays: where they are and 64-bit hashes of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SEGMENT = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_R))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, r in enumerate((_R, pow(_R, -1, 1 << 64))):
            p = np.full(1 << (n - 1).bit_length(), r, _U)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Record batches cut so that their texts have about `most` bytes (a longer text is alone), with the texts' bytes and offsets; null is empty."""
    for b in batches:
        col = b.column(column).fill_null("")
        kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
        off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + b.num_rows + 1].astype(np.int64) if b.num_rows else np.zeros(1, np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield b.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in buf, and for each text the index of its first word (one more at the end)."""
    solid = ~_SPACE[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = off[1:-1][off[1:-1] < len(buf)]
    first[inner] = solid[inner]
    inner = off[1:-1][off[1:-1] > 0] - 1
    last[inner] = solid[inner]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out, i, n = np.empty(len(starts), _U), 0, len(starts)
    while i < n:
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _SEGMENT, "right")))
        up, down = powers(int(ends[j - 1] - base))
        c = np.zeros(int(ends[j - 1] - base) + 1, _U)
        np.cumsum(_BYTE[buf[base : ends[j - 1]]] * up, out=c[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (c[e] - c[s]) * down[s]
        i = j
    return mix(out ^ ((ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)))


class Rolling:
    """Hashes of any runs of a sequence of word hashes, by differences of one running sum."""

    def __init__(self, h: np.ndarray):
        self._up, self._down = powers(len(h) + 1)
        self._sum = np.zeros(len(h) + 1, _U)
        np.cumsum(h * self._up[: len(h)], out=self._sum[1:])

    def runs(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self._sum[e] - self._sum[s]) * self._down[s] ^ (e - s).astype(_U) * _U(0xA0761D6478BD642F))


def leftmost_min(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the index of its least one, the leftmost of equals."""
    now, size = np.arange(len(h)), 1
    while size < w:
        step = min(size, w - size)
        x, y = now[:-step], now[step:]
        now, size = np.where(h[y] < h[x], y, x), size + step
    return now
