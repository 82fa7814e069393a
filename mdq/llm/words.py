"""Words of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    h = (h ^ (h >> _S32)) * _A
    h = (h ^ (h >> _S29)) * _B
    return h ^ (h >> _S32)


class Words:
    """buf holds the texts one after the other; start, end (bytes) and doc of every word; first: index of each text's first word, and their number at the end."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(joined + b"\0" * 8, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        space = _SPACE[self.buf[: len(joined)]]
        before = np.concatenate([[True], space[:-1]])
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(space & ~before)
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of every word's bytes."""
        eight = np.ndarray((len(self.buf) - 7,), "<u8", self.buf, strides=(1,))
        size = self.end - self.start
        h = mix(size.astype(np.uint64) * _B + np.uint64(seed))
        todo, k = np.arange(len(size)), 0
        while len(todo):
            left = size[todo] - k
            h[todo] = mix(h[todo] ^ (eight[self.start[todo] + k] & _MASK[np.minimum(left, 8)]))
            todo, k = todo[left > 8], k + 8
        return h


def windows(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of every n consecutive values; element i covers i to i + n - 1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, done, step = None, 0, 1
    part, power = h, seed | 1
    while True:
        factor = np.uint64(power)
        if n & step:
            if out is None:
                out, done = part, step
            else:  # put `step` more values behind the `done` that out covers
                k = len(h) - done - step + 1
                out, done = out[:k] * factor + part[done : done + k], done + step
        if step * 2 > n:
            return mix(out)
        k = len(h) - 2 * step + 1
        part, power, step = part[:k] * factor + part[step : step + k], power * power % 2**64, step * 2


def as_bytes(column: pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values, as compressed differences."""
    d = np.diff(values, prepend=np.uint64(0))
    return len(values).to_bytes(8, "little") + pa.compress(d.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    d = np.frombuffer(pa.decompress(blob[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T
    return np.cumsum(np.ascontiguousarray(d).view("<u8").ravel(), dtype=np.uint64)


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array `of`."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values
