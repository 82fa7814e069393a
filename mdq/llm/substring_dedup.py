"""Substring dedup of word windows: a count-min prefilter, then exact grouping of what it lets through.

Pass 1 counts the windows of every staged group of documents in a partial count-min sketch and
sends its cells, cut into stripes by a second hash, to one task per stripe, which merges them by
addition. Sums over cells never fall below the true counts, so a window whose estimate is one is
certainly unique. Every group gets back those of its cells that reached two. Pass 2 hashes the
windows whose cells all reached two to 64 bits within a stripe, counts them exactly, and returns
the repeated ones to their groups, where the covered words are cut.

The number of stripes grows with the input, so a stripe's merged sketch has a fixed size. A
window that a third of all documents hold counts once per group in what is sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import bucketed, total_bytes
from .common import pieces
from .words import Words, as_bytes, member, pack, unpack, windows

#: bytes of text for a stripe (about 700,000 words) and cells of a row of its sketch
STRIPE_BYTES, CELL_BITS, DEPTH = 4 << 20, 22, 2
_SENT = "stripe int, part int, __group int, cells binary"


def _window_keys(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, key and stripe hash (independent of the key) of every window that lies in one text."""
    h = words.hashes(11)
    key, other = windows(h, size, 0x51ED270B), windows(h, size, 0x2545F4914F6CDD1D)
    inside = np.flatnonzero(words.doc[: len(key)] == words.doc[size - 1 : size - 1 + len(key)]) if len(key) else np.zeros(0, np.int64)
    return inside, key[inside], other[inside]


def _cells(key: np.ndarray, row: int) -> np.ndarray:
    return (key >> np.uint64(row * CELL_BITS)) & np.uint64((1 << CELL_BITS) - 1)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and which of them occur more than once."""
    v, n = np.unique(values, return_counts=True)
    return v, n > 1


def _merge(blobs: list[bytes]) -> np.ndarray:
    """Values that occur twice or more over all blobs; a blob is its values, then which of them occur more than once in it."""
    v, often = zip(*[_open(b) for b in blobs])
    v, often = np.concatenate(v), np.concatenate(often)
    order = np.argsort(v, kind="stable")
    v, often = v[order], often[order]
    same = np.zeros(len(v), bool)
    same[1:] = v[1:] == v[:-1]
    same[:-1] |= same[1:]
    return np.unique(v[same | often])


def _close(v: np.ndarray, often: np.ndarray) -> bytes:
    head = pack(v)
    return len(head).to_bytes(8, "little") + head + pa.compress(np.packbits(often).tobytes() + b"\0", "zstd", asbytes=True)


def _open(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = int.from_bytes(blob[:8], "little")
    v = unpack(blob[8 : 8 + k])
    bits = pa.decompress(blob[8 + k :], (len(v) + 7) // 8 + 1, "zstd", asbytes=True)
    return v, np.unpackbits(np.frombuffer(bits, np.uint8), count=len(v)).astype(bool)


def _send(group: int, stripe: np.ndarray, key: np.ndarray, parts: list[tuple[int, np.ndarray]]):
    """Rows of _SENT: for every stripe and part, the counted values."""
    out = {"stripe": [], "part": [], "__group": [], "cells": []}
    order = np.argsort(stripe, kind="stable")
    edges = np.flatnonzero(np.diff(stripe[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        own = order[a:b]
        for part, values in parts:
            out["stripe"].append(int(stripe[own[0]]))
            out["part"].append(part)
            out["__group"].append(group)
            out["cells"].append(_close(*_counted(values[own])))
    return pa.table(out, schema=pa.schema([("stripe", pa.int32()), ("part", pa.int32()), ("__group", pa.int32()), ("cells", pa.binary())]))


def _answer(sent: pa.Table) -> pa.Table:
    """Per group, which of its cells of a stripe and part reached two over all groups."""
    blobs = sent["cells"].to_pylist()
    often = _merge(blobs)
    cells = []
    for b in blobs:
        v, _ = _open(b)
        cells.append(pack(v[member(v, often)]))
    return sent.set_column(sent.schema.get_field_index("cells"), "cells", pa.array(cells, pa.binary()))


def repeated_windows(staged: DataFrame, size: int, text_col: str, total: int) -> DataFrame:
    """For every staged group, the sorted keys (cells) of its windows that occur twice or more in all texts, by stripe."""
    n_stripes = pieces(total, STRIPE_BYTES)

    def stripes(other: np.ndarray) -> np.ndarray:
        return (other % np.uint64(n_stripes)).astype(np.int64)

    def sketch(key, rows):
        _, k, other = _window_keys(Words(as_bytes(rows[text_col])), size)
        return _send(key[0].as_py(), stripes(other), k, [(d, _cells(k, d)) for d in range(DEPTH)])

    def merge(_, rows):
        return _answer(rows)

    def exact(key, rows, found):
        _, k, other = _window_keys(Words(as_bytes(rows[text_col])), size)
        stripe, maybe = stripes(other), np.ones(len(k), bool)
        for d in range(DEPTH):
            seen = [unpack(c) + (np.uint64(s) << np.uint64(CELL_BITS)) for s, p, c in zip(found["stripe"].to_pylist(), found["part"].to_pylist(), found["cells"].to_pylist()) if p == d]
            seen = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
            maybe &= member((stripe.astype(np.uint64) << np.uint64(CELL_BITS)) + _cells(k, d), seen)
        return _send(key[0].as_py(), stripe[maybe], k[maybe], [(0, k[maybe])])

    texts = staged.select("__group", text_col)
    estimated = texts.groupBy("__group").applyInArrow(sketch, _SENT).groupBy("stripe", "part").applyInArrow(merge, _SENT)
    passed = texts.groupBy("__group").cogroup(estimated.groupBy("__group")).applyInArrow(exact, _SENT)
    return passed.groupBy("stripe", "part").applyInArrow(merge, _SENT)


def drop_repeated_windows(docs: DataFrame, text_col: str = "text", size: int = 35) -> DataFrame:
    """Cut every word covered by a window of `size` words that also starts anywhere else, in any document.

    Words lie between ASCII white space and are compared unchanged; windows are judged on the
    input, never cross documents, and overlapping ones count. Returns the columns of docs with
    text_col cut (a removed word goes together with the white space behind it; texts without a
    repeat stay as they are, null becomes empty) plus n_words and n_removed. Rows are told apart
    by position, not by id: null, tied or repeated ids are kept, and of two equal rows each makes
    the other's windows repeats. Columns named n_words or n_removed are replaced.
    """
    docs = docs.drop(*[c for c in ("n_words", "n_removed") if c in docs.columns])
    staged = bucketed(docs, "windows")
    repeats = repeated_windows(staged, size, text_col, total_bytes(staged, text_col))
    names = docs.columns
    at = names.index(text_col)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in docs.schema], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(_, rows, found):
        texts = as_bytes(rows[text_col])
        words = Words(texts)
        where, k, _ = _window_keys(words, size)
        known = [unpack(c) for c in found["cells"].to_pylist()]
        hit = where[member(k, np.sort(np.concatenate(known)))] if known else where[:0]
        edge = np.zeros(len(words.start) + 1, np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + size, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) if len(texts) else np.zeros(0, np.int64)
        count = np.diff(words.first)
        removed[count == 0] = 0
        for d in np.flatnonzero(removed):
            a, b, base = words.first[d], words.first[d + 1], words.at[d]
            start = words.start[a:b] - base
            flips = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0))
            kept, last = [], 0
            for i, j in zip(flips[::2], flips[1::2]):
                kept.append(texts[d][last : start[i]])
                last = start[j] if j < len(start) else len(texts[d])
            texts[d] = b"".join([*kept, texts[d][last:]])
        out = rows.select(names).set_column(at, text_col, pa.array(texts, pa.binary()).cast(pa.string()))
        return out.append_column("n_words", pa.array(count, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))

    return staged.groupBy("__group").cogroup(repeats.groupBy("__group")).applyInArrow(cut, schema)
