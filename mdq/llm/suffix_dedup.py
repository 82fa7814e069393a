"""Suffix dedup of byte strings by column-wise construction over collections of aligned pieces.

Any two equal strings of `size` bytes have the same smallest hashed 64-byte gram (the anchor) at
the same place. So every text is cut into pieces, the maximal runs of strings with one anchor, and
a string can only recur in a piece with the same anchor gram, at the same column relative to it.
Pieces that are equal byte for byte are counted once. The distinct pieces of an anchor gram form a
collection, aligned at the anchor, whose suffixes are sorted column by column from the right: each
round inserts one symbol of every piece. The symbols that precede the suffixes of the last round,
read in suffix order (that round's part of the Burrows-Wheeler transform), are sorted stably to
give the order of the new suffixes, and the common prefixes are carried over as the column of the
first mismatch with the suffix before. Where two neighbours agree for `size` bytes, the string
occurs twice. Collections beyond the memory limit keep their columns in a sequential file.

Only suffixes of one column are ordered against each other, which is all that equal strings need:
a round costs the number of pieces, not the length of the whole transform.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import bucketed
from .common import staged
from .words import as_bytes, mix

GRAM = 64
#: string starts that are hashed at once
BLOCK = 1 << 18
#: bytes of columns that a worker holds in memory, and pieces that are built together
MEMORY, BATCH = 64 << 20, 8192
_FAR = np.uint64(2**64 - 1)
_LOW = np.uint64((1 << 24) - 1)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of every GRAM bytes of buf."""
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    h = mix(eight.astype(np.uint64))
    for width, m in ((8, _M1), (16, _M2), (32, _M3)):
        h = h[:-width] * m + h[width:]
        h ^= h >> np.uint64(31)
    return mix(h)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    n = len(v) - w + 1
    padded = np.concatenate([v, np.full(-len(v) % w, _FAR)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def pieces_of(buf: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Pieces of the texts that lie in buf one after the other, text i at at[i] to at[i + 1].

    Returns first (start of the piece's first string in buf), count (of its strings), anchor
    (place in buf) and gram (the anchor's hash).
    """
    found = []
    last = len(buf) - size + 1
    for s in range(0, last, BLOCK):
        e = min(s + BLOCK, last)
        h = _gram_hashes(buf[s : e + size - 1])
        place = np.arange(len(h), dtype=np.uint64)
        least = _sliding_min((h & ~_LOW) | place, size - GRAM + 1)
        where = (least & _LOW).astype(np.int64)
        # strings that cross the end of a text belong to none, and so break the runs
        start = np.arange(s, e)
        inside = start + size <= at[np.searchsorted(at, start, "right")]
        key = np.where(inside, where, -1)
        edge = np.flatnonzero(np.diff(key, prepend=-2))
        n = np.diff(np.append(edge, e - s))
        good = key[edge] >= 0
        edge, n = edge[good], n[good]
        found.append((edge + s, n, where[edge] + s, h[where[edge]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _digest(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data)
    return (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63


class Collection:
    """Pieces with their collection's number and anchor offset, one row each, columns in memory or in a file."""

    def __init__(self, data: list[bytes], group: np.ndarray, anchor: np.ndarray, size: int):
        self.n, self.size, self.group = len(data), size, group
        self.shift = anchor.max() - anchor  # column of every piece's first byte
        self.length = np.fromiter(map(len, data), np.int64, self.n)
        width = int((self.shift + self.length).max())
        shape = (width, self.n)
        self.file = None
        if self.n * width * 2 > MEMORY:
            self.file = tempfile.TemporaryFile()
            self.columns = np.memmap(self.file, np.uint16, "w+", shape=shape)
        else:
            self.columns = np.zeros(shape, np.uint16)
        for a in range(0, self.n, 4096):  # symbol 0 stands for no byte
            rows = np.zeros((min(4096, self.n - a), width), np.uint16)
            for i, x in enumerate(data[a : a + 4096]):
                rows[i, self.shift[a + i] : self.shift[a + i] + len(x)] = np.frombuffer(x, np.uint8)
                rows[i, self.shift[a + i] : self.shift[a + i] + len(x)] += 1
            self.columns[:, a : a + len(rows)] = rows.T

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, first, one past the last string start) of every run of strings that another piece of its collection holds too."""
        order = np.argsort(self.group, kind="stable")
        group = self.group[order].astype(np.uint16)
        fresh = np.diff(group, prepend=-1) != 0  # first of its collection
        mismatch = np.full(self.n, len(self.columns))
        runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        opened = np.full(self.n, -1)  # one past the last start of a run that goes on to the left

        def close(own: np.ndarray, col: int) -> None:
            runs.append((own, col + 1 - self.shift[own], opened[own] - self.shift[own]))
            opened[own] = -1

        for col in range(len(self.columns) - 1, -1, -1):
            symbol = self.columns[col][order]  # the transform of the last round's suffixes
            falls = (symbol[1:] < symbol[:-1]) & ~fresh[1:]
            if falls.any():
                turn = np.argsort(symbol, kind="stable")
                turn = turn[np.argsort(group[turn], kind="stable")]
                order, symbol = order[turn], symbol[turn]
                # common prefix of two that were not neighbours: the least on the way between them
                lo, hi = turn[:-1], turn[1:]
                mismatch_now = np.full(self.n, col)
                same = np.zeros(self.n, bool)
                same[1:] = (symbol[1:] == symbol[:-1]) & (symbol[1:] > 0) & ~fresh[1:]
                near = same.copy()
                near[1:] &= hi == lo + 1
                mismatch_now[near] = mismatch[turn[near]]
                far = np.flatnonzero(same & ~near)
                if len(far):
                    spans = np.stack([turn[far - 1] + 1, turn[far] + 1], axis=1).ravel()
                    mismatch_now[far] = np.minimum.reduceat(np.append(mismatch, 0), spans)[::2]
                mismatch = mismatch_now
            else:
                same = np.zeros(self.n, bool)
                same[1:] = (symbol[1:] == symbol[:-1]) & (symbol[1:] > 0) & ~fresh[1:]
                mismatch = np.where(same, mismatch, col)
            twice = np.flatnonzero(mismatch - col >= self.size)
            hit = np.zeros(self.n, bool)
            hit[order[twice]] = hit[order[twice - 1]] = True
            if (ends := np.flatnonzero((opened >= 0) & ~hit)).size:
                close(ends, col)
            opened[hit & (opened < 0)] = col + 1
        close(np.flatnonzero(opened >= 0), -1)
        if self.file is not None:
            self.columns._mmap.close()
            self.file.close()
        return tuple(np.concatenate(x) for x in zip(*runs))


_PIECE = "gram long, p1 long, p2 long, __group int, n long, row int, start int, length int, anchor int"
_BYTES = "gram long, p1 long, p2 long, anchor int, data binary"
_FOUND = "p1 long, p2 long, runs binary"


def _laid_out(rows: pa.Table, text_col: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The group's texts in the order of their rows, one after the other, and where each starts."""
    rows = rows.sort_by("__row")
    texts = as_bytes(rows[text_col])
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    return texts, np.frombuffer(b"".join(texts), np.uint8), at


def find_repeats(docs: DataFrame, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """The staged documents, and (__group, p1, p2, runs) for every distinct piece of a group that has repeated strings.

    runs holds pairs of 32-bit numbers: the first and one past the last repeated string start in the piece.
    """
    held = bucketed(docs, "suffix")
    texts = held.select("__group", "__row", text_col)

    def cut(key, rows):
        _, buf, at = _laid_out(rows, text_col)
        first, count, anchor, gram = pieces_of(buf, at, size)
        own: dict[tuple[int, int], list] = {}
        view = memoryview(buf)
        for s, n, a, g in zip(first.tolist(), count.tolist(), anchor.tolist(), gram.view(np.int64).tolist()):
            length = n + size - 1
            d = _digest(view[s : s + length])
            seen = own.get(d)
            if seen is None:
                own[d] = [g, *d, key[0].as_py(), 1, 0, s, length, a - s]
            else:
                seen[4] += 1
        columns = list(zip(*own.values())) or [[]] * 9
        kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64()] + [pa.int32()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["gram", "p1", "p2", "__group", "n", "row", "start", "length", "anchor"])

    parts = staged(texts.groupBy("__group").applyInArrow(cut, _PIECE), "pieces")
    # equal pieces count together; only grams with several different pieces need their bytes compared
    distinct = staged(
        parts.groupBy("gram", "p1", "p2").agg(F.sum("n").alias("n"), F.min(F.struct("__group", "start", "length", "anchor")).alias("one")),
        "distinct",
    )
    several = distinct.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1").select("gram")
    wanted = distinct.join(several, "gram", "left_semi").select(F.col("one.__group").alias("__group"), "gram", "p1", "p2", F.col("one.start").alias("start"), F.col("one.length").alias("length"), F.col("one.anchor").alias("anchor"))

    def fetch(_, rows, places):
        view = memoryview(_laid_out(rows, text_col)[1] if places.num_rows else b"")
        data = [bytes(view[s : s + n]) for s, n in zip(places["start"].to_pylist(), places["length"].to_pylist())]
        return places.select(["gram", "p1", "p2", "anchor"]).append_column("data", pa.array(data, pa.binary()))

    def build(batches):
        held: list[pa.RecordBatch] = []

        def flush(upto: pa.Table):
            gram = upto["gram"].to_numpy()
            group = np.cumsum(np.diff(gram, prepend=gram[0]) != 0)
            p1, p2 = upto["p1"].to_numpy(), upto["p2"].to_numpy()
            anchor, data = upto["anchor"].to_numpy().astype(np.int64), upto["data"]
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=group[-1] + 1))
            a = 0
            while a < len(edges) - 1:  # whole collections, about BATCH pieces at a time
                b = a + 1
                while b < len(edges) - 1 and edges[b + 1] - edges[a] <= BATCH:
                    b += 1
                s, e = edges[a], edges[b]
                piece, start, end = Collection(data[s:e].to_pylist(), group[s:e] - group[s], anchor[s:e], size).repeated()
                if len(piece):
                    order = np.argsort(piece, kind="stable")
                    runs = np.stack([start, end], axis=1).astype("<i4")[order]
                    own = np.flatnonzero(np.diff(piece[order], prepend=-1))
                    blobs = [r.tobytes() for r in np.split(runs, own[1:])]
                    who = piece[order][own] + s
                    yield pa.RecordBatch.from_arrays([pa.array(p1[who]), pa.array(p2[who]), pa.array(blobs, pa.binary())], ["p1", "p2", "runs"])
                a = b

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if batch.column(0)[-1].as_py() != held[0].column(0)[0].as_py() and sum(x.num_rows for x in held) >= BATCH:
                all_ = pa.Table.from_batches(held)
                last = all_["gram"].to_numpy()
                k = int(np.flatnonzero(last != last[-1])[-1]) + 1  # the last collection may go on
                yield from flush(all_.slice(0, k).combine_chunks())
                held[:] = all_.slice(k).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = texts.groupBy("__group").cogroup(wanted.groupBy("__group")).applyInArrow(fetch, _BYTES)
    compared = data.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(build, _FOUND)
    whole = distinct.filter("n > 1").select("p1", "p2", F.lit(None).cast("binary").alias("runs"))
    # a piece that occurs twice is repeated as a whole, whatever its neighbours say
    answer = compared.join(whole, ["p1", "p2"], "left_anti").unionByName(whole)
    return held, parts.select("__group", "p1", "p2").join(answer, ["p1", "p2"])


def drop_repeated_bytes(docs: DataFrame, text_col: str = "text", size: int = 400) -> DataFrame:
    """Cut every byte covered by a string of `size` bytes that also starts anywhere else, in any document.

    Texts are UTF-8 bytes (null: empty); strings never cross documents, overlapping ones count,
    and all are judged on the input. Returns the columns of docs (text_col unchanged) plus kept
    (binary, what is left; it may break inside a character), n_bytes, n_removed and n_spans
    (maximal removed runs). Rows are told apart by position, not by id: null or repeated ids are
    kept, and equal rows repeat each other. Columns of docs with these names are replaced.
    """
    if size < 2 * GRAM:
        raise ValueError(f"size must be at least {2 * GRAM}")
    made = [("kept", T.BinaryType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType())]
    docs = docs.drop(*[c for c, _ in made if c in docs.columns])
    held, repeats = find_repeats(docs, text_col, size)
    names = docs.columns
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField(*m) for m in made])

    def cut(_, rows, found):
        rows = rows.sort_by("__row")
        texts, buf, at = _laid_out(rows, text_col)
        runs = {(a, b): r for a, b, r in zip(found["p1"].to_pylist(), found["p2"].to_pylist(), found["runs"].to_pylist())}
        edge = np.zeros(len(buf) + 1, np.int32)
        if runs:
            view = memoryview(buf)
            for s, n in zip(*(x.tolist() for x in pieces_of(buf, at, size)[:2])):
                d = _digest(view[s : s + n + size - 1])
                if d in runs:
                    r = runs[d]
                    for a, b in [(0, n)] if r is None else np.frombuffer(r, "<i4").reshape(-1, 2).tolist():
                        edge[s + a] += 1
                        edge[s + b - 1 + size] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept, removed, spans = [], [], []
        for i in range(len(texts)):
            own = gone[at[i] : at[i + 1]]
            k = int(own.sum())
            removed.append(k)
            spans.append(int(np.count_nonzero(np.diff(own.astype(np.int8), prepend=0) == 1)) if k else 0)
            kept.append(buf[at[i] : at[i + 1]][~own].tobytes() if k else texts[i])
        out = rows.select(names)
        for name, values, kind in (("kept", kept, pa.binary()), ("n_bytes", [len(t) for t in texts], pa.int64()), ("n_removed", removed, pa.int64()), ("n_spans", spans, pa.int64())):
            out = out.append_column(name, pa.array(values, kind))
        return out

    return held.groupBy("__group").cogroup(repeats.groupBy("__group")).applyInArrow(cut, schema)
