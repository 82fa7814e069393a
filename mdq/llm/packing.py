"""Best-fit packing by exact complements, planned on the histogram of lengths and dealt out to all pieces.

The plan sees only how many pieces there are of each length, at most `capacity` numbers however
large the input. Gaps are filled exactly first, by single lengths, pairs and triples whose sums
are indexed; what is left goes best-fit into the tightest gap. The plan says which ranks of a
length go to which sequence and offset; pieces get their ranks from counts per part, so no task
and no driver ever holds the pieces.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged


def byte_ranks(model: dict) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE file as bytes: printable bytes stand for themselves, the others for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}
    return {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items()}


class Ids:
    """Token ids of texts by a tokenizer file with a byte-level BPE.

    Its ids follow the order of its merges, so the rank encoder gives the same ids at a third of
    the time. Texts that spell a special token go to the library of the file.
    """

    def __init__(self, path: str, pattern: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"] for t in file["added_tokens"]]
        vocab = file["model"] | {"vocab": {p: i for p, i in file["model"]["vocab"].items() if p not in self.special}}
        self.ranks = Encoding("file", pat_str=pattern, mergeable_ranks=byte_ranks(vocab), special_tokens={})
        self.whole = Tokenizer.from_file(path)

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return self.ranks.encode_to_numpy(text, disallowed_special=())


def token_pieces(docs: DataFrame, path: str, pattern: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32) of every piece; only documents over the capacity are cut, their first piece is the short one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(path, pattern)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.append(ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = (len(tokens) - 1) % capacity + 1
                edges = [0, *range(first, len(tokens) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    for column, v in zip(out, (doc, k, a, b - a, zlib.crc32(tokens[a:b]))):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["id", "piece", "start", "length", "ids_crc32"])

    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


#: lengths under this share of the capacity keep so many of their pieces back for the residuals
RESERVE, KEPT = 1 / 2, 1 / 2


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """How often each pattern of lengths is packed: (times, lengths), every length as often in all as counts says.

    Lengths are taken from the longest. Its gap is looked up among single lengths, then among
    indexed pair and triple sums, those with the longest pieces first; a combination is consumed as
    often as the available counts allow. A length whose gap no combination fills exactly waits for
    the best-fit residuals. Short pieces fit almost anywhere, and residuals without any would leave
    gaps open, so half of the pieces of short lengths are held back from the combinations.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    held = np.where(np.arange(capacity + 1) < capacity * RESERVE, np.ceil(left * KEPT), 0).astype(np.int64)
    out: list[tuple[int, tuple[int, ...]]] = []
    residual: list[tuple[int, int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        kinds, need = np.unique(lengths, return_counts=True)
        free = left[kinds] - np.where(kinds == lengths[0], 0, held[kinds])
        times = int((free // need).min())
        if times > 0:
            out.append((times, lengths))
            left[kinds] -= need * times

    def pairs(total: int, most: int) -> list[int]:
        """The longer of two available lengths with this sum, longest first."""
        free = left > held
        a = np.arange((total + 1) // 2, min(total, most + 1))
        return a[free[a] & free[total - a]][::-1].tolist()

    for n in sorted(counts, reverse=True):
        gap = capacity - n
        if not gap:
            take((n,))
        elif left[n] and left[gap] > held[gap]:
            take((n, gap))
        for a in pairs(gap, n) if left[n] and gap else ():
            take((n, a, gap - a))
            if not left[n]:
                break
        longest = np.arange((gap + 2) // 3, min(gap, n + 1))
        for a in longest[left[longest] > held[longest]][::-1].tolist() if left[n] and gap else ():
            for b in pairs(gap - a, a):
                take((n, a, b, gap - a - b))
                if not left[n] or left[a] <= held[a]:
                    break
            if not left[n]:
                break
        if left[n]:
            residual.append((n, int(left[n])))
            left[n] = 0
    return out + _best_fit(residual, capacity)


def _best_fit(lengths: list[tuple[int, int]], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over (length, count), longest first; equal sequences are filled together."""
    bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by gap
    gaps: list[int] = []

    def put(gap: int, times: int, items: tuple[int, ...]) -> None:
        if gap not in bins:
            bins[gap] = []
            gaps.insert(bisect_right(gaps, gap), gap)
        bins[gap].append((times, items))

    for n, count in lengths:
        while count:
            at = bisect_right(gaps, n - 1)
            if at == len(gaps):  # open sequences of as many of this length as fit
                each = min(capacity // n, count)
                put(capacity - each * n, count // each, (n,) * each)
                count %= each
                continue
            gap = gaps[at]
            times, items = bins[gap].pop()
            each = min(gap // n, count)
            now = min(times, count // each)
            if times > now:
                bins[gap].append((times - now, items))
            if not bins[gap]:
                del bins[gap]
                gaps.pop(at)
            put(gap - each * n, now, items + (n,) * each)
            count -= now * each
    return [x for v in bins.values() for x in v]


def _slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For every length, from which rank on its pieces go to which sequence (plus one per rank) and offset; sorted by (length, rank)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, items in patterns:
        offset = 0
        for n in items:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    rows.sort()
    return {k: np.array(v, np.int64) for k, v in zip(("length", "rank", "sequence", "offset"), zip(*rows))} if rows else {}


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to rows with a length from 1 to capacity: gapless sequences from 0, of at most capacity.

    Extra columns stay; equal rows each get a place of their own.
    """
    part = pieces.withColumn("__part", F.spark_partition_id())
    # ranks within a part and length; written, so that they stay as they are
    own = staged(part.withColumn("__i", F.row_number().over(Window.partitionBy("__part", "length").orderBy(F.lit(1))) - 1), "ranked")
    sizes = own.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    base = sizes.withColumn("__base", F.sum("__n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most `capacity` rows
    slots = _slots(plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = slots["length"] << 48 | slots["rank"] if slots else None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            length, rank = at["length"].to_numpy().astype(np.int64), at["__rank"].to_numpy()
            k = np.searchsorted(key, length << 48 | rank, "right") - 1
            columns = [at[n] for n in names] + [pa.array(slots["sequence"][k] + rank - slots["rank"][k]), pa.array(slots["offset"][k])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    names = pieces.columns
    ranked = own.join(base.select("length", "__part", F.coalesce("__base", F.lit(0)).alias("__base")), ["length", "__part"]).select(*names, (F.col("__base") + F.col("__i")).alias("__rank"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema], "sequence_id long", "offset long"])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize whole texts, end each with end_id, and pack them into sequences of at most capacity tokens.

    A null text is empty and gives one piece of the end id alone. Returns per piece: id_col,
    piece, start, length, ids_crc32, sequence_id, offset. Null, tied or repeated ids are kept as
    they are: every row is a document.
    """
    return pack(token_pieces(docs, path, pattern, capacity, end_id, id_col, text_col), capacity)
