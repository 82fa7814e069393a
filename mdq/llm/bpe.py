"""Byte-level BPE: ranked merges folded over the bytes of distinct words by Spark higher-order functions.

The rank file becomes a literal map, cut into slots by a hash so that a look-up is constant. For
the distinct words that make up most of a corpus, at most COMMON of them, the fold runs in the
JVM: a word is an array of byte strings (written in hex), each step merges the pair with the
lowest rank, leftmost first. Documents are then encoded where they are, with no shuffle: words by
the dictionary of common ones, and the many rare ones, mostly seen once, by the same fold over
their bytes in the task. Decoding looks up the piece of every id and concatenates.
"""

from __future__ import annotations

import base64
import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

SLOTS = 1 << 15
#: words of the dictionary at most; a bound on memory alone, results do not depend on it
COMMON = 1 << 17
#: bytes of a word that is folded in the JVM; the fold is quadratic
LONGEST = 64
#: documents of an Arrow batch that a task hands back
_ROWS = 256


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _literal(value, kind: T.DataType) -> Column:
    return F.get(F.from_json(F.lit(json.dumps([value])), T.ArrayType(kind)), F.lit(0))


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: slots of small maps from hex to rank."""
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        h = piece.hex().upper()
        slots[xxhash.xxh64_intdigest(h, seed=42) & (SLOTS - 1)][h] = rank
    return _literal(slots, T.ArrayType(T.MapType(T.StringType(), T.IntegerType())))


def fold_word(word: Column, ranks: Column) -> Column:
    """Ids of a word (string column) by ranked merges over its bytes."""

    def rank(x: Column) -> Column:
        return F.element_at(F.get(ranks, F.xxhash64(x).bitwiseAND(SLOTS - 1).cast("int")), x)

    def let(value: Column, then) -> Column:
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def step(state: Column, _: Column) -> Column:
        parts = state["parts"]
        found = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: rank(F.concat(F.get(parts, i), F.get(parts, i + 1))))

        def merged(r: Column) -> Column:
            def at(k: Column) -> Column:
                pair = F.array(F.concat(F.get(parts, k - 1), F.get(parts, k)))
                return F.concat(F.slice(parts, F.lit(1), k - 1), pair, F.slice(parts, k + 2, F.size(parts)))

            none = F.array_min(r).isNull()
            return F.struct(F.when(none, parts).otherwise(let(F.array_position(r, F.array_min(r)).cast("int"), at)).alias("parts"), none.alias("done"))

        return F.when(state["done"] | (F.size(parts) < 2), state).otherwise(let(found, merged))

    h = F.hex(F.encode(word, "UTF-8"))
    n = (F.length(h) / 2).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(h, i * 2 + 1, F.lit(2)))
    start = F.struct(parts.alias("parts"), F.lit(False).alias("done"))
    ids = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step, lambda s: F.transform(s["parts"], rank))
    return F.when(rank(h).isNotNull(), F.array(rank(h))).otherwise(ids)


def common_words(docs: DataFrame, pattern: str, text_col: str, most: int = COMMON) -> DataFrame:
    """(word) of the commonest words over all texts, at most `most`, none over LONGEST bytes."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit("(?U)" + pattern), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.octet_length("word") <= LONGEST))
    counted = staged(counted.withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "words")
    # the least level from which on there are at most `most` words: a histogram of logarithms, so a few hundred rows
    total, least = 0, 1 << 30
    for r in counted.groupBy("level").agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect():
        total += r["k"]
        if total > most:
            break
        least = r["level"]
    return counted.filter(F.col("level") >= least).select("word")


def _bytes(ids: tuple[int, ...]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def dictionary(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> dict[str, bytes]:
    """Ids of the common words as little-endian bytes, folded in the JVM; bounded by COMMON."""
    words = common_words(docs, pattern, text_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = words.repartition(n).select("word", fold_word(F.col("word"), rank_map(read_ranks(ranks_path))).alias("ids")).toArrow()
    return {w: _bytes(i) for w, i in zip(rows["word"].to_pylist(), rows["ids"].to_pylist())}


def merge(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same fold for one word: the pair with the lowest rank is merged, leftmost first."""
    if word in ranks:
        return (ranks[word],)
    if len(word) > 4 * LONGEST:
        return _merge_long(word, ranks)
    none, get = 1 << 60, ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return tuple([ranks[p] for p in parts])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """For long words: all places of the lowest pair in one pass, which gives the same result, as new pairs rank above it."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, none = None, 1 << 60
        for a, b in zip(parts, parts[1:]):
            r = ranks.get(a + b, none)
            if r < none:
                none, best = r, (a, b)
        if best is None:
            break
        out, i, (a, b) = [], 0, best
        while i < len(parts):
            if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return tuple([ranks[p] for p in parts])


class Known(dict):
    """Ids of words as little-endian bytes; a word that is not known is folded and kept, up to `room` of them."""

    def __init__(self, common: dict[str, bytes], ranks: dict[bytes, int], room: int):
        super().__init__(common)
        self.common, self.ranks, self.most = common, ranks, len(common) + room

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.most:
            self.clear()
            self.update(self.common)
        self[word] = ids = np.array(merge(word.encode(), self.ranks), "<i4").tobytes()
        return ids


#: the words that this worker knows, kept from task to task; of the last dictionary only
_KEPT: dict[str, Known] = {}


def _known(made: str, shared, room: int) -> Known:
    if made not in _KEPT:
        _KEPT.clear()
        ranks, common = shared.value
        _KEPT[made] = Known(common, ranks, room)
    return _KEPT[made]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", cache: int = 300_000) -> DataFrame:
    """docs with ids (array of int): every whole text by the ranks, each match of the pattern separately, no special tokens.

    A null or empty text has no ids. A column named ids is replaced. ranks_path is read by the
    driver; tasks get the ranks and the dictionary, both of bounded size, by broadcast.
    """
    docs = docs.drop("ids") if "ids" in docs.columns else docs
    names, at = docs.columns, docs.columns.index(text_col)
    made = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), dictionary(docs, ranks_path, pattern, text_col)))

    def run(batches):
        find = regex.compile(pattern).findall
        known = _known(made, shared, cache)
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):  # short batches: the ids take more room than the text
                batch = whole.slice(start, _ROWS)
                ids = [b"".join(map(known.__getitem__, find(text.as_py() or ""))) for text in batch.column(at)]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], [*names, "ids"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "ids array<int>"])
    return docs.mapInArrow(run, schema)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: their pieces, concatenated."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = _literal(pieces, T.ArrayType(T.StringType()))
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def little_endian(ids: Column, n: int) -> Column:
    """The ids below n as little-endian unsigned 32-bit integers."""
    table = _literal([i.to_bytes(4, "little").hex() for i in range(n)], T.ArrayType(T.StringType()))
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))
