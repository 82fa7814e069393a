"""Spelling variants: pairs of words one edit apart by blocked products of letter counts.

Letter counts of words that differ by one replaced code point are at squared distance 2, by one
inserted or deleted at 1. A block holds words of one length and of the next; the product of its
matrix of letter counts with its transpose gives all squared distances, and pairs at 2 (same
length) or 1 (adjacent) are verified on the letters.

A word of length L is cut in three pieces; one edit changes one of them and moves those behind it.
So words of a block also share the two other pieces, which leaves few words in a block. Blocks of
more than TILE words are dealt out as pairs of tiles.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, staged

#: rows of one product, and words of a block over which it is dealt out in tiles
TILE = 512
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: distinct words a task holds before it passes their counts on
HELD = 400_000


def word_counts(docs: DataFrame, id_col: str, text_col: str, every: int, min_len: int, min_count: int) -> DataFrame:
    """(word, n): distinct letter runs of all whole texts, A-Z lower-cased, after the planted deletions.

    h is the crc32 of `<id>:<run>`; where `every` divides h the code point h % length is deleted.
    """
    run_of = re.compile(f"[a-zÀ-ÿ]{{{min_len},}}")  # shorter runs give shorter words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def passed():
            out = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                own = Counter(run_of.findall(text.translate(_LOWERED).decode(errors="replace")))
                start = zlib.crc32(f"{doc}:".encode())
                changed = [(w, h) for w in own if not (h := zlib.crc32(w.encode(), start)) % every]
                for w, h in changed:
                    k = h % len(w)
                    n = own.pop(w)
                    if len(w) > min_len:
                        total[w[:k] + w[k + 1 :]] += n
                total.update(own)
                if len(total) > HELD:
                    yield passed()
        yield passed()

    cols = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    summed = cols.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return staged(summed.filter(F.col("n") >= min_count), "words")


def cuts(length: int) -> tuple[int, int, int]:
    """Where the three pieces of a word of this length end."""
    return length // 3, 2 * length // 3, length


def block_keys(words: DataFrame) -> DataFrame:
    """(key, long, word, n): the blocks of every word, as one of the block's length and as one that is longer by one.

    The key names the length, the free piece and the letters of the two others.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, longer, of = [], [], []
            for i, w in enumerate(batch.column(0).to_pylist()):
                for more in (0, 1):
                    base = len(w) - more
                    ends = cuts(base)
                    for piece, (a, b) in enumerate(zip((0, *ends), ends)):
                        key.append(f"{base}:{piece}:{w[:a]}:{w[b + more :]}")
                        longer.append(bool(more))
                        of.append(i)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(longer), batch.column(0).take(at), batch.column(1).take(at)], ["key", "longer", "word", "n"])

    return words.mapInArrow(keys, "key string, longer boolean, word string, n long")


def _letters(words: list[bytes]) -> np.ndarray:
    """Latin-1 letters, one row a word, 0 behind its end."""
    width = max(map(len, words)) + 1
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def _edits(a: np.ndarray, b: np.ndarray, longer: np.ndarray, size: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Which pairs (rows of a and b) differ by exactly one edit in the block's piece; longer: b is longer by one, size: length of a.

    A pair whose insertion could be at several places counts in the first piece that ends at or
    behind the last of them, so it is found in one block only.
    """
    differ = a != b
    where = differ.argmax(axis=1)  # the first difference; a letter of b against 0 behind the end of a
    ok = np.ones(len(a), bool)
    same = ~longer
    ok[same] = differ[same].sum(axis=1) == 1
    if longer.any():
        x, y, p = a[longer], b[longer], where[longer]
        moved = x[:, :-1] != y[:, 1:]
        moved &= np.arange(x.shape[1] - 1)[None, :] >= p[:, None]
        ends = np.stack([size[longer] // 3, 2 * size[longer] // 3], axis=1)
        first = (p[:, None] > ends).sum(axis=1)
        ok[longer] = ~moved.any(axis=1) & (first == piece[longer])
    return ok


class Block:
    """Words of some whole blocks (or of two tiles of one): letter counts and the pairs that are one edit apart."""

    def __init__(self, key: np.ndarray, longer: np.ndarray, words: list[bytes], piece: np.ndarray):
        self.key, self.longer, self.piece = key, longer, piece
        self.letters = _letters(words)
        self.size = np.array([len(w) for w in words])
        used, column = np.unique(self.letters, return_inverse=True)
        column = column.reshape(self.letters.shape)
        self.counts = np.zeros((len(words), len(used)), np.float32)
        np.add.at(self.counts, (np.repeat(np.arange(len(words)), column.shape[1]), column.ravel()), 1)
        if used[0] == 0:
            self.counts = self.counts[:, 1:]
        self.norm = (self.counts * self.counts).sum(axis=1)

    def pairs(self, rows: slice, others: slice) -> tuple[np.ndarray, np.ndarray]:
        """Places (i, j), i in rows and of the block's length, j in others, of words one edit apart; same lengths once, i before j."""
        product = self.counts[rows] @ self.counts[others].T
        squared = self.norm[rows][:, None] + self.norm[others][None, :] - 2 * product
        # 2 for the same length, 1 for adjacent lengths
        wanted = np.where(self.longer[others], 1.0, 2.0)[None, :]
        near = (squared == wanted) & (self.key[rows][:, None] == self.key[others][None, :]) & ~self.longer[rows][:, None]
        i, j = np.nonzero(near)
        i, j = i + rows.start, j + others.start
        once = self.longer[j] | (i < j)
        i, j = i[once], j[once]
        ok = _edits(self.letters[i], self.letters[j], self.longer[j], self.size[i], self.piece[i])
        return i[ok], j[ok]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words one edit apart, from (word, n)."""
    spark = words.sparkSession
    keyed = staged(block_keys(words), "keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("held"), F.bool_and("longer").alias("empty"))
    keyed = keyed.join(sizes.filter("held > 1 and not empty"), "key")  # other blocks have no pair
    tiles = F.ceil(F.col("held") / TILE).cast("int")
    rows = keyed.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    # a word of tile t meets the tiles in pairs (i, j), i <= j; blocks of one tile have the pair (0, 0)
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("tile")).alias("i"), F.greatest(o, F.col("tile")).alias("j")))
    rows = rows.select("key", "longer", "word", "n", "tile", F.explode(meets).alias("meet")).select("key", "longer", "word", "n", "tile", "meet.i", "meet.j")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "word")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 8 * TILE):
            word = [w.encode("latin-1") for w in table.column("word").to_pylist()]
            text, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
            i, j, tile = (table.column(c).to_numpy() for c in ("i", "j", "tile"))
            key = table.column("key").combine_chunks()
            fresh = _changes(table)
            group = np.cumsum(fresh) - 1
            heads = key.take(pa.array(np.flatnonzero(fresh))).to_pylist()
            piece = np.array([int(k.split(":", 2)[1]) for k in heads])[group]
            b = Block(group, table.column("longer").to_numpy(zero_copy_only=False), word, piece)
            one, other = [], []
            for start, end in _runs(group, TILE):
                for s, e in _runs(group, TILE):
                    if group[start] <= group[e - 1] and group[s] <= group[end - 1]:
                        x, y = b.pairs(slice(start, end), slice(s, e))
                        cross = (i[x] == j[x]) | (tile[x] != tile[y])  # pairs inside a tile belong to its own block
                        one.append(x[cross])
                        other.append(y[cross])
            x, y = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (one, other))
            a, c = pa.array(np.concatenate([x, y])), np.concatenate([y, x])
            yield pa.RecordBatch.from_arrays([text.take(a), text.take(pa.array(c)), pa.array(n[c])], ["word", "near", "near_n"])

    return dealt.mapInArrow(compare, "word string, near string, near_n long")


def _changes(table: pa.Table) -> np.ndarray:
    """Where a row's (key, i, j) differs from the one before."""
    out = np.ones(table.num_rows, bool)
    key = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
    i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
    out[1:] = (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
    return out


def _runs(group: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of at most `size` rows."""
    return [(a, min(a + size, len(group))) for a in range(0, len(group), size)]


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows of sorted batches, never cutting a group; a group has at most about two tiles."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        last = int(np.flatnonzero(_changes(table))[-1])
        at = 0
        if last:
            starts = np.flatnonzero(_changes(table.slice(0, last)))
            while at < last:
                to = int(starts[np.searchsorted(starts, at + rows)]) if at + rows < starts[-1] else last
                yield table.slice(at, to - at)
                at = to
        held = table.slice(last).to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def variants(docs: DataFrame, every: int = 199, min_len: int = 6, min_count: int = 5, times: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, their form and root: word, form, root, n, n_near, form_n.

    Words are the letter runs (ASCII letters and U+00C0 to U+00FF, only A-Z lower-cased) of all
    whole texts, of at least min_len code points and min_count occurrences n. A word's form is the
    near word (one code point inserted, deleted or replaced) of largest n, ties to the smallest in
    code-point order, if that n is at least `times` the word's; its root is the end of the chain of
    forms, which has few links as n grows by `times` in each.

    Null and empty texts have no words; a null id takes part as the text None. Repeated rows count
    as often as they stand. An empty table gives an empty result. Only the two named columns are
    read.
    """
    words = word_counts(docs, id_col, text_col, every, min_len, min_count)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    large = -F.col("best.n") >= times * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.n")).alias("form_n")
    )
    formed = staged(formed, "formed")
    # chains: every round doubles the links a root has followed
    roots = formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        roots = staged(roots, "roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(further, "root", "left_semi").isEmpty():
            break
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
