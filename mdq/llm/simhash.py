"""SimHash near-dedup: fingerprints, links through BK-trees of shards, connected components.

Two fingerprints that differ in at most 3 of 64 bits agree in one of four 16-bit blocks, and then
in one of four 12-bit blocks of the other 48 bits. So every distinct fingerprint goes to 16 shards
of 28 agreeing bits, and any two that link share a shard. Inside a shard a BK-tree is searched;
the shard emits a spanning forest of its links, not the pairs. The trees stay in the tasks that
hold their shards: a tree over all fingerprints would be a broadcast that grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, staged

#: pairs of (query, node) that a search holds at once
FRONTIER = 4_000_000
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; zero without words."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + _CHUNK], ends[k : k + _CHUNK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fp = np.array([fingerprint(x.as_py() or b"") for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _shards(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 16 shard keys of every fingerprint, and the fingerprints beside them."""
    out = []
    v = fps.view(np.uint64)
    for i in range(4):
        block = (v >> np.uint64(16 * i)) & np.uint64(0xFFFF)
        low = v & np.uint64((1 << (16 * i)) - 1)
        rest = low | ((v >> np.uint64(16 * i + 16)) << np.uint64(16 * i)) if i < 3 else low
        for j in range(4):
            sub = (rest >> np.uint64(12 * j)) & np.uint64(0xFFF)
            out.append((np.uint64(4 * i + j) << np.uint64(28)) | (block << np.uint64(12)) | sub)
    return np.concatenate(out).view(np.int64), np.tile(fps, 16)


class Trees:
    """BK-trees over points grouped by shard: one root per shard, children keyed by their distance to the parent."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        n = len(value)
        self.value = value = value.view(np.uint64)  # of signed numbers the bits of the magnitude would be counted
        group = np.unique(shard, return_inverse=True)[1]
        self.root = np.full(n, -1)
        todo, parent, edge = np.arange(n), np.full(n, -1), np.zeros(n, np.int64)
        while len(todo):
            _, head, own = np.unique(group[todo], return_index=True, return_inverse=True)
            pivot = todo[head][own]
            if self.root[0] < 0:
                self.root = pivot.copy()
            else:
                first = todo[head]
                parent[first], edge[first] = self._above[group[first]], self._edge[group[first]]
            rest = pivot != todo
            todo, pivot = todo[rest], pivot[rest]
            d = np.bitwise_count(value[todo] ^ value[pivot]).astype(np.int64)
            keys, group_of = np.unique(pivot * 128 + d, return_inverse=True)
            group[todo] = group_of
            self._above, self._edge = keys // 128, keys % 128
        child = np.flatnonzero(parent >= 0)
        key = parent[child] * 128 + edge[child]
        order = np.argsort(key)
        self.child, self.key = child[order], key[order]

    def links(self, radius: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(point, other point) within the radius, in blocks of queries."""
        for a in range(0, len(self.value), chunk):
            q = np.arange(a, min(a + chunk, len(self.value)))
            node = self.root[q]
            while len(q):
                d = np.bitwise_count(self.value[q] ^ self.value[node]).astype(np.int64)
                near = (d <= radius) & (q != node)
                yield q[near], node[near]
                lo = np.searchsorted(self.key, node * 128 + np.maximum(d - radius, 0))
                hi = np.searchsorted(self.key, node * 128 + d + radius, "right")
                n = hi - lo
                q = np.repeat(q, n)
                node = self.child[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if n.sum() else q
        return


def _find(parent: dict, x: int) -> int:
    while parent.get(x, x) != x:
        parent[x] = parent.get(parent[x], parent[x])
        x = parent[x]
    return x


def forest(shard: np.ndarray, value: np.ndarray, radius: int) -> np.ndarray:
    """Rows (a, b): a spanning forest of the links inside the shards."""
    _, size = np.unique(shard, return_counts=True)
    label = np.arange(len(value))
    for q, node in Trees(shard, value).links(radius, max(1, FRONTIER // int(size.max()))):
        a, b = label[q], label[node]
        pairs = np.unique(np.minimum(a, b)[a != b] * len(value) + np.maximum(a, b)[a != b])
        if len(pairs):
            parent: dict[int, int] = {}
            for x, y in zip((pairs // len(value)).tolist(), (pairs % len(value)).tolist()):
                x, y = _find(parent, x), _find(parent, y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            changed = np.array(list(parent), np.int64)
            to = np.arange(len(value))
            to[changed] = [_find(parent, x) for x in changed.tolist()]
            label = to[label]
    moved = np.flatnonzero(label != np.arange(len(value)))
    return np.stack([value[moved], value[label[moved]]], axis=1)


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column fp that connect all that are within the radius (at most 3)."""
    if radius > 3:
        raise ValueError("shards guarantee links up to 3 differing bits")

    def deal(batches):
        for batch in batches:
            key, fp = _shards(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["shard", "fp"])

    def search(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(keep: int | None):
            shard, fp = (np.concatenate(x) for x in zip(*held))
            held.clear()
            if keep is not None:  # the last shard may go on in the next batch
                own = shard != keep
                held.append((shard[~own], fp[~own]))
                shard, fp = shard[own], fp[own]
            several = np.zeros(len(shard), bool)
            if len(shard):
                several[1:] = shard[1:] == shard[:-1]
                several[:-1] |= several[1:]
            if several.any():
                e = forest(shard[several], fp[several], radius)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                if held[-1][0][-1] != held[0][0][0]:
                    yield from flush(held[-1][0][-1])
        if held:
            yield from flush(None)

    dealt = fps.select("fp").mapInArrow(deal, "shard long, fp long")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable.

    Large-star and small-star steps in turn until nothing changes; every round is written to the
    shared folder, so the plan does not grow. A node with very many neighbours is aggregated by a
    map-side minimum and joined back, never collected.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        own = both.filter(F.col("v") > F.col("u")) if large else both
        joined = own.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            joined = joined.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return joined.filter("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = staged(edges.filter("a <> b"), "links")
    seen = None
    while (state := mark(now)) != seen:
        seen = state
        now = staged(star(star(now, True), False), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row of docs.

    component_id is the smallest id among the rows reachable over links of at most `radius`
    differing bits. Texts without words (null, empty) have fingerprint zero, linked like any
    other. Rows without an id take part and never give the component its id unless it has no
    other (then it is null); repeated rows each return their own.
    """
    marked = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = marked.groupBy("fp").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("first"))
    distinct = staged(firsts, "distinct")
    roots = staged(components(links(distinct, radius)), "roots")
    own = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    by_root = own.groupBy("root").agg(F.min("first").alias("component_id"))
    answer = own.join(by_root, "root").select("fp", F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id"))
    return marked.join(answer, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """The row of docs with the smallest id of each near-duplicate group; rows without an id stay."""
    groups = near_groups(docs, id_col, text_col, radius)
    first = groups.filter(F.col("component_id") == F.col(id_col)).select(F.col(id_col).alias("__first")).distinct()
    kept = docs.join(first, docs[id_col] == first["__first"], "left_semi")
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
