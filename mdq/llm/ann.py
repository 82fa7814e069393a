"""Nearest neighbours by collision counting over sorted single projections.

Vectors are scaled to length one, where the largest cosine is the smallest distance. Every vector
is projected on the same random lines. A shard of vectors keeps one sorted array per line; a query
opens a window around its own projection on every line and counts how often each vector lies in
one. Virtual rehashing widens all windows by a small constant factor; vectors that have collided on
at least the threshold number of lines are verified with exact cosines, until enough verified ones
lie within the radius that the windows stand for.

How many lines and collisions tell near from far depends on how far neighbours and other vectors
are. Both are measured on a bounded sample: the lines are as many as it takes that a vector at a
neighbour's distance is verified with the chance 1 - MISSED and one at the median distance with
the chance PASSED. The sample does not decide which vectors are searched: all are.

Queries are a stated set. Blocks of them meet shards of vectors, so a task holds one shard and one
block; the best few per block and shard are merged by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: vectors of a shard and queries of a block
SHARD, BLOCK = 16384, 8192
#: vectors and queries of the sample, widening of the windows, chances to miss a neighbour and to verify a vector at the median distance
SAMPLE, ASKED, STEP, MISSED, PASSED = 2048, 256, 1.03, 0.08, 0.04
LEAST_LINES, MOST_LINES = 32, 384


@dataclass
class Settings:
    """Lines, the collisions on them that make a candidate, and the first radius."""

    lines: int
    threshold: int
    start: float


def within(half: float, distance: float) -> float:
    """The chance that a vector at this distance lies in a window of this half-width."""
    return math.erf(half / max(distance, 1e-9) / math.sqrt(2))


def settings(near: np.ndarray, median: float) -> Settings:
    """Settings for neighbours at the distances `near` and others at `median`; windows are as wide as their radius on both sides."""
    typical = float(np.median(near)) if len(near) else 1.0
    far = max(median, typical * 1.01)
    p1, p2 = within(1.0, 1.0), within(typical, far)
    miss, take = NormalDist().inv_cdf(1 - MISSED), NormalDist().inv_cdf(1 - PASSED)
    need = (miss * math.sqrt(p1 * (1 - p1)) + take * math.sqrt(p2 * (1 - p2))) / (p1 - p2)
    lines = min(MOST_LINES, max(LEAST_LINES, math.ceil(need**2)))
    threshold = max(1, math.ceil(p1 * lines - miss * math.sqrt(lines * p1 * (1 - p1))))
    return Settings(lines, threshold, max(1e-3, float(np.quantile(near, 0.25)) * 0.9 if len(near) else 0.05))


def measured(sample: np.ndarray, size: int, k: int) -> Settings:
    """Settings from a sample of the vectors for shards of `size`: the k-th of a shard is as far as a nearer one of a smaller sample."""
    if len(sample) < 3:
        return Settings(LEAST_LINES, 1, 0.05)
    unit = sample / np.sqrt((sample * sample).sum(axis=1))[:, None]
    d = np.sqrt(np.maximum(2 - 2 * unit[:ASKED] @ unit.T, 0))
    d.sort(axis=1)
    at = min(len(unit) - 1, max(1, round(k * len(unit) / max(size, len(unit)))))
    return settings(d[:, at], float(np.median(d[:, 1:])))


def lines_of(dim: int, lines: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, lines))


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact cosines in double precision; equal vectors get equal scores, wherever they stand."""
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


class Shard:
    """Sorted projections of the vectors of one shard."""

    def __init__(self, vectors: np.ndarray, own: Settings):
        self.vectors = vectors
        self.threshold, self.start = own.threshold, own.start
        self.axes = lines_of(vectors.shape[1], own.lines)
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        at = unit @ self.axes
        self.order = np.argsort(at, axis=0).T.astype(np.int32).copy()
        self.at = np.take_along_axis(at.T, self.order, axis=1)

    def search(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every query the places and cosines of those verified, until k of them lie within the radius; there is no cap on candidates."""
        n = len(self.vectors)
        mine = queries / np.sqrt((queries * queries).sum(axis=1))[:, None] @ self.axes
        known: list[tuple[np.ndarray, np.ndarray]] = []

        def windows(step: int) -> tuple[np.ndarray, np.ndarray]:
            """Ends of all queries' windows on all lines after so many widenings."""
            while len(known) <= step:
                half = self.start * STEP ** len(known)
                known.append(tuple(np.stack([np.searchsorted(a, x + d, side) for a, x in zip(self.at, mine.T)], axis=1) for d, side in ((-half, "left"), (half, "right"))))
            return known[step]

        for q, query in enumerate(queries):
            hits, checked = np.zeros(n, np.int64), np.zeros(n, bool)
            places, scores = np.zeros(0, np.int64), np.zeros(0)
            step, lo, hi = 0, None, None
            while True:
                new_lo, new_hi = (w[q] for w in windows(step))
                if lo is None:
                    lo = hi = new_lo
                grown = [s for o, a, b, c, d in zip(self.order, new_lo, lo, hi, new_hi) for s in (o[a:b], o[c:d]) if len(s)]
                if grown:
                    hits += np.bincount(np.concatenate(grown), minlength=n)
                lo, hi = new_lo, new_hi
                fresh = np.flatnonzero((hits >= self.threshold) & ~checked)
                if len(fresh):
                    checked[fresh] = True
                    places = np.concatenate([places, fresh])
                    scores = np.concatenate([scores, cosines(self.vectors[fresh], query)])
                # distance d on unit vectors is cosine 1 - d * d / 2; what lies within the radius has collided often enough, but for MISSED
                reach = (self.start * STEP**step) ** 2 / 2
                if np.count_nonzero(scores >= 1 - reach) >= k or len(places) == n:
                    break
                step += 1
            yield places, scores


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part: no null id, vector or component, all finite, not zero."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For every row whose id is divisible by `every`: its k nearest others by cosine.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id. Rows without an id
    or with a null, zero or non-finite vector take no part; vectors of different lengths are not
    compared. Of rows that repeat one id with one vector, one takes part.

    Equal vectors are searched as one: each is indexed once with its k + 1 smallest ids, which
    decide all ties, so a vector that a third of the rows share costs no more than another.
    """
    rows = staged(_usable(vectors, id_col, vec_col).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), F.size("v").alias("dim")).distinct(), "vectors")
    least = F.row_number().over(Window.partitionBy("h1", "h2", "dim").orderBy("id"))
    kept = rows.select("id", "h1", "h2", "dim").withColumn("r", least).filter(F.col("r") <= k + 1)
    ids = kept.groupBy("h1", "h2", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most k + 1 each
    total = rows.count()
    n_shards = max(1, -(-total // SHARD))
    first = rows.join(ids.select("h1", "h2", "dim", "ids", F.get("ids", F.lit(0)).alias("id")), ["h1", "h2", "dim", "id"])
    index = staged(first.select("v", "h1", "h2", "dim", "ids", F.pmod(F.xxhash64("h1", "h2"), F.lit(n_shards)).cast("int").alias("shard")), "index")
    asked = rows.filter(F.col("id") % every == 0).select("h1", "h2", "dim").distinct()
    n_blocks = max(1, -(-total // every // BLOCK))
    wanted = index.join(asked, ["h1", "h2", "dim"], "left_semi").select(
        F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("dim").alias("qdim"), F.col("v").alias("qv"), F.pmod(F.col("h1"), F.lit(n_blocks)).cast("int").alias("qblock")
    )
    # by length, from a bounded sample of different vectors
    some = index.select("dim", "v").filter(F.pmod(F.xxhash64("h2", "dim"), F.lit(max(1, total // SAMPLE))) == 0).limit(2 * SAMPLE).toArrow()
    tuned: dict[int, Settings] = {}
    for dim in set(some["dim"].to_pylist()):
        own = np.array([v for d, v in zip(some["dim"].to_pylist(), some["v"].to_pylist()) if d == dim], np.float64)[:SAMPLE]
        tuned[dim] = measured(own, -(-total // n_shards), k + 1)

    # a task holds one shard and one block of queries
    spread = wanted.withColumn("qshard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def search(_, own, queries):
        found: list[list] = [[], [], [], []]
        if own.num_rows and queries.num_rows:
            v = np.array(own["v"].to_pylist(), np.float64)
            shard, ids_of = Shard(v, tuned.get(v.shape[1]) or measured(v[:SAMPLE], len(v), k + 1)), own["ids"].to_pylist()
            asked = np.array(queries["qv"].to_pylist(), np.float64)
            for h1, h2, (places, scores) in zip(queries["q1"].to_pylist(), queries["q2"].to_pylist(), shard.search(asked, k + 1)):
                best = np.argsort(-scores, kind="stable")[: k + 1]
                if len(scores) > k + 1:  # all that tie with the last
                    best = np.flatnonzero(scores >= scores[best[-1]])
                pairs = sorted((-scores[i], x) for i in best for x in ids_of[places[i]])[: k + 1]
                for s, x in pairs:
                    for column, value in zip(found, (h1, h2, x, -s)):
                        column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["h1", "h2", "vec_id", "score"])

    hits = held.groupBy("shard", "block", "dim").cogroup(spread.groupBy("qshard", "qblock", "qdim")).applyInArrow(search, "h1 long, h2 long, vec_id long, score double")
    top = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))
    best = hits.withColumn("r", top).filter(F.col("r") <= k + 1).select("h1", "h2", "vec_id", "score")
    queries = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "h1", "h2")
    own = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return queries.join(best, ["h1", "h2"]).filter("vec_id <> query_id").withColumn("rank", own).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
