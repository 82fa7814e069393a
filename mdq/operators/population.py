"""Populations of strategies: dominance, crowding, diversity, importance."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import div, nz
from ..functions.score_expr import features_in_formula
from ..session import cut_lineage

_BLOCK_ROWS = 4096


def _signed(objectives: dict[str, str]) -> list[Column]:
    return [F.col(c) * (1 if d == "max" else -1) for c, d in objectives.items()]


def pareto_front_2d(df: DataFrame, x: str, y: str, parts: int = 64) -> DataFrame:
    """Rows no other row beats on both (x and y are maximised), for any number of rows.

    A row is beaten when a row with larger x has y at least as large, or one with equal x
    has a larger y.  The best y per x is combinable; x is cut into ranges by a quantile
    sketch and one best y per range is carried on, so no task sees all rows.
    """
    best = df.groupBy(x).agg(F.max(y).alias("_by"))
    cuts = best.agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], 2000).alias("_cuts"))
    b = best.join(F.broadcast(cuts)).withColumn("_p", F.aggregate("_cuts", F.lit(0), lambda a, c: a + F.when(c < F.col(x), 1).otherwise(0)))
    tops = b.groupBy("_p").agg(F.max("_by").alias("_top"))  # one row per range
    carry = tops.select("_p", F.max("_top").over(Window.partitionBy(F.lit(1)).orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))
    inside = F.max("_by").over(Window.partitionBy("_p").orderBy(F.col(x).desc()).rowsBetween(Window.unboundedPreceding, -1))
    lim = b.withColumn("_in", inside).join(F.broadcast(carry), "_p").select(x, "_by", F.greatest("_in", "_above").alias("_lim"))
    j = df.join(lim, x)
    return j.where((F.col(y) == F.col("_by")) & (F.col("_lim").isNull() | (F.col("_lim") < F.col(y)))).drop("_by", "_lim")


#: cells per objective of the dominance grid; with d objectives there are at most GRID ** d cells
GRID = 8


def _gridded(df: DataFrame, objectives: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """df with maximised objectives o0, o1, ... and grid coordinates g0, g1, ... (larger is better): equal shares by a quantile sketch."""
    vs = _signed(objectives)
    names = [f"o{i}" for i in range(len(vs))]
    d = df.withColumns(dict(zip(names, vs)))
    probs = [i / GRID for i in range(1, GRID)]
    cuts = d.agg(*[F.percentile_approx(o, probs, 1000).alias(f"_{o}") for o in names]).first()
    place = lambda o: sum(((F.col(o) > float(c)).cast("int") for c in (cuts[f"_{o}"] or [])), F.lit(0))
    return d.withColumns({f"g{i}": place(o) for i, o in enumerate(names)}), names


def _cells_over(d: DataFrame, n: int) -> DataFrame:
    """(cell, over, strict): the cells at least as good as each occupied cell in every objective; strict: better in all. At most GRID ** n cells."""
    cells = d.select(*[f"g{i}" for i in range(n)]).distinct().withColumn("cell", F.concat_ws(",", *[f"g{i}" for i in range(n)]))
    better = cells.select(F.col("cell").alias("over"), *[F.col(f"g{i}").alias(f"h{i}") for i in range(n)])
    for i in range(n):  # every cell names the values it has to meet, one objective after the other
        cells = cells.withColumn(f"h{i}", F.explode(F.sequence(F.col(f"g{i}"), F.lit(GRID - 1))))
    j = cells.join(better, [f"h{i}" for i in range(n)])
    strict = F.lit(True)
    for i in range(n):
        strict = strict & (F.col(f"h{i}") > F.col(f"g{i}"))
    return j.select("cell", "over", strict.alias("strict"))


def _beats(a: str, b: str, names: list[str]) -> Column:
    """Whether row a is at least as good as b in all objectives and better in one."""
    weak, strict = F.lit(True), F.lit(False)
    for o in names:
        weak = weak & (F.col(f"{a}.{o}") >= F.col(f"{b}.{o}"))
        strict = strict | (F.col(f"{a}.{o}") > F.col(f"{b}.{o}"))
    return weak & strict


def dominated_by(df: DataFrame, key: str, objectives: dict[str, str]) -> DataFrame:
    """All dominance pairs (winner, loser): rows meet only those of grid cells that can dominate theirs, by an equi-join on the cell."""
    d, names = _gridded(df, objectives)
    n = len(names)
    d = d.withColumn("cell", F.concat_ws(",", *[f"g{i}" for i in range(n)])).select(F.col(key).alias("id"), "cell", *names)
    asks = d.join(_cells_over(_gridded(df, objectives)[0], n), "cell").select("id", F.col("over").alias("at"), *names)
    j = asks.alias("l").join(d.alias("w"), F.col("l.at") == F.col("w.cell")).where(_beats("w", "l", names))
    return j.select(F.col("w.id").alias("winner"), F.col("l.id").alias("loser"))


def _local_front(names: list[str]):
    """Rows of a group that no other row of the group beats, block by block against the front so far."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows[names].to_numpy(float)
        order = np.lexsort(v.T[::-1])[::-1]  # a row is beaten only by rows before it
        kept = np.zeros(0, np.int64)
        for at in range(0, len(order), 1024):
            new = order[at : at + 1024]
            for pool in (kept, new):
                a, b = v[pool][:, None, :], v[new][None, :, :]
                new = new[~((a >= b).all(axis=2) & (a > b).any(axis=2)).any(axis=0)]
            kept = np.concatenate([kept, new])
        return rows.iloc[np.sort(kept)]

    return run


def skyline(df: DataFrame, key: str, objectives: dict[str, str], parts: int = 64) -> DataFrame:
    """Rows of df that no other row beats, for any number of objectives and rows.

    Rows are cut into grid cells. A cell that another occupied cell beats in every objective goes as
    a whole. What is left is thinned to the front of each part of a cell (parts split large
    cells), and the thinned rows meet those of the cells that can still beat theirs: an anti join
    on the cell that sees fronts, not rows.
    """
    d, names = _gridded(df, objectives)
    n = len(names)
    d = d.withColumn("cell", F.concat_ws(",", *[f"g{i}" for i in range(n)]))
    over = cut_lineage(_cells_over(d, n))
    alive = d.join(over.where("strict").select("cell").distinct(), "cell", "left_anti")
    thin = alive.select(F.col(key).alias("id"), "cell", *names).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    thin = cut_lineage(thin.groupBy("cell", "part").applyInPandas(_local_front(names), thin.schema).drop("part"))
    asks = thin.join(over.where("not strict").select("cell", F.col("over").alias("at")), "cell").select("id", "at", *names)
    lost = asks.alias("l").join(thin.alias("w"), F.col("l.at") == F.col("w.cell")).where(_beats("w", "l", names)).select(F.col("l.id").alias("id")).distinct()
    front = thin.select("id").join(lost, "id", "left_anti")
    return df.join(front, df[key] == front["id"], "left_semi")


def fronts(df: DataFrame, key: str, objectives: dict[str, str], by: str | None = None) -> DataFrame:
    """df plus front, the number of each row's front: 0 for rows that none beats, then 0 again without those, and so on.

    Populations (the rows of one value of `by`, or all) are ranked in one grouped job. A population
    is a bounded set of strategies that one task holds; `skyline` is for sets of any size. Rows are
    taken in an order in which winners come first; a row goes to the first front that has no
    winner over it, found by halving, because fronts before one that beats it beat it too.
    """
    names = list(objectives)
    sign = np.array([1.0 if x == "max" else -1.0 for x in objectives.values()])

    def rank(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows[names].to_numpy(float) * sign
        found: list[list[int]] = []
        out = np.zeros(len(v), np.int64)

        def beaten(f: int, x: np.ndarray) -> bool:
            a = v[found[f]]
            return bool(((a >= x).all(axis=1) & (a > x).any(axis=1)).any())

        for i in np.lexsort(v.T[::-1])[::-1]:
            lo, hi = 0, len(found)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if beaten(mid, v[i]) else (lo, mid)
            if lo == len(found):
                found.append([])
            found[lo].append(int(i))
            out[i] = lo
        return rows.drop(columns="_by").assign(front=out.astype("int32"))

    schema = T.StructType([*df.schema.fields, T.StructField("front", T.IntegerType())])
    return df.withColumn("_by", F.col(by) if by else F.lit(0)).groupBy("_by").applyInPandas(rank, schema)


def crowding(df: DataFrame, key: str, objectives: Iterable[str]) -> DataFrame:
    """Crowding distance inside each front; the ends of every objective are infinite (null here)."""
    total, edge = F.lit(0.0), F.lit(False)
    tmp = df
    for i, c in enumerate(objectives):
        w = Window.partitionBy("front").orderBy(c, key)
        span = F.max(c).over(Window.partitionBy("front")) - F.min(c).over(Window.partitionBy("front"))
        tmp = tmp.withColumns({f"_p{i}": F.lag(c).over(w), f"_n{i}": F.lead(c).over(w), f"_s{i}": span})
        total = total + nz(div(F.col(f"_n{i}") - F.col(f"_p{i}"), F.col(f"_s{i}")))
        edge = edge | F.col(f"_p{i}").isNull() | F.col(f"_n{i}").isNull()
    return tmp.withColumn("crowding", F.when(edge, F.lit(None).cast("double")).otherwise(total)).drop(*[c for c in tmp.columns if c.startswith("_")])


def survivors(df: DataFrame, n: int, key: str) -> DataFrame:
    """Best n by (front, crowding), infinite crowding first."""
    return df.orderBy("front", F.col("crowding").desc_nulls_first(), key).limit(n)


def hypervolume_2d(front: DataFrame, x: str, y: str) -> DataFrame:
    """Area a front of maximised objectives covers above a point one unit under its worst values."""
    ref = front.agg((F.min(x) - 1).alias("rx"), (F.min(y) - 1).alias("ry"))
    pts = front.select(x, y).distinct()
    w = Window.partitionBy(F.lit(1)).orderBy(x)  # points of one front
    s = pts.join(F.broadcast(ref)).withColumn("prev", F.coalesce(F.lag(x).over(w), F.col("rx")))
    return s.agg(F.sum((F.col(x) - F.col("prev")) * (F.col(y) - F.col("ry"))).alias("hypervolume"))


# ---- distances ------------------------------------------------------------------------


def behaviour_vector(results: DataFrame) -> DataFrame:
    """Returns, Sharpes, drawdowns in period order, then turnover, win rate and count."""
    seq = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("period_id", F.col(c).alias("v")))), lambda s: s["v"])
    tail = F.array(F.avg("turnover"), F.avg((F.col("total_return") > 0).cast("double")), F.count("*").cast("double"))
    return results.groupBy("strategy").agg(F.concat(seq("total_return"), seq("sharpe_ratio"), seq("max_drawdown"), tail).alias("vector"))


def distance(a: Column, b: Column, kind: str = "euclidean") -> Column:
    if kind == "euclidean":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    if kind == "manhattan":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return 1 - nz(div(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def sharing(d: Column, sigma: float, alpha: float = 1.0) -> Column:
    return F.when(d < sigma, 1 - F.pow(d / sigma, alpha)).otherwise(0.0)


#: rows of a cell of the neighbour search, and rows measured together
_CELL_ROWS, _ASK_ROWS = 1024, 1024
#: most rows of a block, and the number of blocks up to which it stays smaller
_MOST_ROWS, _BLOCKS = 65536, 16


def _block_rows(total: int) -> int:
    """Rows of a block: a few thousand at first, more as the rows grow, so that pairs of blocks give enough tasks and rows are sent to few of them."""
    return min(_MOST_ROWS, max(_BLOCK_ROWS, math.ceil(total / _BLOCKS)))


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in vectors]) if len(vectors) else np.zeros((0, 1))


def _all_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a to those of b, by one matrix product."""
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squares - 2 * (a @ b.T), 0.0))


def _tiles(n: int):
    return (slice(at, at + _ASK_ROWS) for at in range(0, n, _ASK_ROWS))


def _block_pairs(left: DataFrame, right: DataFrame):
    """Rows that carry the list `to` of (b, other), grouped by the pair of blocks they are sent to."""
    sent = lambda d: d.withColumn("p", F.explode("to")).select("*", "p.b", "p.other").drop("to", "p")
    fresh = sent(right)  # both sides may stem from one frame: columns of their own
    fresh = fresh.select(*[F.col(c).alias(c) for c in fresh.columns])
    return sent(left).groupBy("b", "other").cogroup(fresh.groupBy("b", "other"))


def _spread(points: np.ndarray, n: int) -> np.ndarray:
    """n points far from each other: each next one is the farthest from those taken."""
    taken = [0]
    d = ((points - points[0]) ** 2).sum(axis=1)
    for _ in range(min(n, len(points)) - 1):
        taken.append(int(d.argmax()))
        d = np.minimum(d, ((points - points[taken[-1]]) ** 2).sum(axis=1))
    return np.array(taken)


def _nearest(best: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """The k smallest of best and d by row, in any order."""
    d = np.concatenate([best, d], axis=1)
    return np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d


def niches(df: DataFrame, key: str, vector: str, sigma: float = 1.0, k: int = 15, alpha: float = 1.0, sample: int = 4096) -> DataFrame:
    """(key, niche_count, novelty): niche count within sigma and mean distance to the k nearest of every row; exact.

    Pivots from a bounded sample cut the rows into cells of known radius. Neighbouring cells lie
    together in blocks. The first pass finds an upper bound of a row's k-th best distance in its own
    block and cell. By the triangle inequality two cells whose nearest points are farther apart than
    sigma and than the bounds of their rows add nothing to each other: pairs of blocks without any
    other cells are not sent, and such pairs of cells are not compared. A pair of blocks is one task,
    which measures every distance once for both sides and emits a row's part of the niche count and its k best.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    vectors = dict(rows.dtypes)["v"]
    total = rows.count()
    every = max(1, total // sample)
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).limit(sample).toPandas()  # places the pivots; results do not depend on it
    points = _stacked(some["v"]) if len(some) else np.zeros((1, 1))
    pivots = points[_spread(points, math.ceil(total / _CELL_ROWS))]

    def place(frames):
        for frame in frames:
            x = _stacked(frame["v"])
            cell = _all_distances(x, pivots).argmin(axis=1) if len(x) else np.zeros(0, int)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)) if len(x) else np.zeros(0)
            yield frame.assign(cell=cell.astype("int32"), far=far)

    held = cut_lineage(rows.mapInPandas(place, f"id {kind}, v {vectors}, cell int, far double"))
    sizes = held.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).toPandas()  # a row per pivot
    sizes = sizes.assign(near=((pivots[sizes["cell"].to_numpy(int)] - pivots[0]) ** 2).sum(axis=1)).sort_values(["near", "cell"])
    most, used, block, at = _block_rows(total), 0, 0, []
    for c, n in zip(sizes["cell"], sizes["n"]):
        if used and used + n > most:
            block, used = block + 1, 0
        parts = max(1, math.ceil(n / most))  # a large cell is several blocks
        at.append((int(c), block, parts))
        block, used = (block + parts, 0) if parts > 1 else (block, used + n)
    spark = held.sparkSession
    placed = held.join(F.broadcast(spark.createDataFrame(at, "cell int, first int, parts int")), "cell")
    placed = placed.select("id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("parts"))).cast("int").alias("block"))

    def bound(frame: pd.DataFrame) -> pd.DataFrame:
        reach = np.full(len(frame), np.inf)
        ids, cells, x = frame["id"].to_numpy(), frame["cell"].to_numpy(), _stacked(frame["v"])
        for c in np.unique(cells):
            own = np.flatnonzero(cells == c)
            for part in (own[t] for t in _tiles(len(own))):
                best = np.full((len(part), k), np.inf)
                for other in (own[t] for t in _tiles(len(own))):
                    d = _all_distances(x[part], x[other])
                    d[ids[part][:, None] == ids[other][None, :]] = np.inf
                    best = _nearest(best, d, k)
                reach[part] = best.max(axis=1)
        return frame.assign(reach=reach)

    bounded = cut_lineage(placed.groupBy("block").applyInPandas(bound, f"id {kind}, v {vectors}, cell int, block int, reach double"))
    # what the driver holds: a row per cell and block
    known = bounded.groupBy("cell", "block").agg(F.max("reach").alias("reach")).toPandas().merge(sizes[["cell", "far"]], on="cell")
    widest = np.maximum(known.groupby("cell")["reach"].max(), sigma).to_dict()
    radius = dict(zip(sizes["cell"], sizes["far"]))
    seen = sorted(widest)
    gaps = _all_distances(pivots[seen], pivots[seen]) if seen else np.zeros((0, 0))
    far, reach = np.array([radius[c] for c in seen]), np.array([widest[c] for c in seen])
    meet = gaps - far[:, None] - far[None, :] <= np.maximum(reach[:, None], reach[None, :]) * (1 + 1e-9) + 1e-6 * (1 + gaps)
    place_of = {c: i for i, c in enumerate(seen)}
    cells_of = {b: [place_of[c] for c in g["cell"]] for b, g in known.groupby("block")}
    pairs = [(int(b), int(o)) for b in cells_of for o in cells_of if b <= o and meet[np.ix_(cells_of[b], cells_of[o])].any()]
    sends = spark.createDataFrame([(b, b, o) for b, o in pairs], "block int, b int, other int").groupBy("block").agg(F.collect_list(F.struct("b", "other")).alias("to"))
    gets = spark.createDataFrame([(o, b, o) for b, o in pairs], "block int, b int, other int").groupBy("block").agg(F.collect_list(F.struct("b", "other")).alias("to"))
    base = bounded.select("id", "v", "cell", "block")

    def visit(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        same = bool(len(l)) and bool(len(r)) and l["b"].iloc[0] == l["other"].iloc[0]
        l, r = l.sort_values("cell"), r.sort_values("cell")
        side = [(f["id"].to_numpy(), np.array([place_of[c] for c in f["cell"]], int), _stacked(f["v"])) for f in (l, r)]
        if same:
            side[1] = side[0]
        (ids, cells, x), (other_ids, other_cells, y) = side
        niche, best = [np.zeros(len(s[0])) for s in side], [np.full((len(s[0]), k), np.inf) for s in side]
        for i in _tiles(len(x)):
            for j in _tiles(len(y)):
                if not meet[np.ix_(np.unique(cells[i]), np.unique(other_cells[j]))].any():
                    continue
                d = _all_distances(x[i], y[j])
                d[ids[i][:, None] == other_ids[j][None, :]] = np.inf
                for s, (t, m) in enumerate(((i, d), (j, d.T))[: 1 if same else 2]):
                    niche[s][t] += np.where(m < sigma, 1 - (np.minimum(m, sigma) / sigma) ** alpha, 0.0).sum(axis=1)
                    best[s][t] = _nearest(best[s][t], m, k)
        out = [pd.DataFrame({"id": side[s][0], "niche": niche[s], "best": [row[np.isfinite(row)].tolist() for row in np.sort(best[s], axis=1)]}) for s in range(1 if same else 2)]
        return pd.concat(out)

    found = _block_pairs(base.join(F.broadcast(sends), "block"), base.join(F.broadcast(gets), "block")).applyInPandas(visit, f"id {kind}, niche double, best array<double>")
    g = found.groupBy("id").agg(F.sum("niche").alias("niche"), F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    mean_best = F.aggregate("best", F.lit(0.0), lambda s, v: s + v) / F.size("best")
    return g.select(F.col("id").alias(key), (F.col("niche") + 1).alias("niche_count"), mean_best.alias("novelty"))


def mean_distances(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, mean_distance) of every row to all others, which needs every pair.

    The vectors are cut into blocks; a task holds two of them, measures every distance once by
    matrix products and emits one partial sum per row and side, never the pairs themselves.
    """
    total = df.count()
    blocks = max(1, math.ceil(total / _block_rows(total)))
    kind = dict(df.dtypes)[key]
    base = df.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    pair = lambda b, o: F.struct(b.alias("b"), o.alias("other"))
    left = base.withColumn("to", F.transform(F.sequence("block", F.lit(blocks - 1)), lambda o: pair(F.col("block"), o)))
    right = base.withColumn("to", F.transform(F.sequence(F.lit(0), "block"), lambda b: pair(b, F.col("block"))))

    def part(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame({"id": [], "total": [], "n": []})
        same = l["b"].iloc[0] == l["other"].iloc[0]
        side = [(f["id"].to_numpy(), _stacked(f["v"])) for f in (l, r)]
        totals, counts = [np.zeros(len(s[0])) for s in side], [np.zeros(len(s[0]), np.int64) for s in side]
        (ids, x), (other_ids, y) = side
        for i in _tiles(len(x)):
            for j in _tiles(len(y)):
                d = _all_distances(x[i], y[j])
                other = ids[i][:, None] != other_ids[j][None, :]
                d *= other
                for s, (t, axis) in enumerate(((i, 1), (j, 0))[: 1 if same else 2]):
                    totals[s][t] += d.sum(axis=axis)
                    counts[s][t] += other.sum(axis=axis)
        return pd.concat([pd.DataFrame({"id": side[s][0], "total": totals[s], "n": counts[s]}) for s in range(1 if same else 2)])

    g = _block_pairs(left, right).applyInPandas(part, f"id {kind}, total double, n bigint").groupBy("id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return g.select(F.col("id").alias(key), div(F.col("total"), F.col("n")).alias("mean_distance"))


# ---- population tables ----------------------------------------------------------------


def parsimony(df: DataFrame, weight: float = 0.001, bonus: float = 0.01) -> DataFrame:
    """Fitness less a size penalty, plus a bonus for the first row of a formula."""
    first = df.groupBy("formula").agg(F.min("id").alias("first_id"))
    j = df.join(first, "formula")
    return j.withColumn("adjusted", F.col("fitness") - weight * F.col("size") + F.when(F.col("id") == F.col("first_id"), bonus).otherwise(0.0))


def generation_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("generation").agg(
        F.count("*").alias("n"), F.min("fitness").alias("lo"), F.avg("fitness").alias("mean"), F.max("fitness").alias("best"), F.avg("size").alias("avg_size"),
        F.count_distinct("formula").alias("formulas"), (F.count_distinct("formula") / F.count("*")).alias("unique_share"),
    )


def feature_importance(df: DataFrame, *keys: str) -> DataFrame:
    """Use, share, fitness range and use-weighted score of every feature in printed formulas."""
    f = df.select(*keys, "fitness", F.explode(features_in_formula(F.col("formula"))).alias("feature"))
    g = f.groupBy(*keys, "feature").agg(F.count("*").alias("uses"), F.min("fitness").alias("lo"), F.avg("fitness").alias("mean"), F.max("fitness").alias("best"))
    total = g.groupBy(*keys).agg(F.sum("uses").alias("all_uses")) if keys else g.agg(F.sum("uses").alias("all_uses"))
    j = g.join(total, list(keys)) if keys else g.join(F.broadcast(total))
    return j.withColumns({"use_share": div(F.col("uses"), F.col("all_uses")), "score": F.col("uses") * F.col("mean")})


def archive_statistics(df: DataFrame, per_row: DataFrame, key: str, group: str) -> DataFrame:
    """Size, fitness range and mean pairwise distance of each archive or island."""
    return df.join(per_row, key).groupBy(group).agg(F.count("*").alias("n"), F.avg("fitness").alias("avg_fitness"), F.max("fitness").alias("best"), F.avg("mean_distance").alias("diversity"))
