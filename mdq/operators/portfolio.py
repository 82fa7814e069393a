"""Scoring, selection, walk-forward evaluation and benchmarks over a dense daily panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import ROOT_YEAR, YEAR, div, nz, order_window
from ..functions.rank import pct_rank_bounded, top_share
from ..functions.score_expr import features_of, score
from ..session import cut_lineage
from .calendar import rebalance_dates
from .factors import compute

RISK_FREE = 0.04


def returns(df: DataFrame) -> DataFrame:
    return df.withColumn("r", div(F.col("close"), F.lag("close", 1).over(order_window())) - 1)


def score_table(df: DataFrame, dates: DataFrame, strategies: dict[str, object], execution_lag: int = 1, rank_features: bool = True) -> DataFrame:
    """(strategy, period_id, rebalance_no, date, ticker, score) on rebalance dates only.

    All strategies are evaluated in one pass over the union of the features they read;
    `dates` carries (period_id, date, rebalance_no).
    """
    names = sorted({n for s in strategies.values() for n in features_of(s)})
    at = dates.select("date").distinct()
    feats = compute(df, names, execution_lag=execution_lag).join(F.broadcast(at), "date", "left_semi")
    if rank_features:
        feats = feats.select("ticker", "date", *[pct_rank_bounded(n).alias(n) for n in names])
    for i, spec in enumerate(strategies.values()):
        feats = score(feats, spec, f"score_{i}")
    pairs = F.array(*[F.struct(F.lit(sid).alias("strategy"), F.col(f"score_{i}").alias("score")) for i, sid in enumerate(strategies)])
    long = feats.select("ticker", "date", F.explode(pairs).alias("p")).select("ticker", "date", "p.strategy", "p.score")
    return long.join(F.broadcast(dates), "date")


def turnover(picks: DataFrame, keys=("strategy", "period_id"), step: str = "rebalance_no") -> DataFrame:
    """(|left| + |entered|) / (2 * larger holding) between consecutive holdings; 1 at the first."""
    keys = list(keys)
    held = picks.select(*keys, step, "ticker")
    again = F.lag(step).over(Window.partitionBy(*keys, "ticker").orderBy(step)) == F.col(step) - 1
    held = held.withColumn("again", again.cast("int"))
    sizes = held.groupBy(*keys, step).agg(F.count("*").alias("n"), F.sum("again").alias("kept"))
    w = Window.partitionBy(*keys).orderBy(step)
    out = sizes.withColumn("was", F.lag("n").over(w))
    moved = F.col("n") + F.col("was") - 2 * nz(F.col("kept"), 0)
    return out.select(
        *keys, step, F.when(F.col("was").isNull(), 1.0).otherwise(moved / (2 * F.greatest("n", "was"))).alias("turnover")
    )


def walk_forward(
    df: DataFrame,
    periods: DataFrame,
    strategies: dict[str, object],
    top_share_: float = 0.2,
    every: int = 21,
    cost: float = 0.002,
    stop: float | None = None,
    min_days: int = 5,
    execution_lag: int = 1,
    tradeable: DataFrame | None = None,
) -> DataFrame:
    """One row of metrics per (strategy, period).

    Holdings change on every n-th test day and earn the equal-weight mean return; rebalance
    days after the first pay turnover * cost * 2.  A stop sends the period to cash for good.
    Strategies whose scores are all equal on a rebalance day get the fixed penalty row.
    """
    days = rebalance_dates(df.select("date").distinct(), periods, every).select("period_id", "date", "day_no", "rebalance")
    long_enough = days.groupBy("period_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_days).select("period_id")
    days = days.join(F.broadcast(long_enough), "period_id", "left_semi").withColumn("rebalance_no", F.floor(F.col("day_no") / every))
    at = days.where("rebalance").select("period_id", "date", "rebalance_no")
    scores = score_table(df, at, strategies, execution_lag)
    if tradeable is not None:
        scores = scores.join(tradeable, "ticker", "left_semi")
    group = ["strategy", "period_id", "rebalance_no"]
    # one cross-section per task: the universe of a walk-forward run is a fixed list of tickers
    section = Window.partitionBy(*group)
    ranked = scores.select(
        *group, "ticker",
        F.row_number().over(section.orderBy(F.col("score").desc(), "ticker")).alias("pick"),
        F.count("*").over(section).alias("total"),
        (F.min("score").over(section) == F.max("score").over(section)).alias("is_flat"),
    )
    best = ranked.where(F.col("pick") <= F.greatest(F.lit(1), F.floor(F.col("total") * top_share_ + 1e-9)))
    picks = cut_lineage(best.select(*group, "ticker", "is_flat"))
    flat = picks.where("is_flat").select("strategy", "period_id").distinct()
    turns = turnover(picks)
    prices = returns(df).select("ticker", "date", "r")
    held = picks.join(days.select("period_id", "date", "day_no", "rebalance_no"), ["period_id", "rebalance_no"])
    day = (
        held.join(prices, ["ticker", "date"]).where("day_no > 0")
        .groupBy("strategy", "period_id", "day_no", "rebalance_no").agg(F.avg("r").alias("gross"))
    )
    day = day.join(turns, group).withColumn(
        "net", F.col("gross") - F.when(F.col("day_no") % every == 0, F.col("turnover") * cost * 2).otherwise(0.0)
    )
    w = Window.partitionBy("strategy", "period_id").orderBy("day_no")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    stopped_turn = turns.withColumn("stop_no", F.lit(None).cast("bigint"))
    if stop is not None:
        value = F.exp(F.sum(F.log1p("net")).over(run))
        day = day.withColumn("value", value).withColumn("peak", F.greatest(F.lit(1.0), F.max("value").over(run)))
        hit = F.min(F.when(1 - F.col("value") / F.col("peak") >= stop, F.col("day_no"))).over(Window.partitionBy("strategy", "period_id"))
        day = day.withColumn("hit", hit).withColumn("net", F.when(F.col("day_no") > F.col("hit"), 0.0).otherwise(F.col("net")))
        first_after = day.groupBy("strategy", "period_id").agg((F.floor(F.max("hit") / every) + 1).alias("stop_no"))
        stopped_turn = turns.join(first_after, ["strategy", "period_id"])
    mean_turn = stopped_turn.groupBy("strategy", "period_id").agg(
        F.avg(F.when(F.col("rebalance_no") == F.col("stop_no"), 1.0).otherwise(F.col("turnover"))).alias("turnover")
    )
    result = period_metrics(day, ["strategy", "period_id"], "day_no", "net").join(mean_turn, ["strategy", "period_id"])
    bad = result.join(flat.withColumn("is_flat", F.lit(True)), ["strategy", "period_id"], "left")
    fixed = {"total_return": -0.5, "sharpe_ratio": -2.0, "max_drawdown": 0.5, "turnover": 1.0, "n_days": 0}
    return bad.select(
        "strategy", "period_id",
        *[F.when(F.col("is_flat"), F.lit(v)).otherwise(F.col(k)).alias(k) for k, v in fixed.items()],
    )


def period_metrics(df: DataFrame, keys: list[str], order: str, ret: str, risk_free: float = 0.0) -> DataFrame:
    """Compound return, annualised Sharpe, worst drawdown of the compounded curve, day count."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    curve = df.withColumn("cum", F.exp(F.sum(F.log1p(ret)).over(w))).withColumn("top", F.max("cum").over(w))
    return curve.groupBy(*keys).agg(
        (F.exp(F.sum(F.log1p(ret))) - 1).alias("total_return"),
        nz(div(F.avg(ret) - risk_free / YEAR, F.stddev_samp(ret)) * ROOT_YEAR).alias("sharpe_ratio"),
        F.max(1 - F.col("cum") / F.col("top")).alias("max_drawdown"),
        F.count("*").alias("n_days"),
    )


def benchmark(df: DataFrame, periods: DataFrame, method: str = "equal_weight", ticker: str | None = None, lookback: int = YEAR, share: float = 0.2) -> DataFrame:
    """Benchmark metrics per test window.

    equal_weight (daily rebalanced), buy_hold (equal start, drifting), momentum (top share by
    trailing return at the window start) or single_ticker.  Sharpe is net of the risk-free rate.
    """
    inside = (F.col("date") >= F.col("test_start")) & (F.col("date") <= F.col("test_end"))
    p = F.broadcast(periods.select("period_id", "test_start", "test_end"))
    base = df.select("ticker", "date", "close")
    if method == "single_ticker":
        base = base.where(F.col("ticker") == ticker)
    if method == "momentum":
        trail = base.withColumn("mom", div(F.col("close"), F.lag("close", lookback).over(order_window())) - 1)
        starts = df.select("date").distinct().join(p, inside).groupBy("period_id").agg(F.min("date").alias("date"))
        chosen = top_share(trail.join(F.broadcast(starts), "date").where("mom is not null"), "mom", share, by="period_id")
        joined = base.join(p, inside).join(chosen.select("period_id", "ticker"), ["period_id", "ticker"], "left_semi")
    else:
        joined = base.join(p, inside)
    w = Window.partitionBy("period_id", "ticker").orderBy("date")
    if method == "buy_hold":
        norm = joined.withColumn("v", div(F.col("close"), F.first("close").over(w)))
        line = norm.groupBy("period_id", "date").agg(F.avg("v").alias("v"))
        day = line.withColumn("ret", div(F.col("v"), F.lag("v").over(Window.partitionBy("period_id").orderBy("date"))) - 1)
    else:
        r = joined.withColumn("r", div(F.col("close"), F.lag("close").over(w)) - 1)
        day = r.groupBy("period_id", "date").agg(F.avg("r").alias("ret"))
    return period_metrics(day.where("ret is not null"), ["period_id"], "date", "ret", RISK_FREE)
