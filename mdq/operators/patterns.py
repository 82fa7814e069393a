"""Candle patterns as row predicates over lagged columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import div, last_n, order_window, prior_n

_KEEP = ["ticker", "ts", "idx", "open", "high", "low", "close", "volume"]


def candles(df: DataFrame) -> DataFrame:
    """Body and range columns, the row index and the two candles before, in one window pass."""
    w = order_window("ticker", "ts")
    body = F.abs(F.col("close") - F.col("open"))
    df = df.withColumns({"idx": F.row_number().over(w), "body": body, "ratio": div(body, F.col("high") - F.col("low"))})
    mean = F.when(F.count("body").over(last_n(10, "ticker", "ts")) >= 3, F.avg("body").over(last_n(10, "ticker", "ts")))
    df = df.withColumn("mean_body", mean)
    cols = {}
    for k in (1, 2):
        for c in ("open", "close", "low", "body", "ratio", "mean_body"):
            cols[f"{c}_{k}"] = F.lag(c, k).over(w)
    before = prior_n(6, "ticker", "ts")
    cols["recent_top"] = F.max("close").over(before)
    cols["recent_low"] = F.min("close").over(before)
    return df.withColumns(cols)


def _bear(k: int):
    s = f"_{k}" if k else ""
    return F.col(f"close{s}") < F.col(f"open{s}")


def _bull(k: int):
    s = f"_{k}" if k else ""
    return F.col(f"close{s}") > F.col(f"open{s}")


def _same_open(tol: float):
    return F.abs(F.col("open") - F.col("open_1")) <= tol * F.col("open_1")


def _body_match(limit: float):
    return (F.col("body_1") <= 0) | (F.abs(F.col("body_1") - F.col("body")) <= limit * F.col("body_1"))


def strict_twin(c: DataFrame, bearish: bool = True, tol: float = 0.03, min_body: float = 0.10, adx_min: float | None = 20.0, lead_body: float = 1.0) -> DataFrame:
    """Three candles: a strong one, then two of like body that open at the same price."""
    if bearish:
        shape = _bear(0) & _bear(1) & _bear(2) & ((F.col("idx") <= 6) | (F.col("close") < F.col("recent_top")))
    else:
        shape = _bull(1) & _bull(2) & ((F.col("idx") <= 6) | (F.col("close") > F.col("recent_low")))
    ok = (
        (F.col("idx") >= 3) & shape & (F.col("mean_body_2") > 0) & (F.col("body_2") >= lead_body * F.col("mean_body_2"))
        & (F.col("ratio_1") >= min_body) & (F.col("ratio") >= min_body) & _same_open(tol) & _body_match(0.50)
    )
    if adx_min is not None:
        ok = ok & (F.col("adx") >= adx_min)
    return c.where(ok).select(*_KEEP, F.lit("strict").alias("pattern"), F.lit(1.0).alias("confidence"))


def exhaustion_twin(c: DataFrame, tol: float = 0.05, min_body: float = 0.10, adx_min: float | None = 15.0, lead_body: float = 0.8, reach: int = 10) -> DataFrame:
    """Two like bearish candles after a strong bearish one somewhere in the bars before."""
    strong = (F.col("close") < F.col("open")) & (F.col("mean_body") > 0) & (F.col("body") >= lead_body * F.col("mean_body"))
    w = order_window("ticker", "ts").rowsBetween(-(2 + reach), -2)
    lead = c.withColumn("lead_idx", F.first(F.when(strong, F.col("idx")), ignorenulls=True).over(w))
    ok = (
        (F.col("idx") >= 3) & F.col("lead_idx").isNotNull() & _bear(0) & _bear(1) & (F.col("ratio_1") >= min_body)
        & (F.col("ratio") >= min_body) & _same_open(tol) & _body_match(0.70)
    )
    if adx_min is not None:
        ok = ok & (F.col("adx") >= adx_min)
    return lead.where(ok).select(*_KEEP, F.lit("exhaustion").alias("pattern"), F.lit(0.6).alias("confidence"))


def absorption(c: DataFrame, tol: float = 0.01, adx_min: float | None = 15.0, lead_body: float = 1.5, small: float = 0.4, keep: tuple[str, ...] = ()) -> DataFrame:
    """A heavy bearish candle onto a level, then two small ones that hold its low; needs `support`."""
    hold = F.col("low_2") * 0.998
    cap = small * 2 * F.col("mean_body")
    quiet = F.col("mean_body").isNull() | (F.col("mean_body") <= 0) | ((F.col("body_1") <= cap) & (F.col("body") <= cap))
    ok = (
        (F.col("idx") >= 3) & _bear(2) & (F.col("mean_body_2") > 0) & (F.col("body_2") >= lead_body * F.col("mean_body_2"))
        & (F.abs(F.least("close_2", "low_2") - F.col("support")) <= tol * F.col("support"))
        & (F.col("low_1") >= hold) & (F.col("low") >= hold) & quiet & (_bull(1) | _bull(0))
    )
    if adx_min is not None:
        ok = ok & (F.col("adx") >= adx_min)
    return c.where(ok).select(*_KEEP, *keep, "support", F.lit("absorption").alias("pattern"), F.lit(0.7).alias("confidence"))


def near_level(matches: DataFrame, levels: DataFrame, band: float = 0.005) -> DataFrame:
    """Matches whose body low lies within the band of a level of the same ticker and day."""
    low = F.least("open", "close")
    m = matches.withColumn("day", F.to_date("ts")).join(levels.select("ticker", "day", "support"), ["ticker", "day"])
    return m.where((F.col("support") > 0) & (F.abs(low - F.col("support")) <= band * F.col("support")))


def equal_highs(c: DataFrame, tol: float = 0.02, min_body: float = 0.08) -> DataFrame:
    """Two candles of opposite colour that open at the same price; the higher open is the ceiling."""
    ok = (
        (F.col("idx") >= 2) & (F.col("open_1") > 0) & (_bull(1) != _bull(0)) & (F.col("ratio_1") >= min_body)
        & (F.col("ratio") >= min_body) & _same_open(tol)
    )
    return c.where(ok).select(
        *_KEEP,
        F.lit("eqh_pair").alias("pattern"),
        F.lit(0.8).alias("confidence"),
        F.greatest("open", "open_1").alias("ceiling"),
        F.least("open", "close", "open_1", "close_1").alias("floor"),
    )


def equal_highs_signal(pairs: DataFrame, bars: DataFrame, clear: float = 0.003, reach: int = 5) -> DataFrame:
    """First bar within reach of a pair that clears its ceiling (breakout) or floor (rejection)."""
    p = pairs.select("ticker", F.col("idx").alias("pair_idx"), F.col("ts").alias("pair_ts"), "ceiling", "floor")
    p = p.withColumn("idx", F.explode(F.sequence(F.col("pair_idx") + 1, F.col("pair_idx") + reach)))
    j = p.join(bars.select("ticker", "idx", "ts", "open", "close"), ["ticker", "idx"])
    up = (F.greatest("open", "close") > F.col("ceiling") * (1 + clear)) & (F.col("close") > F.col("ceiling"))
    down = (F.least("open", "close") < F.col("floor") * (1 - clear)) & (F.col("close") < F.col("floor"))
    hit = j.withColumn("signal", F.when(up, "eqh_breakout").when(down, "eqh_rejection")).where("signal is not null")
    first = hit.groupBy("ticker", "pair_idx", "pair_ts", "ceiling").agg(F.min_by(F.struct("signal", "ts", "idx", "close"), "idx").alias("s"))
    return first.select("ticker", "pair_idx", "pair_ts", "ceiling", "s.signal", "s.ts", "s.idx", "s.close")


def best_per_bar(*found: DataFrame) -> DataFrame:
    """Union of detectors, the most confident pattern per (ticker, ts)."""
    cols = ["ticker", "ts", "idx", "pattern", "confidence"]
    all_ = found[0].select(*cols)
    for f in found[1:]:
        all_ = all_.unionByName(f.select(*cols))
    best = all_.groupBy("ticker", "ts", "idx").agg(F.max(F.struct("confidence", "pattern")).alias("b"))
    return best.select("ticker", "ts", "idx", "b.pattern", "b.confidence")
