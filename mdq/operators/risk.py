"""Slippage, liquidity, dilution, sizing, stops, rebalancing and regimes over daily panels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import ROOT_YEAR, div, last_n, nz, order_window, prior_n
from ..functions.ema import ema, span
from ..functions.rank import expanding_rank
from ..functions.rolling import with_windows


def with_adv(df: DataFrame, n: int = 20) -> DataFrame:
    """Average daily dollar volume over the last n rows."""
    return df.withColumn("adv", F.avg("volume").over(last_n(n)) * F.col("close"))


def latest(df: DataFrame, *keep: str) -> DataFrame:
    """Last row per ticker by a combinable max_by, not a sort."""
    cols = list(keep) or [c for c in df.columns if c != "ticker"]
    return df.groupBy("ticker").agg(F.max_by(F.struct(*cols), "date").alias("x")).select("ticker", "x.*")


def slippage(order: Column, adv: Column, base_bps: float = 25, impact: float = 0.5, fee: float = 6.95, cap: float = 0.10) -> Column:
    """Cost share of an order: base + impact * sqrt(order / adv) + fee, capped."""
    return F.least(base_bps / 1e4 + impact * F.sqrt(nz(div(order, adv))) + nz(div(F.lit(fee), order)), F.lit(cap))


def slippage_by_size(df: DataFrame, sizes: list[float], flat: float = 0.002) -> DataFrame:
    last = latest(with_adv(df), "adv", "close")
    s = last.withColumn("size", F.explode(F.array(*[F.lit(float(x)) for x in sizes])))
    s = s.withColumn("slip", slippage(F.col("size"), F.col("adv")))
    return s.withColumns({"vs_flat": F.col("slip") - flat, "cost": F.col("size") * F.col("slip")})


def net_return(gross: Column, turnover: Column, slip: Column, trades: Column, value: Column, fee: float = 6.95) -> Column:
    """Return after slippage on the traded share and commissions."""
    return gross - turnover * slip * 2 - nz(div(trades * fee, value))


def commission_impact(size: Column, fee: float = 6.95) -> Column:
    """Move that pays a round trip's commissions."""
    return div(F.lit(2 * fee), size)


def portfolio_slippage(positions: DataFrame, df: DataFrame) -> DataFrame:
    """Size-weighted slippage of (ticker, dollars) positions."""
    j = positions.join(latest(with_adv(df), "adv"), "ticker").withColumn("slip", slippage(F.col("dollars"), F.col("adv")))
    return j.groupBy("book").agg(F.sum(F.col("slip") * F.col("dollars")).alias("cost"), F.sum("dollars").alias("dollars")).withColumn("weighted_slip", div(F.col("cost"), F.col("dollars")))


def dilution_flags(df: DataFrame, spike: float = 3.0, drop: float = -0.10, keep: int = 3) -> DataFrame:
    """Volume spike with a price fall, and whether one fell in the last `keep` rows."""
    w = order_window()
    d = df.withColumn("ret", div(F.col("close"), F.lag("close").over(w)) - 1)
    d = d.withColumn("flag", nz(((F.col("volume") > spike * F.avg("volume").over(last_n(20))) & (F.col("ret") < drop)).cast("int"), 0).cast("int"))
    return d.withColumn("exit", F.max("flag").over(last_n(keep)))


def liquidity(df: DataFrame, min_adv: float, share: float = 0.05) -> DataFrame:
    last = latest(with_adv(df), "adv", "close", "date")
    return last.withColumns({"max_position": F.col("adv") * share, "liquid": F.col("adv") >= min_adv})


def clip_positions(positions: DataFrame, df: DataFrame, share: float = 0.05) -> DataFrame:
    j = positions.join(latest(with_adv(df), "adv"), "ticker")
    return j.withColumns({"allowed": F.least(F.col("dollars"), F.col("adv") * share), "clipped": F.col("dollars") > F.col("adv") * share})


def technical_dilution(df: DataFrame, spike: float = 3.0, drop: float = -0.10) -> DataFrame:
    """Events against the 20 previous rows with severity tiers (0 low .. 3 extreme)."""
    w = order_window()
    d = df.withColumns(
        {
            "rn": F.row_number().over(w),
            "volume_spike": div(F.col("volume"), F.avg("volume").over(prior_n(20))),
            "price_drop": div(F.col("close"), F.lag("close").over(w)) - 1,
        }
    )
    hit = d.where((F.col("rn") > 20) & (F.col("volume_spike") >= spike) & (F.col("price_drop") <= drop))
    x = F.col("price_drop")
    sev = F.when(x <= -0.50, 3).when(x <= -0.25, 2).when(x <= -0.15, 1).otherwise(0)
    return hit.select("ticker", "date", "volume_spike", "price_drop", sev.alias("severity"), F.lit("technical").alias("kind"), F.lit(0.5).alias("confidence"))


def insider_spikes(sales: DataFrame) -> DataFrame:
    """Tickers whose last 30-row selling sum is above three times its own average."""
    s = sales.withColumns({"roll": F.sum("shares").over(last_n(30))})
    g = s.groupBy("ticker").agg(F.count("*").alias("n"), F.avg("roll").alias("mean"), F.max_by(F.struct("roll", "date"), "date").alias("x"))
    return g.where((F.col("n") >= 2) & (F.col("x.roll") > 3 * F.col("mean"))).select("ticker", F.col("x.date").alias("date"), F.lit(1).alias("severity"), F.lit("insider").alias("kind"), F.lit(0.6).alias("confidence"))


def share_count_jumps(counts: DataFrame, limit: float = 0.05) -> DataFrame:
    up = div(F.col("shares"), F.lag("shares").over(order_window())) - 1
    d = counts.withColumn("increase", up).where(F.col("increase") > limit)
    x = F.col("increase")
    return d.select("ticker", "date", "increase", F.when(x > 0.5, 3).when(x > 0.25, 2).when(x > 0.10, 1).otherwise(0).alias("severity"), F.lit("share_count").alias("kind"), F.lit(0.9).alias("confidence"))


def combine_events(events: DataFrame, gap: int = 5, keep: float = 0.6) -> DataFrame:
    """Events within `gap` days of a group's first event form one event.

    The grouping is greedy in date order, so the anchors of a ticker's distinct event dates
    are found by a fold; dates are bounded by the calendar.  Events themselves stay rows.
    """
    days = events.groupBy("ticker").agg(F.array_sort(F.collect_set(F.datediff("date", F.lit("1970-01-01").cast("date")))).alias("d"))

    def step(acc, d):
        last = F.try_element_at(acc, F.lit(-1))
        return F.when(last.isNull() | (d - last > gap), F.concat(acc, F.array(d))).otherwise(acc)

    anchors = days.select("ticker", F.aggregate("d", F.array().cast("array<int>"), step).alias("a"))
    e = events.join(anchors, "ticker").withColumn("day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    e = e.withColumn("anchor", F.array_max(F.filter("a", lambda x: x <= F.col("day"))))
    g = e.groupBy("ticker", "anchor").agg(
        F.count("*").alias("n"), F.max("severity").alias("severity"), F.max("volume_spike").alias("volume_spike"), F.min("price_drop").alias("price_drop"),
        F.max((F.col("kind") == "filing").cast("int")).alias("filing"), F.max((F.col("kind") == "news").cast("int")).alias("news"), F.avg("confidence").alias("c"),
    )
    g = g.withColumn("confidence", F.least(F.col("c") + 0.2 * (F.col("n") - 1), F.lit(1.0))).where(F.col("confidence") >= keep)
    return g.withColumn("date", F.date_add(F.lit("1970-01-01").cast("date"), F.col("anchor"))).drop("anchor", "c")


def dilution_statistics(events: DataFrame) -> DataFrame:
    return events.groupBy("severity").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.avg("price_drop").alias("avg_drop"), F.count_distinct("ticker").alias("tickers"))


def blacklist(events: DataFrame, days: int = 20) -> DataFrame:
    return events.groupBy("ticker").agg(F.max(F.date_add("date", days)).alias("until"))


def blacklisted(rows: DataFrame, events: DataFrame, days: int = 20) -> DataFrame:
    """Rows whose date falls within `days` after an event of the ticker.

    Rows and events are stacked and each row sees the ticker's last event date up to its own, so
    no event is repeated for the days it covers and neither side is small enough to be broadcast by mistake.
    """
    hit = events.where("ticker is not null and date is not null").select("ticker", "date", F.col("date").alias("_hit"), F.lit(True).alias("_event"))
    none = F.lit(None).cast("date")
    both = rows.where("ticker is not null and date is not null").withColumns({"_hit": none, "_event": F.lit(False)}).unionByName(hit, allowMissingColumns=True)
    last = F.max("_hit").over(order_window().rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("_last", last).where(~F.col("_event") & (F.col("date") <= F.date_add("_last", days))).drop("_hit", "_event", "_last")


def rebalance_trades(current: DataFrame, target: DataFrame, value: float, tolerance: float = 0.20) -> DataFrame:
    """Trades where a weight is off its target by more than the tolerance (missing sides count as 0)."""
    j = current.select("ticker", F.col("weight").alias("cw")).join(target.select("ticker", F.col("weight").alias("tw")), "ticker", "full")
    j = j.withColumns({"cw": nz(F.col("cw")), "tw": nz(F.col("tw"))})
    dev = F.when(F.col("tw") > 0, F.abs(F.col("cw") - F.col("tw")) / F.col("tw")).otherwise(F.when(F.col("cw") > 0, 1.0).otherwise(0.0))
    return j.withColumns({"deviation": dev, "trade": F.when(dev > tolerance, (F.col("tw") - F.col("cw")) * value).otherwise(0.0)})


def drift(current: DataFrame, target: DataFrame, partial: float = 0.05, full: float = 0.10) -> DataFrame:
    """Total drift and the action of the threshold and combined rules."""
    j = rebalance_trades(current, target, 1.0)
    d = j.agg((F.sum(F.abs(F.col("cw") - F.col("tw"))) / 2).alias("drift"), F.sum(F.abs("trade")).alias("turnover"))
    return d.withColumn("action", F.when(F.col("drift") > full, "full").when(F.col("drift") > partial, "partial").otherwise("none"))


def kelly(trades: DataFrame, order: list[str], n: int = 20, cap: float = 0.25, default: float = 0.10) -> DataFrame:
    """Kelly fraction over each ticker's last n trades."""
    w = Window.partitionBy("ticker").orderBy(*order).rowsBetween(-(n - 1), 0)
    p = F.col("pnl_pct")
    t = trades.withColumns(
        {
            "n_last": F.count("*").over(w),
            "wr": F.avg((p > 0).cast("double")).over(w),
            "aw": F.avg(F.when(p > 0, p)).over(w),
            "al": F.abs(F.avg(F.when(p < 0, p)).over(w)),
        }
    )
    raw = div(F.col("wr") * F.col("aw") - (1 - F.col("wr")) * F.col("al"), F.col("aw"))
    ok = (F.col("n_last") >= 5) & F.col("aw").isNotNull() & F.col("al").isNotNull()
    return t.withColumn("kelly", F.when(ok, F.greatest(F.lit(0.0), F.least(raw, F.lit(cap)))).otherwise(default))


def volatility_sizes(df: DataFrame, target: float = 0.20, cap: float = 2.0, n: int = 21) -> DataFrame:
    """Vol-scaled multiple, label and inverse-volatility weight at each ticker's last row."""
    d = df.withColumn("r", div(F.col("close"), F.lag("close").over(order_window())) - 1)
    last = latest(d.withColumn("vol", F.stddev_samp("r").over(last_n(n)) * ROOT_YEAR), "vol").where("vol > 0")
    total = last.agg(F.sum(1 / F.col("vol")).alias("total"))
    v = F.col("vol")
    return last.join(F.broadcast(total)).select(
        "ticker", "vol", F.least(target / v, F.lit(cap)).alias("scale"), (1 / v / F.col("total")).alias("weight"),
        F.when(v < 0.15, "low").when(v < 0.30, "normal").when(v < 0.50, "high").otherwise("extreme").alias("label"),
    )


def trailing_stop(df: DataFrame, k: float = 2.0, n: int = 14, fixed: float = 0.08, max_days: int = 30) -> DataFrame:
    """ATR ratchet from each ticker's first row: the stop is a running maximum; first close at or under it exits."""
    w = order_window()
    pc = F.lag("close").over(w)
    d = df.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))
    d = d.withColumn("atr", F.avg("tr").over(last_n(n)))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"entry": F.first("close").over(run), "start": F.first("date").over(run)})
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("stop", F.max(F.col("close") - k * F.col("atr")).over(before))
    hit = lambda c: F.min(F.when(c, F.col("date")))
    g = d.groupBy("ticker").agg(
        F.first("entry").alias("entry"),
        hit(F.col("close") <= F.col("stop")).alias("atr_exit"),
        F.min_by("stop", F.when(F.col("close") <= F.col("stop"), F.col("date"))).alias("stop"),
        hit(F.col("close") <= F.col("entry") * (1 - fixed)).alias("fixed_exit"),
        hit(F.datediff("date", "start") >= max_days).alias("time_exit"),
    )
    return g.withColumn("protected", div(F.col("stop"), F.col("entry")) - 1)


# timeframe, hold in days, slippage bps (fixed values)
TIMEFRAMES = [("intraday", 0.25, 75.0), ("swing", 5.0, 35.0), ("weekly", 10.0, 25.0), ("monthly", 30.0, 20.0)]


def timeframe_costs(df: DataFrame, slots: int = 3) -> DataFrame:
    """Annual trades, cost drag and position size of each timeframe for each ticker's recent return."""
    last = latest(with_adv(df), "adv", "close")
    items = F.array(*[F.struct(F.lit(n).alias("timeframe"), F.lit(h).alias("hold"), F.lit(b).alias("bps")) for n, h, b in TIMEFRAMES])
    t = last.select("ticker", "adv", "close", F.explode(items).alias("t")).select("ticker", "adv", "close", "t.*")
    annual = 252 / F.col("hold") * slots
    return t.withColumns({"annual_trades": annual, "cost_drag": annual * F.col("bps") / 1e4 * 2 / slots, "size": F.least(F.col("adv") * 0.05, F.lit(100000.0 / slots))})


def dollar_sizing(trades: DataFrame, risk: float = 100.0, k: float = 1.5, fallback: float = 0.02) -> DataFrame:
    """Shares = risk budget / (k * ATR), 2 % of price where ATR is missing; dollar P&L."""
    unit = F.coalesce(F.when(F.col("atr") > 0, F.col("atr")), F.col("entry_price") * fallback)
    sh = F.floor(risk / (k * unit))
    return trades.withColumns({"shares": sh, "dollars": sh * (F.col("exit_price") - F.col("entry_price"))})


def time_of_day_caps(bars: DataFrame, rate: float = 0.02) -> DataFrame:
    """(ticker, tod, cap): a share of the median volume of a ticker's bars at the same time of day; none where that is not over 0."""
    g = bars.groupBy("ticker", F.date_format("ts", "HH:mm").alias("tod")).agg(F.percentile("volume", 0.5).alias("m"))
    return g.where("m > 0").select("ticker", "tod", (F.col("m") * rate).alias("cap"))


def cap_by_time_of_day(trades: DataFrame, bars: DataFrame, rate: float = 0.02) -> DataFrame:
    """trades(ticker, entry_ts, shares, ...) with capped: at most the cap of the entry's time of day, all shares where there is no such bar."""
    caps = time_of_day_caps(bars, rate)
    j = trades.withColumn("tod", F.date_format("entry_ts", "HH:mm")).join(caps, ["ticker", "tod"], "left")
    return j.withColumn("capped", F.least("shares", F.coalesce("cap", "shares"))).drop("tod", "cap")


def close_adx(df: DataFrame, n: int) -> DataFrame:
    """(ticker, date, adx) from closes alone; every smoothing has weight 2 / (n + 1). Rows before a ticker's first move are left out."""
    step = F.col("close") - F.lag("close").over(order_window())
    up, down = F.greatest(nz(step), F.lit(0.0)), F.greatest(nz(-step), F.lit(0.0))
    d = ema(df.select("ticker", "date", "close"), {"up": (up, span(n)), "down": (down, span(n))}, order="date")
    d = d.withColumn("dx", 100 * div(F.abs(F.col("up") - F.col("down")), F.col("up") + F.col("down"))).where("dx is not null")
    return ema(d, {"adx": (F.col("dx"), span(n))}, order="date").select("ticker", "date", "adx")


def correlation_regime(panel: DataFrame, n: int = 20) -> DataFrame:
    """(date, correlation_level, correlation_regime): mean absolute correlation of the last n returns over all pairs of a fixed universe's tickers.

    Needs a dense panel; pairs with a constant side are left out. The pairs of a fixed universe are a fixed number.
    """
    r = panel.select("ticker", "date", (div(F.col("close"), F.lag("close").over(order_window())) - 1).alias("r")).where("r is not null")
    pair = r.select(F.col("ticker").alias("a"), "date", F.col("r").alias("x")).join(r.select(F.col("ticker").alias("b"), "date", F.col("r").alias("y")), "date").where("a < b")
    w = Window.partitionBy("a", "b").orderBy("date").rowsBetween(-(n - 1), 0)
    cov, va, vb = F.covar_samp("x", "y").over(w), F.var_samp("x").over(w), F.var_samp("y").over(w)
    # a variance that is nothing but rounding is a constant side
    moving = (va > 1e-15) & (vb > 1e-15) & (F.count("*").over(w) == n)
    c = pair.select("date", F.abs(F.when(moving, cov / F.sqrt(va * vb))).alias("c")).where("c > 1e-12")
    level = c.groupBy("date").agg(F.avg("c").alias("correlation_level"))
    x = F.col("correlation_level")
    return level.withColumn("correlation_regime", F.when(x < 0.3, "low").when(x < 0.6, "moderate").otherwise("high"))


def regimes(df: DataFrame, correlation: DataFrame | None = None, n_vol: int = 20, n_trend: int = 50, n_market: int = 200) -> DataFrame:
    """Volatility, trend, market and correlation regime of every row from its own past, with strengths and confidence.

    correlation: (date, correlation_level, correlation_regime) of the universe; where it has no
    row, 0.5 and moderate stand. Before there are enough rows the trend and the market are sideways.
    """
    w = order_window()
    d = df.withColumn("r", div(F.col("close"), F.lag("close").over(w)) - 1)
    d = d.select("ticker", "date", "close", "r", F.avg("r").over(last_n(n_market // 4)).alias("recent"))
    means = {"ma_s": n_trend // 2, "ma_l": n_trend, "ma_m": n_market}
    d = with_windows(d, {"vol": ("full_sd", n_vol, "r"), "wide": ("full_sd", n_market, "r"), **{x: ("full_mean", n, "close") for x, n in means.items()}})
    d = d.drop("rn", "r").withColumn("vol", F.round(F.col("vol") * ROOT_YEAR, 10))
    d = d.withColumn("usual", F.avg("wide").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.join(expanding_rank(d, "vol", "pct"), ["ticker", "date"], "left").join(close_adx(df, n_trend), ["ticker", "date"], "left")
    p, adx, c = F.col("pct"), nz(F.col("adx")), F.col("close")
    way = F.greatest(F.least(div(F.col("ma_s") - F.col("ma_l"), F.col("ma_l")) * 10, F.lit(1.0)), F.lit(-1.0))
    far = div(c - F.col("ma_m"), F.col("ma_m")) * 2
    d = d.withColumns(
        {
            "trend_strength": F.when(F.col("ma_l").isNotNull(), way * adx / 100),
            "sentiment": F.when(far.isNotNull(), F.greatest(F.least(far, F.lit(1.0)), F.lit(-1.0))),
            "strength": adx,
        }
    )
    t = F.col("trend_strength")
    d = d.withColumns(
        {
            "vol_regime": F.when(p < 0.25, "low").when(p < 0.75, "normal").when(p < 0.95, "high").when(p.isNotNull(), "extreme"),
            "trend_regime": F.when(F.col("strength") < 20, "sideways").when(t > 0.5, "strong_uptrend").when(t > 0.2, "weak_uptrend").when(t < -0.5, "strong_downtrend").when(t < -0.2, "weak_downtrend").otherwise("sideways"),
            "market_regime": F.when((c > F.col("ma_m") * 1.05) & (F.col("recent") > 0), "bull").when((c < F.col("ma_m") * 0.95) & (F.col("recent") < 0), "bear").when(F.col("vol") / ROOT_YEAR > 1.5 * F.col("usual"), "volatile").otherwise("sideways"),
        }
    )
    if correlation is not None:
        d = d.join(correlation, "date", "left")
    else:
        d = d.withColumns({"correlation_level": F.lit(None).cast("double"), "correlation_regime": F.lit(None).cast("string")})
    return d.select(
        "ticker", "date", "pct", "trend_strength", "sentiment", nz(F.col("correlation_level"), 0.5).alias("correlation_level"), regime_confidence().alias("confidence"),
        "vol_regime", "trend_regime", "market_regime", F.coalesce("correlation_regime", F.lit("moderate")).alias("correlation_regime"),
    )


def regime_confidence() -> Column:
    """0.5, and more where the regimes of a row agree."""
    v, t, m = F.col("vol_regime"), F.col("trend_regime"), F.col("market_regime")
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    bull = plus(t.isin("strong_uptrend", "weak_uptrend"), 0.2) + plus(v.isin("low", "normal"), 0.1)
    bear = plus(t.isin("strong_downtrend", "weak_downtrend"), 0.2) + plus(v == "high", 0.1)
    return 0.5 + F.when(m == "bull", bull).when(m == "bear", bear).when(m == "volatile", plus(v.isin("high", "extreme"), 0.3)).otherwise(0.0)


def regime_weights(reg: DataFrame) -> DataFrame:
    """Position scale, stop scale and slot limit of each row's regimes."""
    v, m, high = F.col("vol_regime"), F.col("market_regime"), F.col("correlation_regime") == "high"
    scale = F.when(v == "low", 1.2).when(v == "high", 0.7).when(v == "extreme", 0.5).otherwise(1.0)
    scale = scale * F.when(m == "bull", 1.1).when(m == "bear", 0.8).when(m == "volatile", 0.6).otherwise(1.0) * F.when(high, 0.9).otherwise(1.0)
    stop = F.when(v == "low", 0.8).when(v == "high", 1.5).when(v == "extreme", 2.0).otherwise(1.0)
    slots = F.when(m == "bull", 12).when(m == "bear", 6).when(m == "volatile", 5).otherwise(10)
    return reg.withColumns({"scale": scale, "stop_scale": stop, "max_positions": F.when(high, F.least(slots, F.lit(5))).otherwise(slots)})
