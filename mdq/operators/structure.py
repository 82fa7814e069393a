"""Smart-money, support/resistance and commodity-linked features over daily OHLCV."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import ROOT_YEAR, div, last_n, nz, order_window, prior_n
from ..functions.rolling import _ROWS, with_windows
from ..functions.scan import state_before

O, H, L, C, V = "open", "high", "low", "close", "volume"


def _w():
    return order_window()


def _lag(x, k: int = 1) -> Column:
    return F.lag(x, k).over(_w())


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _full(x, n: int, f) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(last_n(n)) == n, f(x).over(last_n(n)))


def order_blocks(df: DataFrame, move: float = 0.02, look: int = 20) -> DataFrame:
    """On a large move, strength (at most 1) of the last row before it that closed the other way: volume against the rows before it, times ten times its range."""
    d = df.withColumns({"chg": div(F.col(C), _lag(C)) - 1, "rn": F.row_number().over(_w())})
    before = F.when(F.count(V).over(prior_n(20)) == 20, F.avg(V).over(prior_n(20)))
    d = d.withColumn("force", F.least(div(F.col(V), before) * div(F.col(H) - F.col(L), F.col(C)) * 10, F.lit(1.0)))
    box = F.struct(F.col("force").alias("x"))
    span = _w().rowsBetween(-(look - 1), -1)
    d = d.withColumns(
        {
            "fell": F.last(F.when(F.col("chg") < 0, box), ignorenulls=True).over(span),
            "rose": F.last(F.when(F.col("chg") > 0, box), ignorenulls=True).over(span),
        }
    )
    ready = F.col("rn") > look
    return d.withColumns(
        {
            "order_block_bull": nz(F.when(ready & (F.col("chg") > move), F.col("fell.x"))),
            "order_block_bear": nz(F.when(ready & (F.col("chg") < -move), F.col("rose.x"))),
        }
    )


def fair_value_gaps(df: DataFrame, least: float = 0.001) -> DataFrame:
    """Gap between a row and the one two rows back: a hundred times its share of price, at most 1."""
    up = div(F.col(L) - _lag(H, 2), F.col(C))
    down = div(_lag(L, 2) - F.col(H), F.col(C))
    size = lambda x: nz(F.when(x > least, F.least(x * 100, F.lit(1.0))))
    return df.withColumns({"fvg_bull": size(up), "fvg_bear": size(down)})


def liquidity_sweeps(df: DataFrame, n: int = 20, spike: float = 1.5) -> DataFrame:
    """A heavy row that breaks the n-row extreme and closes back, confirmed by the next row, where it is written; positive after a broken high."""
    whole = F.count("*").over(prior_n(n)) == n
    d = df.withColumns({"hi_n": F.when(whole, F.max(H).over(prior_n(n))), "lo_n": F.when(whole, F.min(L).over(prior_n(n))), "av": F.avg(V).over(last_n(n)), "c_1": _lag(C)})
    d = d.withColumns({f"p_{x}": _lag(x) for x in (H, L, C, V, "hi_n", "lo_n", "av", "c_1")})
    heavy = div(F.col("p_volume"), F.col("p_av")) > spike
    high, low = F.col("p_high") > F.col("p_hi_n"), F.col("p_low") < F.col("p_lo_n")
    turn = div(F.col(C) - F.col("p_close"), F.col("p_close")) * 50
    up = high & (F.col("p_close") < F.col("p_c_1")) & (F.col(C) > F.col("p_close")) & heavy
    down = ~high & low & (F.col("p_close") > F.col("p_c_1")) & (F.col(C) < F.col("p_close")) & heavy
    return d.withColumn("liquidity_sweep", F.when(up, F.least(turn, F.lit(1.0))).when(down, F.greatest(turn, F.lit(-1.0))).otherwise(0.0))


def swings(df: DataFrame, n: int = 5) -> DataFrame:
    """Strict extremes of n rows on both sides."""
    after = _w().rowsBetween(1, n)
    hi = (F.col(H) > F.max(H).over(prior_n(n))) & (F.col(H) > F.max(H).over(after)) & (F.count("*").over(prior_n(n)) == n) & (F.count("*").over(after) == n)
    lo = (F.col(L) < F.min(L).over(prior_n(n))) & (F.col(L) < F.min(L).over(after)) & (F.count("*").over(prior_n(n)) == n) & (F.count("*").over(after) == n)
    return df.withColumns({"swing_high": nz(hi.cast("int"), 0).cast("int"), "swing_low": nz(lo.cast("int"), 0).cast("int")})


def structure_breaks(df: DataFrame, n: int = 5, skip: int = 50) -> DataFrame:
    """Break of the last swing against the trend: fifty times its share of the close, at most 1; negative under a swing low in an uptrend.

    The trend turns up at a swing high over the one before, down at a swing low under the one
    before, and with every break. The first `skip` rows of a ticker and their swings don't count.
    """
    d = swings(df, n).withColumn("rn", F.row_number().over(_w()))
    live = F.col("rn") > skip
    d = d.withColumns({"at_high": F.when(live & (F.col("swing_high") == 1), F.col(H)), "at_low": F.when(live & (F.col("swing_low") == 1), F.col(L))})
    upto, before = _w().rowsBetween(Window.unboundedPreceding, 0), _w().rowsBetween(Window.unboundedPreceding, -1)
    last = lambda x, w: F.last(x, ignorenulls=True).over(w)
    d = d.withColumns({"last_high": last("at_high", upto), "last_low": last("at_low", upto), "old_high": last("at_high", before), "old_low": last("at_low", before)})
    up, down = _yes(F.col("at_high") > F.col("old_high")), _yes(F.col("at_low") < F.col("old_low"))
    under, over = live & _yes(F.col(L) < F.col("last_low")), live & _yes(F.col(H) > F.col("last_high"))
    # states: 0 down, 1 neutral, 2 up; the swings set the trend first, then a break turns it
    set_to = lambda s: F.when(down, 0).when(up, 2).otherwise(s)
    turned = lambda t: F.when((t == 2) & under, 0).when((t == 0) & over, 2).otherwise(t)
    d = state_before(d, ["ticker"], "date", [turned(set_to(s)) for s in range(3)], start=1, name="trend")
    d = d.withColumn("side", set_to(F.col("trend")))
    size = lambda x: F.least(div(x, F.col(C)) * 50, F.lit(1.0))
    drop, rise = size(F.col("last_low") - F.col(L)), size(F.col(H) - F.col("last_high"))
    out = F.when((F.col("side") == 2) & under, -drop).when((F.col("side") == 0) & over, rise)
    return d.withColumn("break_of_structure", nz(out))


def character_changes(df: DataFrame, n: int = 10, volume_rows: int = 20) -> DataFrame:
    """Mean return of n rows that turns up from below zero, or down from above, on more than the usual volume: fifty times the turn, at most 1."""
    d = df.withColumns({"chg": div(F.col(C), _lag(C)) - 1, "rn": F.row_number().over(_w()), "av": F.avg(V).over(last_n(volume_rows))})
    d = d.withColumn("mom", _full("chg", n, F.avg))
    d = d.withColumn("pm", _lag("mom")).withColumn("turn", F.col("mom") - F.col("pm"))
    hit = (F.signum("turn") * F.signum("pm") < 0) & (F.col(V) > F.col("av")) & (F.col("rn") > volume_rows)
    return d.withColumn("change_of_character", nz(F.when(hit, F.greatest(F.least(F.col("turn") * 50, F.lit(1.0)), F.lit(-1.0)))))


def _value_area(price: np.ndarray, volume: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Busiest bin's middle and the edges of the value area, for many windows at once."""
    bins, share = PROFILE_BINS - 1, 0.70
    step = (high - low) / bins
    with np.errstate(all="ignore"):
        at = np.ceil((price - low[:, None]) / step[:, None] - 1e-9) - 1
    at = np.clip(np.nan_to_num(at, nan=0.0, posinf=0.0, neginf=0.0), 0, bins - 1).astype(int)
    rows = np.arange(len(price))
    held = np.zeros((len(price), bins + 2))  # an empty bin on both sides
    for k in range(price.shape[1]):
        held[rows, at[:, k] + 1] += volume[:, k]
    top = held[:, 1:-1].argmax(axis=1)
    first, last = top.copy(), top.copy()
    now, goal = held[rows, top + 1], held.sum(axis=1) * share
    for _ in range(bins - 1):
        left, right = held[rows, first], held[rows, last + 2]
        go = now < goal
        down = go & (left > right) & (first > 0)
        up = go & ~down & (last < bins - 1)
        now = now + np.where(down, left, 0) + np.where(up, right, 0)
        first, last = first - down, last + up
    return low + (top + 0.5) * step, low + (last + 1) * step, low + first * step


#: edges of the price bins of a rolling profile
PROFILE_BINS = 50


def rolling_profile(df: DataFrame, n: int = 20) -> DataFrame:
    """Distance of the close to the busiest price and to the edges of the value area of the n rows before, as shares of the close.

    The value area grows from the busiest bin to the busier neighbour, upwards if equal, until it
    holds 70 % of the volume. Rows without n rows before have 0.
    """
    d = with_windows(df, {}, row="_rn", more=_profile(n))
    return d.select("ticker", "date", *[x.alias(name) for name, x in _profile_out().items()])


def _profile(n: int = 20) -> tuple:
    """The step of with_windows that adds poc, va_high and va_low of the n rows before, null without so many known closes."""

    def add(whole: dict[str, np.ndarray], number: np.ndarray) -> list[np.ndarray]:
        out = np.full((3, len(number)), np.nan)
        if len(whole[C]) > n:
            # the window before a row ends one row earlier; the first rows of a key have none of their own
            views = {c: np.lib.stride_tricks.sliding_window_view(whole[c][:-1], n)[-len(number) :] for c in (C, V, H, L)}
            skip = len(number) - len(views[C])
            for at in range(0, len(views[C]), _ROWS):
                w = {c: x[at : at + _ROWS] for c, x in views.items()}
                rows = np.flatnonzero((number[skip + at : skip + at + len(w[C])] > n) & ~np.isnan(w[C]).any(axis=1))
                if len(rows):
                    out[:, skip + at + rows] = _value_area(w[C][rows], np.nan_to_num(w[V][rows]), np.fmin.reduce(w[L][rows], axis=1), np.fmax.reduce(w[H][rows], axis=1))
        return list(out)

    return add, (C, V, H, L), n + 1, ("poc", "va_high", "va_low")


def _profile_out() -> dict[str, Column]:
    return {f"{x}_distance": nz(div(F.col(x) - F.col(C), F.col(C))) for x in ("poc", "va_high", "va_low")}


def pivot_levels(h: Column, l: Column, c: Column) -> dict[str, tuple[Column, ...]]:
    """pivot, r1, r2, r3, s1, s2, s3 by method, of one row's high, low and close."""
    rng, p, w = h - l, (h + l + c) / 3, (h + l + 2 * c) / 4
    plain = lambda p: (p, 2 * p - l, p + rng, h + 2 * (p - l), 2 * p - h, p - rng, l - 2 * (h - p))
    around = lambda x, mid, steps: (x, *[mid + k * rng for k in steps], *[mid - k * rng for k in steps])
    return {
        "traditional": plain(p),
        "fibonacci": around(p, p, (0.382, 0.618, 1.0)),
        "camarilla": around(p, c, (1.1 / 12, 1.1 / 6, 1.1 / 4)),
        "woodie": plain(w),
    }


PIVOTS = ["pivot_p", "r1", "r2", "r3", "s1", "s2", "s3"]


def pivot_distances(df: DataFrame) -> DataFrame:
    """Distance of the pivot levels of the row before to the close, as a share of it, by method; 0 in a ticker's first row."""
    far = lambda x: nz(div(x - F.col(C), F.col(C)))
    levels = pivot_levels(_lag(H), _lag(L), _lag(C))
    d = df.withColumns({f"{m}_{n}": far(x) for m, v in levels.items() for n, x in zip(PIVOTS, v)})
    rows = F.array(*[F.struct(F.lit(m).alias("method"), *[F.col(f"{m}_{n}").alias(n) for n in PIVOTS]) for m in levels])
    return d.select("ticker", "date", F.explode(rows).alias("m")).select("ticker", "date", "m.*")


AVERAGES = (20, 50, 100, 200)


def bands(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Distances to moving averages, Bollinger and Keltner bands as shares of the close, band widths and positions, and the squeeze (the first inside the second)."""
    d = with_windows(df.withColumns(_band_in()), _band_windows(n), row="_rn")
    return d.select("ticker", "date", *[x.alias(n) for n, x in _band_out(k).items()])


def _band_in() -> dict[str, Column]:
    pc = _lag(C)
    return {"tr": F.greatest(F.col(H) - F.col(L), F.abs(F.col(H) - pc), F.abs(F.col(L) - pc))}


def _band_windows(n: int = 20) -> dict[str, tuple[str, int, str]]:
    return {"mid": ("full_mean", n, C), "sd": ("full_sd", n, C), "atr": ("full_mean", n, "tr"), **{f"ma_{m}": ("full_mean", m, C) for m in AVERAGES}}


def _band_out(k: float = 2.0) -> dict[str, Column]:
    c, far = F.col(C), lambda x: div(x - F.col(C), F.col(C))
    flag = lambda x: _yes(x).cast("int")
    out: dict[str, Column] = {}
    for m in AVERAGES:
        out |= {f"ma_{m}_distance": far(F.col(f"ma_{m}")), f"above_ma_{m}": flag(c > F.col(f"ma_{m}"))}
    for name, half in (("bb", F.col("sd") * k), ("kc", F.col("atr") * k)):
        low, high = F.col("mid") - half, F.col("mid") + half
        out |= {f"{name}_upper_distance": far(high), f"{name}_lower_distance": far(low), f"{name}_width": div(high - low, F.col("mid")), f"{name}_position": div(c - low, high - low)}
    out["squeeze"] = flag(F.col("sd") < F.col("atr"))
    return out


ROUND = (5, 10, 50, 100)


def action_levels(df: DataFrame, n: int = 50) -> DataFrame:
    """Distances to the n-row extremes and to round numbers as shares of the close, place in the range, and consolidation (volatility of returns under half its 100-row mean)."""
    d = with_windows(df.withColumns(_action_in()), _action_windows(n), row="_rn")
    return d.select("ticker", "date", *[x.alias(n) for n, x in _action_out().items()])


def _action_in() -> dict[str, Column]:
    return {"r": div(C, _lag(C)) - 1}


def _action_windows(n: int = 50) -> dict[str, tuple[str, int, str]]:
    return {"hi": ("full_max", n, H), "lo": ("full_min", n, L), "vol": ("full_sd", 20, "r"), "usual": ("full_mean", 100, "vol")}


def _action_out() -> dict[str, Column]:
    c, far = F.col(C), lambda x: div(x - F.col(C), F.col(C))
    out = {"distance_to_high": far(F.col("hi")), "distance_to_low": far(F.col("lo")), "range_position": div(c - F.col("lo"), F.col("hi") - F.col("lo"))}
    out |= {"consolidation": _yes(F.col("vol") < F.col("usual") * 0.5).cast("int")}
    out |= {f"distance_to_round_{k}": far(F.rint(c / k) * k) for k in ROUND}
    return out


def support_resistance(df: DataFrame) -> DataFrame:
    """The support/resistance family in one frame: profile, traditional pivots, bands and averages, action levels."""
    levels = pivot_levels(_lag(H), _lag(L), _lag(C))["traditional"]
    pivots = {f"sr_pivot_{x}": nz(div(level - F.col(C), F.col(C))) for x, level in zip(PIVOTS, levels)}
    # one order of the rows and one pass for all parts
    d = with_windows(df.withColumns({**_band_in(), **_action_in(), **pivots}), {**_band_windows(), **_action_windows()}, row="_rn", more=_profile())
    profile = {f"sr_{n}": x for n, x in _profile_out().items()}
    out = d.where("ticker is not null and date is not null")
    return out.select("ticker", "date", *[x.alias(n) for n, x in profile.items()], *pivots, *[x.alias(n) for n, x in {**_band_out(), **_action_out()}.items()])


def linked(df: DataFrame, series: DataFrame, n: int = 60) -> DataFrame:
    """Rolling correlation and beta of returns to a commodity series(date, price)."""
    w1 = Window.partitionBy(F.lit(1)).orderBy("date")  # one series, bounded by the calendar
    s = series.withColumn("b", div(F.col("price"), F.lag("price").over(w1)) - 1).select("date", "b")
    d = df.withColumn("r", div(F.col(C), _lag(C)) - 1).join(s, "date").where("r is not null and b is not null")
    w = last_n(n)
    full = F.count("*").over(w) == n
    cov, va, vb = F.covar_samp("r", "b").over(w), F.var_samp("r").over(w), F.var_samp("b").over(w)
    return d.withColumns({"correlation": F.when(full, nz(div(cov, F.sqrt(va * vb)))), "beta": F.when(full, nz(div(cov, vb)))})


def commodity(df: DataFrame, value: str = C, periods: tuple[int, ...] = (5, 10, 20, 60), n: int = 20) -> DataFrame:
    """Momentum over several periods, yearly volatility, and up days of the last n against half of them."""
    d = df.withColumn("r", div(value, _lag(value)) - 1)
    up = _full(_yes(F.col("r") > 0).cast("double"), n, F.sum)
    return d.withColumns({**{f"momentum_{p}": div(value, _lag(value, p)) - 1 for p in periods}, "volatility": _full("r", n, F.stddev_samp) * ROOT_YEAR, "trend_strength": (up - n / 2) / (n / 2)})


def _slope(x: Column, n: int) -> Column:
    """Slope of x over the last n rows, null before there are so many; needs the row number rn."""
    w = last_n(n)
    return F.when(F.count(x).over(w) == n, F.regr_slope(x, F.col("rn")).over(w))


def inventory_features(df: DataFrame, value: str, n: int = 20) -> DataFrame:
    """Deviation from the mean of 5 n rows, change and its share, slope over n rows, and change against the mean change of 4 rows."""
    x, was = F.col(value), _lag(value)
    d = df.withColumns({"rn": F.row_number().over(_w()), "inventory_change": x - was, "inventory_change_pct": div(x, was) - 1, "usual": _full(value, 5 * n, F.avg)})
    return d.withColumns({"inventory_deviation": div(x - F.col("usual"), F.col("usual")), "inventory_trend": _slope(x, n), "inventory_surprise": F.col("inventory_change") - _full("inventory_change", 4, F.avg)}).drop("rn", "usual")


def utilisation_features(df: DataFrame, value: str, n: int = 52, short: int = 12) -> DataFrame:
    """Change, deviation from the mean of n rows and slope over `short` rows."""
    x = F.col(value)
    d = df.withColumns({"rn": F.row_number().over(_w()), "utilisation_change": x - _lag(value), "usual": _full(value, n, F.avg)})
    return d.withColumns({"utilisation_deviation": div(x - F.col("usual"), F.col("usual")), "utilisation_trend": _slope(x, short)}).drop("rn", "usual")


def _rolling_rank(x: str, n: int) -> Column:
    """Mean rank of the last value among the last n, as a share; null before there are so many."""
    past = F.collect_list(x).over(last_n(n))
    below, upto = (F.size(F.filter(past, f)) for f in (lambda y: y < F.col(x), lambda y: y <= F.col(x)))
    return F.when(F.size(past) == n, (below + upto + 1) / 2 / n)


def crack_spreads(df: DataFrame, crude: str, gasoline: str, diesel: str, n: int = 252, mom: int = 20) -> DataFrame:
    """Refining margins: two parts gasoline and one diesel over three crude, and each product alone; momentum of the first and percentiles within the last n rows."""
    g, d, c = F.col(gasoline), F.col(diesel), F.col(crude)
    out = df.withColumns({"crack_321": (2 * g + d) / 3 - c, "crack_gasoline": g - c, "crack_diesel": d - c})
    out = out.withColumn("crack_momentum", div("crack_321", _lag("crack_321", mom)) - 1)
    return out.withColumns({f"{x}_percentile": _rolling_rank(x, n) for x in ("crack_321", "crack_gasoline", "crack_diesel")})


def spread_series(df: DataFrame, one: str, other: str, n: int = 252, mom: int = 20) -> DataFrame:
    """Difference of two prices, its share of the second, its relative change over mom rows and its percentile within the last n."""
    d = df.withColumn("spread", F.col(one) - F.col(other)).withColumn("spread_pct", div("spread", other))
    return d.withColumns({"spread_momentum": div("spread", _lag("spread", mom)) - 1, "spread_percentile": _rolling_rank("spread", n)})


def seasonal(df: DataFrame) -> DataFrame:
    """Driving, heating and shoulder season flags and the same-month average return of the ticker."""
    d = df.withColumns({"r": div(F.col(C), _lag(C)) - 1, "month": F.month("date")})
    avg = d.groupBy("ticker", "month").agg(F.avg("r").alias("month_avg"))
    driving, heating = F.col("month").between(5, 9), F.col("month").isin(11, 12, 1, 2, 3)
    return d.join(avg, ["ticker", "month"]).withColumns({"driving": driving.cast("int"), "heating": heating.cast("int"), "shoulder": (~driving & ~heating).cast("int")})


def risk_proxy(df: DataFrame, move: float = 0.03) -> DataFrame:
    """Short volatility against its 60-row mean, large-move flags and their 5-row count."""
    d = df.withColumn("r", div(F.col(C), _lag(C)) - 1)
    d = d.withColumns({"vol": _full("r", 10, F.stddev_samp), "large": nz((F.abs("r") > move).cast("int"), 0).cast("int")})
    return d.withColumns({"risk": div(F.col("vol"), _full("vol", 60, F.avg)), "large_5": F.sum("large").over(last_n(5))})


MARKET = [*[f"momentum_{p}" for p in (5, 10, 20, 60)], "volatility", "trend_strength", "inventory_deviation", "inventory_change", "inventory_change_pct", "inventory_trend", "inventory_surprise"]
MARKET += ["crack_321", "crack_gasoline", "crack_diesel", "crack_momentum", "crack_321_percentile", "crack_gasoline_percentile", "crack_diesel_percentile"]
MARKET += ["utilisation_change", "utilisation_deviation", "utilisation_trend", "spread", "spread_pct", "spread_momentum", "spread_percentile", "vol_spike", "large_move", "large_move_5"]


def market_features(market: DataFrame) -> DataFrame:
    """Everything that follows from the commodity market alone: (date, ...) of market(date, crude, other_crude, gasoline, diesel, inventory, utilisation), one row a date."""
    d = commodity(market.withColumn("ticker", F.lit("market")), "crude")
    d = inventory_features(d, "inventory")
    d = utilisation_features(crack_spreads(d, "crude", "gasoline", "diesel"), "utilisation")
    d = spread_series(d, "crude", "other_crude").withColumn("large_move", _yes(F.abs("r") > 0.03).cast("int"))
    d = d.withColumns({"vol_spike": div("volatility", _full("volatility", 60, F.avg)), "large_move_5": _full("large_move", 5, F.sum)})
    return d.select("date", *MARKET)


def commodity_linked(df: DataFrame, market: DataFrame, n: int = 60) -> DataFrame:
    """The commodity-linked family in one frame: correlation and beta to crude, the market's features, seasons.

    The market has a row per date, so joining it needs no shuffle by ticker.
    """
    w = last_n(n)
    crude = market.withColumn("ticker", F.lit("market")).withColumn("b", div("crude", _lag("crude")) - 1).select("date", "b")
    d = df.withColumn("a", div(C, _lag(C)) - 1).join(crude, "date")
    d = d.withColumns({"x": F.when(F.col("b").isNotNull(), F.col("a")), "y": F.when(F.col("a").isNotNull(), F.col("b"))})
    whole = F.count("x").over(w) == n
    cov, va, vb = F.covar_samp("x", "y").over(w), F.var_samp("x").over(w), F.var_samp("y").over(w)
    d = d.withColumns({"correlation": nz(F.when(whole, div(cov, F.sqrt(va * vb)))), "beta": nz(F.when(whole, div(cov, vb)))}).select("ticker", "date", "correlation", "beta")
    seasons = seasonal(df).select("ticker", "date", "driving", "heating", "shoulder", "month_avg")
    return d.join(seasons, ["ticker", "date"]).join(market_features(market), "date")


#: family and column of every feature type of the three families
FAMILIES = {
    **{t: "smart_money" for t in ("order_block_bull", "order_block_bear", "fvg_bull", "fvg_bear", "liquidity_sweep", "break_of_structure", "change_of_character")},
    **{t: "support_resistance" for t in (*[f"sr_{x}" for x in ("poc_distance", "va_high_distance", "va_low_distance")], *[f"sr_{x if x[0] == "p" else "pivot_" + x}" for x in PIVOTS])},
    **{t: "support_resistance" for t in (*[f"ma_{m}_distance" for m in AVERAGES], *[f"above_ma_{m}" for m in AVERAGES], "squeeze", "range_position", "consolidation")},
    **{t: "support_resistance" for t in (*[f"{x}_{y}" for x in ("bb", "kc") for y in ("upper_distance", "lower_distance", "width", "position")], "distance_to_high", "distance_to_low")},
    **{t: "support_resistance" for t in (f"distance_to_round_{k}" for k in ROUND)},
    **{t: "commodity_linked" for t in ("correlation", "beta", "driving", "heating", "shoulder", "month_avg", *MARKET)},
}


def family_features(df: DataFrame, names: list[str], market: DataFrame | None = None, lag: int = 0) -> DataFrame:
    """Chosen features of the three families by name; only the families asked for are computed. lag shifts them back by so many rows.

    Features that are undefined in a row are 0, like those of the main library. Commodity-linked
    ones need a market.
    """
    unknown = [n for n in names if n not in FAMILIES]
    if unknown:
        raise KeyError(f"no such feature: {unknown}")
    build = {"smart_money": smart_money, "support_resistance": support_resistance, "commodity_linked": lambda d: commodity_linked(d, market)}
    out = df.select("ticker", "date")
    for family in dict.fromkeys(FAMILIES[n] for n in names):
        own = [n for n in names if FAMILIES[n] == family]
        out = out.join(build[family](df).select("ticker", "date", *own), ["ticker", "date"], "left")
    out = out.select("ticker", "date", *[nz(F.col(n)).alias(n) for n in names])
    return out.select("ticker", "date", *[F.lag(n, lag).over(_w()).alias(n) for n in names]) if lag else out


def smart_money(df: DataFrame) -> DataFrame:
    """The smart-money family in one frame."""
    made = ["order_block_bull", "order_block_bear", "fvg_bull", "fvg_bear", "liquidity_sweep", "change_of_character"]
    # the scan of breaks comes last, on what is still needed, so that all share one order of the rows
    return structure_breaks(character_changes(liquidity_sweeps(fair_value_gaps(order_blocks(df)))).select(*df.columns, *made))
