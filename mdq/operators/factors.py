"""The daily factor library: every feature on every date from one pass of ticker windows.

Input is a long panel (ticker, date, close, volume) with one row per ticker and date.
`compute` adds the intermediate columns the requested features need, level by level, so
each level is a single Window node over one sort.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import ROOT_YEAR, YEAR, div, last_n, nz, order_window, prior_n, safe_corr, so_far
from ..functions.rank import by_group, pct_rank, pct_ranks
from ..functions.rolling import with_windows
from ..session import cut_lineage

# ---- fixed values: feature type -> (name pattern, parameter sets) ---------------------
_SPEC_ROWS = [
    ("momentum", "mom_{0}d", [(5,), (10,), (21,), (63,), (126,), (252,)]),
    ("momentum_skip", ["mom_12_1", "mom_6_1", "mom_3_1"], [(252, 21), (126, 21), (63, 21)]),
    ("momentum_accel", ["mom_accel_short", "mom_accel_medium", "mom_accel_long"], [(5, 21), (21, 63), (63, 252)]),
    ("momentum_consistency", "mom_consistency_{0}d", [(21, 5), (63, 21)]),
    ("momentum_smoothness", "mom_smoothness_{0}d", [(21,), (63,)]),
    ("zscore", "zscore_{0}d", [(5,), (10,), (21,), (63,)]),
    ("distance_from_ma", "dist_ma_{0}", [(10,), (21,), (50,), (200,)]),
    ("reversion_speed", "reversion_speed_{0}d", [(10,), (21,), (63,)]),
    ("rsi", "rsi_{0}", [(14,), (28,)]),
    ("volatility", "vol_{0}d", [(5,), (21,), (63,), (252,)]),
    ("vol_ratio", "vol_ratio_{0}_{1}", [(5, 21), (21, 63), (63, 252)]),
    ("vol_of_vol", "vol_of_vol_{0}d", [(21,), (63,)]),
    ("vol_trend", "vol_trend_{0}d", [(21, 63)]),
    ("drawdown", "drawdown_{0}d", [(21,), (63,), (126,), (252,)]),
    ("drawdown_duration", "drawdown_duration_{0}d", [(63,), (252,)]),
    ("recovery_rate", "recovery_rate_{0}d", [(63,), (126,)]),
    ("max_drawdown", "max_dd_{0}d", [(63,), (126,)]),
    ("ulcer_index", "ulcer_index_{0}d", [(63,)]),
    ("skewness", "skew_{0}d", [(21,), (63,), (126,)]),
    ("kurtosis", "kurt_{0}d", [(21,), (63,), (126,)]),
    ("downside_deviation", "downside_dev_{0}d", [(21,), (63,)]),
    ("up_down_capture", "up_down_ratio_{0}d", [(63,)]),
    ("left_tail", "left_tail_{0}d", [(21, 0.05), (63, 0.05)]),
    ("trend_r2", "trend_r2_{0}d", [(21,), (63,), (126,)]),
    ("trend_slope", "trend_slope_{0}d", [(21,), (63,)]),
    ("trend_deviation", "trend_deviation_{0}d", [(21,), (63,)]),
    ("hurst_proxy", "hurst_proxy_{0}d", [(63,), (126,)]),
    ("range_position", "range_position_{0}d", [(21,), (63,), (252,)]),
    ("high_proximity", "high_proximity_{0}d", [(63,), (252,)]),
    ("breakout_strength", "breakout_{0}d", [(21,), (63,)]),
    ("support_distance", "support_distance_{0}d", [(21,)]),
    ("resistance_distance", "resistance_distance_{0}d", [(21,)]),
    ("relative_strength", "rel_strength_{0}d", [(21,), (63,), (126,)]),
    ("relative_volatility", "rel_vol_{0}d", [(21,), (63,)]),
    ("excess_momentum", "excess_mom_{0}d", [(21,), (63,)]),
    ("relative_value", "rel_value_{0}d", [(21,), (63,)]),
    ("sharpe_ratio", "sharpe_{0}d", [(21,), (63,), (126,)]),
    ("sortino_ratio", "sortino_{0}d", [(21,), (63,)]),
    ("calmar_ratio", "calmar_{0}d", [(63,), (126,)]),
    ("information_ratio", "info_ratio_{0}d", [(63,), (126,)]),
    ("volume_trend", "volume_trend_{0}d", [(21,)]),
    ("volume_ratio", "volume_ratio_{0}_{1}", [(5, 21)]),
    ("price_volume_corr", "price_volume_corr_{0}d", [(21,)]),
    ("volume_volatility", "volume_volatility_{0}d", [(21,)]),
    ("gap_reversal", "gap_reversal_{0}d", [(10,)]),
    ("streak_strength", "streak_strength", [(21,)]),
    ("return_autocorr", "return_autocorr_{1}d", [(21, 1), (21, 5)]),
    ("abs_return_momentum", "abs_return_{0}d", [(21,), (63,)]),
    ("market_beta", "market_beta_{0}d", [(21,), (63,), (126,)]),
    ("beta_instability", "beta_instability_{0}d", [(63,)]),
    ("idiosyncratic_vol", "idio_vol_{0}d", [(21,), (63,)]),
    ("sector_correlation", "sector_correlation_{0}d", [(21,), (63,)]),
    ("universe_dispersion", "universe_dispersion_{0}d", [(21,)]),
    ("amihud_illiquidity", "amihud_{0}d", [(21,), (63,)]),
    ("roll_spread", "roll_spread_{0}d", [(21,)]),
    ("kyle_lambda", "kyle_lambda_{0}d", [(21,)]),
    ("zero_return_fraction", "zero_return_days_{0}d", [(21,), (63,)]),
    ("turnover_rate", "turnover_rate_{0}d", [(21,)]),
    ("volatility_regime", "vol_regime", [(63,)]),
    ("adx_proxy", "trend_strength_{0}d", [(21,), (63,)]),
    ("correlation_spike", "correlation_spike_{0}d", [(21,)]),
    ("market_breadth", "breadth_{0}d", [(50,), (200,)]),
    ("momentum_sharpe", "mom_sharpe_{0}d", [(21,), (63,)]),
    ("drawdown_adjusted_momentum", "dd_adj_mom_{0}d", [(63,)]),
    ("vol_adjusted_momentum", "vol_adj_mom_{0}d", [(21,), (63,)]),
    ("efficiency_ratio", "efficiency_ratio_{0}d", [(21,), (63,)]),
    ("fractal_dimension", "fractal_dim_{0}d", [(63,)]),
]
#: value of a feature while the history is too short; types not listed start at 0
_SHORT = {
    "momentum_consistency": 0.5, "momentum_smoothness": 0.5, "rsi": 50.0, "vol_ratio": 1.0, "recovery_rate": 0.5,
    "up_down_capture": 1.0, "hurst_proxy": 0.5, "range_position": 0.5, "relative_strength": 0.5,
    "relative_volatility": 0.5, "volume_ratio": 1.0, "market_beta": 1.0, "volatility_regime": 0.5,
    "market_breadth": 0.5, "efficiency_ratio": 0.5, "fractal_dimension": 1.5,
}
#: value where the history is long enough but the ratio is undefined, when it differs
_SPARSE = {"up_down_capture": 0.0}
#: features that are bounded already and skip the rank transform
_UNRANKED_TYPES = {
    "relative_strength", "relative_volatility", "range_position", "high_proximity", "recovery_rate",
    "momentum_consistency", "hurst_proxy",
}
# ---- end of fixed values --------------------------------------------------------------


def _expand() -> dict[str, tuple]:
    out = {}
    for kind, pattern, params in _SPEC_ROWS:
        for i, p in enumerate(params):
            name = pattern[i] if isinstance(pattern, list) else pattern.format(*p)
            out[name] = (kind, *p)
    return out


SPECS: dict[str, tuple] = _expand()


def names_of(kind: str) -> list[str]:
    return [n for n, s in SPECS.items() if s[0] == kind]


# ---- rolling sums -----------------------------------------------------------------------
# A rolling sum is the difference of two running sums, so its cost does not depend on the
# window length.  Terms are named: "r" is a base column, "r*m" a product, "r|m" is r where m
# is present.  Builders record the terms they use; `compute` adds the running sums.

c = v = r = rn = m = wo = None
_used: set[str] = set()
_rolled: dict[str, tuple[str, int, str]] = {}


def _bind() -> None:
    """Columns need a running session, so the short names are bound when a plan is built."""
    global c, v, r, rn, m, wo
    c, v, r, rn, m = (F.col(x) for x in ("close", "volume", "r", "rn", "m"))
    wo = order_window()
    _used.clear()
    _rolled.clear()


def _base(name: str) -> Column:
    special = {
        "abs": lambda: F.abs(r),
        "up": lambda: (r + F.abs(r)) / 2,
        "down": lambda: (r - F.abs(r)) / 2,
        "excess": lambda: r - m,
        "signed": lambda: F.signum(r) * v,
        "illiquid": lambda: div(F.abs(r), c * v),
        "flat": lambda: (F.abs(r) < 1e-8).cast("double"),
        "r_bull": lambda: F.when(m > 0, r),
        "m_bull": lambda: F.when(m > 0, m),
        "r_bear": lambda: F.when(m < 0, r),
        "m_bear": lambda: F.when(m < 0, m),
    }
    return special[name]() if name in special else F.col(name)


def _term(name: str) -> Column:
    value, _, mask = name.partition("|")
    out = None
    for part in value.split("*"):
        out = _base(part) if out is None else out * _base(part)
    return F.when(_base(mask).isNotNull(), out) if mask else out


def _add_running_sums(df: DataFrame) -> DataFrame:
    w = so_far()
    cols = {}
    for name in sorted(_used):
        x = _term(name)
        cols[f"s:{name}"] = F.sum(nz(x)).over(w)
        cols[f"n:{name}"] = F.count(x).over(w)
    return df.withColumns(cols) if cols else df


def _diff(column: str, n: int, back: int) -> Column:
    col = F.col(f"`{column}`")
    end = _lag(col, back) if back else col
    return nz(end) - nz(_lag(col, n + back))


def _sum(name: str, n: int, back: int = 0) -> Column:
    """Sum of a term over n rows, ending `back` rows before the current one."""
    _used.add(name)
    return _diff(f"s:{name}", n, back)


def _count(name: str, n: int, back: int = 0) -> Column:
    _used.add(name)
    return _diff(f"n:{name}", n, back)


def _mean(name: str, n: int, back: int = 0) -> Column:
    return div(_sum(name, n, back), _count(name, n, back))


def _cov(a: str, b: str, n: int, back: int = 0) -> Column:
    k = _count(f"{a}*{b}", n, back)
    cross = _sum(f"{a}*{b}", n, back) - div(_sum(f"{a}|{b}", n, back) * _sum(f"{b}|{a}", n, back), k)
    return div(cross, k - 1)


def _var(a: str, n: int, back: int = 0, where: str | None = None) -> Column:
    mask = f"|{where}" if where else ""
    k = _count(f"{a}*{a}{mask}", n, back)
    s = _sum(f"{a}{mask}", n, back)
    return div(F.greatest(_sum(f"{a}*{a}{mask}", n, back) - div(s * s, k), F.lit(0.0)), k - 1)


def _sd(a: str, n: int, back: int = 0) -> Column:
    return F.sqrt(_var(a, n, back))


def _corr(a: str, b: str, n: int) -> Column:
    return safe_corr(_cov(a, b, n), _var(a, n, where=b), _var(b, n, where=a))


# ---- builders: type -> Column over the prepared frame ---------------------------------


def _lag(col: Column, k: int) -> Column:
    return F.lag(col, k).over(wo)


def _ret(p: int) -> Column:
    return div(c, _lag(c, p)) - 1


def _over(kind: str, p: int) -> Column:
    """A statistic of the last p closes that `compute` adds by rolling.with_windows."""
    _rolled[f"{kind}_{p}"] = (kind, p, "close")
    return F.col(f"{kind}_{p}")


def _autocorr(p: int, k: int) -> Column:
    return _corr("r", f"r_{k}", p - k)


def _consistency(p: int, q: int) -> Column:
    n = p // q
    hits = F.lit(0)
    for i in range(n):
        hits = hits + F.when(_sum("r", q, p - (i + 1) * q) > 0, 1).otherwise(0)
    return hits / n


def _central(p: int) -> tuple[Column, Column, Column, Column, Column]:
    """(n, mean, m2, m3, m4) central sums from raw sums; returns sit close to zero."""
    n = _count("r", p).cast("double")
    s1, s2, s3, s4 = (_sum("*".join(["r"] * i), p) for i in (1, 2, 3, 4))
    mu = div(s1, n)
    m2 = s2 - n * mu * mu
    m3 = s3 - 3 * mu * s2 + 2 * n * mu * mu * mu
    m4 = s4 - 4 * mu * s3 + 6 * mu * mu * s2 - 3 * n * mu * mu * mu * mu
    return n, mu, m2, m3, m4


def _moment3(p: int) -> Column:
    n, _, m2, m3, _ = _central(p)
    g1 = div(m3 / n, F.pow(m2 / n, 1.5))
    return F.when((n > 2) & (m2 > 0), g1 * F.sqrt(n * (n - 1)) / (n - 2))


def _moment4(p: int) -> Column:
    n, _, m2, _, m4 = _central(p)
    g2 = div(m4 / n, F.pow(m2 / n, 2)) - 3
    return F.when((n > 3) & (m2 > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def _capture(p: int) -> Column:
    return div(_mean("r_bull", p), _mean("m_bull", p)) - div(_mean("r_bear", p), _mean("m_bear", p))


def _range_pos(p: int) -> Column:
    lo, hi = F.min(c).over(last_n(p)), F.max(c).over(last_n(p))
    return div(c - lo, hi - lo)


def _hurst(p: int) -> Column:
    """Range of the cumulative return inside the window: the running sum differs by a constant."""
    _used.add("r")
    return F.log(F.coalesce(div(F.col(f"span_{p}"), _sd("r", p)), F.lit(1.0))) / math.log(p)


def _fractal(p: int) -> Column:
    return 1 + F.log(div(_sum("d1", p - 1), _sum("d2", p - 2) / 2)) / math.log(2)


def _beta(p: int) -> Column:
    return div(_cov("r", "m", p), _var("m", p, where="r"))


def _idio(p: int) -> Column:
    cov = _cov("r", "m", p)
    return F.sqrt(F.greatest(_var("r", p) - div(cov * cov, _var("m", p, where="r")), F.lit(0.0))) * ROOT_YEAR


def _half_volume(p: int) -> Column:
    h = p // 2
    return div(_mean("volume", p - h), _mean("volume", h, p - h)) - 1


def _roll(p: int) -> Column:
    return 2 * F.sqrt(F.greatest(-_sum("r*r_1", p - 1) / (p - 1), F.lit(0.0)))


class Clipped:
    """A raw value with its fill and bounds; bounds apply one level up so it is computed once."""

    def __init__(self, value: Column, lo: float, hi: float, fill: float | None = None):
        self.value, self.lo, self.hi, self.fill = value, lo, hi, fill


#: type -> (rows of history needed, Column)
_BUILD = {
    "momentum": lambda p: (p + 1, _ret(p)),
    "momentum_skip": lambda p, s: (p + s + 1, div(_lag(c, s), _lag(c, p + s)) - 1),
    "momentum_accel": lambda p, q: (q + 1, _ret(p) - _ret(q) * p / q),
    "momentum_consistency": lambda p, q: (p, _consistency(p, q)),
    "momentum_smoothness": lambda p: (p, Clipped(div(_ret(p - 1), _sum("abs", p)), -1, 1, 0)),
    "zscore": lambda p: (p, Clipped(_over("score", p), -4, 4)),
    "distance_from_ma": lambda p: (p, div(c, _mean("close", p)) - 1),
    "reversion_speed": lambda p: (2 * p, -_autocorr(p, 1)),
    "rsi": lambda p: (p + 1, 100 - 100 / (1 + div(_mean("up", p), -_mean("down", p)))),
    "volatility": lambda p: (p, _sd("r", p) * ROOT_YEAR),
    "vol_ratio": lambda p, q: (q, div(_sd("r", p), _sd("r", q))),
    "vol_of_vol": lambda p: (p, _sd("sd5", p)),
    "vol_trend": lambda p, q: (q, div(_sd("r", p), _sd("r", q - p, p)) - 1),
    "drawdown": lambda p: (p, div(c, F.max(c).over(last_n(p))) - 1),
    "drawdown_duration": lambda p: (p, _over("age", p) / p),
    "recovery_rate": lambda p: (p, _over("near", p) / p),
    "max_drawdown": lambda p: (p, F.col(f"dd_{p}")),
    "ulcer_index": lambda p: (p, -F.sqrt(_over("square", p) / p)),
    "skewness": lambda p: (p, Clipped(_moment3(p), -3, 3)),
    "kurtosis": lambda p: (p, Clipped(_moment4(p), -5, 10)),
    "downside_deviation": lambda p: (p, _sd("down", p) * ROOT_YEAR),
    "up_down_capture": lambda p: (p, _capture(p)),
    "left_tail": lambda p, q: (p, -F.percentile(r, q).over(last_n(p))),
    "trend_r2": lambda p: (p, _over("r2", p)),
    "trend_slope": lambda p: (p, div(_over("slope", p), _over("mean", p)) * p),
    "trend_deviation": lambda p: (p, div(c - _over("fit", p), _over("mean", p))),
    "hurst_proxy": lambda p: (p, Clipped(_hurst(p), 0, 1, 0.5)),
    "range_position": lambda p: (p, _range_pos(p)),
    "high_proximity": lambda p: (p, div(c, F.max(c).over(last_n(p)))),
    "breakout_strength": lambda p: (p + 1, Clipped(div(c, F.max(c).over(prior_n(p))) - 1, 0, 0.5)),
    "support_distance": lambda p: (p, div(c, F.min(c).over(last_n(p))) - 1),
    "resistance_distance": lambda p: (p, div(F.max(c).over(last_n(p)), c) - 1),
    "relative_strength": lambda p: (p + 1, F.col(f"rank_mom_{p}")),
    "relative_volatility": lambda p: (p, F.col(f"rank_sd_{p}")),
    "excess_momentum": lambda p: (p + 1, _ret(p) - F.col(f"mean_mom_{p}")),
    "relative_value": lambda p: (p, -(F.col(f"disc_{p}") - F.col(f"mean_disc_{p}"))),
    "sharpe_ratio": lambda p: (p, Clipped(div(_mean("r", p) * YEAR, _sd("r", p) * ROOT_YEAR), -3, 3)),
    "sortino_ratio": lambda p: (p, Clipped(div(_mean("r", p) * YEAR, _sd("down", p) * ROOT_YEAR), -5, 5)),
    "calmar_ratio": lambda p: (p, Clipped(div(F.pow(1 + _ret(p - 1), YEAR / p) - 1, F.abs(F.col(f"dd_{p}"))), -5, 5)),
    "information_ratio": lambda p: (p, Clipped(div(_mean("excess", p), _sd("excess", p)) * ROOT_YEAR, -3, 3)),
    "volume_trend": lambda p: (p, _half_volume(p)),
    "volume_ratio": lambda p, q: (q, div(_mean("volume", p), _mean("volume", q))),
    "price_volume_corr": lambda p: (p, _corr("r", "vr", p)),
    "volume_volatility": lambda p: (p, _sd("vr", p)),
    "gap_reversal": lambda p: (p + 1, F.col(f"reversal_{p}")),
    "streak_strength": lambda p: (p, F.signum(r) * F.least(rn - F.col("run_start") + 1, F.lit(p)) / p),
    "return_autocorr": lambda p, k: (p + k, _autocorr(p, k)),
    "abs_return_momentum": lambda p: (p, _mean("abs", p) * ROOT_YEAR),
    "market_beta": lambda p: (p + 1, _beta(p)),
    "beta_instability": lambda p: (p + 21, F.stddev_pop("beta21").over(last_n(p + 1))),
    "idiosyncratic_vol": lambda p: (p + 1, _idio(p)),
    "sector_correlation": lambda p: (p + 1, _corr("r", "m", p)),
    "universe_dispersion": lambda p: (p + 1, F.col(f"disp_{p}")),
    "amihud_illiquidity": lambda p: (p, _mean("illiquid", p)),
    "roll_spread": lambda p: (p + 1, _roll(p)),
    "kyle_lambda": lambda p: (p, F.abs(div(_cov("r", "signed", p), _var("signed", p)))),
    "zero_return_fraction": lambda p: (p + 1, _mean("flat", p)),
    "turnover_rate": lambda p: (p, div(_mean("volume", p), _mean("close", p))),
    "volatility_regime": lambda p: (YEAR, Clipped(div(_sd("r", p), _sd("r", YEAR)), 0, 3, 1)),
    "adx_proxy": lambda p: (p + 1, Clipped(div(F.abs(_sum("r", p)), _sum("abs", p)), 0, 1)),
    "correlation_spike": lambda p: (p + 63, F.col(f"spike_{p}")),
    "market_breadth": lambda p: (p, F.col(f"breadth_{p}")),
    "momentum_sharpe": lambda p: (p + 1, Clipped(div(_mean("r", p), _sd("r", p)), -3, 3)),
    "drawdown_adjusted_momentum": lambda p: (p, Clipped(div(_ret(p - 1), F.abs(F.col(f"dd_{p}"))), -5, 5)),
    "vol_adjusted_momentum": lambda p: (p + 1, Clipped(div(_ret(p), _sd("r", p) * ROOT_YEAR), -5, 5)),
    "efficiency_ratio": lambda p: (p + 1, Clipped(div(F.abs(c - _lag(c, p)), _sum("d1", p)), 0, 1, 0.5)),
    "fractal_dimension": lambda p: (p, Clipped(_fractal(p), 1, 2, 1.5)),
}


#: types that need nothing but the close and statistics of the last closes
_ROLLED_ONLY = {"zscore", "drawdown_duration", "recovery_rate", "ulcer_index", "trend_r2", "trend_slope", "trend_deviation"}


def register(kind: str, build, default: float = 0.0) -> None:
    """Add a feature type: build(*params) -> (rows needed, Column)."""
    _BUILD[kind] = build
    if default:
        _SHORT[kind] = default


# ---- intermediate columns -------------------------------------------------------------


def _add_drawdowns(df: DataFrame, periods: list[int]) -> DataFrame:
    """dd_<p>: worst fall from the running peak inside the last p rows.

    A block of rows is known by its highest and lowest close and its worst ratio; two neighbouring
    blocks combine, so blocks of 2, 4, 8 ... rows and their sums cost a lag each and no arrays.
    """
    parts = ("mx", "mn", "ws")
    names = lambda k: [f"{x}:{k}" for x in parts]

    def combine(old: list[Column], new: list[Column]) -> list[Column]:
        return [F.greatest(old[0], new[0]), F.least(old[1], new[1]), F.least(old[2], new[2], div(new[1], old[0]))]

    df = df.withColumns(dict(zip(names(1), (F.col("close"), F.col("close"), F.lit(1.0)))))
    k = 1
    while 2 * k <= max(periods):
        now = [F.col(f"`{n}`") for n in names(k)]
        df = df.withColumns(dict(zip(names(2 * k), combine([_lag(x, k) for x in now], now))))
        k *= 2
    for p in periods:
        acc, done = None, 0
        for b in (1 << i for i in reversed(range(p.bit_length())) if p >> i & 1):
            block = [F.col(f"`{n}`") for n in names(b)]
            block = [_lag(x, done) for x in block] if done else block
            acc, done = block if acc is None else combine(block, acc), done + b
        df = df.withColumn(f"dd_{p}", acc[2] - 1)
    return df.drop(*[c for c in df.columns if c.split(":")[0] in parts and ":" in c])


def _reversal(p: int) -> Column:
    arr, sd = F.collect_list("r").over(last_n(p)), F.stddev_samp("r").over(last_n(p))
    pairs = F.zip_with(
        F.slice(arr, 1, p - 1),
        F.slice(arr, 2, p - 1),
        lambda a, b: F.struct((F.abs(a) > sd * 2).alias("big"), (F.signum(a) != F.signum(b)).alias("turn")),
    )
    big = F.filter(pairs, lambda x: x["big"])
    return nz(div(F.size(F.filter(big, lambda x: x["turn"])), F.size(big)))


def mean_pair_correlation(df: DataFrame, n: int, out: str) -> DataFrame:
    """Average correlation over all ticker pairs of the last n rows, per date, without pairs.

    With z the returns standardised inside the window, the sum over pairs is half of
    (sum over rows of (sum of z over tickers)^2 / (n-1)) - tickers, so the work is linear in
    tickers.  Expects a dense grid (see mdq.operators.calendar.fill_grid).
    """
    w = last_n(n)
    z = (
        df.withColumn("rr", F.collect_list("r").over(w))
        .withColumn("mu", F.avg("r").over(w))
        .withColumn("sd", F.stddev_samp("r").over(w))
        .where((F.size("rr") == n) & (F.col("sd") > 0))
        .select("date", "mu", "sd", F.posexplode("rr").alias("pos", "x"))
    )
    rows = z.groupBy("date", "pos").agg(F.sum((F.col("x") - F.col("mu")) / F.col("sd")).alias("s"), F.count("*").alias("k"))
    total = rows.groupBy("date").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("k").alias("k"))
    return total.select("date", div(F.col("ss") / (n - 1) - F.col("k"), F.col("k") * (F.col("k") - 1)).alias(out))


def _prepare(df: DataFrame, specs: list[tuple]) -> DataFrame:
    kinds = {s[0] for s in specs}
    periods = lambda *ks: sorted({s[1] for s in specs if s[0] in ks})
    df = df.withColumns(
        {
            "rn": F.row_number().over(wo),
            "r": _ret(1),
            "vr": div(v, _lag(v, 1)) - 1,
            "d1": F.abs(c - _lag(c, 1)),
            "d2": F.abs(c - _lag(c, 2)),
        }
    )
    level: dict[str, Column] = {}
    lags = {1} if kinds & {"reversion_speed", "roll_spread"} else set()
    lags |= {s[2] for s in specs if s[0] == "return_autocorr"}
    for k in sorted(lags):
        level[f"r_{k}"] = _lag(r, k)
    if "vol_of_vol" in kinds:
        level["sd5"] = F.when(F.count(r).over(last_n(5)) == 5, F.stddev_samp(r).over(last_n(5)))
    for p in periods("gap_reversal"):
        level[f"reversal_{p}"] = _reversal(p)
    for p in periods("relative_strength", "excess_momentum"):
        level[f"mom_{p}"] = _ret(p)
    for p in periods("relative_volatility"):
        level[f"sd_{p}"] = F.when(rn >= p, F.stddev_samp(r).over(last_n(p)))
    for p in periods("relative_value"):
        level[f"disc_{p}"] = F.when(rn >= p, div(c, F.avg(c).over(last_n(p))) - 1)
    for p in periods("market_breadth"):
        level[f"above_{p}"] = F.when(rn >= p, (c > F.avg(c).over(last_n(p))).cast("double"))
    if "streak_strength" in kinds:
        level["turn"] = F.when(~nz((F.signum(r) == F.signum(_lag(r, 1))).cast("int"), 0).cast("boolean"), rn)
    if level:
        df = df.withColumns(level)
    if falls := periods("max_drawdown", "calmar_ratio", "drawdown_adjusted_momentum"):
        df = _add_drawdowns(df, falls)
    if "streak_strength" in kinds:
        df = df.withColumn("run_start", F.max("turn").over(so_far()))

    aggs = []
    if kinds & {"up_down_capture", "information_ratio", "market_beta", "beta_instability", "idiosyncratic_vol", "sector_correlation"}:
        aggs.append(F.avg("r").alias("m"))
    for p in periods("excess_momentum"):
        aggs.append(F.avg(f"mom_{p}").alias(f"mean_mom_{p}"))
    for p in periods("relative_value"):
        aggs.append(F.avg(f"disc_{p}").alias(f"mean_disc_{p}"))
    for p in periods("market_breadth"):
        aggs.append(F.avg(f"above_{p}").alias(f"breadth_{p}"))
    if aggs:
        df = by_group(df, "date", *aggs)
    if "beta_instability" in kinds:
        beta = div(F.covar_samp(r, m).over(last_n(21)), F.var_samp(m).over(last_n(21)))
        df = df.withColumn("beta21", nz(beta, 1.0))
    for p in periods("universe_dispersion"):
        # one row per date: bounded by the calendar
        days = df.groupBy("date").agg(F.stddev_samp("r").alias("disp"))
        days = days.select("date", F.avg("disp").over(Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(-(p - 1), 0)).alias(f"disp_{p}"))
        df = df.join(days, "date", "left")
    for p in periods("correlation_spike"):
        spike = mean_pair_correlation(df, p, "near").join(mean_pair_correlation(df, 63, "far"), "date")
        df = df.join(spike.select("date", (F.col("near") - F.col("far")).alias(f"spike_{p}")), "date", "left")
    ranks = {f"mom_{p}": f"rank_mom_{p}" for p in periods("relative_strength")}
    ranks |= {f"sd_{p}": f"rank_sd_{p}" for p in periods("relative_volatility")}
    if ranks:
        df = pct_ranks(df, ranks, ["ticker", "date"])
    return df


def compute(df: DataFrame, names: Iterable[str], specs: dict[str, tuple] | None = None, execution_lag: int = 0) -> DataFrame:
    """(ticker, date, <names>) for every row; execution_lag > 0 gives the value known that many rows earlier."""
    specs = {**SPECS, **(specs or {})}
    _bind()
    names = list(names)
    raw, final = {}, []
    for n in names:
        kind, *params = specs[n]
        need, value = _BUILD[kind](*params)
        default = _SHORT.get(kind, 0.0)
        x = F.col(f"raw_{n}")
        if isinstance(value, Clipped):
            raw[f"raw_{n}"] = value.value
            fill = nz(x, default if value.fill is None else value.fill)
            known = F.least(F.greatest(fill, F.lit(float(value.lo))), F.lit(float(value.hi)))
        else:
            raw[f"raw_{n}"] = value
            known = nz(x, _SPARSE.get(kind, default))
        final.append(F.when(rn < need, F.lit(default)).otherwise(known).alias(n))
    if _rolled and {specs[n][0] for n in names} <= _ROLLED_ONLY:
        ready = with_windows(df.select("ticker", "date", "close"), _rolled)
        return _finished(ready, raw, final, names, execution_lag)
    ready = _prepare(df, [specs[n] for n in names])
    ready = _add_running_sums(ready)
    for p in sorted({specs[n][1] for n in names if specs[n][0] == "hurst_proxy"}):
        run = F.when(r.isNotNull(), F.col("`s:r`"))
        ready = ready.withColumn(f"span_{p}", F.max(run).over(last_n(p)) - F.min(run).over(last_n(p)))
    if _rolled:
        ready = with_windows(ready, _rolled)
    return _finished(ready, raw, final, names, execution_lag)


def _finished(ready: DataFrame, raw: dict[str, Column], final: list[Column], names: list[str], execution_lag: int) -> DataFrame:
    out = ready.withColumns(raw).select("ticker", "date", *final)
    if execution_lag:
        out = out.select("ticker", "date", *[F.lag(n, execution_lag).over(order_window()).alias(n) for n in names])
    return out


def rank_transform(features: DataFrame, names: Iterable[str]) -> DataFrame:
    """Long form (date, feature, ticker, value, rank): all features in one distributed rank."""
    names = list(names)
    kept = [n for n in names if SPECS.get(n, ("",))[0] in _UNRANKED_TYPES]
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])
    long = features.select("ticker", "date", F.explode(pairs).alias("p")).select("ticker", "date", "p.feature", "p.value")
    ranked = pct_rank(long, "value", "pct", by=["date", "feature"])
    return ranked.withColumn("pct", F.when(F.col("feature").isin(kept), F.col("value")).otherwise(F.col("pct")))


def all_features(df: DataFrame, execution_lag: int = 1, batch: int = 16) -> DataFrame:
    """The default library in one wide frame, built in batches.

    A single select of the whole library would be one very large plan; each batch is cut and
    the batches meet in joins on (ticker, date).  Pair correlation needs a dense grid and is
    left to `compute` on such a grid.
    """
    names = [n for n, s in SPECS.items() if s[0] != "correlation_spike"]
    out = None
    for i in range(0, len(names), batch):
        part = cut_lineage(compute(df, names[i : i + batch], execution_lag=execution_lag))
        out = part if out is None else out.join(part, ["ticker", "date"])
    return out


#: feature-name prefixes of each category, first match wins (fixed values)
CATEGORIES = [
    ("engineered", ["mom_sharpe", "dd_adj", "vol_adj", "efficiency", "fractal"]),
    ("regime", ["vol_regime", "trend_strength", "correlation_spike", "breadth"]),
    ("momentum", ["mom_"]),
    ("mean_reversion", ["zscore", "dist_ma", "reversion", "rsi"]),
    ("volatility", ["vol_"]),
    ("drawdown", ["drawdown", "recovery", "max_dd", "ulcer"]),
    ("higher_moments", ["skew", "kurt", "downside", "up_down", "left_tail"]),
    ("trend", ["trend_", "hurst"]),
    ("price_level", ["range", "high_prox", "breakout", "support", "resistance"]),
    ("cross_sectional", ["rel_", "excess"]),
    ("risk_adjusted", ["sharpe", "sortino", "calmar", "info_ratio"]),
    ("volume", ["volume", "price_volume"]),
    ("market_relative", ["market_beta", "beta_instability", "idio_vol", "sector_corr", "universe_disp"]),
    ("microstructure", ["amihud", "roll_spread", "kyle_lambda", "zero_return", "turnover_rate"]),
]


def category(name: Column) -> Column:
    out = None
    for label, prefixes in CATEGORIES:
        cond = F.lit(False)
        for p in prefixes:
            cond = cond | name.startswith(p)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise("pattern")
