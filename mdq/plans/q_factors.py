"""One registered query per feature type, with an independently written SQL form."""

from __future__ import annotations

from ..functions.core import tidy
from ..operators import factors
from .inputs import daily, grid
from .registry import cte, query, rounded

cte(
    "fx0",
    """SELECT *, row_number() OVER o AS rn, close / lag(close) OVER o - 1 AS r,
 volume / nullif(lag(volume) OVER o, 0) - 1 AS vr, abs(close - lag(close) OVER o) AS d1
 FROM daily WINDOW o AS (PARTITION BY ticker ORDER BY date)""",
)
cte("fx", "SELECT f.*, m.m, m.disp FROM fx0 f JOIN (SELECT date, avg(r) AS m, stddev_samp(r) AS disp FROM fx0 GROUP BY date) m USING (date)")

O = "OVER (PARTITION BY ticker ORDER BY date)"


def W(n: int, back: int = 0) -> str:
    """The n rows ending `back` rows before the current one."""
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1 + back} PRECEDING AND {f'{back} PRECEDING' if back else 'CURRENT ROW'})"


def lagc(k: int) -> str:
    return f"lag(close, {k}) {O}"


def clipped(x: str, lo, hi) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def mdd(p: int) -> str:
    """Worst drawdown of a window by a list reduction over (peak, worst) pairs."""
    return f"""list_reduce(list_transform(list(close) {W(p)}, lambda x: {{'pk': x, 'dd': 0.0::DOUBLE}}),
 lambda a, b: {{'pk': greatest(a.pk, b.pk), 'dd': least(a.dd, b.pk / greatest(a.pk, b.pk) - 1)}}).dd"""


def ddlist(p: int) -> str:
    """Drawdowns against the running peak as a list."""
    return f"list_transform(range(1, len(list(close) {W(p)}) + 1), lambda i: (list(close) {W(p)})[i] / list_max((list(close) {W(p)})[1:i]) - 1)"


def beta(p: int) -> str:
    return f"covar_samp(r, m) {W(p)} / nullif(var_samp(m) {W(p)}, 0)"


def corr(a: str, b: str, w: str) -> str:
    a2, b2 = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"covar_samp({a}, {b}) {w} / nullif(stddev_samp({a2}) {w} * stddev_samp({b2}) {w}, 0)"


# type -> function(params) -> (rows needed, default, expression)
FORMS = {
    "momentum": lambda p: (p + 1, 0, f"close / {lagc(p)} - 1"),
    "momentum_skip": lambda p, s: (p + s + 1, 0, f"{lagc(s)} / {lagc(p + s)} - 1"),
    "momentum_accel": lambda p, q: (q + 1, 0, f"close / {lagc(p)} - 1 - (close / {lagc(q)} - 1) * {p} / {q}"),
    "momentum_consistency": lambda p, q: (
        p, 0.5, "(" + " + ".join(f"CASE WHEN sum(r) {W(q, p - (i + 1) * q)} > 0 THEN 1 ELSE 0 END" for i in range(p // q)) + f") / {float(p // q)}"),
    "momentum_smoothness": lambda p: (p, 0.5, clipped(f"coalesce((close / {lagc(p - 1)} - 1) / nullif(sum(abs(r)) {W(p)}, 0), 0)", -1, 1)),
    "zscore": lambda p: (p, 0, clipped(f"coalesce((close - avg(close) {W(p)}) / nullif(stddev_samp(close) {W(p)}, 0), 0)", -4, 4)),
    "distance_from_ma": lambda p: (p, 0, f"close / avg(close) {W(p)} - 1"),
    "reversion_speed": lambda p: (2 * p, 0, f"-{corr('r', 'r1', W(p - 1))}"),
    "rsi": lambda p: (p + 1, 50, f"100 - 100 / (1 + avg(greatest(r, 0)) {W(p)} / nullif(-avg(least(r, 0)) {W(p)}, 0))"),
    "volatility": lambda p: (p, 0, f"stddev_samp(r) {W(p)} * sqrt(252)"),
    "vol_ratio": lambda p, q: (q, 1, f"stddev_samp(r) {W(p)} / nullif(stddev_samp(r) {W(q)}, 0)"),
    "vol_of_vol": lambda p: (p, 0, f"stddev_samp(sd5) {W(p)}"),
    "vol_trend": lambda p, q: (q, 0, f"stddev_samp(r) {W(p)} / nullif(stddev_samp(r) {W(q - p, p)}, 0) - 1"),
    "drawdown": lambda p: (p, 0, f"(close - max(close) {W(p)}) / max(close) {W(p)}"),
    "drawdown_duration": lambda p: (p, 0, f"(rn - max(CASE WHEN TRUE THEN rn END) FILTER (close >= 0) {W(p)}) / {p}.0"),
    "recovery_rate": lambda p: (p, 0.5, f"len(list_filter({ddlist(p)}, lambda d: d > -0.05)) / {p}.0"),
    "max_drawdown": lambda p: (p, 0, mdd(p)),
    "ulcer_index": lambda p: (p, 0, f"-sqrt(list_avg(list_transform({ddlist(p)}, lambda d: d * d)))"),
    "skewness": lambda p: (p, 0, clipped(f"skewness(r) {W(p)}", -3, 3)),
    "kurtosis": lambda p: (p, 0, clipped(f"kurtosis(r) {W(p)}", -5, 10)),
    "downside_deviation": lambda p: (p, 0, f"stddev_samp((r - abs(r)) / 2) {W(p)} * sqrt(252)"),
    "up_down_capture": lambda p: (
        p, 1, f"CASE WHEN rn < {p} THEN 1 ELSE coalesce(avg(r) FILTER (m > 0) {W(p)} / avg(m) FILTER (m > 0) {W(p)} - avg(r) FILTER (m < 0) {W(p)} / avg(m) FILTER (m < 0) {W(p)}, 0) END"),
    "left_tail": lambda p, q: (p, 0, f"-quantile_cont(r, {q}) {W(p)}"),
    "trend_r2": lambda p: (p, 0, f"({corr('close', 'rn', W(p))}) ** 2"),
    "trend_slope": lambda p: (p, 0, f"regr_slope(close, rn) {W(p)} / avg(close) {W(p)} * {p}"),
    "trend_deviation": lambda p: (p, 0, f"(close - regr_slope(close, rn) {W(p)} * rn - regr_intercept(close, rn) {W(p)}) / avg(close) {W(p)}"),
    "hurst_proxy": lambda p: (
        p, 0.5, clipped(f"ln((list_max(cums) - list_min(cums)) / nullif(sdp, 0)) / ln({p})", 0, 1)),
    "range_position": lambda p: (p, 0.5, f"(close - min(close) {W(p)}) / nullif(max(close) {W(p)} - min(close) {W(p)}, 0)"),
    "high_proximity": lambda p: (p, 0, f"close / max(close) {W(p)}"),
    "breakout_strength": lambda p: (p + 1, 0, clipped(f"close / max(close) {W(p, 1)} - 1", 0, 0.5)),
    "support_distance": lambda p: (p, 0, f"close / min(close) {W(p)} - 1"),
    "resistance_distance": lambda p: (p, 0, f"max(close) {W(p)} / close - 1"),
    "sharpe_ratio": lambda p: (p, 0, clipped(f"coalesce(avg(r) {W(p)} * 252 / nullif(stddev_samp(r) {W(p)} * sqrt(252), 0), 0)", -3, 3)),
    "sortino_ratio": lambda p: (p, 0, clipped(f"coalesce(avg(r) {W(p)} * 252 / nullif(stddev_samp((r - abs(r)) / 2) {W(p)} * sqrt(252), 0), 0)", -5, 5)),
    "calmar_ratio": lambda p: (p, 0, clipped(f"coalesce((pow(close / {lagc(p - 1)}, 252 / {p}.0) - 1) / nullif(abs({mdd(p)}), 0), 0)", -5, 5)),
    "information_ratio": lambda p: (p, 0, clipped(f"coalesce(avg(r - m) {W(p)} / nullif(stddev_samp(r - m) {W(p)}, 0) * sqrt(252), 0)", -3, 3)),
    "volume_trend": lambda p: (p, 0, f"avg(volume) {W(p - p // 2)} / nullif(avg(volume) {W(p // 2, p - p // 2)}, 0) - 1"),
    "volume_ratio": lambda p, q: (q, 1, f"avg(volume) {W(p)} / nullif(avg(volume) {W(q)}, 0)"),
    "price_volume_corr": lambda p: (p, 0, corr("r", "vr", W(p))),
    "volume_volatility": lambda p: (p, 0, f"stddev_samp(vr) {W(p)}"),
    "gap_reversal": lambda p: (
        p + 1, 0, f"""coalesce(len(list_filter(range(1, {p}), lambda i: abs(l[i]) > 2 * sdp AND sign(l[i]) <> sign(l[i + 1])))
 / nullif(len(list_filter(range(1, {p}), lambda i: abs(l[i]) > 2 * sdp)), 0)::DOUBLE, 0)"""),
    "streak_strength": lambda p: (p, 0, f"sign(r) * least(count(*) OVER (PARTITION BY ticker, island ORDER BY date), {p}) / {p}.0"),
    "return_autocorr": lambda p, k: (p + k, 0, corr("r", f"r{k}", W(p - k))),
    "abs_return_momentum": lambda p: (p, 0, f"avg(abs(r)) {W(p)} * sqrt(252)"),
    "market_beta": lambda p: (p + 1, 1, f"coalesce({beta(p)}, 1)"),
    "beta_instability": lambda p: (p + 21, 0, f"stddev_pop(b21) {W(p + 1)}"),
    "idiosyncratic_vol": lambda p: (p + 1, 0, f"sqrt(greatest(var_samp(r) {W(p)} - (covar_samp(r, m) {W(p)}) ** 2 / nullif(var_samp(m) {W(p)}, 0), 0)) * sqrt(252)"),
    "sector_correlation": lambda p: (p + 1, 0, corr("r", "m", W(p))),
    "amihud_illiquidity": lambda p: (p, 0, f"avg(abs(r) / nullif(close * volume, 0)) {W(p)}"),
    "roll_spread": lambda p: (p + 1, 0, f"2 * sqrt(greatest(-(sum(r * r1) {W(p - 1)}) / {p - 1}, 0))"),
    "kyle_lambda": lambda p: (p, 0, f"abs(covar_samp(r, sign(r) * volume) {W(p)} / nullif(var_samp(sign(r) * volume) {W(p)}, 0))"),
    "zero_return_fraction": lambda p: (p + 1, 0, f"avg(CASE WHEN abs(r) < 1e-8 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) {W(p)}"),
    "turnover_rate": lambda p: (p, 0, f"avg(volume) {W(p)} / avg(close) {W(p)}"),
    "volatility_regime": lambda p: (252, 0.5, clipped(f"coalesce(stddev_samp(r) {W(p)} / nullif(stddev_samp(r) {W(252)}, 0), 1)", 0, 3)),
    "adx_proxy": lambda p: (p + 1, 0, f"abs(sum(r) {W(p)}) / nullif(sum(abs(r)) {W(p)}, 0)"),
    "momentum_sharpe": lambda p: (p + 1, 0, clipped(f"coalesce(avg(r) {W(p)} / nullif(stddev_samp(r) {W(p)}, 0), 0)", -3, 3)),
    "drawdown_adjusted_momentum": lambda p: (p, 0, clipped(f"coalesce((close / {lagc(p - 1)} - 1) / nullif(abs({mdd(p)}), 0), 0)", -5, 5)),
    "vol_adjusted_momentum": lambda p: (p + 1, 0, clipped(f"coalesce((close / {lagc(p)} - 1) / nullif(stddev_samp(r) {W(p)} * sqrt(252), 0), 0)", -5, 5)),
    "efficiency_ratio": lambda p: (p + 1, 0.5, f"abs(close - {lagc(p)}) / nullif(sum(d1) {W(p)}, 0)"),
    "fractal_dimension": lambda p: (
        p, 1.5, clipped(f"1 + log2(sum(d1) {W(p - 1)} / nullif(sum(d2) {W(p - 2)} / 2, 0))", 1, 2)),
}

# frames that some forms need in addition to fx
SOURCES = {
    "reversion_speed": f"(SELECT *, lag(r) {O} AS r1 FROM fx)",
    "roll_spread": f"(SELECT *, lag(r) {O} AS r1 FROM fx)",
    "return_autocorr": f"(SELECT *, lag(r) {O} AS r1, lag(r, 5) {O} AS r5 FROM fx)",
    "vol_of_vol": f"(SELECT *, CASE WHEN count(r) {W(5)} = 5 THEN stddev_samp(r) {W(5)} END AS sd5 FROM fx)",
    "beta_instability": f"(SELECT *, coalesce({beta(21)}, 1) AS b21 FROM fx)",
    "fractal_dimension": f"(SELECT *, abs(close - lag(close, 2) {O}) AS d2 FROM fx)",
    "gap_reversal": f"(SELECT *, list(r) {W(10)} AS l, stddev_samp(r) {W(10)} AS sdp FROM fx)",
    "streak_strength": f"""(SELECT *, sum(chg) {O} AS island FROM (
 SELECT *, CASE WHEN sign(r) = sign(lag(r) {O}) THEN 0 ELSE 1 END AS chg FROM fx))""",
}


DIGITS = {"amihud_illiquidity": 12, "kyle_lambda": 9, "rsi": 4}


def _sql(kind: str) -> str:
    names = factors.names_of(kind)
    digits = DIGITS.get(kind, 6)
    parts = []
    for n in names:
        need, default, expr = FORMS[kind](*factors.SPECS[n][1:])
        parts.append(f"CASE WHEN rn < {need} THEN {default} ELSE coalesce({expr}, {default}) END AS {n}")
    body = f"SELECT ticker, date, {', '.join(parts)} FROM {SOURCES.get(kind, 'fx')}"
    return rounded("ticker date", names, body, digits)


def _special(kind: str) -> str | None:
    names = factors.names_of(kind)
    if kind in ("relative_strength", "relative_volatility", "excess_momentum", "relative_value"):
        parts, cols = [], []
        for n in names:
            p = factors.SPECS[n][1]
            base = {
                "relative_strength": f"CASE WHEN rn > {p} THEN close / {lagc(p)} - 1 END",
                "excess_momentum": f"CASE WHEN rn > {p} THEN close / {lagc(p)} - 1 END",
                "relative_volatility": f"CASE WHEN rn >= {p} THEN stddev_samp(r) {W(p)} END",
                "relative_value": f"CASE WHEN rn >= {p} THEN close / avg(close) {W(p)} - 1 END",
            }[kind]
            parts.append(f"{base} AS x{p}")
            x = f"x{p}"
            cols.append({
                "excess_momentum": f"coalesce({x} - avg({x}) OVER (PARTITION BY date), 0)",
                "relative_value": f"coalesce(avg({x}) OVER (PARTITION BY date) - {x}, 0)",
            }.get(kind, f"""CASE WHEN {x} IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST)
 + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / nullif(count({x}) OVER (PARTITION BY date), 0) END""") + f" AS {n}")
        return rounded("ticker date", names, f"SELECT ticker, date, {', '.join(cols)} FROM (SELECT *, {', '.join(parts)} FROM fx)")
    if kind == "drawdown_duration":
        cols = []
        for n in names:
            p = factors.SPECS[n][1]
            cols.append(f"CASE WHEN rn < {p} THEN 0 ELSE (rn - arg_max(rn, close * 100000 + rn / 100000.0) {W(p)}) / {p}.0 END AS {n}")
        return rounded("ticker date", names, f"SELECT ticker, date, {', '.join(cols)} FROM fx")
    if kind == "hurst_proxy":
        inner = ", ".join(f"list(r) {W(p)} AS l{p}, stddev_samp(r) {W(p)} AS s{p}" for p in (63, 126))
        cums = ", ".join(f"list_transform(range(1, len(l{p}) + 1), lambda i: list_sum(l{p}[1:i])) AS cums{p}" for p in (63, 126))
        cols = ", ".join(
            f"CASE WHEN rn < {p} THEN 0.5 ELSE " + clipped(f"ln((list_max(cums{p}) - list_min(cums{p})) / nullif(s{p}, 0)) / ln({p})", 0, 1) + f" END AS hurst_proxy_{p}d"
            for p in (63, 126))
        return rounded("ticker date", names, f"SELECT ticker, date, {cols} FROM (SELECT *, {cums} FROM (SELECT *, {inner} FROM fx))")
    if kind in ("recovery_rate", "ulcer_index"):
        ps = [factors.SPECS[n][1] for n in names]
        inner = ", ".join(f"list(close) {W(p)} AS l{p}" for p in ps)
        dds = ", ".join(f"list_transform(range(1, len(l{p}) + 1), lambda i: l{p}[i] / list_max(l{p}[1:i]) - 1) AS dd{p}" for p in ps)
        form = {
            "recovery_rate": "CASE WHEN rn < {p} THEN 0.5 ELSE len(list_filter(dd{p}, lambda d: d > -0.05)) / {p}.0 END",
            "ulcer_index": "CASE WHEN rn < {p} THEN 0 ELSE -sqrt(list_avg(list_transform(dd{p}, lambda d: d * d))) END",
        }[kind]
        cols = ", ".join(form.format(p=p) + f" AS {n}" for p, n in zip(ps, names))
        return rounded("ticker date", names, f"SELECT ticker, date, {cols} FROM (SELECT *, {dds} FROM (SELECT *, {inner} FROM fx))")
    if kind == "universe_dispersion":
        return rounded("ticker date", names, """SELECT ticker, date, CASE WHEN rn < 22 THEN 0 ELSE coalesce(d, 0) END AS universe_dispersion_21d
 FROM fx JOIN (SELECT date, avg(disp) OVER (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS d
 FROM (SELECT DISTINCT date, disp FROM fx)) USING (date)""")
    if kind == "market_breadth":
        cols = ", ".join(f"CASE WHEN rn < {p} THEN 0.5 ELSE avg(a{p}) OVER (PARTITION BY date) END AS breadth_{p}d" for p in (50, 200))
        inner = ", ".join(f"CASE WHEN rn >= {p} THEN CASE WHEN close > avg(close) {W(p)} THEN 1.0 ELSE 0.0 END END AS a{p}" for p in (50, 200))
        return rounded("ticker date", names, f"SELECT ticker, date, {cols} FROM (SELECT *, {inner} FROM fx)")
    return None


cte(
    "grid",
    """SELECT t.ticker, d.date, last_value(p.close IGNORE NULLS) OVER g AS close, last_value(p.volume IGNORE NULLS) OVER g AS volume
 FROM (SELECT ticker, min(date) AS lo FROM panel GROUP BY 1) t JOIN (SELECT DISTINCT date FROM panel) d ON d.date >= t.lo
 LEFT JOIN panel p ON p.ticker = t.ticker AND p.date = d.date
 WINDOW g AS (PARTITION BY t.ticker ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
cte("gridr", f"SELECT *, row_number() {O} AS rn, close / lag(close) {O} - 1 AS r FROM grid")


def _register(kind: str) -> None:
    names = factors.names_of(kind)
    digits = DIGITS.get(kind, 6)

    @query(f"factor_{kind}", _special(kind) or _sql(kind))
    def run(spark, sf_dir):
        return tidy(factors.compute(daily(spark, sf_dir), names), ["ticker", "date"], names, digits)


for _kind in dict.fromkeys(s[0] for s in factors.SPECS.values()):
    if _kind != "correlation_spike":
        _register(_kind)


cte("grid_pairs", "SELECT a.ticker AS a, b.ticker AS b, a.date, a.r AS x, b.r AS y FROM gridr a JOIN gridr b ON a.date = b.date AND a.ticker < b.ticker", kept=True)


def _pair_corr(p: int) -> str:
    """Mean correlation over all pairs per date, of the tickers whose last p returns are known and not all the same."""
    return f"""SELECT date, avg(cov / (sx * sy)) AS c{p} FROM (SELECT date, count(x) OVER w AS nx, count(y) OVER w AS ny, stddev_samp(x) OVER w AS sx, stddev_samp(y) OVER w AS sy, covar_samp(x, y) OVER w AS cov
 FROM grid_pairs WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)) WHERE nx = {p} AND ny = {p} AND sx > 0 AND sy > 0 GROUP BY 1"""


@query(
    "factor_correlation_spike",
    rounded(
        "ticker date",
        ["correlation_spike_21d"],
        f"""SELECT ticker, date, CASE WHEN rn < 84 THEN 0 ELSE coalesce(c21 - c63, 0) END AS correlation_spike_21d FROM gridr
 LEFT JOIN ({_pair_corr(21)}) USING (date) LEFT JOIN ({_pair_corr(63)}) USING (date)""",
    ),
)
def correlation_spike(spark, sf_dir):
    names = ["correlation_spike_21d"]
    return tidy(factors.compute(grid(spark, sf_dir), names), ["ticker", "date"], names)
