"""Registered queries over bars: indicators and candle patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import tidy
from ..operators import intraday, patterns
from .inputs import bars, once
from .registry import cte, query, rounded

T = "PARTITION BY ticker ORDER BY ts"
D = "PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts"
TP = "(high + low + close) / 3"


def B(n: int, back: int = 0) -> str:
    return f"OVER ({T} ROWS BETWEEN {n - 1 + back} PRECEDING AND {f'{back} PRECEDING' if back else 'CURRENT ROW'})"


cte("bi", f"SELECT *, row_number() OVER ({T}) AS idx, CAST(ts AS DATE) AS day FROM bars")
_VWAP = f"sum({TP} * volume) OVER ({D}) / nullif(sum(volume) OVER ({D}), 0)"


@query("intraday_vwap", rounded("ticker ts", "vwap total_vwap", f"SELECT ticker, ts, {_VWAP} AS vwap, sum({TP} * volume) OVER ({T}) / sum(volume) OVER ({T}) AS total_vwap FROM bars"))
def q_vwap(spark, sf_dir):
    return tidy(intraday.vwap(intraday.vwap(bars(spark, sf_dir)), False, "total_vwap"), ["ticker", "ts"], ["vwap", "total_vwap"])


@query("intraday_vwap_bands", rounded("ticker ts", "upper lower", f"""SELECT ticker, ts, vwap + 2 * sd AS upper, vwap - 2 * sd AS lower FROM (
 SELECT *, sqrt(sum(({TP} - vwap) ** 2 * volume) OVER ({D}) / sum(volume) OVER ({D})) AS sd FROM (SELECT *, {_VWAP} AS vwap FROM bars))"""))
def q_bands(spark, sf_dir):
    return tidy(intraday.vwap_bands(bars(spark, sf_dir)), ["ticker", "ts"], ["upper", "lower"])


_IMB = "coalesce(((close - low) / nullif(high - low, 0) - 0.5) * 2, 0)"


@query("intraday_order_flow", rounded("ticker ts", "imbalance weighted_imbalance", f"""SELECT ticker, ts, imbalance,
 CASE WHEN count(*) {B(20)} = 20 THEN sum(imbalance * volume) {B(20)} / sum(volume) {B(20)} END AS weighted_imbalance FROM (SELECT *, {_IMB} AS imbalance FROM bars)"""))
def q_flow(spark, sf_dir):
    return tidy(intraday.order_flow(bars(spark, sf_dir)), ["ticker", "ts"], ["imbalance", "weighted_imbalance"])


@query("intraday_volume_spike", f"SELECT ticker, ts, CASE WHEN count(*) {B(20)} = 20 AND volume > 3 * avg(volume) {B(20)} THEN 1 ELSE 0 END AS spike FROM bars")
def q_spike(spark, sf_dir):
    return intraday.volume_spike(bars(spark, sf_dir)).select("ticker", "ts", "spike")


@query("intraday_divergence", f"""SELECT ticker, ts, CASE WHEN dp < -0.02 AND dv > 0.5 THEN 1 WHEN dp > 0.02 AND dv < -0.3 THEN -1 ELSE 0 END AS divergence FROM (
 SELECT *, close / lag(close, 5) OVER ({T}) - 1 AS dp, volume / nullif(lag(volume, 5) OVER ({T}), 0) - 1 AS dv FROM bars)""")
def q_divergence(spark, sf_dir):
    return intraday.divergence(bars(spark, sf_dir)).select("ticker", "ts", "divergence")


@query("intraday_momentum", rounded("ticker ts", "mom_5 mom_10 mom_20", "SELECT ticker, ts, " + ", ".join(f"close / lag(close, {p}) OVER ({T}) - 1 AS mom_{p}" for p in (5, 10, 20)) + " FROM bars"))
def q_momentum(spark, sf_dir):
    return tidy(intraday.momentum(bars(spark, sf_dir)), ["ticker", "ts"], ["mom_5", "mom_10", "mom_20"])


@query("intraday_rsi", rounded("ticker ts", "rsi", f"""SELECT ticker, ts, CASE WHEN count(*) {B(14)} = 14 THEN
 CASE WHEN avg(l) {B(14)} = 0 THEN CASE WHEN avg(g) {B(14)} > 0 THEN 100 END ELSE 100 - 100 / (1 + avg(g) {B(14)} / nullif(avg(l) {B(14)}, 0)) END END AS rsi FROM (
 SELECT *, greatest(coalesce(d, 0), 0) AS g, greatest(coalesce(-d, 0), 0) AS l FROM (SELECT *, close - lag(close) OVER ({T}) AS d FROM bars))""", 5))
def q_rsi(spark, sf_dir):
    return tidy(intraday.rsi(bars(spark, sf_dir)), ["ticker", "ts"], ["rsi"], 5)


# recursive averages: one recursion step per row in SQL
cte(
    "macd1",
    """SELECT ticker, idx, close AS nf, close AS ns, 1.0::DOUBLE AS df, 1.0::DOUBLE AS ds FROM bi WHERE idx = 1
 UNION ALL SELECT b.ticker, b.idx, b.close + nf * 11 / 13, b.close + ns * 25 / 27, 1 + df * 11 / 13, 1 + ds * 25 / 27 FROM macd1 m JOIN bi b ON b.ticker = m.ticker AND b.idx = m.idx + 1""",
)
cte("macd2", "SELECT ticker, idx, nf / df - ns / ds AS macd FROM macd1")
cte(
    "macd3",
    """SELECT ticker, idx, macd, macd AS n, 1.0::DOUBLE AS d FROM macd2 WHERE idx = 1
 UNION ALL SELECT b.ticker, b.idx, b.macd, b.macd + n * 0.8, 1 + d * 0.8 FROM macd3 m JOIN macd2 b ON b.ticker = m.ticker AND b.idx = m.idx + 1""",
)
cte(
    "wild0",
    f"""SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN u > d AND u > 0 THEN u ELSE 0 END AS up, CASE WHEN d > u AND d > 0 THEN d ELSE 0 END AS dn
 FROM (SELECT *, lag(close) OVER ({T}) AS pc, high - lag(high) OVER ({T}) AS u, lag(low) OVER ({T}) - low AS d FROM bi)""",
)
cte(
    "wild1",
    """SELECT ticker, idx, tr AS atr, up::DOUBLE AS us, dn::DOUBLE AS dns FROM wild0 WHERE idx = 1
 UNION ALL SELECT b.ticker, b.idx, b.tr / 14 + atr * 13 / 14, b.up / 14 + us * 13 / 14, b.dn / 14 + dns * 13 / 14 FROM wild1 m JOIN wild0 b ON b.ticker = m.ticker AND b.idx = m.idx + 1""",
)
cte("wild2", "SELECT ticker, idx, atr, 100 * us / nullif(atr, 0) AS p, 100 * dns / nullif(atr, 0) AS m FROM wild1")
cte("wild3", "SELECT *, coalesce(100 * abs(p - m) / nullif(p + m, 0), 0) AS dx FROM wild2")
cte(
    "adxs",
    """SELECT ticker, idx, atr, dx AS adx FROM wild3 WHERE idx = 1
 UNION ALL SELECT b.ticker, b.idx, b.atr, b.dx / 14 + a.adx * 13 / 14 FROM adxs a JOIN wild3 b ON b.ticker = a.ticker AND b.idx = a.idx + 1""",
)


@query("intraday_macd", rounded("ticker ts", "macd signal histogram", "SELECT ticker, ts, m.macd, n / d AS signal, m.macd - n / d AS histogram FROM macd3 m JOIN bi USING (ticker, idx)"))
def q_macd(spark, sf_dir):
    return tidy(intraday.macd(bars(spark, sf_dir)), ["ticker", "ts"], ["macd", "signal", "histogram"])


@once("bars_adx")
def bars_adx(spark, sf_dir):
    return intraday.adx(bars(spark, sf_dir))


@query("wilder_atr_adx", rounded("ticker ts", "atr adx", "SELECT ticker, ts, atr, adx FROM adxs JOIN bi USING (ticker, idx)"))
def q_adx(spark, sf_dir):
    return tidy(bars_adx(spark, sf_dir), ["ticker", "ts"], ["atr", "adx"])


cte(
    "profile",
    f"""SELECT ticker, day, bin, any_value(lo + (bin - 0.5) * (hi - lo) / 20) AS price, sum(volume) AS volume FROM (
 SELECT *, CAST(least(greatest(ceil(({TP} - lo) / nullif((hi - lo) / 20, 0)), 1), 20) AS BIGINT) AS bin FROM (
 SELECT *, min(low) OVER (PARTITION BY ticker, day) AS lo, max(high) OVER (PARTITION BY ticker, day) AS hi FROM bi)) GROUP BY 1, 2, 3""",
)
cte("pocs", "SELECT ticker, day, price AS poc FROM (SELECT *, row_number() OVER (PARTITION BY ticker, day ORDER BY volume DESC, bin) AS k FROM profile) WHERE k = 1")


@query("volume_profile_by_day", rounded("ticker day bin", "price volume", "SELECT ticker, day, bin, price, volume FROM profile"))
def q_profile(spark, sf_dir):
    return tidy(intraday.poc_by_day(bars(spark, sf_dir)), ["ticker", "day", "bin"], ["price", "volume"])


@query("point_of_control", rounded("ticker day", "poc", "SELECT * FROM pocs"))
def q_poc(spark, sf_dir):
    return tidy(intraday.poc(bars(spark, sf_dir)), ["ticker", "day"], ["poc"])


@query("intraday_all_features", rounded("ticker ts divergence", "vs_vwap vs_poc histogram imbalance mom_5", f"""SELECT b.ticker, b.ts,
 CASE WHEN dp < -0.02 AND dv > 0.5 THEN 1 WHEN dp > 0.02 AND dv < -0.3 THEN -1 ELSE 0 END AS divergence, close / vwap - 1 AS vs_vwap, close / poc - 1 AS vs_poc,
 m.macd - n / d AS histogram, imbalance, dp AS mom_5 FROM (
 SELECT *, {_VWAP} AS vwap, {_IMB} AS imbalance, close / lag(close, 5) OVER ({T}) - 1 AS dp, volume / nullif(lag(volume, 5) OVER ({T}), 0) - 1 AS dv FROM bi) b
 JOIN macd3 m USING (ticker, idx) JOIN pocs p ON p.ticker = b.ticker AND p.day = b.day"""))
def q_all(spark, sf_dir):
    return tidy(intraday.all_features(bars(spark, sf_dir)), ["ticker", "ts", "divergence"], ["vs_vwap", "vs_poc", "histogram", "imbalance", "mom_5"])


@query("session_regime", f"""SELECT ticker, day, crossings, CASE WHEN crossings >= 4 THEN 'choppy' ELSE 'trending' END AS regime FROM (
 SELECT ticker, day, count(*) FILTER (g * pg < 0) AS crossings FROM (SELECT *, lag(g) OVER ({D}) AS pg FROM (
 SELECT *, close - {_VWAP} AS g FROM (SELECT *, row_number() OVER ({D}) AS k FROM bi) WHERE k <= 12)) GROUP BY 1, 2)""")
def q_regime(spark, sf_dir):
    return intraday.session_regime(bars(spark, sf_dir))


def _full(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {B(n)} = {n} THEN avg({x}) {B(n)} END"


@query("oscillator_3_10", rounded("ticker ts", "osc osc_hist osc_diff", f"""SELECT ticker, ts, osc, osc_hist, osc_hist - lag(osc_hist) OVER ({T}) AS osc_diff FROM (
 SELECT *, osc - {_full('osc', 16)} AS osc_hist FROM (SELECT *, {_full('close', 3)} - {_full('close', 10)} AS osc FROM bars))"""))
def q_osc(spark, sf_dir):
    return tidy(intraday.oscillator(bars(spark, sf_dir)), ["ticker", "ts"], ["osc", "osc_hist", "osc_diff"])


# ---- patterns -------------------------------------------------------------------------

cte(
    "cand",
    f"""SELECT c.*, {', '.join(f'lag({x}, {k}) OVER ({T}) AS {x}_{k}' for k in (1, 2) for x in ('open', 'close', 'low', 'body', 'ratio', 'mean_body'))},
 max(close) {B(6, 1)} AS recent_top, min(close) {B(6, 1)} AS recent_low FROM (
 SELECT *, CASE WHEN count(*) {B(10)} >= 3 THEN avg(body) {B(10)} END AS mean_body FROM (
 SELECT *, abs(close - open) AS body, abs(close - open) / nullif(high - low, 0) AS ratio FROM bi)) c""",
)
cte("canda", "SELECT cand.*, adx FROM cand JOIN adxs USING (ticker, idx)")
_TWIN = """idx >= 3 AND mean_body_2 > 0 AND body_2 >= mean_body_2 AND ratio_1 >= 0.1 AND ratio >= 0.1 AND abs(open - open_1) <= 0.03 * open_1
 AND (body_1 <= 0 OR abs(body_1 - body) <= 0.5 * body_1)"""
_BEAR3 = "close < open AND close_1 < open_1 AND close_2 < open_2 AND (idx <= 6 OR close < recent_top)"
_BULL2 = "close_1 > open_1 AND close_2 > open_2 AND (idx <= 6 OR close > recent_low)"


@once("candles")
def candles(spark, sf_dir):
    return patterns.candles(bars_adx(spark, sf_dir))


@query("pattern_strict_twin", f"""SELECT ticker, ts, 'bearish' AS side FROM canda WHERE {_TWIN} AND {_BEAR3} AND adx >= 20
 UNION ALL SELECT ticker, ts, 'bullish' FROM canda WHERE {_TWIN} AND {_BULL2} AND adx >= 20""")
def q_strict(spark, sf_dir):
    c = candles(spark, sf_dir)
    a = patterns.strict_twin(c).select("ticker", "ts", F.lit("bearish").alias("side"))
    return a.unionByName(patterns.strict_twin(c, bearish=False).select("ticker", "ts", F.lit("bullish").alias("side")))


_EXH = f"""SELECT ticker, ts, lead_idx FROM (SELECT *, min(CASE WHEN close < open AND mean_body > 0 AND body >= 0.8 * mean_body THEN idx END)
 OVER ({T} ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING) AS lead_idx FROM canda) WHERE idx >= 3 AND lead_idx IS NOT NULL AND close < open AND close_1 < open_1
 AND ratio_1 >= 0.1 AND ratio >= 0.1 AND abs(open - open_1) <= 0.05 * open_1 AND (body_1 <= 0 OR abs(body_1 - body) <= 0.7 * body_1) AND adx >= 15"""


@query("pattern_exhaustion_twin", f"SELECT ticker, ts FROM ({_EXH})")
def q_exhaustion(spark, sf_dir):
    return patterns.exhaustion_twin(candles(spark, sf_dir)).select("ticker", "ts")


cte(
    "levels_daily",
    """SELECT ticker, day, round(coalesce(n.support, q.support) + 1e-9, 4) AS support, round(coalesce(n.resistance, q.resistance) + 1e-9, 4) AS resistance FROM (
 SELECT d.ticker, d.day, d.ticker || '|' || d.day AS of, quantile_cont(b.low, 0.15) AS support, quantile_cont(b.high, 0.85) AS resistance
 FROM (SELECT DISTINCT ticker, day FROM bi) d JOIN bi b ON b.ticker = d.ticker AND b.day < d.day GROUP BY 1, 2, 3) q LEFT JOIN (SELECT ticker AS of, support, resistance FROM asof_nearest) n USING (of)""",
    kept=True,
)


@once("levels_daily")
def levels_daily(spark, sf_dir):
    from ..operators import outcomes

    return outcomes.entries_from_bars(bars(spark, sf_dir))


@query("entries_from_prior_days", rounded("ticker day", "support resistance stop", "SELECT ticker, day, support, resistance, round(support * 0.95 + 1e-9, 4) AS stop FROM levels_daily", 4))
def q_entries(spark, sf_dir):
    return tidy(levels_daily(spark, sf_dir), ["ticker", "day"], ["support", "resistance", "stop"], 4)


@query("pattern_absorption", """SELECT ticker, ts, support FROM (SELECT c.*, l.support FROM canda c JOIN levels_daily l ON l.ticker = c.ticker AND l.day = c.day)
 WHERE idx >= 3 AND close_2 < open_2 AND mean_body_2 > 0 AND body_2 >= 1.2 * mean_body_2 AND abs(least(close_2, low_2) - support) <= 0.03 * support
 AND low_1 >= low_2 * 0.998 AND low >= low_2 * 0.998 AND (mean_body IS NULL OR mean_body <= 0 OR (body_1 <= 0.8 * mean_body AND body <= 0.8 * mean_body))
 AND (close_1 > open_1 OR close > open) AND adx >= 15""")
def q_absorption(spark, sf_dir):
    c = candles(spark, sf_dir).withColumn("day", F.to_date("ts")).join(levels_daily(spark, sf_dir).select("ticker", "day", "support"), ["ticker", "day"])
    return patterns.absorption(c, tol=0.03, lead_body=1.2).select("ticker", "ts", "support")


@query("pattern_near_support", f"""SELECT m.ticker, m.ts, l.support FROM (SELECT * FROM canda WHERE {_TWIN} AND {_BEAR3}) m JOIN levels_daily l ON l.ticker = m.ticker AND l.day = m.day
 WHERE abs(least(open, close) - support) <= 0.02 * support""")
def q_near(spark, sf_dir):
    m = patterns.strict_twin(candles(spark, sf_dir), adx_min=None)
    return patterns.near_level(m, levels_daily(spark, sf_dir), 0.02).select("ticker", "ts", "support")


cte(
    "eqh",
    """SELECT *, greatest(open, open_1) AS ceiling, least(open, close, open_1, close_1) AS floor FROM cand WHERE idx >= 2 AND open_1 > 0
 AND (close_1 > open_1) <> (close > open) AND ratio_1 >= 0.08 AND ratio >= 0.08 AND abs(open - open_1) <= 0.02 * open_1""",
)


@query("pattern_equal_highs", "SELECT ticker, ts, ceiling, floor FROM eqh")
def q_eqh(spark, sf_dir):
    return patterns.equal_highs(candles(spark, sf_dir)).select("ticker", "ts", "ceiling", "floor")


cte(
    "eqhsig",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, pair_idx ORDER BY idx) AS k FROM (
 SELECT e.ticker, e.idx AS pair_idx, e.ts AS pair_ts, e.ceiling, b.idx, b.ts, b.close,
 CASE WHEN greatest(b.open, b.close) > e.ceiling * 1.003 AND b.close > e.ceiling THEN 'eqh_breakout'
  WHEN least(b.open, b.close) < e.floor * (1 - 0.003) AND b.close < e.floor THEN 'eqh_rejection' END AS signal
 FROM eqh e JOIN bi b ON b.ticker = e.ticker AND b.idx BETWEEN e.idx + 1 AND e.idx + 5) WHERE signal IS NOT NULL) WHERE k = 1""",
)


@once("eqh_signals")
def eqh_signals(spark, sf_dir):
    c = candles(spark, sf_dir)
    return patterns.equal_highs_signal(patterns.equal_highs(c), c)


@query("pattern_breakout_signal", "SELECT ticker, pair_ts, ts, signal FROM eqhsig")
def q_eqh_signal(spark, sf_dir):
    return eqh_signals(spark, sf_dir).select("ticker", "pair_ts", "ts", "signal")


@query("pattern_best_per_bar", f"""SELECT ticker, ts, pattern, confidence FROM (SELECT *, row_number() OVER (PARTITION BY ticker, ts ORDER BY confidence DESC) AS k FROM (
 SELECT ticker, ts, 'strict' AS pattern, 1.0::DOUBLE AS confidence FROM canda WHERE {_TWIN} AND {_BEAR3} AND adx >= 20
 UNION ALL SELECT ticker, ts, 'exhaustion', 0.6 FROM ({_EXH}) UNION ALL SELECT ticker, ts, 'eqh_pair', 0.8 FROM eqh)) WHERE k = 1""")
def q_best(spark, sf_dir):
    c = candles(spark, sf_dir)
    return patterns.best_per_bar(patterns.strict_twin(c), patterns.exhaustion_twin(c), patterns.equal_highs(c)).drop("idx")
