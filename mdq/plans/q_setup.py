"""Registered queries: setup score, cards, timeframes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import tidy
from ..operators import cards, patterns, reports, setup_score
from ..sources.adapters import table
from .inputs import bars, daily, once
from .q_intraday import bars_adx, candles, eqh_signals, levels_daily
from .q_levels import cands, last_support, merged, trades
from .q_reports import _O
from .registry import cte, query, rounded


@query("score_adx_tier", rounded("ticker", "adx_value adx", "SELECT ticker, adx_value, CASE WHEN n < 30 THEN 0 WHEN adx_value > 25 THEN 2 WHEN adx_value >= 15 THEN 1 ELSE 0 END AS adx FROM (SELECT ticker, arg_max(adx, idx) AS adx_value, count(*) AS n FROM adxs GROUP BY 1)", 4))
def q_adx(spark, sf_dir):
    return tidy(setup_score.adx_score(bars_adx(spark, sf_dir)), ["ticker"], ["adx_value", "adx"], 4)


@query("score_reward_risk", rounded("ticker entry_ts", "rr_ratio rr", "SELECT *, CASE WHEN rr_ratio >= 2 THEN 2 WHEN rr_ratio >= 1 THEN 1 ELSE 0 END AS rr FROM (SELECT ticker, entry_ts, CASE WHEN support > 0 AND resistance > entry_price AND entry_price > round(support * 0.95 + 1e-9, 4) THEN least((resistance - entry_price) / nullif(entry_price - round(support * 0.95 + 1e-9, 4), 0), 10) ELSE 0 END AS rr_ratio FROM cands)", 4))
def q_rr(spark, sf_dir):
    c = cands(spark, sf_dir).withColumns({"entry": F.col("entry_price"), "stop": F.round(F.col("support") * 0.95 + 1e-9, 4)})
    return tidy(setup_score.rr_score(c), ["ticker", "entry_ts"], ["rr_ratio", "rr"], 4)


cte("lastk", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM bi")
cte("bigbar", "SELECT ticker, ts AS at, volume AS v FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(close - open) DESC, ts) AS r FROM lastk WHERE k <= 15) WHERE r = 1")


@query("score_relative_volume", rounded("ticker", "ratio rel_volume", """SELECT ticker, ratio, CASE WHEN ratio >= 2 THEN 2 WHEN ratio >= 1.5 THEN 1 ELSE 0 END AS rel_volume FROM (
 SELECT b.ticker, CASE WHEN v > 0 AND samples >= 3 AND median > 0 THEN v / median ELSE 0 END AS ratio FROM bigbar b LEFT JOIN (
 SELECT x.ticker, quantile_cont(y.volume, 0.5) AS median, count(*) AS samples FROM bigbar x JOIN lastk y ON y.ticker = x.ticker AND y.k > 15
 AND abs(hour(y.ts) * 60 + minute(y.ts) - hour(x.at) * 60 - minute(x.at)) <= 5 GROUP BY 1) m ON m.ticker = b.ticker)""", 4))
def q_relvol(spark, sf_dir):
    return tidy(setup_score.relative_volume(bars(spark, sf_dir)), ["ticker"], ["ratio", "rel_volume"], 4)


def _ema_sql(x: str, alpha: float, src: str) -> str:
    """The recursive average of x at every row t (from 1) of src, as one weighted sum."""
    w = f"CASE WHEN i.t = 1 THEN pow({1 - alpha!r}, j.t - 1) ELSE {alpha!r} * pow({1 - alpha!r}, j.t - i.t) END"
    return f"sum(i.{x} * {w})"


cte("steps", "SELECT ticker, ts, close, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS t, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS d FROM bi) WHERE d IS NOT NULL")
cte("wilder", f"""SELECT ticker, ts, 100 - 100 / (1 + g / nullif(l, 0)) AS rsi FROM (
 SELECT j.ticker, j.ts, {_ema_sql('g', 1 / 14, 'steps')} AS g, {_ema_sql('l', 1 / 14, 'steps')} AS l
 FROM steps j JOIN lastk z ON z.ticker = j.ticker AND z.ts = j.ts AND z.k <= 20 JOIN steps i ON i.ticker = j.ticker AND i.t <= j.t GROUP BY 1, 2)""")


@query("score_rsi_divergence", """SELECT ticker, CASE WHEN n < 20 THEN 0.0 WHEN ac < bc AND ar - br > 1 THEN 2.0 WHEN ac < bc AND abs(ar - br) < 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS rsi FROM (
 SELECT ticker, any_value(n) AS n, min(close) FILTER (k <= 3) AS ac, min(close) FILTER (k > 3) AS bc, arg_min(coalesce(rsi, 'nan'::DOUBLE), (close, ts)) FILTER (k <= 3) AS ar, arg_min(coalesce(rsi, 'nan'::DOUBLE), (close, ts)) FILTER (k > 3) AS br
 FROM lastk LEFT JOIN wilder USING (ticker, ts) WHERE k <= 20 GROUP BY 1)""")
def q_rsi_div(spark, sf_dir):
    return setup_score.rsi_divergence(bars(spark, sf_dir))


cte("halves", "SELECT ticker, s AS ts, close, row_number() OVER (PARTITION BY ticker ORDER BY s) AS t, count(*) OVER (PARTITION BY ticker) AS n FROM (SELECT ticker, time_bucket(INTERVAL 30 MINUTE, ts) AS s, arg_max(close, ts) AS close FROM bi GROUP BY 1, 2)")


@query("score_regime", f"""SELECT ticker, CASE WHEN bars < 40 OR steps < 10 THEN 1.0 WHEN slope < -0.005 THEN 2.0 WHEN slope < 0.005 THEN 1.0 ELSE 0.0 END::DOUBLE AS regime FROM (
 SELECT ticker, any_value(n) AS steps, (max(e) FILTER (t = n) - max(e) FILTER (t = n - 3)) / max(close) FILTER (t = n) AS slope FROM (
 SELECT j.ticker, j.t, any_value(j.n) AS n, any_value(j.close) AS close, {_ema_sql('close', 2 / 9, 'halves')} AS e FROM halves j JOIN halves i ON i.ticker = j.ticker AND i.t <= j.t WHERE j.t >= j.n - 3 GROUP BY 1, 2) GROUP BY 1)
 JOIN (SELECT ticker, count(*) AS bars FROM bi GROUP BY 1) USING (ticker)""")
def q_regime(spark, sf_dir):
    return setup_score.regime_score(bars(spark, sf_dir))


cte("closes", "SELECT ticker, ts, close, idx AS t, n FROM lastk")
cte("fastslow", f"SELECT j.ticker, j.t, any_value(j.n) AS n, {_ema_sql('close', 2 / 13, 'closes')} - {_ema_sql('close', 2 / 27, 'closes')} AS m FROM closes j JOIN closes i ON i.ticker = j.ticker AND i.t <= j.t GROUP BY 1, 2")


@query("score_macd_slope", f"""SELECT ticker, CASE WHEN n < 35 THEN 0.0 WHEN h0 > h2 THEN 2.0 WHEN h0 > h1 THEN 1.0 ELSE 0.0 END::DOUBLE AS macd FROM (
 SELECT ticker, any_value(n) AS n, max(h) FILTER (t = n) AS h0, max(h) FILTER (t = n - 1) AS h1, max(h) FILTER (t = n - 2) AS h2 FROM (
 SELECT j.ticker, j.t, any_value(j.n) AS n, any_value(j.m) - {_ema_sql('m', 2 / 10, 'fastslow')} AS h FROM fastslow j JOIN fastslow i ON i.ticker = j.ticker AND i.t <= j.t WHERE j.t >= j.n - 2 GROUP BY 1, 2) GROUP BY 1)""")
def q_macd_slope(spark, sf_dir):
    return setup_score.macd_score(bars(spark, sf_dir))


@query("score_equal_highs", """SELECT ticker, CASE WHEN fired OR gap <= 0.005 THEN 2.0 WHEN gap <= 0.02 THEN 1.0 ELSE 0.0 END::DOUBLE AS eqh FROM (
 SELECT p.ticker, min(abs(q.ceiling - p.close) / p.close) AS gap, coalesce(bool_or(s.ticker IS NOT NULL), false) AS fired FROM (SELECT * FROM lastk WHERE k = 1) p
 LEFT JOIN (SELECT e.ticker, e.ts, e.ceiling FROM eqh e JOIN lastk z ON z.ticker = e.ticker AND z.ts = e.ts WHERE z.k < least(20, z.n)) q ON q.ticker = p.ticker
 LEFT JOIN (SELECT g.ticker, g.pair_ts FROM eqhsig g JOIN lastk z ON z.ticker = g.ticker AND z.ts = g.ts WHERE z.k <= 20) s ON s.ticker = q.ticker AND s.pair_ts = q.ts GROUP BY 1)""")
def q_eqh_score(spark, sf_dir):
    return setup_score.eqh_score(patterns.equal_highs(candles(spark, sf_dir)), eqh_signals(spark, sf_dir), bars(spark, sf_dir))


def _reversed_sql(look: int, need: int) -> str:
    return f"""SELECT ticker, n_up >= {need} AND coalesce(last_up, 0) > 1 AND last BETWEEN level * 0.997 AND level * 1.003 * 1.01 AS hit FROM (SELECT ticker, level, count(*) FILTER (close > level * 1.003) AS n_up,
 min(k) FILTER (close > level * 1.003) AS last_up, arg_min(close, k) AS last FROM lastk JOIN lastday USING (ticker) WHERE k <= {look} GROUP BY 1, 2)"""


@query("score_role_reversal", f"SELECT a.ticker, CASE WHEN a.hit THEN 2.0 WHEN b.hit THEN 1.0 ELSE 0.0 END::DOUBLE AS role FROM ({_reversed_sql(100, 3)}) a JOIN ({_reversed_sql(50, 1)}) b USING (ticker)")
def q_role_score(spark, sf_dir):
    return setup_score.role_score(bars(spark, sf_dir), last_support(spark, sf_dir))


@query("score_rejections", "SELECT ticker, CASE WHEN r >= 2 THEN 2.0 WHEN r = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS rejection FROM (SELECT ticker, count(*) FILTER (low <= level * 1.003 AND close > level) AS r FROM lastk JOIN lastday USING (ticker) WHERE k <= 60 GROUP BY 1)")
def q_rejection_score(spark, sf_dir):
    return setup_score.rejection_score(bars(spark, sf_dir), last_support(spark, sf_dir))


@query("score_support_ok", "SELECT ticker, avg(CASE WHEN close < 0.99 * level THEN 1.0 ELSE 0.0 END) <= 0.5 AS support_ok FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS k FROM bi) JOIN lastday USING (ticker) WHERE k <= 12 GROUP BY 1")
def q_ok(spark, sf_dir):
    return setup_score.support_ok(bars(spark, sf_dir), last_support(spark, sf_dir))


_PARTS = {"adx": 2, "macd": 3, "regime": 5, "pattern": 7, "confluence": 11, "role": 13, "rejection": 17, "eqh": 19, "rsi": 23, "rel_volume": 29, "history": 31}


@query("score_total", rounded("o_orderkey label", "score", """SELECT o_orderkey, score, CASE WHEN score >= 7 THEN 'strong' WHEN score >= 4 THEN 'watch' ELSE 'skip' END AS label FROM (SELECT o_orderkey, round((adx + macd + regime) * (1 + 0.1 * (pattern + confluence + role + eqh) + 0.05 * (rejection + rsi)) * (1 + 0.1 * (rel_volume + history))
 * CASE WHEN eqh > 0 AND confluence > 0 AND role > 0 THEN 1.5 ELSE 1 END / 16.8 * 10 + 1e-9, 2) AS score FROM (SELECT o_orderkey, """ + ", ".join(f"(o_custkey // {k} % 3)::DOUBLE AS {n}" for n, k in _PARTS.items()) + " FROM orders))", 2))
def q_total(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(f"cast((o_custkey div {k}) % 3 as double)").alias(n) for n, k in _PARTS.items()])
    return tidy(setup_score.total(o), ["o_orderkey", "label"], ["score"], 2)


@once("found")
def found(spark, sf_dir):
    c = candles(spark, sf_dir)
    return patterns.best_per_bar(patterns.strict_twin(c), patterns.exhaustion_twin(c))


@once("setup_scores")
def scores(spark, sf_dir):
    h = reports.history(trades(spark, sf_dir))
    c, support = candles(spark, sf_dir), last_support(spark, sf_dir)
    absorbed = patterns.absorption(c.join(support.withColumnRenamed("level", "support"), "ticker"), adx_min=15.0)
    return setup_score.setup_scores(
        bars_adx(spark, sf_dir), patterns.strict_twin(c), patterns.exhaustion_twin(c), absorbed, patterns.equal_highs(c),
        eqh_signals(spark, sf_dir), merged(spark, sf_dir), support, h,
    )


@query("setup_scores")
def q_scores(spark, sf_dir):
    return tidy(scores(spark, sf_dir), ["ticker", "label"], [*setup_score.PARTS, "score"], 3)


@query("setup_level_resolution")
def q_resolve(spark, sf_dir):
    px = bars(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "ts").alias("px"))
    given = levels_daily(spark, sf_dir).groupBy("ticker").agg(F.max_by(F.struct("support", "resistance"), "day").alias("x")).select("ticker", "x.support", "x.resistance")
    return tidy(setup_score.resolve_levels(merged(spark, sf_dir), px, given), ["ticker", "support_broken"], ["entry", "support", "resistance"], 4)


@query("latest_post_scoring")
def q_latest(spark, sf_dir):
    last = levels_daily(spark, sf_dir).groupBy("ticker").agg(F.max("day").alias("day"))
    return tidy(last.join(scores(spark, sf_dir).select("ticker", "score", "label"), "ticker").orderBy(F.col("score").desc()), ["ticker", "day", "label"], ["score"], 2)


_CARD = """SELECT c.ticker, c.day, c.entry_idx, c.entry_ts, coalesce(why, 'close') AS reason, coalesce(exit_ts, c.entry_ts) AS exit_ts,
 round((coalesce(px, c.entry_price) / c.entry_price - 1) * 100, 4) AS pnl_pct FROM cands c LEFT JOIN (
 SELECT ticker, day, entry_idx, arg_min(why, b_idx) FILTER (why IS NOT NULL) AS why, arg_min(px, b_idx) FILTER (why IS NOT NULL) AS px, arg_min(b_ts, b_idx) FILTER (why IS NOT NULL) AS exit_ts FROM (
 SELECT *, CASE WHEN top >= entry_price * 1.02 AND low <= top * 0.99 THEN 'trail' WHEN low <= stop THEN 'stop' WHEN high >= entry_price * 1.012 THEN 'target'
  WHEN late THEN 'close' WHEN held >= 6 AND close < entry_price THEN 'stall' WHEN b_idx = last_idx THEN 'close' END AS why,
 CASE WHEN top >= entry_price * 1.02 AND low <= top * 0.99 THEN top * 0.99 WHEN low <= stop THEN least(open, stop) * 0.995 WHEN high >= entry_price * 1.012 THEN entry_price * 1.012 ELSE close END AS px FROM (
 SELECT c.ticker, c.day, c.entry_idx, c.entry_price, c.entry_price * 0.992 AS stop, b.idx AS b_idx, b.ts AS b_ts, b.open, b.high, b.low, b.close, hour(b.ts) * 60 + minute(b.ts) >= 1200 AS late,
  greatest(c.entry_price, max(b.high) OVER (PARTITION BY c.ticker, c.day, c.entry_idx ORDER BY b.idx)) AS top, max(b.idx) OVER (PARTITION BY c.ticker, c.day, c.entry_idx) AS last_idx,
  row_number() OVER (PARTITION BY c.ticker, c.day, c.entry_idx ORDER BY b.idx) AS held
 FROM cands c JOIN be n ON n.ticker = c.ticker AND n.idx = c.entry_idx JOIN bi b ON b.ticker = c.ticker AND b.idx > c.entry_idx AND b.idx <= n.end_idx
  AND CAST(b.ts AS DATE) = CAST(c.entry_ts AS DATE) AND hour(b.ts) * 60 + minute(b.ts) BETWEEN 810 AND 1200)) GROUP BY 1, 2, 3) x
 ON x.ticker = c.ticker AND x.day = c.day AND x.entry_idx = c.entry_idx"""


@once("cards")
def card_rows(spark, sf_dir):
    return cards.card_outcomes(cands(spark, sf_dir), candles(spark, sf_dir))


@query("card_outcomes", rounded("ticker day entry_idx reason exit_ts", "pnl_pct", _CARD, 3))
def q_cards(spark, sf_dir):
    return tidy(card_rows(spark, sf_dir), ["ticker", "day", "entry_idx", "reason", "exit_ts"], ["pnl_pct"], 3)


@query("card_admission")
def q_admit(spark, sf_dir):
    return tidy(cards.admit(card_rows(spark, sf_dir)), ["ticker", "day", "entry_idx"], ["pnl_pct"], 3)


@query("card_session_candidates")
def q_session(spark, sf_dir):
    return tidy(cards.session_candidates(cands(spark, sf_dir), bars(spark, sf_dir), trades(spark, sf_dir)), ["ticker", "day", "entry_idx"], ["vwap", "rate"], 4)


_TF = {"swing": (5, 35.0), "weekly": (10, 25.0), "monthly": (21, 20.0)}


@query("timeframe_comparison", rounded("timeframe trades", "avg_net win_rate sd", "SELECT timeframe, count(*) AS trades, avg(net) AS avg_net, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, stddev_samp(net) AS sd FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS timeframe, f{h} / close - 1 - 2 * {b} / 1e4 AS net FROM sig WHERE f{h} IS NOT NULL" for n, (h, b) in _TF.items()) + ") GROUP BY 1"))
def q_timeframes(spark, sf_dir):
    return tidy(cards.timeframes(daily(spark, sf_dir), cards.momentum_signal, _TF), ["timeframe", "trades"], ["avg_net", "win_rate", "sd"])


cte("sig", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal DESC, ticker) AS k FROM (SELECT * FROM (SELECT *, least(greatest((close / lag(close, 5) {_O} - 1) * 10, -1), 1) + CASE WHEN lag(close, 5) {_O} IS NULL THEN NULL ELSE 0 END AS signal, {', '.join(f'lead(close, {h}) {_O} AS f{h}' for h, _ in _TF.values())} FROM daily) WHERE signal > 0.2)) WHERE k <= 3")
