"""Registered queries: risk, sizing, dilution, regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import tidy
from ..operators import risk
from ..sources.adapters import table
from .inputs import daily, grid, once, panel
from .q_intraday import bars_adx
from .q_levels import trades
from .q_reports import _O, _w
from .registry import cte, query, rounded


def prior(n):
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


cte("advs", f"SELECT ticker, date, close, avg(volume) {_w(20)} * close AS adv FROM daily")
cte("lastadv", "SELECT ticker, arg_max(adv, date) AS adv, arg_max(close, date) AS close, max(date) AS date FROM advs GROUP BY 1")


def slip(order, adv="adv"):
    return f"least(0.0025 + 0.5 * sqrt(coalesce({order} / nullif({adv}, 0), 0)) + 6.95 / nullif({order}, 0), 0.10)"


@query("slippage_by_order_size", rounded("ticker size", "slip vs_flat cost", f"SELECT *, slip - 0.002 AS vs_flat, size * slip AS cost FROM (SELECT ticker, size, {slip('size')} AS slip FROM lastadv, (SELECT unnest([500, 1000, 5000]::DOUBLE[]) AS size))", 5))
def q_slippage(spark, sf_dir):
    return tidy(risk.slippage_by_size(daily(spark, sf_dir), [500, 1000, 5000]), ["ticker", "size"], ["slip", "vs_flat", "cost"], 5)


@query("net_returns_after_costs", rounded("ticker", "net breakeven", f"SELECT ticker, 0.05 - 0.3 * 2 * {slip('5000')} - 4 * 6.95 / 5000 AS net, 2 * 6.95 / nullif(adv * 0.05, 0) AS breakeven FROM lastadv"))
def q_net(spark, sf_dir):
    d = risk.latest(risk.with_adv(daily(spark, sf_dir)), "adv")
    s = risk.slippage(F.lit(5000.0), F.col("adv"))
    return tidy(d.withColumns({"net": risk.net_return(F.lit(0.05), F.lit(0.3), s, F.lit(4), F.lit(5000.0)), "breakeven": risk.commission_impact(F.col("adv") * 0.05)}), ["ticker"], ["net", "breakeven"])


_POS = "SELECT 'S' || l_suppkey AS ticker, l_returnflag AS book, CAST(round(sum(l_extendedprice * 100)) AS BIGINT) / 100.0 / 1000 AS dollars FROM lineitem GROUP BY 1, 2"


@once("positions")
def positions(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.col("l_returnflag").alias("book"))
    return d.agg((F.round(F.sum(F.col("l_extendedprice") * 100)).cast("bigint") / 100.0 / 1000).alias("dollars"))


@query("portfolio_slippage", rounded("book", "weighted_slip dollars", f"SELECT book, sum(s * dollars) / sum(dollars) AS weighted_slip, sum(dollars) AS dollars FROM (SELECT p.*, {slip('dollars')} AS s FROM ({_POS}) p JOIN lastadv USING (ticker)) GROUP BY 1", 4))
def q_book(spark, sf_dir):
    return tidy(risk.portfolio_slippage(positions(spark, sf_dir), daily(spark, sf_dir)), ["book"], ["weighted_slip", "dollars"], 4)


@query("clipped_positions", rounded("ticker book clipped", "allowed", f"SELECT ticker, book, dollars > adv * 0.05 AS clipped, least(dollars, adv * 0.05) AS allowed FROM ({_POS}) JOIN lastadv USING (ticker)", 4))
def q_clip(spark, sf_dir):
    return tidy(risk.clip_positions(positions(spark, sf_dir), daily(spark, sf_dir)), ["ticker", "book", "clipped"], ["allowed"], 4)


@query("liquidity_filter", rounded("ticker liquid", "adv max_position", "SELECT ticker, adv >= 2500 AS liquid, adv, adv * 0.05 AS max_position FROM lastadv", 4))
def q_liquidity(spark, sf_dir):
    return tidy(risk.liquidity(daily(spark, sf_dir), 2500.0), ["ticker", "liquid"], ["adv", "max_position"], 4)


_FLAG = f"SELECT *, CASE WHEN volume > 1.8 * avg(volume) {_w(20)} AND ret < -0.03 THEN 1 ELSE 0 END AS flag FROM (SELECT *, close / lag(close) {_O} - 1 AS ret FROM daily)"
cte("dflag", f"SELECT *, max(flag) {_w(3)} AS exit FROM ({_FLAG})")


@query("dilution_flags", "SELECT ticker, date, flag, exit FROM dflag")
def q_flags(spark, sf_dir):
    return risk.dilution_flags(daily(spark, sf_dir), 1.8, -0.03).select("ticker", "date", "flag", "exit")


@query("risk_report", rounded("ticker exit liquid", "adv slip max_position", f"SELECT ticker, exit, adv >= 2500 AS liquid, adv, {slip('5000')} AS slip, adv * 0.05 AS max_position FROM lastadv JOIN (SELECT ticker, arg_max(exit, date) AS exit FROM dflag GROUP BY 1) USING (ticker)", 5))
def q_report(spark, sf_dir):
    d = daily(spark, sf_dir)
    liq = risk.liquidity(d, 2500.0).withColumn("slip", risk.slippage(F.lit(5000.0), F.col("adv")))
    ex = risk.latest(risk.dilution_flags(d, 1.8, -0.03), "exit")
    return tidy(liq.join(ex, "ticker"), ["ticker", "exit", "liquid"], ["adv", "slip", "max_position"], 5)


cte(
    "tdil",
    f"""SELECT ticker, date, volume_spike, price_drop, CASE WHEN price_drop <= -0.5 THEN 3 WHEN price_drop <= -0.25 THEN 2 WHEN price_drop <= -0.15 THEN 1 ELSE 0 END AS severity, 'technical' AS kind, 0.5 AS confidence FROM (
 SELECT *, row_number() {_O} AS rn, volume / nullif(avg(volume) {prior(20)}, 0) AS volume_spike, close / lag(close) {_O} - 1 AS price_drop FROM daily) WHERE rn > 20 AND volume_spike >= 1.8 AND price_drop <= -0.03""",
)


@once("tdil")
def technical(spark, sf_dir):
    return risk.technical_dilution(daily(spark, sf_dir), 1.8, -0.03)


@query("technical_dilution", rounded("ticker date severity", "volume_spike price_drop", "SELECT * FROM tdil"))
def q_technical(spark, sf_dir):
    return tidy(technical(spark, sf_dir), ["ticker", "date", "severity"], ["volume_spike", "price_drop"])


# sales: returned line items; share counts: open line items per quarter
cte("sales", "SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS shares FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2")


def sales(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("shares"))


_INS = f"SELECT ticker, count(*) AS n, avg(roll) AS mean, arg_max(roll, date) AS last, max(date) AS date FROM (SELECT *, sum(shares) {_w(30)} AS roll FROM sales) GROUP BY 1"


@query("insider_selling_level", rounded("ticker date n", "ratio", f"SELECT ticker, date, n, last / mean AS ratio FROM ({_INS}) WHERE n >= 2 AND last > 1.05 * mean"))
def q_insider_level(spark, sf_dir):
    from ..functions.core import last_n

    s = sales(spark, sf_dir).withColumn("roll", F.sum("shares").over(last_n(30)))
    g = s.groupBy("ticker").agg(F.count("*").alias("n"), F.avg("roll").alias("mean"), F.max_by(F.struct("roll", "date"), "date").alias("x"))
    g = g.select("ticker", "n", F.col("x.date").alias("date"), (F.col("x.roll") / F.col("mean")).alias("ratio")).where("n >= 2 and ratio > 1.05")
    return tidy(g, ["ticker", "date", "n"], ["ratio"])


cte("counts", "SELECT 'S' || l_suppkey AS ticker, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, sum(l_quantity) AS shares FROM lineitem GROUP BY 1, 2")
cte("jumps", f"SELECT ticker, date, increase, CASE WHEN increase > 0.5 THEN 3 WHEN increase > 0.25 THEN 2 WHEN increase > 0.1 THEN 1 ELSE 0 END AS severity FROM (SELECT *, shares / lag(shares) {_O} - 1 AS increase FROM counts) WHERE increase > 0.05")


@once("jumps")
def jumps(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.trunc("l_shipdate", "quarter").alias("date")).agg(F.sum("l_quantity").alias("shares"))
    return risk.share_count_jumps(c)


@query("share_count_jumps", rounded("ticker date severity", "increase", "SELECT * FROM jumps"))
def q_jumps(spark, sf_dir):
    return tidy(jumps(spark, sf_dir), ["ticker", "date", "severity"], ["increase"])


cte("events_all", "SELECT ticker, date, severity, volume_spike, price_drop, kind, confidence::DOUBLE AS confidence FROM tdil UNION ALL SELECT ticker, date, severity, 0, 0, 'share_count', 0.9 FROM jumps")
cte("evd", "SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM (SELECT DISTINCT ticker, date FROM events_all)")
cte(
    "anch",
    """SELECT ticker, date, date AS anchor, k FROM evd WHERE k = 1
 UNION ALL SELECT e.ticker, e.date, CASE WHEN e.date - a.anchor > 5 THEN e.date ELSE a.anchor END, e.k FROM anch a JOIN evd e ON e.ticker = a.ticker AND e.k = a.k + 1""",
)
cte(
    "combined",
    """SELECT * FROM (SELECT ticker, anchor AS date, count(*) AS n, max(severity) AS severity, max(volume_spike) AS volume_spike, min(price_drop) AS price_drop, least(avg(confidence) + 0.2 * (count(*) - 1), 1.0) AS confidence
 FROM events_all JOIN anch USING (ticker, date) GROUP BY 1, 2) WHERE confidence >= 0.6""",
)


@once("combined")
def combined(spark, sf_dir):
    j = jumps(spark, sf_dir).select("ticker", "date", "severity", F.lit(0.0).alias("volume_spike"), F.lit(0.0).alias("price_drop"), "kind", "confidence")
    return risk.combine_events(technical(spark, sf_dir).select(j.columns).unionByName(j))


@query("dilution_combined", rounded("ticker date n severity", "volume_spike price_drop confidence", "SELECT * FROM combined"))
def q_combined(spark, sf_dir):
    return tidy(combined(spark, sf_dir), ["ticker", "date", "n", "severity"], ["volume_spike", "price_drop", "confidence"])


@query("dilution_statistics", rounded("severity n tickers", "avg_confidence avg_drop", "SELECT severity, count(*) AS n, count(DISTINCT ticker) AS tickers, avg(confidence) AS avg_confidence, avg(price_drop) AS avg_drop FROM combined GROUP BY 1"))
def q_dstats(spark, sf_dir):
    return tidy(risk.dilution_statistics(combined(spark, sf_dir)), ["severity", "n", "tickers"], ["avg_confidence", "avg_drop"])


@query("dilution_blacklist", "SELECT ticker, max(date) + 20 AS until FROM combined GROUP BY 1")
def q_blacklist(spark, sf_dir):
    return risk.blacklist(combined(spark, sf_dir))


@query("blacklisted_rows", "SELECT ticker, date FROM daily d WHERE EXISTS (SELECT 1 FROM combined c WHERE c.ticker = d.ticker AND d.date BETWEEN c.date AND c.date + 20)")
def q_blacklisted(spark, sf_dir):
    return risk.blacklisted(daily(spark, sf_dir).select("ticker", "date"), combined(spark, sf_dir))


cte("wcur", "SELECT ticker, v / sum(v) OVER () AS weight FROM (SELECT ticker, arg_max(volume, date) AS v FROM panel GROUP BY 1)")
cte("wtgt", "SELECT n_name AS ticker, 1.0 / count(*) OVER () AS weight FROM nation WHERE n_regionkey <> 0")
cte("rtr", "SELECT *, CASE WHEN deviation > 0.2 THEN (tw - cw) * 100000 ELSE 0 END AS trade FROM (SELECT *, CASE WHEN tw > 0 THEN abs(cw - tw) / tw WHEN cw > 0 THEN 1.0 ELSE 0.0 END AS deviation FROM (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.weight, 0) AS cw, coalesce(b.weight, 0) AS tw FROM wcur a FULL JOIN wtgt b ON a.ticker = b.ticker))")


def _weights(spark, sf_dir):
    v = panel(spark, sf_dir).groupBy("ticker").agg(F.max_by("volume", "date").alias("v"))
    cur = v.join(F.broadcast(v.agg(F.sum("v").alias("t")))).select("ticker", (F.col("v") / F.col("t")).alias("weight"))
    n = table(spark, sf_dir, "nation").where("n_regionkey <> 0")
    tgt = n.join(F.broadcast(n.agg(F.count("*").alias("k")))).select(F.col("n_name").alias("ticker"), (1.0 / F.col("k")).alias("weight"))
    return cur, tgt


@query("rebalance_trades", rounded("ticker", "deviation trade", "SELECT * FROM rtr", 5))
def q_rebalance(spark, sf_dir):
    return tidy(risk.rebalance_trades(*_weights(spark, sf_dir), 100000.0), ["ticker"], ["deviation", "trade"], 5)


@query("portfolio_drift", rounded("action", "drift turnover", "SELECT CASE WHEN drift > 0.1 THEN 'full' WHEN drift > 0.05 THEN 'partial' ELSE 'none' END AS action, drift, turnover FROM (SELECT sum(abs(cw - tw)) / 2 AS drift, sum(abs(trade)) / 100000 AS turnover FROM rtr)"))
def q_drift(spark, sf_dir):
    return tidy(risk.drift(*_weights(spark, sf_dir)), ["action"], ["drift", "turnover"])


_K = "OVER (PARTITION BY ticker ORDER BY entry_ts, pt, sl ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("kelly_fraction", rounded("ticker entry_ts pt sl", "kelly", f"""SELECT ticker, entry_ts, pt, sl, CASE WHEN n >= 5 AND aw IS NOT NULL AND al IS NOT NULL THEN greatest(0, least((wr * aw - (1 - wr) * al) / aw, 0.25)) ELSE 0.1 END AS kelly FROM (
 SELECT *, count(*) {_K} AS n, avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0.0 END) {_K} AS wr, avg(CASE WHEN pnl_pct > 0 THEN pnl_pct END) {_K} AS aw, abs(avg(CASE WHEN pnl_pct < 0 THEN pnl_pct END) {_K}) AS al FROM trades)"""))
def q_kelly(spark, sf_dir):
    return tidy(risk.kelly(trades(spark, sf_dir), ["entry_ts", "pt", "sl"]), ["ticker", "entry_ts", "pt", "sl"], ["kelly"])


@query("volatility_sizing", rounded("ticker label", "vol scale weight", f"""SELECT ticker, CASE WHEN vol < 0.15 THEN 'low' WHEN vol < 0.3 THEN 'normal' WHEN vol < 0.5 THEN 'high' ELSE 'extreme' END AS label, vol, least(0.2 / vol, 2) AS scale, 1 / vol / sum(1 / vol) OVER () AS weight FROM (
 SELECT ticker, arg_max(vol, date) AS vol FROM (SELECT *, stddev_samp(r) {_w(21)} * sqrt(252) AS vol FROM (SELECT *, close / lag(close) {_O} - 1 AS r FROM daily)) GROUP BY 1) WHERE vol > 0"""))
def q_volsize(spark, sf_dir):
    return tidy(risk.volatility_sizes(daily(spark, sf_dir)), ["ticker", "label"], ["vol", "scale", "weight"])


@query("trailing_stops", rounded("ticker atr_exit fixed_exit time_exit", "stop protected", f"""SELECT ticker, min(date) FILTER (close <= stop) AS atr_exit, min(date) FILTER (close <= entry * 0.92) AS fixed_exit, min(date) FILTER (date - start >= 30) AS time_exit, arg_min(stop, date) FILTER (close <= stop) AS stop,
 arg_min(stop, date) FILTER (close <= stop) / any_value(entry) - 1 AS protected FROM (SELECT *, max(close - 2 * atr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM (
 SELECT *, avg(tr) {_w(14)} AS atr, first_value(close) {_O} AS entry, first_value(date) {_O} AS start FROM (SELECT *, greatest(high - low, abs(high - lag(close) {_O}), abs(low - lag(close) {_O})) AS tr FROM daily))) GROUP BY 1""", 5))
def q_stops(spark, sf_dir):
    return tidy(risk.trailing_stop(daily(spark, sf_dir)), ["ticker", "atr_exit", "fixed_exit", "time_exit"], ["stop", "protected"], 5)


@query("timeframe_costs", rounded("ticker timeframe", "annual_trades cost_drag size", "SELECT ticker, timeframe, 252 / hold * 3 AS annual_trades, 252 / hold * bps / 1e4 * 2 AS cost_drag, least(adv * 0.05, 100000.0 / 3) AS size FROM lastadv, (VALUES ('intraday', 0.25, 75.0), ('swing', 5.0, 35.0), ('weekly', 10.0, 25.0), ('monthly', 30.0, 20.0)) t(timeframe, hold, bps)", 4))
def q_timeframes(spark, sf_dir):
    return tidy(risk.timeframe_costs(daily(spark, sf_dir)), ["ticker", "timeframe"], ["annual_trades", "cost_drag", "size"], 4)


@query("atr_dollar_sizing", rounded("ticker entry_ts pt sl shares", "dollars", "SELECT *, shares * (exit_price - entry_price) AS dollars FROM (SELECT t.*, CAST(floor(100 / (1.5 * coalesce(CASE WHEN atr > 0 THEN atr END, entry_price * 0.02))) AS BIGINT) AS shares FROM trades t JOIN adxs a ON a.ticker = t.ticker AND a.idx = t.entry_idx - 1)", 3))
def q_dollars(spark, sf_dir):
    from ..operators.patterns import candles

    atr = candles(bars_adx(spark, sf_dir)).select("ticker", (F.col("idx") + 1).alias("entry_idx"), "atr")
    return tidy(risk.dollar_sizing(trades(spark, sf_dir).join(atr, ["ticker", "entry_idx"])), ["ticker", "entry_ts", "pt", "sl", "shares"], ["dollars"], 3)


# the smoothings of a close-only ADX, row by row
cte(
    "adx_moves",
    f"SELECT ticker, date, row_number() {_O} AS rn, greatest(coalesce(close - lag(close) {_O}, 0), 0) AS up, greatest(coalesce(lag(close) {_O} - close, 0), 0) AS down FROM daily",
)
cte(
    "adx_steps",
    """SELECT ticker, date, rn, CAST(up AS DOUBLE) AS u, CAST(down AS DOUBLE) AS d, CAST(NULL AS DOUBLE) AS adx FROM adx_moves WHERE rn = 1
 UNION ALL
 SELECT ticker, date, rn, u, d, CASE WHEN u + d > 0 THEN coalesce(old + (100 * abs(u - d) / (u + d) - old) * 2 / 51.0, 100 * abs(u - d) / (u + d)) END FROM (
 SELECT n.ticker, n.date, n.rn, p.u + (n.up - p.u) * 2 / 51.0 AS u, p.d + (n.down - p.d) * 2 / 51.0 AS d, p.adx AS old FROM adx_steps p JOIN adx_moves n ON n.ticker = p.ticker AND n.rn = p.rn + 1)""",
)
cte(
    "vols",
    f"""SELECT *, CASE WHEN count(r) {_w(200)} = 200 THEN stddev_samp(r) {_w(200)} END AS wide, round(CASE WHEN count(r) {_w(20)} = 20 THEN stddev_samp(r) {_w(20)} END * sqrt(252), 10) AS vol,
 CASE WHEN count(*) {_w(25)} = 25 THEN avg(close) {_w(25)} END AS ma_s, CASE WHEN count(*) {_w(50)} = 50 THEN avg(close) {_w(50)} END AS ma_l,
 CASE WHEN count(*) {_w(200)} = 200 THEN avg(close) {_w(200)} END AS ma_m, avg(r) {_w(50)} AS recent FROM (SELECT *, close / lag(close) {_O} - 1 AS r FROM daily)""",
)
cte(
    "volrank",
    """SELECT a.ticker, a.date, (count(*) FILTER (b.vol < a.vol) + count(*) FILTER (b.vol <= a.vol) + 1) / 2.0 / count(*) AS pct
 FROM vols a JOIN vols b ON b.ticker = a.ticker AND b.date <= a.date WHERE a.vol IS NOT NULL AND b.vol IS NOT NULL GROUP BY 1, 2""",
)
cte(
    "pair_levels",
    """SELECT date, avg(c) AS correlation_level FROM (SELECT date, CASE WHEN count(*) OVER w = 20 AND var_samp(x) OVER w > 1e-15 AND var_samp(y) OVER w > 1e-15
  THEN abs(covar_samp(x, y) OVER w / sqrt(var_samp(x) OVER w * var_samp(y) OVER w)) END AS c
  FROM (SELECT a.ticker AS a, b.ticker AS b, a.date, a.r AS x, b.r AS y FROM gridr a JOIN gridr b ON a.date = b.date AND a.ticker < b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL)
  WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE c > 1e-12 GROUP BY 1""",
)
cte("correlations", "SELECT *, CASE WHEN correlation_level < 0.3 THEN 'low' WHEN correlation_level < 0.6 THEN 'moderate' ELSE 'high' END AS correlation_regime FROM pair_levels")
cte(
    "regs",
    """SELECT ticker, date, pct, trend_strength, sentiment, coalesce(correlation_level, 0.5) AS correlation_level, vol_regime, trend_regime, market_regime, coalesce(correlation_regime, 'moderate') AS correlation_regime,
 0.5 + CASE market_regime WHEN 'bull' THEN CASE WHEN trend_regime IN ('strong_uptrend', 'weak_uptrend') THEN 0.2 ELSE 0 END + CASE WHEN vol_regime IN ('low', 'normal') THEN 0.1 ELSE 0 END
  WHEN 'bear' THEN CASE WHEN trend_regime IN ('strong_downtrend', 'weak_downtrend') THEN 0.2 ELSE 0 END + CASE WHEN vol_regime = 'high' THEN 0.1 ELSE 0 END
  WHEN 'volatile' THEN CASE WHEN vol_regime IN ('high', 'extreme') THEN 0.3 ELSE 0 END ELSE 0 END AS confidence FROM (
 SELECT *, CASE WHEN pct < 0.25 THEN 'low' WHEN pct < 0.75 THEN 'normal' WHEN pct < 0.95 THEN 'high' WHEN pct IS NOT NULL THEN 'extreme' END AS vol_regime,
  CASE WHEN strength < 20 THEN 'sideways' WHEN trend_strength > 0.5 THEN 'strong_uptrend' WHEN trend_strength > 0.2 THEN 'weak_uptrend' WHEN trend_strength < -0.5 THEN 'strong_downtrend' WHEN trend_strength < -0.2 THEN 'weak_downtrend' ELSE 'sideways' END AS trend_regime,
  CASE WHEN close > ma_m * 1.05 AND recent > 0 THEN 'bull' WHEN close < ma_m * 0.95 AND recent < 0 THEN 'bear' WHEN vol / sqrt(252) > 1.5 * usual THEN 'volatile' ELSE 'sideways' END AS market_regime FROM (
 SELECT v.*, pct, coalesce(adx, 0) AS strength, CASE WHEN ma_l IS NOT NULL THEN greatest(least((ma_s - ma_l) / ma_l * 10, 1), -1) * coalesce(adx, 0) / 100 END AS trend_strength,
  CASE WHEN ma_m IS NOT NULL THEN greatest(least((close - ma_m) / ma_m * 2, 1), -1) END AS sentiment FROM (
 SELECT *, avg(wide) OVER (PARTITION BY ticker ORDER BY date) AS usual FROM vols) v LEFT JOIN volrank USING (ticker, date) LEFT JOIN (SELECT ticker, date, adx FROM adx_steps) USING (ticker, date))) LEFT JOIN correlations USING (date)""",
)


@once("correlation_regime")
def correlation(spark, sf_dir):
    return risk.correlation_regime(grid(spark, sf_dir))


@once("regimes")
def regimes(spark, sf_dir):
    return risk.regimes(daily(spark, sf_dir), correlation(spark, sf_dir))


RK = ["ticker", "date", "vol_regime", "trend_regime", "market_regime", "correlation_regime"]
RV = ["pct", "trend_strength", "sentiment", "correlation_level", "confidence"]


@query("correlation_regime", rounded("date correlation_regime", "correlation_level", "SELECT * FROM correlations", 5))
def q_correlation(spark, sf_dir):
    return tidy(correlation(spark, sf_dir), ["date", "correlation_regime"], ["correlation_level"], 5)


@query("market_regimes", rounded(" ".join(RK), RV, "SELECT * FROM regs", 5))
def q_regimes(spark, sf_dir):
    return tidy(regimes(spark, sf_dir), RK, RV, 5)


@query("regime_weights", rounded("ticker date max_positions", "scale stop_scale", """SELECT ticker, date, CASE vol_regime WHEN 'low' THEN 1.2 WHEN 'high' THEN 0.7 WHEN 'extreme' THEN 0.5 ELSE 1.0 END * CASE market_regime WHEN 'bull' THEN 1.1 WHEN 'bear' THEN 0.8 WHEN 'volatile' THEN 0.6 ELSE 1.0 END
  * CASE correlation_regime WHEN 'high' THEN 0.9 ELSE 1.0 END AS scale, CASE vol_regime WHEN 'low' THEN 0.8 WHEN 'high' THEN 1.5 WHEN 'extreme' THEN 2.0 ELSE 1.0 END AS stop_scale,
 least(CASE market_regime WHEN 'bull' THEN 12 WHEN 'bear' THEN 6 WHEN 'volatile' THEN 5 ELSE 10 END, CASE correlation_regime WHEN 'high' THEN 5 ELSE 12 END) AS max_positions FROM regs"""))
def q_weights(spark, sf_dir):
    return tidy(risk.regime_weights(regimes(spark, sf_dir)), ["ticker", "date", "max_positions"], ["scale", "stop_scale"])
