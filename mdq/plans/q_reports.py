"""Registered queries: trade summaries, sweeps, checks and daily statistics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.core import tidy
from ..operators import outcomes, patterns, reports
from .inputs import daily, once, panel
from .q_intraday import candles, levels_daily
from .q_levels import trades
from .registry import CTES, KEPT, cte, query, rounded

_S = """count(*) AS trades, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'timeout') AS timeouts,
 avg(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0.0 END) AS win_rate, coalesce(avg(pnl_pct) FILTER (outcome = 'win'), 0) AS avg_win, coalesce(avg(pnl_pct) FILTER (outcome = 'loss'), 0) AS avg_loss,
 coalesce(sum(pnl_pct) FILTER (outcome = 'win'), 0) AS gross_win, abs(coalesce(sum(pnl_pct) FILTER (outcome <> 'win'), 0)) AS gross_loss, avg(hold_bars) AS avg_hold,
 avg(CASE WHEN support_respected THEN 1.0 ELSE 0.0 END) AS respect_rate"""


def _summary(keys: str) -> str:
    return f"SELECT *, gross_win / nullif(gross_loss, 0) AS profit_factor, win_rate * avg_win + (1 - win_rate) * avg_loss AS expectancy FROM (SELECT {keys}, {_S} FROM trades GROUP BY {keys})"


cte("sums", _summary("pt, sl"))
SV = ["win_rate", "avg_win", "avg_loss", "expectancy", "profit_factor", "avg_hold", "respect_rate"]


@query("trade_summary_grid", rounded("pt sl trades wins losses timeouts", SV, "SELECT * FROM sums", 5))
def q_summary(spark, sf_dir):
    return tidy(reports.summary(trades(spark, sf_dir), "pt", "sl"), ["pt", "sl", "trades", "wins", "losses", "timeouts"], SV, 5)


@once("tsess")
def with_session(spark, sf_dir):
    return trades(spark, sf_dir).withColumn("session", outcomes.session_of(F.col("entry_ts")))


_SESS = """CASE WHEN hour(entry_ts) * 60 + minute(entry_ts) BETWEEN 540 AND 805 THEN 'pre_market' WHEN hour(entry_ts) * 60 + minute(entry_ts) BETWEEN 810 AND 1200 THEN 'market_open'
 WHEN hour(entry_ts) * 60 + minute(entry_ts) BETWEEN 1200 AND 1435 THEN 'after_hours' ELSE 'unknown' END"""
WR = [f"wr_{s}" for s in ("pre_market", "market_open", "after_hours", "unknown")]


@query("trade_session_win_rates", rounded("pt sl", WR, "SELECT pt, sl, " + ", ".join(f"avg(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0.0 END) FILTER (s = '{w[3:]}') AS {w}" for w in WR) + f" FROM (SELECT *, {_SESS} AS s FROM trades) GROUP BY 1, 2"))
def q_sessions(spark, sf_dir):
    return tidy(reports.session_rates(with_session(spark, sf_dir), "pt", "sl"), ["pt", "sl"], WR)


@query("sweep_best_by_metric", rounded("metric pt sl", "value", " UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS metric, round({m}, 9) AS value, pt, sl FROM sums WHERE trades >= 5 AND {m} IS NOT NULL ORDER BY round({m}, 9) DESC, pt, sl LIMIT 1)" for m in ("win_rate", "expectancy", "profit_factor"))))
def q_best(spark, sf_dir):
    s = reports.summary(trades(spark, sf_dir), "pt", "sl")
    out = None
    for m in ("win_rate", "expectancy", "profit_factor"):
        b = reports.best_by(s, m)
        out = b if out is None else out.unionByName(b)
    return tidy(out, ["metric", "pt", "sl"], ["value"])


@query("sweep_pivot", rounded("sl", "pt_06 pt_12 pt_24", "SELECT sl, max(expectancy) FILTER (pt = 0.6) AS pt_06, max(expectancy) FILTER (pt = 1.2) AS pt_12, max(expectancy) FILTER (pt = 2.4) AS pt_24 FROM sums GROUP BY 1", 5))
def q_pivot(spark, sf_dir):
    s = reports.summary(trades(spark, sf_dir), "pt", "sl").groupBy("sl").pivot("pt", [0.6, 1.2, 2.4]).avg("expectancy")
    for v, n in ((0.6, "pt_06"), (1.2, "pt_12"), (2.4, "pt_24")):
        s = s.withColumnRenamed(str(v), n)
    return tidy(s, ["sl"], ["pt_06", "pt_12", "pt_24"], 5)


@query("sweep_top_n", rounded("pt sl trades", "expectancy", "SELECT * FROM sums ORDER BY round(expectancy, 9) DESC, pt, sl LIMIT 5", 5))
def q_top(spark, sf_dir):
    s = reports.summary(trades(spark, sf_dir), "pt", "sl").orderBy(F.round("expectancy", 9).desc(), "pt", "sl").limit(5)
    return tidy(s, ["pt", "sl", "trades"], ["expectancy"], 5)


@query("trade_breakdown", rounded("kind label trades", "win_rate avg_pnl total_pnl", """SELECT CASE WHEN pattern IS NOT NULL THEN 'pattern' WHEN tries IS NOT NULL THEN 'attempt' WHEN ticker IS NOT NULL THEN 'ticker' ELSE 'all' END AS kind,
 coalesce(pattern, tries, ticker, 'all') AS label, count(*) AS trades, avg(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0.0 END) AS win_rate, avg(pnl_pct) AS avg_pnl, sum(pnl_pct) AS total_pnl
 FROM (SELECT *, CASE WHEN attempt >= 3 THEN '3+' ELSE CAST(attempt AS VARCHAR) END AS tries FROM trades) GROUP BY GROUPING SETS ((pattern), (tries), (ticker), ())""", 4))
def q_breakdown(spark, sf_dir):
    return tidy(reports.breakdown(trades(spark, sf_dir)), ["kind", "label", "trades"], ["win_rate", "avg_pnl", "total_pnl"], 4)


cte("curve", "SELECT *, greatest(max(cum) OVER w, 0) AS peak FROM (SELECT *, sum(pnl_pct) OVER w AS cum FROM trades WINDOW w AS (PARTITION BY pt, sl ORDER BY entry_ts, ticker)) WINDOW w AS (PARTITION BY pt, sl ORDER BY entry_ts, ticker)")


@query("equity_and_drawdown", rounded("pt sl ticker entry_ts", "cum peak drawdown", "SELECT pt, sl, ticker, entry_ts, cum, peak, cum - peak AS drawdown FROM curve", 4))
def q_curve(spark, sf_dir):
    return tidy(reports.curve(trades(spark, sf_dir), ["pt", "sl"]), ["pt", "sl", "ticker", "entry_ts"], ["cum", "peak", "drawdown"], 4)


@query("trade_risk_ratios", rounded("pt sl", "sharpe sortino max_drawdown", """SELECT pt, sl, coalesce(avg(pnl_pct) / nullif(stddev_samp(pnl_pct), 0) * sqrt(252), 0) AS sharpe,
 coalesce(avg(pnl_pct) / nullif(stddev_samp(pnl_pct) FILTER (pnl_pct < 0), 0) * sqrt(252), 0) AS sortino, min(cum - peak) AS max_drawdown FROM curve GROUP BY 1, 2""", 4))
def q_risk(spark, sf_dir):
    return tidy(reports.trade_risk(trades(spark, sf_dir), ["pt", "sl"]), ["pt", "sl"], ["sharpe", "sortino", "max_drawdown"], 4)


_CUT = "DATE '2024-01-20'"


@query("ticker_history_as_of", rounded("ticker trades last5_wins", "win_rate expectancy history_score", f"""SELECT *, CASE WHEN trades < 3 THEN 0 WHEN win_rate >= 0.6 THEN 2 WHEN win_rate >= 0.3 THEN 1 ELSE 0 END AS history_score FROM (
 SELECT *, win_rate * avg_win + (1 - win_rate) * avg_loss AS expectancy FROM (SELECT ticker, {_S} FROM trades WHERE CAST(entry_ts AS DATE) < {_CUT} GROUP BY 1)) JOIN (
 SELECT ticker, count(*) FILTER (outcome = 'win') AS last5_wins FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY entry_ts DESC, pt, sl) AS k FROM trades WHERE CAST(entry_ts AS DATE) < {_CUT}) WHERE k <= 5 GROUP BY 1) USING (ticker)""", 4))
def q_history(spark, sf_dir):
    h = reports.history(trades(spark, sf_dir), F.lit("2024-01-20").cast("date"))
    return tidy(h, ["ticker", "trades", "last5_wins"], ["win_rate", "expectancy", "history_score"], 4)


@query("win_concentration", rounded("ticker wins trades", "win_share", "SELECT *, wins / nullif(sum(wins) OVER (), 0)::DOUBLE AS win_share FROM (SELECT ticker, count(*) FILTER (outcome = 'win') AS wins, count(*) AS trades FROM trades GROUP BY 1)"))
def q_concentration(spark, sf_dir):
    return tidy(reports.concentration(trades(spark, sf_dir)), ["ticker", "wins", "trades"], ["win_share"])


@query("duplicate_trades", rounded("trades unique_trades", "duplicate_share unique_win_rate", """SELECT CAST(sum(n) AS BIGINT) AS trades, count(*) AS unique_trades, 1 - count(*) / sum(n)::DOUBLE AS duplicate_share, avg(CASE WHEN o = 'win' THEN 1.0 ELSE 0.0 END) AS unique_win_rate FROM (
 SELECT ticker, entry_ts, count(*) AS n, arg_min(outcome, pt * 1000 + sl) AS o FROM trades GROUP BY 1, 2)"""))
def q_duplicates(spark, sf_dir):
    return tidy(reports.duplicates(trades(spark, sf_dir)), ["trades", "unique_trades"], ["duplicate_share", "unique_win_rate"])


@query("out_of_sample_folds", rounded("fold test_trades", "test_win_rate test_avg_pnl train_win_rate", """SELECT fold, n AS test_trades, w / n::DOUBLE AS test_win_rate, p / n AS test_avg_pnl,
 sum(w) OVER x / nullif(sum(n) OVER x, 0)::DOUBLE AS train_win_rate FROM (SELECT (CASE WHEN e > c[1] THEN 1 ELSE 0 END + CASE WHEN e > c[2] THEN 1 ELSE 0 END + CASE WHEN e > c[3] THEN 1 ELSE 0 END + CASE WHEN e > c[4] THEN 1 ELSE 0 END) AS fold,
 count(*) AS n, count(*) FILTER (outcome = 'win') AS w, sum(pnl_pct) AS p FROM (SELECT *, epoch(entry_ts)::DOUBLE AS e FROM trades), (SELECT quantile_cont(epoch(entry_ts)::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS c FROM trades) GROUP BY 1)
 WINDOW x AS (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", 4))
def q_folds(spark, sf_dir):
    return tidy(reports.folds(trades(spark, sf_dir)), ["fold", "test_trades"], ["test_win_rate", "test_avg_pnl", "train_win_rate"], 4)


_SL = [0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75]


@query("slippage_sensitivity", rounded("slip fails", "profit_factor avg_net", f"""SELECT *, CASE WHEN profit_factor < 1 THEN 1 ELSE 0 END AS fails FROM (SELECT slip, coalesce(sum(net) FILTER (net > 0), 0) / nullif(abs(coalesce(sum(net) FILTER (net < 0), 0)), 0) AS profit_factor, avg(net) AS avg_net
 FROM (SELECT slip, (x - e) / e * 100 AS net FROM (SELECT slip, entry_price * (1 + slip / 100) AS e, exit_price * CASE outcome WHEN 'win' THEN 1 - slip / 100 WHEN 'loss' THEN 1 + slip / 100 ELSE 1 END AS x FROM trades, (SELECT unnest({_SL}::DOUBLE[]) AS slip))) GROUP BY 1)""", 5))
def q_slip(spark, sf_dir):
    return tidy(reports.slippage_sensitivity(trades(spark, sf_dir), _SL), ["slip", "fails"], ["profit_factor", "avg_net"], 5)


@query("realistic_grid_check", rounded("pairs positive", "best", "SELECT count(*) AS pairs, count(*) FILTER (expectancy > 0) AS positive, max(expectancy) AS best FROM sums WHERE trades >= 5"))
def q_realistic(spark, sf_dir):
    s = reports.summary(trades(spark, sf_dir), "pt", "sl").where("trades >= 5")
    return tidy(s.agg(F.count("*").alias("pairs"), reports.count_if(F.col("expectancy") > 0).alias("positive"), F.max("expectancy").alias("best")), ["pairs", "positive"], ["best"])


@query("loose_vs_tight_entries", rounded("band trades", "win_rate avg_pnl", " UNION ALL ".join(f"SELECT '{n}' AS band, count(*) AS trades, avg(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0.0 END) AS win_rate, avg(pnl_pct) AS avg_pnl FROM trades WHERE abs(entry_price - support) <= {b} * support" for n, b in (("loose", 0.05), ("tight", 0.005))), 5))
def q_loose(spark, sf_dir):
    t = trades(spark, sf_dir)
    near = F.abs(F.col("entry_price") - F.col("support"))
    bands = F.filter(F.array(F.when(near <= 0.05 * F.col("support"), F.lit("loose")), F.when(near <= 0.005 * F.col("support"), F.lit("tight"))), lambda x: x.isNotNull())
    g = t.withColumn("band", F.explode(bands)).groupBy("band").agg(F.count("*").alias("trades"), reports.share(F.col("outcome") == "win").alias("win_rate"), F.avg("pnl_pct").alias("avg_pnl"))
    return tidy(g, ["band", "trades"], ["win_rate", "avg_pnl"], 5)


def _uniform_sql(key: str, rep: str, salt: int) -> str:
    m = f"(({key}) % 1000003 * 7919 + {rep} * 104729 + {salt * 611_953}) % 1000003"
    return f"((({m}) * ({m})) % 1000003 * 48271 + {salt}) % 1000003 / 1000003.0::DOUBLE"


_REPS = 1000
# the whole name as a number
_NAME = "list_sum(list_transform(range(1, length(ticker) + 1), lambda i: ascii(ticker[i]) * (i * 131 + 7)))"
_KEY = "entry_idx * 10007 + CAST(round(pt * 100) AS BIGINT) * 101 + CAST(round(sl * 100) AS BIGINT) + " + _NAME
cte(
    "replicates",
    f"""SELECT rep, sum(500.0 / e * (x - e)) AS pnl, avg(CASE WHEN x > e THEN 1.0 ELSE 0.0 END) AS win_rate FROM (
 SELECT rep, entry_price * (1 + 0.001 + 0.004 * ({_uniform_sql('key', 'rep', 1)})) AS e, exit_price * (1 - 0.001 - 0.004 * ({_uniform_sql('key', 'rep', 2)})) AS x
 FROM (SELECT entry_price, exit_price, {_KEY} AS key FROM trades), (SELECT unnest(range(1, {_REPS + 1})) AS rep)) GROUP BY 1""",
)


@query("monte_carlo_slippage", rounded("", "base mean median p05 p95 mean_win_rate median_win_rate p_loss", f"""SELECT b.base, mean, p[{_REPS // 2 + 1}] AS median, p[{_REPS // 20 + 1}] AS p05, p[{_REPS * 19 // 20 + 1}] AS p95, mean_win_rate, w[{_REPS // 2 + 1}] AS median_win_rate, p_loss FROM (
 SELECT list_sort(list(pnl)) AS p, list_sort(list(win_rate)) AS w, avg(pnl) AS mean, avg(win_rate) AS mean_win_rate, avg(CASE WHEN pnl < 0 THEN 1.0 ELSE 0.0 END) AS p_loss FROM replicates), (SELECT sum(500.0 / entry_price * (exit_price - entry_price)) AS base FROM trades) b""", 4))
def q_mc(spark, sf_dir):
    names = ["base", "mean", "median", "p05", "p95", "mean_win_rate", "median_win_rate", "p_loss"]
    return tidy(reports.monte_carlo(trades(spark, sf_dir), _REPS), [], names, 4)


_SHUFFLES = 20
cte(
    "shuffled_levels",
    f"""SELECT ticker || '#' || rep AS ticker, day, round(lo + (hi - lo) * ({_uniform_sql("date_diff('day', DATE '2000-01-01', day) * 211 + " + _NAME, "rep", 3)}) + 1e-9, 4) AS support, resistance
 FROM levels_daily, (SELECT unnest(range(1, {_SHUFFLES + 1})) AS rep), (SELECT s[CAST(floor(len(s) * 0.05) AS BIGINT) + 1] AS lo, s[least(len(s), CAST(floor(len(s) * 0.95) AS BIGINT) + 1)] AS hi FROM (SELECT list_sort(list(support)) AS s FROM levels_daily))""",
)
cte("bi_x", f"SELECT * REPLACE (ticker || '#' || rep AS ticker) FROM bi, (SELECT unnest(range(1, {_SHUFFLES + 1})) AS rep)")
cte("canda_x", f"SELECT * REPLACE (ticker || '#' || rep AS ticker) FROM canda, (SELECT unnest(range(1, {_SHUFFLES + 1})) AS rep)", kept=True)
_OWN = ("reached", "gated", "session_bars", "armings", "be", "cands", "barr")


def _again(body: str) -> str:
    """A candidate or outcome statement over the shuffled tables."""
    for name, other in (("bi", "bi_x"), ("canda", "canda_x"), ("levels_daily", "shuffled_levels"), ("gridp", "one_grid"), *((n, f"{n}_x") for n in _OWN)):
        body = re.sub(rf"\b{name}\b", other, body)
    return body


cte("one_grid", "SELECT 1.2::DOUBLE AS pt, 0.8::DOUBLE AS sl")
for _name in _OWN:
    cte(f"{_name}_x", _again(CTES[_name]), kept=_name in KEPT)


@query("shuffle_control", rounded("beats_chance", "real mean sd", f"""SELECT *, real > mean + 1.5 * sd AS beats_chance FROM (SELECT avg(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0.0 END) AS real FROM trades WHERE pt = 1.2 AND sl = 0.8),
 (SELECT avg(coalesce(wr, 0)) AS mean, stddev_samp(coalesce(wr, 0)) AS sd FROM (SELECT unnest(range(1, {_SHUFFLES + 1})) AS rep) LEFT JOIN (
 SELECT CAST(split_part(ticker, '#', 2) AS BIGINT) AS rep, avg(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0.0 END) AS wr FROM ({_again(CTES['trades'])}) GROUP BY 1) USING (rep))"""))
def q_shuffle(spark, sf_dir):
    c = candles(spark, sf_dir)
    again = lambda df: reports.replicated(df, _SHUFFLES)
    entries = reports.shuffled_entries(levels_daily(spark, sf_dir).select("ticker", "day", "support", "resistance"), _SHUFFLES)
    bars_x = again(c.select("ticker", "ts", "idx", "open", "high", "low", "close"))
    found = outcomes.candidates(bars_x, entries, outcomes.gate_patterns(again(c), entries))
    fake = outcomes.first_barrier(outcomes.barriers(outcomes.with_grid(found, [(1.2, 0.8)])), bars_x)
    real = trades(spark, sf_dir).where("pt = 1.2 AND sl = 0.8")
    return tidy(reports.shuffle_control(real, fake, _SHUFFLES), ["beats_chance"], ["real", "mean", "sd"])


@query("daily_ledger", rounded("day trades wins", "pnl equity", """SELECT *, sum(pnl) OVER (ORDER BY day) AS equity FROM (SELECT CAST(exit_ts AS DATE) AS day, count(*) AS trades, count(*) FILTER (outcome = 'win') AS wins, sum(pnl_pct) AS pnl FROM trades GROUP BY 1)""", 4))
def q_ledger(spark, sf_dir):
    g = trades(spark, sf_dir).groupBy(F.to_date("exit_ts").alias("day")).agg(F.count("*").alias("trades"), reports.count_if(F.col("outcome") == "win").alias("wins"), F.sum("pnl_pct").alias("pnl"))
    from pyspark.sql import Window

    g = g.withColumn("equity", F.sum("pnl").over(Window.partitionBy(F.lit(1)).orderBy("day")))  # one row per day
    return tidy(g, ["day", "trades", "wins"], ["pnl", "equity"], 4)


@query("circuit_breaker_inputs", rounded("ticker day closed opened", "pnl", """SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.day, b.day) AS day, coalesce(closed, 0) AS closed, coalesce(opened, 0) AS opened, coalesce(pnl, 0) AS pnl
 FROM (SELECT ticker, CAST(exit_ts AS DATE) AS day, count(*) AS closed, sum(pnl_pct) AS pnl FROM trades GROUP BY 1, 2) a FULL JOIN (SELECT ticker, CAST(entry_ts AS DATE) AS day, count(*) AS opened FROM trades GROUP BY 1, 2) b ON a.ticker = b.ticker AND a.day = b.day""", 4))
def q_breaker(spark, sf_dir):
    t = trades(spark, sf_dir)
    both = F.array(F.struct(F.to_date("exit_ts").alias("day"), F.lit(1).alias("c"), F.lit(0).alias("o"), F.col("pnl_pct").alias("p")), F.struct(F.to_date("entry_ts").alias("day"), F.lit(0).alias("c"), F.lit(1).alias("o"), F.lit(0.0).alias("p")))
    g = t.select("ticker", F.explode(both).alias("e")).groupBy("ticker", "e.day").agg(F.sum("e.c").alias("closed"), F.sum("e.o").alias("opened"), F.sum("e.p").alias("pnl"))
    return tidy(g, ["ticker", "day", "closed", "opened"], ["pnl"], 4)


@query("fill_rollup", rounded("pattern ticker trades", "pnl sharpe", "SELECT pattern, ticker, count(*) AS trades, sum(pnl_pct) AS pnl, coalesce(avg(pnl_pct) / nullif(stddev_samp(pnl_pct), 0) * sqrt(252), 0) AS sharpe FROM trades GROUP BY ROLLUP (pattern, ticker)", 4))
def q_rollup(spark, sf_dir):
    from ..functions.core import ROOT_YEAR, div, nz

    g = trades(spark, sf_dir).rollup("pattern", "ticker").agg(F.count("*").alias("trades"), F.sum("pnl_pct").alias("pnl"), nz(div(F.avg("pnl_pct"), F.stddev_samp("pnl_pct")) * ROOT_YEAR).alias("sharpe"))
    return tidy(g, ["pattern", "ticker", "trades"], ["pnl", "sharpe"], 4)


@query("tuned_stop_per_ticker", rounded("ticker n", "pt_median", """SELECT ticker, n, CASE WHEN n >= 3 THEN m ELSE g END AS pt_median FROM (SELECT ticker, count(*) AS n, quantile_cont(pnl_pct, 0.5) AS m FROM trades WHERE outcome = 'win' GROUP BY 1), (SELECT quantile_cont(pnl_pct, 0.5) AS g FROM trades WHERE outcome = 'win')""", 4))
def q_tuned(spark, sf_dir):
    w = trades(spark, sf_dir).where("outcome = 'win'")
    g = w.groupBy("ticker").agg(F.count("*").alias("n"), F.percentile("pnl_pct", 0.5).alias("m")).join(F.broadcast(w.agg(F.percentile("pnl_pct", 0.5).alias("g"))))
    return tidy(g.withColumn("pt_median", F.when(F.col("n") >= 3, F.col("m")).otherwise(F.col("g"))), ["ticker", "n"], ["pt_median"], 4)


# ---- daily statistics -----------------------------------------------------------------

_O = "OVER (PARTITION BY ticker ORDER BY date)"


def _w(n):
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _enrich(src: str) -> str:
    return f"""SELECT *, volume / vol_20d_avg AS vol_ratio, vol_10d_ann / nullif(vol_30d_ann, 0) AS vol_regime FROM (
 SELECT *, (open - pc) / pc * 100 AS gap_pct, (high - low) / open * 100 AS intraday_range, (open - low) / open * 100 AS drop_from_open, (high - open) / open * 100 AS rise_from_open,
 (close - open) / open * 100 AS open_to_close, (close - low) / nullif(high - low, 0) AS close_in_range, (next_open - close) / close * 100 AS overnight_ret,
 CASE WHEN count(*) {_w(20)} = 20 THEN avg(volume) {_w(20)} END AS vol_20d_avg, CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year, CAST(isodow(date) - 1 AS INTEGER) AS dow,
 month(date) = 3 AS is_march, (day(date) - 1) // 7 + 1 AS week_of_month, CASE WHEN count(ret) {_w(10)} = 10 THEN stddev_samp(ret) {_w(10)} END * sqrt(252) * 100 AS vol_10d_ann,
 CASE WHEN count(ret) {_w(30)} = 30 THEN stddev_samp(ret) {_w(30)} END * sqrt(252) * 100 AS vol_30d_ann, {', '.join(f'(close / lag(close, {n}) {_O} - 1) * 100 AS mom_{n}d' for n in (5, 10, 20))}
 FROM (SELECT *, lag(close) {_O} AS pc, close / lag(close) {_O} - 1 AS ret, lead(open) {_O} AS next_open FROM {src}))"""


cte("en", _enrich("daily"))
cte("enp", _enrich("panel"))


def enriched(spark, sf_dir):
    """Not staged: every query computes the columns that it reads, a fraction of the table."""
    return reports.enrich(daily(spark, sf_dir))


@once("enriched_panel")
def enriched_panel(spark, sf_dir):
    return reports.enrich(panel(spark, sf_dir))


EV = ["gap_pct", "intraday_range", "drop_from_open", "rise_from_open", "open_to_close", "close_in_range", "overnight_ret", "vol_ratio", "vol_10d_ann", "vol_regime", "mom_5d", "mom_20d"]


@query("daily_enrichment", rounded("ticker date month year dow is_march week_of_month", EV, "SELECT * FROM en", 4))
def q_enrich(spark, sf_dir):
    return tidy(enriched(spark, sf_dir), ["ticker", "date", "month", "year", "dow", "is_march", "week_of_month"], EV, 4)


@query("march_peak_distance", rounded("ticker date", "from_peak", "SELECT ticker, date, close / max(close) FILTER (month(date) = 3) OVER (PARTITION BY ticker) - 1 AS from_peak FROM daily"))
def q_peak(spark, sf_dir):
    return tidy(reports.peak_distance(daily(spark, sf_dir)), ["ticker", "date"], ["from_peak"])


RULES = {
    "deep_drop": lambda: F.col("drop_from_open") >= 3.0,
    "volume_surge": lambda: F.col("vol_ratio") > 2.0,
    "calm_to_wild": lambda: F.col("vol_regime") > 1.5,
    "weak_close": lambda: F.col("close_in_range") < 0.1,
    "momentum_up": lambda: (F.col("mom_5d") > 5) & (F.col("mom_20d") > 0),
}


@query("forward_signals", "SELECT ticker, date, signal, CAST(coalesce(fired, 0) AS INTEGER) AS fired FROM (" + " UNION ALL ".join(f"SELECT ticker, date, '{n}' AS signal, CASE WHEN {c} THEN 1 ELSE 0 END AS fired FROM en" for n, c in (("deep_drop", "drop_from_open >= 3.0"), ("volume_surge", "vol_ratio > 2.0"), ("calm_to_wild", "vol_regime > 1.5"), ("weak_close", "close_in_range < 0.1"), ("momentum_up", "mom_5d > 5 AND mom_20d > 0"))) + ")")
def q_signals(spark, sf_dir):
    return reports.fired_signals(enriched(spark, sf_dir), RULES)


OE = ["freq_pct", "win_rate", "avg_win", "avg_loss", "payoff", "avg_ret", "ev", "total_ret", "sharpe", "max_drawdown"]


# compounded signal returns in order of date and ticker, with the peak so far (1 at the start)
cte(
    "edge_rows",
    """SELECT t, y, date, ticker, ln(1 + overnight_ret / 100) AS lx FROM (SELECT ticker AS t, CAST(NULL AS INTEGER) AS y, * FROM en UNION ALL SELECT NULL, CAST(year AS INTEGER), * FROM en UNION ALL SELECT NULL, NULL, * FROM en)
 WHERE drop_from_open >= 2.0 AND overnight_ret IS NOT NULL""",
)
cte(
    "edge_falls",
    """SELECT t, y, min(exp(cum - greatest(peak, 0)) - 1) AS max_drawdown FROM (SELECT *, max(cum) OVER (PARTITION BY t, y ORDER BY date, ticker) AS peak FROM (
 SELECT *, sum(lx) OVER (PARTITION BY t, y ORDER BY date, ticker) AS cum FROM edge_rows)) GROUP BY 1, 2""",
)


@query("overnight_edge", rounded("ticker year n", OE, """SELECT e.*, f.max_drawdown FROM (SELECT *, abs(avg_win / nullif(avg_loss, 0)) AS payoff, win_rate * avg_win + (1 - win_rate) * avg_loss AS ev FROM (SELECT ticker, year, count(*) FILTER (s) AS n, count(*) FILTER (s) / count(*)::DOUBLE * 100 AS freq_pct,
 avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) FILTER (s) AS win_rate, coalesce(avg(x) FILTER (s AND x > 0), 0) AS avg_win, coalesce(avg(x) FILTER (s AND x <= 0), 0) AS avg_loss, avg(x) FILTER (s) AS avg_ret, exp(sum(ln(1 + x)) FILTER (s)) - 1 AS total_ret,
 coalesce(avg(x) FILTER (s) / nullif(stddev_samp(x) FILTER (s), 0) * sqrt(252), 0) AS sharpe FROM (SELECT *, overnight_ret / 100 AS x, drop_from_open >= 2.0 AS s FROM en WHERE overnight_ret IS NOT NULL) GROUP BY GROUPING SETS ((ticker), (year), ())) WHERE n > 0) e LEFT JOIN edge_falls f ON f.t IS NOT DISTINCT FROM e.ticker AND f.y IS NOT DISTINCT FROM e.year""", 5))
def q_overnight(spark, sf_dir):
    return tidy(reports.overnight_edge(enriched(spark, sf_dir), 2.0), ["ticker", "year", "n"], OE, 5)


@query("drop_threshold_sweep", rounded("ticker threshold n", "avg_ret win_rate freq", """SELECT ticker, threshold, count(*) FILTER (s) AS n, avg(overnight_ret) FILTER (s) AS avg_ret, avg(CASE WHEN overnight_ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (s) AS win_rate, count(*) FILTER (s) / count(*)::DOUBLE AS freq
 FROM (SELECT *, drop_from_open >= threshold AS s FROM en, (SELECT unnest([0.5, 1.0, 2.0, 3.0, 4.0]::DOUBLE[]) AS threshold) WHERE overnight_ret IS NOT NULL) GROUP BY 1, 2""", 5))
def q_thresholds(spark, sf_dir):
    return tidy(reports.threshold_sweep(enriched(spark, sf_dir), [0.5, 1.0, 2.0, 3.0, 4.0]), ["ticker", "threshold", "n"], ["avg_ret", "win_rate", "freq"], 5)


@query("monthly_cube", rounded("year month n", "avg_ret sd up_share", "SELECT year, month, count(*) AS n, avg(ret) AS avg_ret, stddev_samp(ret) AS sd, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS up_share FROM en WHERE ret IS NOT NULL GROUP BY CUBE (year, month)"))
def q_monthly(spark, sf_dir):
    return tidy(reports.monthly(enriched(spark, sf_dir)), ["year", "month", "n"], ["avg_ret", "sd", "up_share"])


@query("month_against_rest", rounded("ticker inside n", "avg_ret sd", "SELECT ticker, month = 3 AS inside, count(*) AS n, avg(ret) AS avg_ret, stddev_samp(ret) AS sd FROM en WHERE ret IS NOT NULL GROUP BY 1, 2"))
def q_month_rest(spark, sf_dir):
    return tidy(reports.month_vs_rest(enriched(spark, sf_dir)), ["ticker", "inside", "n"], ["avg_ret", "sd"])


TR = ["var_95", "cvar_95", "sortino", "omega", "kelly", "half_kelly", "ann_vol", "ann_ret"]


@query("tail_risk", rounded("ticker", TR, """SELECT ticker, v * 100 AS var_95, cvar * 100 AS cvar_95, coalesce(mean * 252 / nullif(down * sqrt(252), 0), 0) AS sortino, gain / nullif(pain, 0) AS omega,
 (p * aw / al - (1 - p)) / (aw / al) AS kelly, (p * aw / al - (1 - p)) / (aw / al) / 2 AS half_kelly, sd * sqrt(252) * 100 AS ann_vol, mean * 252 * 100 AS ann_ret FROM (
 SELECT ticker, any_value(v) AS v, avg(ret) FILTER (ret <= v) AS cvar, stddev_samp(ret) FILTER (ret < 0) AS down, avg(ret) AS mean, stddev_samp(ret) AS sd, sum(ret) FILTER (ret > 0) AS gain, -sum(ret) FILTER (ret <= 0) AS pain,
 avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(ret) FILTER (ret > 0) AS aw, abs(avg(ret) FILTER (ret <= 0)) AS al FROM en JOIN (SELECT ticker, quantile_cont(ret, 0.05) AS v FROM en GROUP BY 1) USING (ticker) WHERE ret IS NOT NULL GROUP BY 1)""", 5))
def q_tail(spark, sf_dir):
    return tidy(reports.tail_risk(enriched(spark, sf_dir)), ["ticker"], TR, 5)


@query("spread_estimates", rounded("ticker", "roll_pct hl_pct conservative_pct", f"""SELECT ticker, roll * 100 AS roll_pct, hl * 100 AS hl_pct, greatest(coalesce(roll, 0), hl, 0.02) * 100 AS conservative_pct FROM (SELECT ticker, CASE WHEN c < 0 THEN 2 * sqrt(-c) END AS roll, hl FROM (
 SELECT ticker, covar_samp(ret, lr) AS c, avg(k2) * 0.5 AS hl FROM (SELECT *, lag(ret) {_O} AS lr, CASE WHEN count(*) {_w(2)} = 2 THEN sqrt(avg(ln(high / low) ** 2) {_w(2)}) END AS k2 FROM en) GROUP BY 1))""", 4))
def q_spreads(spark, sf_dir):
    return tidy(reports.spreads(enriched(spark, sf_dir)), ["ticker"], ["roll_pct", "hl_pct", "conservative_pct"], 4)


_PAIR = "SELECT x.ticker AS a, y.ticker AS b, x.date, x.ret AS ra, y.ret AS rb, x.close AS ca, y.close AS cb, x.month FROM enp x JOIN enp y ON x.date = y.date AND x.ticker < y.ticker"


@query("pair_correlations", rounded("a b n", "corr", f"SELECT a, b, count(*) AS n, covar_samp(ra, rb) / nullif(stddev_samp(ra) * stddev_samp(rb), 0) AS corr FROM ({_PAIR}) WHERE ra IS NOT NULL AND rb IS NOT NULL GROUP BY 1, 2"))
def q_corr(spark, sf_dir):
    return tidy(reports.correlations(enriched_panel(spark, sf_dir)), ["a", "b", "n"], ["corr"])


@query("pair_correlations_by_month", rounded("a b month n", "corr", f"SELECT a, b, month, count(*) AS n, coalesce(covar_samp(ra, rb) / nullif(stddev_samp(ra) * stddev_samp(rb), 0), 0) AS corr FROM ({_PAIR}) WHERE ra IS NOT NULL AND rb IS NOT NULL GROUP BY 1, 2, 3"))
def q_corr_month(spark, sf_dir):
    return tidy(reports.correlations(enriched_panel(spark, sf_dir), "month").withColumnRenamed("month_a", "month"), ["a", "b", "month", "n"], ["corr"])


@query("lead_lag_correlation", rounded("lag", "corr", "SELECT k AS lag, covar_samp(x, ry) / (stddev_samp(x) * stddev_samp(ry)) AS corr FROM (" + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k, lag(rx, {k}) OVER (ORDER BY date) AS x, ry FROM (SELECT p.date, p.ret AS rx, q.ret AS ry FROM enp p JOIN enp q ON p.date = q.date WHERE p.ticker = 'NATION_1' AND q.ticker = 'NATION_2')" for k in range(6)) + ") WHERE x IS NOT NULL AND ry IS NOT NULL GROUP BY 1"))
def q_leadlag(spark, sf_dir):
    return tidy(reports.lead_lag(enriched_panel(spark, sf_dir), "NATION_1", "NATION_2"), ["lag"], ["corr"])


PS = ["hedge", "spread_mean", "spread_std", "z", "half_life", "z_threshold"]


@query("pair_spread_half_life", rounded("a b", PS, f"""SELECT a, b, hedge, m AS spread_mean, sd AS spread_std, (last - m) / nullif(sd, 0) AS z, CASE WHEN k < 0 THEN -ln(2) / k END AS half_life, CASE WHEN k < 0 THEN 0.04 * level / sd END AS z_threshold FROM (
 SELECT a, b, any_value(hedge) AS hedge, avg(s) AS m, stddev_samp(s) AS sd, arg_max(s, date) AS last, regr_slope(s - ls, ls) AS k, any_value(level) AS level FROM (SELECT *, lag(s) OVER (PARTITION BY a, b ORDER BY date) AS ls FROM (
 SELECT p.*, hedge, level, ca - hedge * cb AS s FROM ({_PAIR}) p JOIN (SELECT a, b, regr_slope(ca, cb) AS hedge, avg(ca) AS level FROM ({_PAIR}) GROUP BY 1, 2) f USING (a, b))) GROUP BY 1, 2)""", 4))
def q_pairs(spark, sf_dir):
    return tidy(reports.pair_spreads(panel(spark, sf_dir)), ["a", "b"], PS, 4)


@query("two_sample_tests", rounded("ticker n1 n2", "t_stat u z", """SELECT ticker, n1, n2, t_stat, r1 - n1 * (n1 + 1) / 2.0 AS u, (r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0) AS z FROM (
 SELECT ticker, count(*) FILTER (month = 3) AS n1, count(*) FILTER (month <> 3) AS n2, sum(rk) FILTER (month = 3) AS r1, avg(ret) FILTER (month = 3) / (stddev_samp(ret) FILTER (month = 3) / sqrt(count(*) FILTER (month = 3))) AS t_stat FROM (
 SELECT *, rank() OVER (PARTITION BY ticker ORDER BY ret) + (count(*) OVER (PARTITION BY ticker, ret) - 1) / 2.0 AS rk FROM en WHERE ret IS NOT NULL) GROUP BY 1)"""))
def q_tests(spark, sf_dir):
    return tidy(reports.two_sample(enriched(spark, sf_dir)), ["ticker", "n1", "n2"], ["t_stat", "u", "z"])


@query("permutation_test")
def q_perm(spark, sf_dir):
    return tidy(reports.permutation_test(enriched(spark, sf_dir), reps=50), ["ticker"], ["real_difference", "p_value"])


@query("bootstrap_sharpe")
def q_boot(spark, sf_dir):
    return tidy(reports.bootstrap_sharpe(enriched(spark, sf_dir), reps=50), ["ticker"], ["lo", "mid", "hi"], 4)


@query("mean_without_top_returns", rounded("ticker n", "mean t_stat", "SELECT ticker, count(*) AS n, avg(ret) AS mean, avg(ret) / (stddev_samp(ret) / sqrt(count(*))) AS t_stat FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ret DESC, date) AS k FROM en WHERE ret IS NOT NULL) WHERE k > 2 GROUP BY 1"))
def q_top2(spark, sf_dir):
    return tidy(reports.without_top(enriched(spark, sf_dir)), ["ticker", "n"], ["mean", "t_stat"])


_BJ = "SELECT x.*, y.ret AS b FROM enp x JOIN enp y ON x.date = y.date AND y.ticker = 'NATION_3' WHERE x.ticker <> 'NATION_3' AND x.ret IS NOT NULL AND y.ret IS NOT NULL"


@query("benchmark_premium", rounded("ticker", "beta excess", f"""SELECT ticker, any_value(beta) AS beta, sum(ret - beta * b) AS excess FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM ({_BJ}))
 JOIN (SELECT ticker, covar_samp(ret, b) / var_samp(b) AS beta FROM ({_BJ}) GROUP BY 1) USING (ticker) WHERE k <= 5 GROUP BY 1"""))
def q_premium(spark, sf_dir):
    return tidy(reports.premium(enriched_panel(spark, sf_dir), "NATION_3"), ["ticker"], ["beta", "excess"])


def _pb(n):
    w = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(*) {w} = {n} THEN covar_samp(ret, b) {w} / nullif(var_samp(b) {w}, 0) END AS beta_{n}"


@query("rolling_prior_beta", rounded("ticker date", "beta_5 beta_20", f"SELECT ticker, date, {_pb(5)}, {_pb(20)} FROM ({_BJ})", 5))
def q_prior_beta(spark, sf_dir):
    return tidy(reports.prior_beta(enriched_panel(spark, sf_dir), "NATION_3"), ["ticker", "date"], ["beta_5", "beta_20"], 5)


@query("floor_sensitivity", rounded("ticker price hedge", "floor_value", """SELECT ticker, price, hedge, close * (hedge + (1 - hedge) * price / 100) AS floor_value FROM (SELECT ticker, arg_max(close, date) AS close FROM daily GROUP BY 1),
 (SELECT unnest([60.0, 80.0, 100.0]::DOUBLE[]) AS price), (SELECT unnest([0.0, 0.5, 1.0]::DOUBLE[]) AS hedge)"""))
def q_floor(spark, sf_dir):
    base = daily(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "date").alias("close"))
    return tidy(reports.floor_grid(base, [60, 80, 100], [0, 0.5, 1]), ["ticker", "price", "hedge"], ["floor_value"])
