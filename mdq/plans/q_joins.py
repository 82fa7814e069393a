"""Registered queries: joins, predicates, set operations, table upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.core import nz, tidy
from ..operators import calendar, decisions, factors, joins, portfolio, reports, risk
from ..session import shared_folder
from ..sources import store
from ..sources.adapters import table
from .inputs import bars, daily, once, panel
from .q_intraday import levels_daily
from .q_levels import trades
from .q_portfolio import bench, periods, walk
from .q_risk import combined, q_flags, regimes, sales
from .registry import cte, query, rounded


def ev(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


@query("join_asof_backward", "SELECT user_id, ts, event_id, value, seen FROM (SELECT p.user_id, p.ts, p.event_id, p.value, v.value AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts)")
def q_asof(spark, sf_dir):
    e = ev(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    right = e.where("event_type = 'view'").select("user_id", "ts", "event_id", F.col("value").alias("seen"))
    return joins.asof_backward(left, right, "user_id", "ts", ["seen"], "event_id")


@query("join_asof_entry_or_first", "SELECT user_id, event_id, coalesce(seen, first_seen) AS level FROM (SELECT p.user_id, p.event_id, v.value AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts) LEFT JOIN (SELECT user_id, arg_min(value, ts) AS first_seen FROM events WHERE event_type = 'view' GROUP BY 1) USING (user_id)")
def q_asof_first(spark, sf_dir):
    first = ev(spark, sf_dir).where("event_type = 'view'").groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("first_seen"))
    return q_asof(spark, sf_dir).join(first, "user_id", "left").select("user_id", "event_id", F.coalesce("seen", "first_seen").alias("level"))


@query("join_nearest_date", rounded("ticker wanted stored", "close", """SELECT ticker, wanted, date AS stored, close FROM (SELECT w.ticker, w.wanted, d.date, d.close, row_number() OVER (PARTITION BY w.ticker, w.wanted ORDER BY abs(d.date - w.wanted), d.date) AS k
 FROM (SELECT DISTINCT ticker, CAST(date_trunc('month', date) AS DATE) AS wanted FROM daily) w JOIN daily d ON d.ticker = w.ticker AND d.date BETWEEN w.wanted - 5 AND w.wanted + 5) WHERE k = 1""", 4))
def q_nearest_date(spark, sf_dir):
    d = daily(spark, sf_dir).select("ticker", "date", "close")
    wanted = d.select("ticker", F.trunc("date", "month").alias("date")).distinct()
    return tidy(joins.nearest_date(wanted, d, "ticker"), ["ticker", "wanted", "stored"], ["close"], 4)


@query("join_nearest_bar", rounded("event_id bar_ts", "close", """SELECT event_id, ts2 AS bar_ts, close FROM (SELECT e.event_id, b.ts AS ts2, b.close, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch_us(e.ts) - epoch_us(b.ts)), b.ts) AS k
 FROM events e JOIN bars b ON b.ticker = e.event_type) WHERE k = 1""", 4))
def q_nearest_bar(spark, sf_dir):
    pts = table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("ticker"))
    return tidy(joins.nearest_bar(pts, bars(spark, sf_dir), "ticker"), ["event_id", "bar_ts"], ["close"], 4)


@query("join_inner_alignment", rounded("date", "x y", "SELECT a.date, a.close AS x, b.close AS y FROM panel a JOIN panel b ON a.date = b.date WHERE a.ticker = 'NATION_1' AND b.ticker = 'NATION_2'", 4))
def q_align(spark, sf_dir):
    p = panel(spark, sf_dir)
    a = p.where("ticker = 'NATION_1'").select("date", F.col("close").alias("x"))
    return tidy(a.join(p.where("ticker = 'NATION_2'").select("date", F.col("close").alias("y")), "date"), ["date"], ["x", "y"], 4)


@query("join_aligned_bars", rounded("ts", "click error purchase signup view", """SELECT ts, max(c) FILTER (ticker = 'click') AS click, max(c) FILTER (ticker = 'error') AS error, max(c) FILTER (ticker = 'purchase') AS purchase, max(c) FILTER (ticker = 'signup') AS signup, max(c) FILTER (ticker = 'view') AS view FROM (
 SELECT t.ticker, d.ts, last_value(b.close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS c FROM (SELECT ticker, min(ts) AS lo FROM bars GROUP BY 1) t JOIN (SELECT DISTINCT ts FROM bars) d ON d.ts >= t.lo LEFT JOIN bars b ON b.ticker = t.ticker AND b.ts = d.ts)
 GROUP BY 1 HAVING count(c) = 5""", 4))
def q_aligned(spark, sf_dir):
    names = ["click", "error", "purchase", "signup", "view"]
    g = calendar.fill_grid(bars(spark, sf_dir).select("ticker", "ts", "close"), ["close"], limit=3, step="1 hour", order="ts")
    wide = g.groupBy("ts").pivot("ticker", names).agg(F.max("close")).dropna(subset=names)
    return tidy(wide, ["ts"], names, 4)


CRISES = [("wave_1", "1997-07-01", "1998-03-31"), ("wave_2", "2000-03-01", "2001-09-30")]


def _crises(spark):
    return spark.createDataFrame(CRISES, "name string, start string, end string").select("name", F.to_date("start").alias("start"), F.to_date("end").alias("end"))


_CR = "(SELECT * FROM (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in CRISES) + ") c(name, s, e))"


@query("join_crisis_windows", rounded("name ticker n", "avg_ret worst", f"SELECT name, ticker, count(*) AS n, avg(ret) AS avg_ret, min(ret) AS worst FROM enp JOIN {_CR} ON date BETWEEN s AND e WHERE ret IS NOT NULL GROUP BY 1, 2"))
def q_crisis(spark, sf_dir):
    r = portfolio.returns(panel(spark, sf_dir)).where("r is not null")
    g = joins.within_windows(r, _crises(spark)).groupBy("name", "ticker").agg(F.count("*").alias("n"), F.avg("r").alias("avg_ret"), F.min("r").alias("worst"))
    return tidy(g, ["name", "ticker", "n"], ["avg_ret", "worst"])


@query("join_period_returns", rounded("period_id ticker n", "ret", "SELECT period_id, ticker, count(*) AS n, exp(sum(ln(1 + ret))) - 1 AS ret FROM enp JOIN periods ON date BETWEEN test_start AND test_end WHERE ret IS NOT NULL GROUP BY 1, 2"))
def q_period_returns(spark, sf_dir):
    r = portfolio.returns(panel(spark, sf_dir)).where("r is not null")
    w = periods(spark, sf_dir).select(F.col("period_id").cast("bigint").alias("period_id"), F.col("test_start").alias("start"), F.col("test_end").alias("end"))
    g = joins.within_windows(r, w).groupBy("period_id", "ticker").agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("ret"))
    return tidy(g, ["period_id", "ticker", "n"], ["ret"])


@query("join_dilution_lookback", "SELECT ticker, date, CAST(max(CASE WHEN f.fdate IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS flagged FROM sales s LEFT JOIN (SELECT ticker AS t, date AS fdate FROM dflag WHERE flag = 1) f ON f.t = s.ticker AND f.fdate BETWEEN s.date - 10 AND s.date GROUP BY 1, 2")
def q_lookback(spark, sf_dir):
    hot = q_flags(spark, sf_dir).where("flag = 1").select("ticker", F.explode(F.sequence(F.col("date"), F.date_add("date", 10))).alias("date")).distinct()
    s = sales(spark, sf_dir).select("ticker", "date")
    return s.join(hot.withColumn("flagged", F.lit(1)), ["ticker", "date"], "left").select("ticker", "date", nz(F.col("flagged"), 0).cast("int").alias("flagged"))


cte_tr = "SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) / 1000 AS pnl, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2"


@once("fills")
def fills(spark, sf_dir):
    """Daily fills per supplier: count, value, result flag (R counts as a loss)."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"))
    return d.agg(F.count("*").alias("n"), (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000).alias("pnl"), F.max("l_returnflag").alias("flag"))


@query("win_rate_by_regime", rounded("vol_regime n", "win_rate spread", f"SELECT *, max(win_rate) OVER () - min(win_rate) OVER () AS spread FROM (SELECT vol_regime, count(*) AS n, avg(CASE WHEN flag <> 'R' THEN 1.0 ELSE 0.0 END) AS win_rate FROM ({cte_tr}) JOIN regs USING (ticker, date) WHERE vol_regime IS NOT NULL GROUP BY 1)"))
def q_by_regime(spark, sf_dir):
    j = fills(spark, sf_dir).join(regimes(spark, sf_dir).where("vol_regime is not null"), ["ticker", "date"])
    g = j.groupBy("vol_regime").agg(F.count("*").alias("n"), reports.share(F.col("flag") != "R").alias("win_rate"))
    s = g.agg((F.max("win_rate") - F.min("win_rate")).alias("spread"))
    return tidy(g.join(F.broadcast(s)), ["vol_regime", "n"], ["win_rate", "spread"])


@query("dilution_recall", rounded("losses wins", "recall false_positive", f"SELECT count(*) FILTER (flag = 'R') AS losses, count(*) FILTER (flag <> 'R') AS wins, avg(f) FILTER (flag = 'R') AS recall, avg(f) FILTER (flag <> 'R') AS false_positive FROM (SELECT t.*, d.exit::DOUBLE AS f FROM ({cte_tr}) t JOIN dflag d USING (ticker, date))"))
def q_recall(spark, sf_dir):
    j = fills(spark, sf_dir).join(q_flags(spark, sf_dir).select("ticker", "date", F.col("exit").cast("double").alias("f")), ["ticker", "date"])
    loss = F.col("flag") == "R"
    return tidy(j.agg(reports.count_if(loss).alias("losses"), reports.count_if(~loss).alias("wins"), F.avg(F.when(loss, F.col("f"))).alias("recall"), F.avg(F.when(~loss, F.col("f"))).alias("false_positive")), ["losses", "wins"], ["recall", "false_positive"])


@query("filtered_vs_actual_fills", rounded("kept n", "pnl", f"SELECT f = 0 AS kept, count(*) AS n, sum(pnl) AS pnl FROM (SELECT t.*, d.exit AS f FROM ({cte_tr}) t JOIN dflag d USING (ticker, date)) GROUP BY 1", 2))
def q_filtered(spark, sf_dir):
    j = fills(spark, sf_dir).join(q_flags(spark, sf_dir), ["ticker", "date"])
    return tidy(j.groupBy((F.col("exit") == 0).alias("kept")).agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl")), ["kept", "n"], ["pnl"], 2)


@query("anti_join_without_events", "SELECT 'S' || s_suppkey AS ticker FROM supplier WHERE NOT EXISTS (SELECT 1 FROM dflag WHERE flag = 1 AND ticker = 'S' || s_suppkey)")
def q_anti(spark, sf_dir):
    all_ = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"))
    return all_.join(q_flags(spark, sf_dir).where("flag = 1").select("ticker"), "ticker", "left_anti")


@query("semi_join_tradeable", "SELECT ticker, count(*) AS n FROM daily WHERE ticker IN (SELECT 'S' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')) GROUP BY 1")
def q_semi(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))), F.col("n_regionkey") == F.col("r_regionkey"))
    ok = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"))
    return daily(spark, sf_dir).join(ok, "ticker", "left_semi").groupBy("ticker").agg(F.count("*").alias("n"))


@query("universe_dimension", "SELECT r_name AS sector, count(*) AS tickers, count(*) FILTER (s_acctbal > 0) AS tradeable FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def q_universe(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy(F.col("r_name").alias("sector")).agg(F.count("*").alias("tickers"), reports.count_if(F.col("s_acctbal") > 0).alias("tradeable"))


@query("universe_union_and_difference", "(SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def q_union(spark, sf_dir):
    u = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, sf_dir, "customer").select("c_nationkey")).distinct()
    return u.exceptAll(table(spark, sf_dir, "nation").where("n_regionkey = 0").select("n_nationkey"))


@query("universe_date_intersection", "SELECT date FROM panel WHERE ticker = 'NATION_1' INTERSECT SELECT date FROM panel WHERE ticker = 'NATION_4'")
def q_intersect(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.where("ticker = 'NATION_1'").select("date").intersect(p.where("ticker = 'NATION_4'").select("date"))


@query("universe_fingerprint", "SELECT substr(md5(string_agg(DISTINCT ticker, ',' ORDER BY ticker)), 1, 8) AS fingerprint FROM panel")
def q_fingerprint(spark, sf_dir):
    return store.universe_fingerprint(panel(spark, sf_dir))


@query("strategy_vs_benchmark", rounded("strategy beats", "avg_ret avg_alpha", "SELECT strategy, count(*) FILTER (w.total_return > b.total_return) AS beats, avg(w.total_return) AS avg_ret, avg(w.total_return - b.total_return) AS avg_alpha FROM wf w JOIN bench b USING (period_id) GROUP BY 1"))
def q_vs(spark, sf_dir):
    b = bench(spark, sf_dir).select("period_id", F.col("total_return").alias("b"))
    j = walk(spark, sf_dir).join(F.broadcast(b), "period_id")
    return tidy(j.groupBy("strategy").agg(reports.count_if(F.col("total_return") > F.col("b")).alias("beats"), F.avg("total_return").alias("avg_ret"), F.avg(F.col("total_return") - F.col("b")).alias("avg_alpha")), ["strategy", "beats"], ["avg_ret", "avg_alpha"])


@query("alpha_by_period", rounded("strategy period_id", "alpha", "SELECT strategy, w.period_id, w.total_return - coalesce(b.total_return, 0) AS alpha FROM wf w LEFT JOIN bench b ON b.period_id = w.period_id"))
def q_alpha(spark, sf_dir):
    b = bench(spark, sf_dir).select("period_id", F.col("total_return").alias("b"))
    return tidy(walk(spark, sf_dir).join(b, "period_id", "left").withColumn("alpha", F.col("total_return") - nz(F.col("b"))), ["strategy", "period_id"], ["alpha"])


@query("kpi_block", rounded("strategy", "avg_ret cumulative alpha calmar", "SELECT strategy, avg(w.total_return) AS avg_ret, exp(sum(ln(1 + w.total_return))) - 1 AS cumulative, avg(w.total_return - coalesce(b.total_return, 0)) AS alpha, avg(w.total_return) / nullif(max(w.max_drawdown), 0) AS calmar FROM wf w LEFT JOIN bench b ON b.period_id = w.period_id GROUP BY 1"))
def q_kpi(spark, sf_dir):
    from ..functions.core import div

    b = bench(spark, sf_dir).select("period_id", F.col("total_return").alias("b"))
    g = walk(spark, sf_dir).join(b, "period_id", "left").groupBy("strategy").agg(F.avg("total_return").alias("avg_ret"), (F.exp(F.sum(F.log1p("total_return"))) - 1).alias("cumulative"), F.avg(F.col("total_return") - nz(F.col("b"))).alias("alpha"), div(F.avg("total_return"), F.max("max_drawdown")).alias("calmar"))
    return tidy(g, ["strategy"], ["avg_ret", "cumulative", "alpha", "calmar"])


@query("compounded_equity", rounded("strategy period_id", "equity", "SELECT strategy, period_id, 10000 * exp(sum(ln(1 + total_return)) OVER (PARTITION BY strategy ORDER BY period_id)) AS equity FROM wf", 3))
def q_equity(spark, sf_dir):
    return tidy(decisions.compound(walk(spark, sf_dir), ["strategy"], ["period_id"], "total_return", 10000.0), ["strategy", "period_id"], ["equity"], 3)


# ---- predicates -----------------------------------------------------------------------


@query("bar_quality_filter", "SELECT ticker, ts FROM nyday WHERE volume >= 100 AND (high - low) / close * 1e4 <= 200 AND hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') * 60 + minute(ts) BETWEEN 570 AND 960")
def q_quality(spark, sf_dir):
    return decisions.quality(bars(spark, sf_dir)).select("ticker", "ts")


@query("session_predicate", "SELECT ticker, ts, CASE WHEN m BETWEEN 540 AND 805 THEN 'pre_market' WHEN m BETWEEN 810 AND 1200 THEN 'market_open' WHEN m BETWEEN 1200 AND 1435 THEN 'after_hours' ELSE 'unknown' END AS session, (m >= 1320 OR m <= 120) AS overnight FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM bars)")
def q_session(spark, sf_dir):
    from ..operators.outcomes import in_session, session_of

    return bars(spark, sf_dir).select("ticker", "ts", session_of(F.col("ts")).alias("session"), in_session(F.col("ts"), F.lit(1320), F.lit(120)).alias("overnight"))


@query("stale_levels", "SELECT b.ticker, b.ts, (support IS NULL OR support <= 0 OR abs(close - support) > 0.02 * support) AS stale FROM bi b LEFT JOIN levels_daily l ON l.ticker = b.ticker AND l.day = b.day")
def q_stale(spark, sf_dir):
    j = bars(spark, sf_dir).withColumn("day", F.to_date("ts")).join(levels_daily(spark, sf_dir), ["ticker", "day"], "left")
    return j.select("ticker", "ts", decisions.stale(F.col("support"), F.col("close"), 0.02).alias("stale"))


@query("stale_support_exclusion", rounded("ticker day", "median", "SELECT ticker, day, median FROM (SELECT ticker, day, quantile_cont(px, 0.5) AS median FROM (SELECT ticker, day, open AS px FROM bi UNION ALL SELECT ticker, day, close FROM bi) GROUP BY 1, 2) JOIN levels_daily USING (ticker, day) WHERE median <= support * 1.02", 4))
def q_stale_support(spark, sf_dir):
    return tidy(decisions.stale_support(bars(spark, sf_dir), levels_daily(spark, sf_dir), 0.02), ["ticker", "day"], ["median"], 4)


_GATE = """SELECT ticker, ts, close AS price, high - low AS atr, CASE WHEN isodow(ts) >= 6 THEN 'weekend' WHEN hour(ts) * 60 + minute(ts) < 810 THEN 'outside_hours' WHEN volume / 20 < 5 THEN 'low_score'
 WHEN (close / open - 1) * 100 <= -0.5 THEN 'day_loss' WHEN idx % 5 >= 3 THEN 'too_many_open' WHEN close <= 0 THEN 'no_price' ELSE 'ok' END AS reason FROM bi"""


def _gate_sql(units: str) -> str:
    quantity = f"CASE WHEN reason = 'ok' THEN greatest(CAST({units} AS BIGINT), 1) ELSE 0 END"
    return f"SELECT *, reason = 'ok' AS go, {quantity} AS quantity, CASE WHEN reason = 'ok' THEN round(price * 1.002 + 1e-9, 4) END AS limit_price FROM ({_GATE})"


def _gate_input(spark, sf_dir):
    from pyspark.sql import Window

    b = bars(spark, sf_dir).withColumn("idx", F.row_number().over(Window.partitionBy("ticker").orderBy("ts")))
    pnl = (F.col("close") / F.col("open") - 1) * 100
    return b.select("ticker", "ts", F.col("close").alias("price"), (F.col("high") - F.col("low")).alias("atr"), (F.col("volume") / 20).alias("score"), pnl.alias("day_pnl"), (F.col("idx") % 5).alias("open_positions"))


@query("decision_gate", rounded("ticker ts reason go quantity", "limit_price", _gate_sql("floor(1000 / price)"), 4))
def q_decide(spark, sf_dir):
    return tidy(decisions.decide(_gate_input(spark, sf_dir), max_loss=-0.5), ["ticker", "ts", "reason", "go", "quantity"], ["limit_price"], 4)


@query("decision_gate_by_atr", rounded("ticker ts reason go quantity", "limit_price", _gate_sql("CASE WHEN atr > 0 THEN floor(100 / (atr * 1.5)) ELSE floor(1000 / price) END"), 4))
def q_decide_atr(spark, sf_dir):
    return tidy(decisions.decide(_gate_input(spark, sf_dir), max_loss=-0.5, by_atr=True), ["ticker", "ts", "reason", "go", "quantity"], ["limit_price"], 4)


@query("support_touch_gate", "SELECT ticker, ts, support FROM (SELECT b.*, lag(least(open, close)) OVER (PARTITION BY ticker ORDER BY ts) AS dip FROM bi b) JOIN levels_daily USING (ticker, day) WHERE dip <= support * 1.02 AND close >= support * 0.9")
def q_touch(spark, sf_dir):
    return decisions.touch_gate(bars(spark, sf_dir), levels_daily(spark, sf_dir))


@query("score_gate", "SELECT ticker, day FROM levels_daily LEFT JOIN (SELECT ticker, day, avg(volume) / 20 AS score FROM bi WHERE ticker <> 'view' GROUP BY 1, 2) USING (ticker, day) WHERE score >= 7 OR score IS NULL")
def q_gate(spark, sf_dir):
    s = bars(spark, sf_dir).where("ticker <> 'view'").groupBy("ticker", F.to_date("ts").alias("day")).agg((F.avg("volume") / 20).alias("score"))
    return levels_daily(spark, sf_dir).join(s, ["ticker", "day"], "left").where("score >= 7 or score is null").select("ticker", "day")


@query("signal_slots", "SELECT date, ticker, signal, k FROM (SELECT date, ticker, signal, k FROM (SELECT date, ticker, n::DOUBLE AS signal, row_number() OVER (PARTITION BY date ORDER BY n DESC, ticker) AS k FROM (" + cte_tr + ") WHERE n > 0.5)) LEFT JOIN (SELECT date, count(*) AS used FROM (" + cte_tr + ") WHERE flag = 'A' GROUP BY 1) USING (date) WHERE k <= 3 - coalesce(used, 0)")
def q_slots(spark, sf_dir):
    f = fills(spark, sf_dir)
    return decisions.slots(f.select("date", "ticker", F.col("n").cast("double").alias("signal")), f.where("flag = 'A'").select("date", "ticker"))


cte_ep = """SELECT ticker, episode, min(date) AS begin, max(date) AS until, min(dd) AS depth, arg_min(date, dd) AS trough, count(*) AS rows FROM (
 SELECT *, sum(op) OVER (PARTITION BY ticker ORDER BY date) AS episode FROM (SELECT *, CASE WHEN state = 1 AND coalesce(lag(state) OVER (PARTITION BY ticker ORDER BY date), 0) = 0 THEN 1 ELSE 0 END AS op FROM (
 SELECT *, last_value(CASE WHEN dd < -0.01 THEN 1 WHEN dd >= -0.001 THEN 0 END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM (SELECT *, close / max(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS dd FROM daily)))) WHERE state = 1 GROUP BY 1, 2"""


@query("drawdown_episodes", rounded("ticker begin until trough rows", "depth", cte_ep))
def q_episodes(spark, sf_dir):
    return tidy(decisions.episodes(daily(spark, sf_dir)), ["ticker", "begin", "until", "trough", "rows"], ["depth"])


@query("deepest_drawdowns", rounded("ticker begin", "depth", f"SELECT * FROM ({cte_ep}) ORDER BY depth, ticker, begin LIMIT 5"))
def q_deepest(spark, sf_dir):
    return tidy(decisions.episodes(daily(spark, sf_dir)).orderBy("depth", "ticker", "begin").limit(5), ["ticker", "begin"], ["depth"])


@query("chronological_compounding", rounded("ticker date", "equity", f"SELECT ticker, date, exp(sum(ln(1 + pnl / 10000)) OVER (PARTITION BY ticker ORDER BY date)) AS equity FROM ({cte_tr})", 5))
def q_compound(spark, sf_dir):
    return tidy(decisions.compound(fills(spark, sf_dir).withColumn("x", F.col("pnl") / 10000), ["ticker"], ["date"], "x"), ["ticker", "date"], ["equity"], 5)


@query("feature_categories")
def q_categories(spark, sf_dir):
    d = daily(spark, sf_dir)
    f = factors.compute(d, ["mom_21d", "vol_21d", "rsi_14", "amihud_21d", "skew_21d"])
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in f.columns[2:]])
    long = f.select(F.explode(items).alias("x")).select("x.*")
    return tidy(long.groupBy("feature", factors.category(F.col("feature")).alias("category")).agg(F.avg("value").alias("avg_value")), ["feature", "category"], ["avg_value"], 4)


_RK = ["mom_21d", "vol_21d", "range_position_21d"]


@query("rank_transform", rounded("ticker date feature", "pct", """SELECT ticker, date, feature, CASE WHEN feature = 'range_position_21d' THEN value ELSE (rank() OVER (PARTITION BY date, feature ORDER BY value) + (count(*) OVER (PARTITION BY date, feature, value) - 1) / 2.0) / count(*) OVER (PARTITION BY date, feature) END AS pct FROM (
 SELECT ticker, date, 'mom_21d' AS feature, CASE WHEN rn < 22 THEN 0 ELSE close / lag(close, 21) OVER o - 1 END AS value FROM fx0 WINDOW o AS (PARTITION BY ticker ORDER BY date)
 UNION ALL SELECT ticker, date, 'range_position_21d', CASE WHEN rn < 21 THEN 0.5 ELSE coalesce((close - min(close) OVER w) / nullif(max(close) OVER w - min(close) OVER w, 0), 0.5) END FROM fx0 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))"""))
def q_rank(spark, sf_dir):
    names = ["mom_21d", "range_position_21d"]
    return tidy(factors.rank_transform(factors.compute(daily(spark, sf_dir), names), names), ["ticker", "date", "feature"], ["pct"])


@query("factor_all_features")
def q_all_features(spark, sf_dir):
    f = factors.all_features(panel(spark, sf_dir))
    return tidy(f, ["ticker", "date"], f.columns[2:], 5)


# ---- table upkeep ---------------------------------------------------------------------


@query("coverage_filter", rounded("ticker n", "coverage", "SELECT * FROM (SELECT *, max(coverage) OVER () AS best FROM (SELECT ticker, count(close) AS n, count(close) / (SELECT count(DISTINCT date) FROM panel)::DOUBLE AS coverage FROM panel GROUP BY 1)) WHERE coverage >= CASE WHEN best >= 0.8 THEN 0.8 ELSE 0.5 END"))
def q_coverage(spark, sf_dir):
    return tidy(store.coverage(panel(spark, sf_dir)), ["ticker", "n"], ["coverage"])


@query("panel_slice", "SELECT ticker, date, close FROM daily WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND ticker IN ('S1', 'S2', 'S3')")
def q_slice(spark, sf_dir):
    d = daily(spark, sf_dir).where(F.col("date").between("1997-01-01", "1998-12-31") & F.col("ticker").isin("S1", "S2", "S3"))
    return d.select("ticker", "date", "close")


@query("merge_new_over_old", "SELECT user_id, event_type, arg_max(value, CASE WHEN event_id >= 300 THEN 1e12 ELSE 0 END + event_id) AS value FROM events GROUP BY 1, 2")
def q_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    old = store.keep_last(e.where("event_id < 300"), ["user_id", "event_type"], ["event_id"])
    new = store.keep_last(e.where("event_id >= 300"), ["user_id", "event_type"], ["event_id"])
    return store.merge_over(old, new, ["user_id", "event_type"]).select("user_id", "event_type", "value")


@query("rolling_bar_store", "SELECT ticker, ts, close FROM bars WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 10 DAY")
def q_rolling(spark, sf_dir):
    b = bars(spark, sf_dir)
    return store.rolling_store(b.where("ts < timestamp'2024-01-25'"), b.where("ts >= timestamp'2024-01-20'"), ["ticker", "ts"], 10).select("ticker", "ts", "close")


@query("gap_finder", "SELECT ticker, last, CAST(floor((epoch(now_) - epoch(last)) / 60) AS BIGINT) AS minutes, CAST(floor((epoch(now_) - epoch(last)) / 86400) AS BIGINT) AS days FROM (SELECT *, max(last) OVER () AS now_ FROM (SELECT ticker, max(ts) AS last FROM bars GROUP BY 1))")
def q_gaps(spark, sf_dir):
    return store.freshness(bars(spark, sf_dir))


@query("fetch_plan", "SELECT DISTINCT ticker, day - 3 AS start, day + 2 AS \"end\" FROM levels_daily")
def q_plan(spark, sf_dir):
    return store.fetch_plan(levels_daily(spark, sf_dir))


@query("insert_new_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')")
def q_insert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return store.insert_new(o.where("o_orderdate < timestamp'1996-01-01'"), o.select("o_orderkey", "o_custkey"), ["o_custkey"])


@query("update_exits", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'CLOSED' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def q_update(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    ch = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.lit("CLOSED").alias("o_orderpriority"))
    return store.update_rows(o, ch, "o_orderkey", ["o_orderpriority"])


@query("trade_store_filter", "SELECT ticker, entry_ts, outcome FROM trades WHERE pt = 1.2 AND outcome = 'win' AND ticker IN ('click', 'view')")
def q_filter(spark, sf_dir):
    return trades(spark, sf_dir).where("pt = 1.2 and outcome = 'win' and ticker in ('click', 'view')").select("ticker", "entry_ts", "outcome")


@query("overlay_open_positions", "SELECT ticker, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker, ts ORDER BY v DESC) AS k FROM (SELECT ticker, ts, close, 0 AS v FROM bars UNION ALL SELECT event_type, date_trunc('hour', ts), arg_max(value, event_id), 1 FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2)) WHERE k = 1")
def q_overlay(spark, sf_dir):
    b = bars(spark, sf_dir).select("ticker", "ts", "close")
    held = b.where("ticker in ('click', 'view')").select("ticker").distinct()
    fine = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max_by("value", "event_id").alias("close"))
    return store.merge_over(b, fine.join(held, "ticker", "left_semi"), ["ticker", "ts"])


@query("resample_daily", rounded("ticker day", "open high low close volume", "SELECT ticker, day, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bi GROUP BY 1, 2", 4))
def q_resample(spark, sf_dir):
    g = bars(spark, sf_dir).groupBy("ticker", F.to_date("ts").alias("day")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return tidy(g, ["ticker", "day"], ["open", "high", "low", "close", "volume"], 4)


cte("tod_caps", "SELECT ticker, strftime(ts, '%H:%M') AS tod, quantile_cont(volume, 0.5) * 0.02 AS cap FROM bars GROUP BY 1, 2 HAVING quantile_cont(volume, 0.5) > 0")


@query("time_of_day_liquidity_cap", rounded("ticker tod", "cap", "SELECT * FROM tod_caps"))
def q_tod(spark, sf_dir):
    return tidy(risk.time_of_day_caps(bars(spark, sf_dir)), ["ticker", "tod"], ["cap"])


@query("time_of_day_capped_trades", rounded("ticker entry_ts pt sl", "shares capped", """SELECT ticker, entry_ts, pt, sl, shares, least(shares, coalesce(cap, shares)) AS capped FROM (
 SELECT ticker, entry_ts, pt, sl, floor(1000 / entry_price) AS shares FROM trades) t LEFT JOIN (SELECT ticker AS k, tod, cap FROM tod_caps) c ON k = ticker AND tod = strftime(entry_ts, '%H:%M')""", 4))
def q_tod_trades(spark, sf_dir):
    t = trades(spark, sf_dir).select("ticker", "entry_ts", "pt", "sl", F.floor(1000 / F.col("entry_price")).cast("double").alias("shares"))
    return tidy(risk.cap_by_time_of_day(t, bars(spark, sf_dir)), ["ticker", "entry_ts", "pt", "sl"], ["shares", "capped"], 4)


@query("vessel_census", """SELECT count(*) AS vessels, CAST(sum(CASE WHEN k * 5 > 300 THEN 1 ELSE 0 END) AS BIGINT) AS large, CAST(sum(CASE WHEN k / 4.0 > 15 THEN 1 ELSE 0 END) AS BIGINT) AS laden, count(*) FILTER (value BETWEEN 90 AND 210) AS outbound,
 count(*) FILTER (value BETWEEN 270 AND 360) AS inbound, count(*) FILTER (NOT (value BETWEEN 90 AND 210 OR value BETWEEN 270 AND 360)) AS transit FROM (SELECT user_id, arg_max(value, event_id) AS value, arg_max(CAST(json_extract(props, '$.k') AS INTEGER), event_id) AS k FROM events GROUP BY 1)""")
def q_census(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.from_json("props", "k int").alias("p"))
    last = e.groupBy("user_id").agg(F.max_by(F.struct("value", "p.k"), "event_id").alias("x"))
    return decisions.vessel_counts(last.select(F.col("x.value").alias("course"), (F.col("x.k") / 4.0).alias("draught"), (F.col("x.k") * 5).alias("length")))


@query("feature_store_update", """SELECT run, CASE run WHEN 1 THEN half WHEN 2 THEN total - half ELSE 0 END AS written, stored FROM (SELECT unnest([1, 2, 3]) AS run),
 (SELECT count(*) AS stored, count(DISTINCT date) AS total, count(DISTINCT date) FILTER (year(date) < 1995) AS half FROM (SELECT DISTINCT ticker, CAST(date_trunc('month', date) AS DATE) AS date FROM panel))""")
def q_feature_store(spark, sf_dir):
    """A store of monthly features updated three times: with the early months, with all, and with all again (which writes nothing)."""
    month = F.trunc("date", "month").alias("date")
    f = panel(spark, sf_dir).groupBy("ticker", month).agg(F.avg("close").alias("mean_close"), F.count("*").alias("n"))
    path = f"{shared_folder(spark)}/mdq/{spark.sparkContext.applicationId}/features-{uuid.uuid4().hex}"
    written = [store.update_features(part, path, "nations") for part in (f.where(F.year("date") < 1995), f, f)]
    runs = spark.createDataFrame(list(enumerate(written, 1)), "run int, written bigint")
    return runs.join(spark.read.parquet(path).agg(F.count("*").alias("stored")))  # one row
