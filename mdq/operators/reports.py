"""Aggregate reports over trades and daily prices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import ROOT_YEAR, YEAR, div, last_n, nz, order_window, prior_n
from ..functions.prefix import running_curve
from ..functions.rank import rank_table

WIN, LOSS, TIME = (lambda: F.col("outcome") == "win"), (lambda: F.col("outcome") == "loss"), (lambda: F.col("outcome") == "timeout")


def share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def count_if(cond: Column) -> Column:
    return F.sum(cond.cast("bigint"))


def summary(trades: DataFrame, *keys: str) -> DataFrame:
    """Win/loss metrics per group; an undefined profit factor is null."""
    p = F.col("pnl_pct")
    g = trades.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        count_if(WIN()).alias("wins"),
        count_if(LOSS()).alias("losses"),
        count_if(TIME()).alias("timeouts"),
        share(WIN()).alias("win_rate"),
        nz(F.avg(F.when(WIN(), p))).alias("avg_win"),
        nz(F.avg(F.when(LOSS(), p))).alias("avg_loss"),
        nz(F.sum(F.when(WIN(), p))).alias("gross_win"),
        F.abs(nz(F.sum(F.when(~WIN(), p)))).alias("gross_loss"),
        F.avg("hold_bars").alias("avg_hold"),
        share(F.col("support_respected")).alias("respect_rate"),
    )
    g = g.withColumn("profit_factor", div(F.col("gross_win"), F.col("gross_loss")))
    return g.withColumn("expectancy", F.col("win_rate") * F.col("avg_win") + (1 - F.col("win_rate")) * F.col("avg_loss"))


def session_rates(trades: DataFrame, *keys: str) -> DataFrame:
    """Win rate per session, one row per group with the sessions as columns."""
    names = ["pre_market", "market_open", "after_hours", "unknown"]
    return trades.groupBy(*keys).agg(*[share(F.when(F.col("session") == s, WIN())).alias(f"wr_{s}") for s in names])


def best_by(summaries: DataFrame, metric: str, min_trades: int = 5) -> DataFrame:
    """The (pt, sl) with the highest metric among pairs with enough trades."""
    ok = summaries.where((F.col("trades") >= min_trades) & F.col(metric).isNotNull())
    b = ok.agg(F.max(F.struct(F.round(metric, 9).alias("m"), (-F.col("pt")).alias("p"), (-F.col("sl")).alias("s"))).alias("b"))
    return b.select(F.lit(metric).alias("metric"), F.col("b.m").alias("value"), (-F.col("b.p")).alias("pt"), (-F.col("b.s")).alias("sl"))


def breakdown(trades: DataFrame) -> DataFrame:
    """By pattern, by attempt, by ticker and overall in one pass (grouping sets)."""
    t = trades.withColumn("tries", F.when(F.col("attempt") >= 3, "3+").otherwise(F.col("attempt").cast("string")))
    g = t.groupingSets([["pattern"], ["tries"], ["ticker"], []], "pattern", "tries", "ticker").agg(
        F.count("*").alias("trades"), share(WIN()).alias("win_rate"), F.avg("pnl_pct").alias("avg_pnl"), F.sum("pnl_pct").alias("total_pnl")
    )
    kind = F.when(F.col("pattern").isNotNull(), "pattern").when(F.col("tries").isNotNull(), "attempt").when(F.col("ticker").isNotNull(), "ticker").otherwise("all")
    return g.select(kind.alias("kind"), F.coalesce("pattern", "tries", "ticker", F.lit("all")).alias("label"), "trades", "win_rate", "avg_pnl", "total_pnl")


def curve(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Additive equity and drawdown in trade order."""
    c = running_curve(trades, keys, "day", ["entry_ts", "ticker"], "pnl_pct")
    return c.withColumn("drawdown", F.col("cum") - F.col("peak"))


def trade_risk(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Per-trade Sharpe, Sortino and the worst additive drawdown."""
    p = F.col("pnl_pct")
    g = curve(trades, keys).groupBy(*keys).agg(
        F.avg(p).alias("mean"),
        F.stddev_samp(p).alias("sd"),
        F.stddev_samp(F.when(p < 0, p)).alias("down_sd"),
        F.min("drawdown").alias("max_drawdown"),
    )
    return g.withColumns(
        {"sharpe": nz(div(F.col("mean"), F.col("sd")) * ROOT_YEAR), "sortino": nz(div(F.col("mean"), F.col("down_sd")) * ROOT_YEAR)}
    )


def history(trades: DataFrame, before: Column | None = None) -> DataFrame:
    """Per-ticker record with the last-five streak; `before` (a date) leaves only trades entered on earlier days."""
    t = trades if before is None else trades.where(F.to_date("entry_ts") < before)
    w = Window.partitionBy("ticker").orderBy(F.col("entry_ts").desc(), F.col("pt"), F.col("sl"))
    # the last five per ticker only: the rank filter is pushed below the shuffle
    last = t.select("ticker", "entry_ts", "pt", "sl", "outcome").withColumn("k", F.row_number().over(w)).where("k <= 5")
    streak = last.groupBy("ticker").agg(count_if(WIN()).alias("last5_wins"))
    s = summary(t, "ticker").select("ticker", "trades", "win_rate", "avg_win", "avg_loss", "expectancy")
    out = s.join(streak, "ticker")
    score = (
        F.when(F.col("trades") < 3, 0.0)
        .when(F.col("win_rate") >= 0.6, 2.0)
        .when(F.col("win_rate") >= 0.3, 1.0)
        .otherwise(0.0)
    )
    return out.withColumn("history_score", score)


def concentration(trades: DataFrame) -> DataFrame:
    """Each ticker's share of all wins."""
    g = trades.groupBy("ticker").agg(count_if(WIN()).alias("wins"), F.count("*").alias("trades"))
    total = g.agg(F.sum("wins").alias("all_wins"))
    return g.join(F.broadcast(total)).select("ticker", "wins", "trades", div(F.col("wins"), F.col("all_wins")).alias("win_share"))


def duplicates(trades: DataFrame) -> DataFrame:
    """Share of repeated (ticker, entry) pairs and the win rate without them."""
    key = trades.groupBy("ticker", "entry_ts").agg(F.count("*").alias("n"), F.max_by("outcome", F.struct(-F.col("pt"), -F.col("sl"))).alias("outcome"))
    return key.agg(F.sum("n").alias("trades"), F.count("*").alias("unique_trades"), (1 - F.count("*") / F.sum("n")).alias("duplicate_share"), share(WIN()).alias("unique_win_rate"))


def folds(trades: DataFrame, n: int = 5) -> DataFrame:
    """Walk-forward check: fold k is tested, the folds before it are training."""
    cuts = trades.select(F.percentile(F.unix_timestamp("entry_ts"), [i / n for i in range(1, n)]).alias("cuts"))
    t = trades.join(F.broadcast(cuts)).withColumn(
        "fold", F.aggregate("cuts", F.lit(0), lambda a, c: a + F.when(F.unix_timestamp("entry_ts") > c, 1).otherwise(0))
    )
    by = t.groupBy("fold").agg(F.count("*").alias("n"), count_if(WIN()).alias("w"), F.sum("pnl_pct").alias("p"))
    prev = Window.partitionBy(F.lit(1)).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # n rows
    return by.select(
        "fold", F.col("n").alias("test_trades"), (F.col("w") / F.col("n")).alias("test_win_rate"), (F.col("p") / F.col("n")).alias("test_avg_pnl"),
        div(F.sum("w").over(prev), F.sum("n").over(prev)).alias("train_win_rate"),
    )


def levels_of(df: DataFrame, name: str, values: list) -> DataFrame:
    """Repeat rows for each value of a short parameter list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def slippage_sensitivity(trades: DataFrame, levels: list[float], fail_under: float = 1.0) -> DataFrame:
    """Profit factor with a worse entry and, by outcome, a worse exit (in percent), and whether it still pays."""
    t, f = levels_of(trades, "slip", levels), F.col("slip") / 100
    entry = F.col("entry_price") * (1 + f)
    exit_ = F.col("exit_price") * F.when(F.col("outcome") == "win", 1 - f).when(F.col("outcome") == "loss", 1 + f).otherwise(1.0)
    t = t.withColumn("net", nz((exit_ - entry) / entry * 100))
    g = t.groupBy("slip").agg(nz(F.sum(F.when(F.col("net") > 0, F.col("net")))).alias("up"), F.abs(nz(F.sum(F.when(F.col("net") < 0, F.col("net"))))).alias("down"), F.avg("net").alias("avg_net"))
    return g.withColumn("profit_factor", div(F.col("up"), F.col("down"))).withColumn("fails", nz((F.col("profit_factor") < fail_under).cast("int"), 0).cast("int"))


def uniform(key: Column, rep: Column, salt: int) -> Column:
    """Repeatable draw in [0, 1) from whole numbers, by arithmetic that any engine can repeat."""
    p = F.lit(1_000_003).cast("bigint")
    m = F.pmod(F.pmod(key.cast("bigint"), p) * 7919 + rep.cast("bigint") * 104_729 + salt * 611_953, p)
    return F.pmod(F.pmod(m * m, p) * 48_271 + salt, p) / 1_000_003


def hashed(*parts: Column) -> Column:
    """Repeatable draw in [0, 1) from a hash of its arguments."""
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / 1_000_003


def name_key(name: str) -> Column:
    """A whole name as a number: its code points weighted by their places."""
    at = F.sequence(F.lit(1), F.length(name))
    return F.aggregate(at, F.lit(0).cast("bigint"), lambda acc, i: acc + F.ascii(F.substring(name, i, F.lit(1))) * (i * 131 + 7))


def trade_key() -> Column:
    """A whole number that tells trades of one grid apart."""
    return F.col("entry_idx") * 10_007 + F.round(F.col("pt") * 100).cast("bigint") * 101 + F.round(F.col("sl") * 100).cast("bigint") + name_key("ticker")


def monte_carlo(trades: DataFrame, reps: int = 1000, low: float = 0.001, high: float = 0.005, size: float = 500.0) -> DataFrame:
    """Dollar P&L and win rate of equal stakes when every leg slips by a random share, over many replicates.

    Quantiles are the sorted replicates at reps/2, reps/20 and 19 reps/20.
    """
    t = trades.select("entry_price", "exit_price", trade_key().alias("key"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    slip = lambda salt: low + (high - low) * uniform(F.col("key"), F.col("rep"), salt)
    entry, exit_ = F.col("entry_price") * (1 + slip(1)), F.col("exit_price") * (1 - slip(2))
    tot = t.groupBy("rep").agg(F.sum(size / entry * (exit_ - entry)).alias("pnl"), share(exit_ > entry).alias("win_rate"))
    got = tot.agg(F.sort_array(F.collect_list("pnl")).alias("p"), F.sort_array(F.collect_list("win_rate")).alias("w"), F.avg("pnl").alias("mean"), F.avg("win_rate").alias("mean_win_rate"), share(F.col("pnl") < 0).alias("p_loss"))
    at = lambda c, q: F.get(c, F.lit(int(reps * q)))
    base = trades.agg(F.sum(size / F.col("entry_price") * (F.col("exit_price") - F.col("entry_price"))).alias("base"))
    return got.join(F.broadcast(base)).select(  # one row each
        "base", "mean", at("p", 0.5).alias("median"), at("p", 0.05).alias("p05"), at("p", 0.95).alias("p95"), "mean_win_rate", at("w", 0.5).alias("median_win_rate"), "p_loss"
    )


def shuffled_entries(entries: DataFrame, reps: int) -> DataFrame:
    """entries(ticker, day, support, resistance) once per replicate, with supports drawn between their 5th and 95th percentile.

    The replicate is part of the ticker, so every outcome operator runs on them as they are. The
    limits are the sorted supports at 5 and 95 percent of their number, found by a rank.
    """
    n = entries.where("support is not null").agg(F.count("*").alias("n"))
    ranked = rank_table(entries.where("support is not null").select(F.lit(1).alias("all"), "support"), "support", "all").join(F.broadcast(n))
    at = lambda q: F.max(F.when((F.col("below") <= q) & (q < F.col("below") + F.col("ties")), F.col("support")))
    lo, hi = F.floor(F.col("n") * 0.05), F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    limits = ranked.agg(at(lo).alias("lo"), at(hi).alias("hi"))
    e = entries.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).join(F.broadcast(limits))
    key = F.datediff("day", F.lit("2000-01-01").cast("date")) * 211 + name_key("ticker")
    drawn = F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * uniform(key, F.col("rep"), 3) + 1e-9, 4)
    return e.select(F.concat("ticker", F.lit("#"), F.col("rep").cast("string")).alias("ticker"), "day", drawn.alias("support"), "resistance")


def replicated(rows: DataFrame, reps: int) -> DataFrame:
    """Rows of a ticker once per replicate, named like shuffled_entries."""
    r = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return r.withColumn("ticker", F.concat("ticker", F.lit("#"), F.col("rep").cast("string"))).drop("rep")


def shuffle_control(real: DataFrame, shuffled: DataFrame, reps: int = 20) -> DataFrame:
    """Win rate of real trades against the mean and deviation of trades on shuffled supports; a replicate without trades has rate 0."""
    rep = F.split("ticker", "#").getItem(1).cast("int")
    rates = shuffled.groupBy(rep.alias("rep")).agg(share(WIN()).alias("wr"))
    all_ = real.sparkSession.range(1, reps + 1).select(F.col("id").cast("int").alias("rep")).join(rates, "rep", "left").select(nz(F.col("wr")).alias("wr"))
    lim = all_.agg(F.avg("wr").alias("mean"), F.stddev_samp("wr").alias("sd"))
    return real.agg(share(WIN()).alias("real")).join(F.broadcast(lim)).withColumn("beats_chance", F.col("real") > F.col("mean") + 1.5 * F.col("sd"))


# ---- daily reports --------------------------------------------------------------------


def enrich(df: DataFrame) -> DataFrame:
    """Row-local, lagged and rolling columns of a daily OHLCV frame."""
    w = order_window()
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    pc = F.lag("close").over(w)
    full = lambda x, n, f: F.when(F.count(x).over(last_n(n)) == n, f(x).over(last_n(n)))
    df = df.withColumns({"ret": div(c, pc) - 1, "next_open": F.lead("open").over(w)})
    df = df.withColumns(
        {
            "gap_pct": div(o - pc, pc) * 100,
            "intraday_range": div(h - l, o) * 100,
            "drop_from_open": div(o - l, o) * 100,
            "rise_from_open": div(h - o, o) * 100,
            "open_to_close": div(c - o, o) * 100,
            "close_in_range": div(c - l, h - l),
            "overnight_ret": div(F.col("next_open") - c, c) * 100,
            "vol_20d_avg": full(v, 20, F.avg),
            "month": F.month("date"),
            "year": F.year("date"),
            "dow": F.weekday("date"),
            "is_march": F.month("date") == 3,
            "week_of_month": F.floor((F.dayofmonth("date") - 1) / 7) + 1,
            "vol_10d_ann": full(F.col("ret"), 10, F.stddev_samp) * ROOT_YEAR * 100,
            "vol_30d_ann": full(F.col("ret"), 30, F.stddev_samp) * ROOT_YEAR * 100,
            **{f"mom_{n}d": (div(c, F.lag("close", n).over(w)) - 1) * 100 for n in (5, 10, 20)},
        }
    )
    return df.withColumns({"vol_ratio": div(v, F.col("vol_20d_avg")), "vol_regime": div(F.col("vol_10d_ann"), F.col("vol_30d_ann"))})


def peak_distance(df: DataFrame, month: int = 3) -> DataFrame:
    peaks = df.groupBy("ticker").agg(F.max(F.when(F.month("date") == month, F.col("close"))).alias("peak"))
    return df.join(peaks, "ticker").select("ticker", "date", (div(F.col("close"), F.col("peak")) - 1).alias("from_peak"))


def fired_signals(df: DataFrame, rules: dict[str, object]) -> DataFrame:
    """Long rows (ticker, date, signal, fired) for named predicates over an enriched frame."""
    items = F.array(*[F.struct(F.lit(n).alias("signal"), nz(f().cast("int"), 0).cast("int").alias("fired")) for n, f in rules.items()])
    return df.select("ticker", "date", F.explode(items).alias("s")).select("ticker", "date", "s.signal", "s.fired")


def overnight_edge(df: DataFrame, min_drop: float) -> DataFrame:
    """Statistics of overnight returns after a drop from the open, per ticker, year and pooled."""
    e = df.withColumn("x", F.col("overnight_ret") / 100).where(F.col("x").isNotNull())
    sig = F.col("drop_from_open") >= min_drop
    x = F.when(sig, F.col("x"))
    g = e.groupingSets([["ticker"], ["year"], []], "ticker", "year").agg(
        F.count(x).alias("n"), (F.count(x) / F.count("*") * 100).alias("freq_pct"), share(x > 0).alias("win_rate"),
        nz(F.avg(F.when(x > 0, x))).alias("avg_win"), nz(F.avg(F.when(x <= 0, x))).alias("avg_loss"), F.avg(x).alias("avg_ret"),
        (F.exp(F.sum(F.log1p(x))) - 1).alias("total_ret"), nz(div(F.avg(x), F.stddev_samp(x)) * ROOT_YEAR).alias("sharpe"),
    )
    out = g.withColumns(
        {"payoff": F.abs(div(F.col("avg_win"), F.col("avg_loss"))), "ev": F.col("win_rate") * F.col("avg_win") + (1 - F.col("win_rate")) * F.col("avg_loss")}
    ).where("n > 0")
    return out.join(_signal_drawdowns(e.where(sig)), out["ticker"].eqNullSafe(F.col("_t")) & out["year"].eqNullSafe(F.col("_y")), "left").drop("_t", "_y")


def _signal_drawdowns(e: DataFrame) -> DataFrame:
    """(_t, _y, max_drawdown) per ticker, per year and pooled: the worst fall of compounded returns x from their peak (1 at the start), in order of date and ticker.

    Pooled and per year, months are summed on their own and carry their totals and peaks on, so no
    task orders all rows.
    """
    sets = F.array(F.struct(F.col("ticker").alias("t"), F.lit(None).cast("int").alias("y")), F.struct(F.lit(None).cast("string").alias("t"), F.col("year").cast("int").alias("y")), F.struct(F.lit(None).cast("string").alias("t"), F.lit(None).cast("int").alias("y")))
    rows = e.select(F.explode(sets).alias("g"), "date", "ticker", F.trunc("date", "month").alias("month"), F.log1p("x").alias("lx"))
    rows = rows.select(F.coalesce("g.t", F.lit("")).alias("kt"), F.coalesce("g.y", F.lit(-1)).alias("ky"), "date", "ticker", "month", "lx")
    curve = running_curve(rows, ["kt", "ky"], "month", ["date", "ticker"], "lx")
    worst = curve.groupBy("kt", "ky").agg(F.min(F.exp(F.col("cum") - F.col("peak")) - 1).alias("max_drawdown"))
    return worst.select(F.when(F.col("kt") != "", F.col("kt")).alias("_t"), F.when(F.col("ky") != -1, F.col("ky")).alias("_y"), F.least("max_drawdown", F.lit(0.0)).alias("max_drawdown"))


def threshold_sweep(df: DataFrame, thresholds: list[float]) -> DataFrame:
    e = levels_of(df.where("overnight_ret is not null"), "threshold", thresholds)
    x = F.when(F.col("drop_from_open") >= F.col("threshold"), F.col("overnight_ret"))
    return e.groupBy("ticker", "threshold").agg(F.count(x).alias("n"), F.avg(x).alias("avg_ret"), share(x > 0).alias("win_rate"), (F.count(x) / F.count("*")).alias("freq"))


def monthly(df: DataFrame) -> DataFrame:
    """Return statistics by month, by year and month, and overall (cube)."""
    g = df.where("ret is not null").cube("year", "month").agg(F.count("*").alias("n"), F.avg("ret").alias("avg_ret"), F.stddev_samp("ret").alias("sd"), share(F.col("ret") > 0).alias("up_share"))
    return g


def month_vs_rest(df: DataFrame, month: int = 3) -> DataFrame:
    g = df.where("ret is not null").groupBy("ticker", (F.col("month") == month).alias("inside"))
    return g.agg(F.count("*").alias("n"), F.avg("ret").alias("avg_ret"), F.stddev_samp("ret").alias("sd"))


def tail_risk(df: DataFrame, level: float = 0.95) -> DataFrame:
    """VaR, CVaR, Sortino, Omega, Kelly and annualised moments per ticker."""
    r = F.col("ret")
    d = df.where(r.isNotNull())
    var = d.groupBy("ticker").agg(F.percentile("ret", 1 - level).alias("var"))
    g = d.join(var, "ticker").groupBy("ticker").agg(
        F.first("var").alias("var"), F.avg(F.when(r <= F.col("var"), r)).alias("cvar"), F.stddev_samp(F.when(r < 0, r)).alias("down"),
        F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), nz(F.sum(F.when(r > 0, r))).alias("gain"), nz(-F.sum(F.when(r <= 0, r))).alias("pain"),
        share(r > 0).alias("p"), F.avg(F.when(r > 0, r)).alias("aw"), F.abs(F.avg(F.when(r <= 0, r))).alias("al"),
    )
    b = div(F.col("aw"), F.col("al"))
    kelly = div(F.col("p") * b - (1 - F.col("p")), b)
    return g.select(
        "ticker", (F.col("var") * 100).alias("var_95"), (F.col("cvar") * 100).alias("cvar_95"),
        nz(div(F.col("mean") * YEAR, F.col("down") * ROOT_YEAR)).alias("sortino"), div(F.col("gain"), F.col("pain")).alias("omega"),
        kelly.alias("kelly"), (kelly / 2).alias("half_kelly"), (F.col("sd") * ROOT_YEAR * 100).alias("ann_vol"), (F.col("mean") * YEAR * 100).alias("ann_ret"),
    )


def spreads(df: DataFrame) -> DataFrame:
    """Roll spread (null when serial covariance is not negative), a high-low proxy and the larger of both."""
    w = order_window()
    d = df.withColumns({"lr": F.lag("ret").over(w), "khl": F.pow(F.log(div(F.col("high"), F.col("low"))), 2)})
    d = d.withColumn("k2", F.when(F.count("khl").over(last_n(2)) == 2, F.sqrt(F.avg("khl").over(last_n(2)))))
    both = F.col("ret").isNotNull() & F.col("lr").isNotNull()
    g = d.groupBy("ticker").agg(F.covar_samp(F.when(both, F.col("ret")), F.when(both, F.col("lr"))).alias("cov"), (F.avg("k2") * 0.5).alias("hl"))
    roll = F.when(F.col("cov") < 0, 2 * F.sqrt(-F.col("cov")))
    return g.select("ticker", (roll * 100).alias("roll_pct"), (F.col("hl") * 100).alias("hl_pct"), (F.greatest(nz(roll), F.col("hl"), F.lit(0.02)) * 100).alias("conservative_pct"))


def pair_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Date-aligned rows of every ticker pair; for universes of a fixed, small number of tickers."""
    a = df.select(F.col("ticker").alias("a"), "date", *[F.col(c).alias(f"{c}_a") for c in columns])
    b = df.select(F.col("ticker").alias("b"), "date", *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, "date").where(F.col("a") < F.col("b"))


def correlations(df: DataFrame, *groups: str) -> DataFrame:
    """Pearson correlation of returns per ticker pair from sums that combine before the shuffle."""
    p = pair_table(df.where("ret is not null"), ["ret", *groups])
    keys = ["a", "b", *[f"{g}_a" for g in groups]]
    g = p.groupBy(*keys).agg(
        F.count("*").alias("n"), F.covar_samp("ret_a", "ret_b").alias("cov"), F.stddev_samp("ret_a").alias("sa"), F.stddev_samp("ret_b").alias("sb")
    )
    return g.withColumn("corr", nz(div(F.col("cov"), F.col("sa") * F.col("sb"))))


def lead_lag(df: DataFrame, lead: str, follow: str, lags: int = 5) -> DataFrame:
    """Correlation of one ticker's return with another's 0..n rows later."""
    a = df.where(F.col("ticker") == lead).select("date", F.col("ret").alias("x"))
    b = df.where(F.col("ticker") == follow).select("date", F.col("ret").alias("y"))
    j = a.join(b, "date")
    w = Window.partitionBy(F.lit(1)).orderBy("date")  # one aligned series, bounded by the calendar
    j = j.withColumns({f"x{k}": F.lag("x", k).over(w) for k in range(lags + 1)})
    arr = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"x{k}").alias("x")) for k in range(lags + 1)])
    long = j.select("y", F.explode(arr).alias("s")).where("y is not null and s.x is not null")
    g = long.groupBy("s.lag").agg(F.covar_samp("s.x", "y").alias("c"), F.stddev_samp("s.x").alias("sx"), F.stddev_samp("y").alias("sy"))
    return g.select("lag", nz(div(F.col("c"), F.col("sx") * F.col("sy"))).alias("corr"))


def pair_spreads(df: DataFrame, cost: float = 0.04) -> DataFrame:
    """OLS hedge, spread, current z-score and Ornstein-Uhlenbeck half-life of every ticker pair."""
    p = pair_table(df, ["close"])
    fit = p.groupBy("a", "b").agg(F.regr_slope("close_a", "close_b").alias("hedge"), F.avg("close_a").alias("level"))
    s = p.join(fit, ["a", "b"]).withColumn("s", F.col("close_a") - F.col("hedge") * F.col("close_b"))
    s = s.withColumn("ls", F.lag("s").over(Window.partitionBy("a", "b").orderBy("date")))
    g = s.groupBy("a", "b").agg(
        F.first("hedge").alias("hedge"), F.avg("s").alias("spread_mean"), F.stddev_samp("s").alias("spread_std"), F.max_by("s", "date").alias("last"),
        F.regr_slope(F.col("s") - F.col("ls"), F.col("ls")).alias("k"), F.first("level").alias("level"),
    )
    half = F.when(F.col("k") < 0, F.lit(-math.log(2)) / F.col("k"))
    return g.select(
        "a", "b", "hedge", "spread_mean", "spread_std", div(F.col("last") - F.col("spread_mean"), F.col("spread_std")).alias("z"), half.alias("half_life"),
        F.when(half.isNotNull(), div(cost * F.col("level"), F.col("spread_std"))).alias("z_threshold"),
    )


def two_sample(df: DataFrame, month: int = 3) -> DataFrame:
    """Welch-style t of the mean against 0 and Mann-Whitney U (normal approximation) of inside vs rest, per ticker."""
    d = df.where("ret is not null").withColumn("inside", (F.col("month") == month))
    # the rows of a ticker are bounded by the calendar, so windows rank them; equal returns share their mean rank
    ties = F.count("*").over(Window.partitionBy("ticker", "ret"))
    r = d.select("ticker", "ret", "inside", (F.rank().over(Window.partitionBy("ticker").orderBy("ret")) + (ties - 1) / 2).alias("rank")).where("ticker is not null")
    i = F.col("inside")
    g = r.groupBy("ticker").agg(
        count_if(i).alias("n1"), count_if(~i).alias("n2"), F.sum(F.when(i, F.col("rank"))).alias("r1"),
        F.avg(F.when(i, F.col("ret"))).alias("mean_in"), F.stddev_samp(F.when(i, F.col("ret"))).alias("sd_in"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    return g.select("ticker", "n1", "n2", div(F.col("mean_in"), F.col("sd_in") / F.sqrt(n1)).alias("t_stat"), u.alias("u"), div(u - n1 * n2 / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)).alias("z"))


def permutation_test(df: DataFrame, month: int = 3, reps: int = 200) -> DataFrame:
    """Share of hash-drawn splits whose mean difference is at least the real one, per ticker."""
    d = df.where("ret is not null").withColumn("inside", F.col("month") == month)
    real = d.groupBy("ticker").agg((F.avg(F.when(F.col("inside"), F.col("ret"))) - F.avg(F.when(~F.col("inside"), F.col("ret")))).alias("real"), share(F.col("inside")).alias("p"))
    r = d.join(real, "ticker").select("ticker", "date", "ret", "real", "p", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    pick = hashed(F.col("rep"), F.col("ticker"), F.col("date")) < F.col("p")
    g = r.groupBy("ticker", "rep").agg(F.first("real").alias("real"), (F.avg(F.when(pick, F.col("ret"))) - F.avg(F.when(~pick, F.col("ret")))).alias("fake"))
    return g.groupBy("ticker").agg(F.first("real").alias("real_difference"), share(F.col("fake") >= F.col("real")).alias("p_value"))


def bootstrap_sharpe(df: DataFrame, reps: int = 200) -> DataFrame:
    """Poisson-weighted bootstrap interval of the annual Sharpe ratio per ticker."""
    d = df.where("ret is not null").select("ticker", "date", "ret", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    u = hashed(F.col("rep"), F.col("ticker"), F.col("date"))
    # Poisson(1) weights by inverse distribution, until the tail is below double precision
    total, term, wt, k = 0.0, math.exp(-1), F.when(F.lit(False), 0), 0
    while term > 1e-17:
        total, wt = total + term, wt.when(u < total + term, k)
        k, term = k + 1, term / (k + 1)
    wt = wt.otherwise(k).cast("double")
    g = d.withColumn("w", wt).groupBy("ticker", "rep").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("ret")).alias("s"), F.sum(F.col("w") * F.col("ret") * F.col("ret")).alias("q"))
    m = F.col("s") / F.col("n")
    g = g.withColumn("sharpe", div(m, F.sqrt(F.greatest(F.col("q") / F.col("n") - m * m, F.lit(0.0)))) * ROOT_YEAR)
    return g.groupBy("ticker").agg(F.percentile("sharpe", 0.025).alias("lo"), F.percentile("sharpe", 0.5).alias("mid"), F.percentile("sharpe", 0.975).alias("hi"))


def without_top(df: DataFrame, n: int = 2) -> DataFrame:
    """Mean and t after the n best returns of each ticker are left out."""
    w = Window.partitionBy("ticker").orderBy(F.col("ret").desc(), "date")
    d = df.where("ret is not null").withColumn("k", F.row_number().over(w)).where(F.col("k") > n)
    g = d.groupBy("ticker").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))
    return g.withColumn("t_stat", div(F.col("mean"), F.col("sd") / F.sqrt(F.col("n"))))


def premium(df: DataFrame, bench: str, last: int = 5) -> DataFrame:
    """Beta to one ticker over the whole sample and the excess return of the last rows."""
    b = df.where(F.col("ticker") == bench).select("date", F.col("ret").alias("b"))
    j = df.where(F.col("ticker") != bench).join(b, "date").where("ret is not null and b is not null")
    beta = j.groupBy("ticker").agg(div(F.covar_samp("ret", "b"), F.var_samp("b")).alias("beta"))
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    lastn = j.withColumn("k", F.row_number().over(w)).where(F.col("k") <= last)
    return lastn.join(beta, "ticker").groupBy("ticker").agg(F.first("beta").alias("beta"), F.sum(F.col("ret") - F.col("beta") * F.col("b")).alias("excess"))


def floor_grid(base: DataFrame, prices: list[float], hedges: list[float]) -> DataFrame:
    """Floor value of each ticker over a price and hedge grid."""
    g = levels_of(levels_of(base, "price", prices), "hedge", hedges)
    value = F.col("close") * (F.col("hedge") + (1 - F.col("hedge")) * F.col("price") / 100)
    return g.select("ticker", "price", "hedge", value.alias("floor_value"))


def prior_beta(df: DataFrame, bench: str, periods=(5, 20)) -> DataFrame:
    """Rolling beta over earlier rows only."""
    b = df.where(F.col("ticker") == bench).select("date", F.col("ret").alias("b"))
    j = df.where(F.col("ticker") != bench).join(b, "date").where("ret is not null and b is not null")
    cols = {}
    for n in periods:
        w = prior_n(n)
        cols[f"beta_{n}"] = F.when(F.count("*").over(w) == n, div(F.covar_samp("ret", "b").over(w), F.var_samp("b").over(w)))
    return j.withColumns(cols)
