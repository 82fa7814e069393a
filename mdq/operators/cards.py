"""Session cards: candidates, exits with stall, admission limits; timeframe comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import div, nz, order_window
from . import intraday
from .joins import asof_backward
from .outcomes import forward_bars, minute_of_day


def session_candidates(cands: DataFrame, bars: DataFrame, history: DataFrame, first: int = 810, last: int = 1140) -> DataFrame:
    """Entry candidates above the session VWAP within the cut-offs, with the ticker's record before the day."""
    v = intraday.vwap(bars).select("ticker", F.col("ts").alias("entry_ts"), "vwap")
    m = F.hour("entry_ts") * 60 + F.minute("entry_ts")
    j = cands.join(v, ["ticker", "entry_ts"]).where(m.between(first, last) & (F.col("entry_price") >= F.col("vwap") * 0.99))
    past = history.select("ticker", F.to_date("exit_ts").alias("h_day"), (F.col("outcome") == "win").cast("double").alias("won"))
    daily = past.groupBy("ticker", "h_day").agg(F.sum("won").alias("w"), F.count("*").alias("n"))
    run = Window.partitionBy("ticker").orderBy("h_day").rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.select("ticker", F.col("h_day").alias("at"), "h_day", div(F.sum("w").over(run), F.sum("n").over(run)).alias("rate"))
    days = j.select("ticker", F.col("day").alias("at")).distinct().withColumn("h_day", F.col("at"))
    # the record of the last earlier day with a trade, however long ago
    rates = asof_backward(days, daily, "ticker", "at", ["rate"], "h_day", bucket=F.trunc("at", "year")).select("ticker", F.col("at").alias("day"), "rate")
    return j.join(rates, ["ticker", "day"], "left").withColumn("rate", nz(F.col("rate"), 0.5))


def card_outcomes(c: DataFrame, bars: DataFrame, pt: float = 1.2, sl: float = 0.8, trail_from: float = 2.0, trail: float = 1.0, stall: int = 6, slip: float = 0.005, start: int = 810, close: int = 1200) -> DataFrame:
    """First of trail (once in profit), stop with slippage, target, session close, or a stall under water; a card ends on its own day and in its session.

    There is no longest hold. A card without a later bar in its session ends at its entry price.
    """
    c = c.select("ticker", "day", "entry_idx", "entry_ts", "entry_price")
    e = F.col("entry_price")
    j = forward_bars(c, bars, close).where((F.to_date("b_ts") == F.to_date("entry_ts")) & minute_of_day(F.col("b_ts")).between(start, close))
    w = Window.partitionBy("ticker", "day", "entry_idx")
    j = j.withColumns(
        {
            "top": F.greatest(e, F.max("b_high").over(w.orderBy("b_idx").rowsBetween(Window.unboundedPreceding, 0))),
            "last_idx": F.max("b_idx").over(w),
            "held": F.row_number().over(w.orderBy("b_idx")),
        }
    )
    stop, tail = e * (1 - sl / 100), F.col("top") * (1 - trail / 100)
    ev = (
        F.when((F.col("top") >= e * (1 + trail_from / 100)) & (F.col("b_low") <= tail), F.struct(F.lit("trail").alias("why"), tail.alias("px")))
        .when(F.col("b_low") <= stop, F.struct(F.lit("stop").alias("why"), (F.least(F.col("b_open"), stop) * (1 - slip)).alias("px")))
        .when(F.col("b_high") >= e * (1 + pt / 100), F.struct(F.lit("target").alias("why"), (e * (1 + pt / 100)).alias("px")))
        .when(minute_of_day(F.col("b_ts")) >= close, F.struct(F.lit("close").alias("why"), F.col("b_close").alias("px")))
        .when((F.col("held") >= stall) & (F.col("b_close") < e), F.struct(F.lit("stall").alias("why"), F.col("b_close").alias("px")))
        .when(F.col("b_idx") == F.col("last_idx"), F.struct(F.lit("close").alias("why"), F.col("b_close").alias("px")))
    )
    j = j.withColumn("ev", ev)
    keys = ["ticker", "day", "entry_idx", "entry_ts", "entry_price"]
    g = j.groupBy(*keys).agg(F.min_by(F.struct("ev.why", "ev.px", "b_idx", "b_ts"), F.when(F.col("ev").isNotNull(), F.col("b_idx"))).alias("x"))
    g = c.join(g, keys, "left")
    return g.select(
        "ticker", "day", "entry_idx", "entry_ts", "entry_price", F.coalesce("x.why", F.lit("close")).alias("reason"),
        F.coalesce("x.b_ts", "entry_ts").alias("exit_ts"), F.round((F.coalesce("x.px", e) / e - 1) * 100, 4).alias("pnl_pct"),
    )


def admit(cards: DataFrame, slots: int = 3, day_loss: float = -2.0, cooldown_minutes: int = 30) -> DataFrame:
    """Walk a day's cards in time: free slots, no ticker that lost today, cooldown, day-loss halt.

    Admission depends on what was admitted before, so it is a fold over one day's cards;
    days run in parallel.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    item = F.struct(us("entry_ts").alias("at"), "ticker", us("exit_ts").alias("until"), F.col("pnl_pct").alias("pnl"), "entry_idx")
    days = cards.groupBy("day").agg(F.array_sort(F.collect_list(item)).alias("a"))
    zero = F.struct(F.slice("a", 1, 0).alias("taken"), F.lit(0).alias("n"))

    def step(acc, x):
        closed = F.filter(acc["taken"], lambda t: t["until"] <= x["at"])
        pnl = F.aggregate(closed, F.lit(0.0), lambda s, t: s + t["pnl"])
        live = F.size(F.filter(acc["taken"], lambda t: t["until"] > x["at"]))
        lost = F.exists(closed, lambda t: (t["ticker"] == x["ticker"]) & (t["pnl"] < 0))
        busy = F.exists(acc["taken"], lambda t: (t["ticker"] == x["ticker"]) & (t["until"] + cooldown_minutes * 60_000_000 > x["at"]))
        go = (live < slots) & ~lost & ~busy & (pnl > day_loss)
        return F.struct(F.when(go, F.concat(acc["taken"], F.array(x))).otherwise(acc["taken"]).alias("taken"), (acc["n"] + 1).alias("n"))

    kept = days.select("day", F.explode(F.aggregate("a", zero, step, lambda s: s["taken"])).alias("t"))
    return cards.join(kept.select("day", "t.ticker", "t.entry_idx"), ["day", "ticker", "entry_idx"], "left_semi")


def momentum_signal(df: DataFrame, n: int = 5) -> DataFrame:
    """Built-in signal: clipped n-row momentum."""
    m = div(F.col("close"), F.lag("close", n).over(order_window())) - 1
    return df.withColumn("signal", F.least(F.greatest(m * 10, F.lit(-1.0)), F.lit(1.0)))


def timeframes(df: DataFrame, signal, holds: dict[str, tuple[int, float]], top: int = 3, floor: float = 0.2) -> DataFrame:
    """Net return of holding each day's best signals for each timeframe's number of rows."""
    s = signal(df)
    w = order_window()
    for name, (n, _) in holds.items():
        s = s.withColumn(f"f_{name}", div(F.lead("close", n).over(w), F.col("close")) - 1)
    k = F.row_number().over(Window.partitionBy("date").orderBy(F.col("signal").desc(), "ticker"))
    best = s.where(F.col("signal") > floor).withColumn("k", k).where(F.col("k") <= top)
    items = F.array(*[F.struct(F.lit(n).alias("timeframe"), (F.col(f"f_{n}") - 2 * bps / 1e4).alias("net")) for n, (_, bps) in holds.items()])
    long = best.select("date", "ticker", F.explode(items).alias("x")).select("date", "ticker", "x.*").where("net is not null")
    return long.groupBy("timeframe").agg(F.count("*").alias("trades"), F.avg("net").alias("avg_net"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.stddev_samp("net").alias("sd"))
