"""From entries to trades: candidates, first-barrier outcomes, admissible chains.

Bars of one ticker carry a row index; a forward look ends with the session, at the first bar at or
after its close (or the last bar there is), so the range joins hash on (ticker, index block) and
never compare all bars of a ticker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import div, nz, order_window
from ..functions.rank import expanding_quantiles
from ..functions.scan import state_before
from . import patterns
from .levels import merged, nearest

_SPAN = 32

# sessions in UTC minutes of the day (fixed values)
SESSIONS = [("pre_market", 540, 805), ("market_open", 810, 1200), ("after_hours", 1200, 1435), ("unknown", 810, 1200)]


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def session_of(ts: Column) -> Column:
    m = minute_of_day(ts)
    out = None
    for name, lo, hi in SESSIONS[:3]:
        cond = m.between(lo, hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("unknown")


def in_session(ts: Column, start: Column, end: Column) -> Column:
    """Minutes-of-day test that also covers windows over midnight."""
    m = minute_of_day(ts)
    return F.when(start <= end, m.between(start, end)).otherwise((m >= start) | (m <= end))


def entries_from_bars(bars: DataFrame, q_low: float = 0.15, q_high: float = 0.85) -> DataFrame:
    """Per (ticker, day) after the first: support and resistance from all prior days.

    The levels as of the day come first, the nearest ones around the day's last close; where there
    is none, a quantile of the prior lows or highs stands in.
    """
    b = bars.withColumn("day", F.to_date("ts"))
    days = b.groupBy("ticker", "day").agg(F.max_by("close", "ts").alias("px"))
    known = expanding_quantiles(b, {"q_low": ("low", q_low), "q_high": ("high", q_high)})
    # a ticker as of a day is a ticker of its own: its bars are all bars before the day
    of = F.concat_ws("|", "ticker", "day")
    marks = days.select(F.col("ticker").alias("t"), "day", of.alias("as_of"), "px")
    past = bars.join(marks.select("t", F.col("day").alias("d"), "as_of"), (F.col("ticker") == F.col("t")) & (F.to_date("ts") < F.col("d")))
    past = past.drop("ticker", "t", "d").withColumnRenamed("as_of", "ticker")
    prices = marks.select(F.col("as_of").alias("ticker"), "px")
    near = nearest(merged(past, prices), prices).select(F.col("ticker").alias("as_of"), "support", "resistance")
    lv = known.join(days, ["ticker", "day"]).withColumn("as_of", of).join(near, "as_of", "left")
    up = lambda x: F.round(x + 1e-9, 4)
    lv = lv.select("ticker", "day", up(F.coalesce("support", "q_low")).alias("support"), up(F.coalesce("resistance", "q_high")).alias("resistance"))
    return lv.withColumn("stop", F.round(F.col("support") * 0.95 + 1e-9, 4))


def gate_patterns(candles: DataFrame, entries: DataFrame, look: int = 20, tol: float = 0.01, near: float = 0.015) -> DataFrame:
    """(ticker, day, idx, pattern, confidence): the most confident pattern of every bar that a look-back from an entry's day can reach.

    Strict and exhaustion twins do not depend on the entry; absorption is judged at its support.
    """
    w = order_window("ticker", "idx")
    day = F.to_date("ts")
    # the entry days a bar is in reach of: its own up to that of the bar `look` rows on
    far = F.coalesce(F.lead(day, look).over(w), F.last(day).over(w.rowsBetween(0, Window.unboundedFollowing)))
    reach = candles.select("ticker", "idx", F.sequence(day, far).alias("days")).select("ticker", "idx", F.explode("days").alias("day")).join(entries.select("ticker", "day", "support"), ["ticker", "day"])
    free = patterns.best_per_bar(patterns.strict_twin(candles, tol=tol), patterns.exhaustion_twin(candles))
    found = reach.join(free.select("ticker", "idx", "pattern", "confidence"), ["ticker", "idx"]).select("ticker", "day", "idx", "pattern", "confidence")
    held = patterns.absorption(candles.join(reach, ["ticker", "idx"]), tol=near, keep=("day",)).select("ticker", "day", "idx", "pattern", "confidence")
    best = found.unionByName(held).groupBy("ticker", "day", "idx").agg(F.max(F.struct("confidence", "pattern")).alias("b"))
    return best.select("ticker", "day", "idx", "b.pattern", "b.confidence")


def candidates(bars: DataFrame, entries: DataFrame, found: DataFrame, look: int = 20, open_min: int = 810, open_max: int = 1199, max_loss: float = 5.0) -> DataFrame:
    """Entry candidates per (ticker, day): support touched, close held, a pattern nearby; enter at the next open.

    bars carry idx; found (ticker, day, idx, pattern) has the pattern of a bar as seen from the
    entry of a day. A touch arms the level; a close under 90 % of it, a next open under 0.10 or too
    far above the level disarms it until the next touch. attempt counts the armings so far.
    """
    w = order_window("ticker", "idx")
    b = bars.withColumns({"next_open": F.lead("open").over(w), "next_ts": F.lead("ts").over(w), "day": F.to_date("ts")})
    b = b.where(minute_of_day(F.col("ts")).between(open_min, open_max)).join(entries.select("ticker", "day", "support", "resistance"), ["ticker", "day"])
    # patterns lie on bars before the session too, so both kinds of rows share one ordered window
    marks = found.select("ticker", "day", "idx", F.struct("idx", "pattern").alias("mark"))
    seen = F.max("mark").over(Window.partitionBy("ticker", "day").orderBy("idx").rangeBetween(-look, 0))
    both = b.unionByName(marks, allowMissingColumns=True)
    j = both.withColumn("last_p", seen).where("ts is not null").drop("mark")
    touch = F.least("open", "close") <= F.col("support") * 1.02
    broke = F.col("close") < F.col("support") * 0.90
    risk = (F.col("next_open") - F.col("support")) / F.col("next_open") * 100
    inside = (minute_of_day(F.col("next_ts")) <= open_max) & (F.to_date("next_ts") == F.col("day"))
    ready = F.col("last_p").isNotNull() & F.coalesce(inside, F.lit(False))
    refused = (F.col("next_open") < 0.10) | (risk > max_loss)
    reset = broke | (ready & refused)
    j = state_before(j, ["ticker", "day"], "idx", [F.when(touch, 1).otherwise(0), F.when(reset, 0).otherwise(1)], 0, "armed")
    arming = F.when((F.col("armed") == 0) & touch, 1).otherwise(0)
    j = j.withColumn("attempt", F.sum(arming).over(Window.partitionBy("ticker", "day").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    return j.where((F.col("armed") == 1) & ready & ~reset).select(
        "ticker", "day", "support", "resistance", (F.col("idx") + 1).alias("entry_idx"), F.col("next_ts").alias("entry_ts"),
        F.col("next_open").alias("entry_price"), F.col("last_p.pattern").alias("pattern"),
        (F.col("idx") - F.col("last_p.idx")).alias("bars_since"), F.col("attempt").cast("bigint").alias("attempt"),
    )


def with_grid(df: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """Repeat each row for every (profit target, stop) pair of a short parameter list."""
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("pt"), F.lit(float(b)).alias("sl")) for a, b in grid])
    return df.withColumn("_g", F.explode(pairs)).select("*", "_g.pt", "_g.sl").drop("_g")


def barriers(c: DataFrame, max_loss: float = 5.0) -> DataFrame:
    """Target, stop and hard floor of each candidate."""
    e, s = F.col("entry_price"), F.col("support")
    target = e * (1 + F.col("pt") / 100)
    capped = e + (target * 1.5 - e)
    stop = e * (1 - F.col("sl") / 100)
    return c.withColumns(
        {
            "target": F.when(F.col("resistance") > e * 1.005, F.least(F.col("resistance"), capped)).otherwise(target),
            "stop": F.when((s * 0.999 > stop) & (s * 0.999 < e), s * 0.999).otherwise(stop),
            "floor": e * (1 - max_loss / 100),
        }
    )


def session_ends(bars: DataFrame, close_minute: int = 1200) -> DataFrame:
    """(ticker, entry_idx, end_idx): the first later bar at or after the close, or the ticker's last bar."""
    w = Window.partitionBy("ticker").orderBy(F.col("idx").desc())
    after = F.when(minute_of_day(F.col("ts")) >= close_minute, F.col("idx"))
    later = F.last(after, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    last = F.first("idx").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return bars.select("ticker", F.col("idx").alias("entry_idx"), F.coalesce(later, last).alias("end_idx"))


def forward_bars(c: DataFrame, bars: DataFrame, close_minute: int = 1200) -> DataFrame:
    """Candidate rows joined to the bars after their entry up to the session end, by (ticker, index block)."""
    left = c.join(session_ends(bars, close_minute), ["ticker", "entry_idx"]).where(F.col("end_idx") > F.col("entry_idx"))
    blocks = F.sequence(F.floor((F.col("entry_idx") + 1) / _SPAN), F.floor(F.col("end_idx") / _SPAN))
    left = left.withColumn("_blk", F.explode(blocks))
    right = bars.select(
        "ticker", F.floor(F.col("idx") / _SPAN).alias("_blk"), F.col("idx").alias("b_idx"), F.col("ts").alias("b_ts"),
        *[F.col(x).alias(f"b_{x}") for x in ("open", "high", "low", "close")],
    )
    j = left.join(right, ["ticker", "_blk"])
    return j.where((F.col("b_idx") > F.col("entry_idx")) & (F.col("b_idx") <= F.col("end_idx"))).drop("_blk", "end_idx")


def first_barrier(c: DataFrame, bars: DataFrame, trail: float | None = None, trail_from: float = 1.0, close_minute: int = 1200) -> DataFrame:
    """One trade per candidate: the first bar that hits floor, stop or trail, target, or the session end.

    c needs entry_idx, entry_price, target, stop, floor, support and any identifying columns.
    """
    keys = [x for x in c.columns]
    j = forward_bars(c, bars, close_minute)
    w = Window.partitionBy(*keys).orderBy("b_idx")
    e = F.col("entry_price")
    eff = F.col("stop")
    if trail is not None:
        top = F.greatest(e, F.max("b_high").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        j = j.withColumn("top", top)
        active = (F.col("top") - e) / e * 100 >= trail_from
        eff = F.when(active, F.greatest(F.col("stop"), F.col("top") * (1 - trail / 100))).otherwise(F.col("stop"))
    j = j.withColumns({"eff": eff, "last_idx": F.max("b_idx").over(Window.partitionBy(*keys))})
    ended = F.col("b_idx") == F.col("last_idx")
    event = (
        F.when(F.col("b_low") <= F.col("floor"), F.struct(F.lit("loss").alias("outcome"), F.least("b_open", "floor").alias("px")))
        .when(
            F.col("b_low") <= F.col("eff"),
            F.struct(F.when(F.col("eff") > e, "win").otherwise("loss").alias("outcome"), F.least("b_open", "eff").alias("px")),
        )
        .when(F.col("b_high") >= F.col("target"), F.struct(F.lit("win").alias("outcome"), F.col("target").alias("px")))
        .when(ended, F.struct(F.lit("timeout").alias("outcome"), F.col("b_close").alias("px")))
    )
    j = j.withColumn("ev", event)
    hit = F.min_by(F.struct("ev.outcome", "ev.px", "b_ts", "b_idx"), F.when(F.col("ev").isNotNull(), F.col("b_idx")))
    g = j.groupBy(*keys).agg(
        hit.alias("x"),
        F.min(F.when(F.col("b_close") < F.col("support") * 0.99, F.col("b_idx"))).alias("weak_idx"),
    )
    return g.select(
        *keys,
        F.col("x.outcome").alias("outcome"),
        F.col("x.px").alias("exit_price"),
        F.col("x.b_ts").alias("exit_ts"),
        F.col("x.b_idx").alias("exit_idx"),
        (F.col("x.b_idx") - F.col("entry_idx")).alias("hold_bars"),
        F.round((F.col("x.px") - e) / e * 100, 4).alias("pnl_pct"),
        (F.col("weak_idx").isNull() | (F.col("weak_idx") > F.least(F.col("x.b_idx"), F.col("entry_idx") + 12))).alias("support_respected"),
    )


def admissible(trades: DataFrame, keys: list[str], cooldown: int = 6, max_losses: int = 5, max_trades: int = 10) -> DataFrame:
    """Keep a non-overlapping chain per key: re-enter after exit, wait after a loss, stop after enough losses.

    The chain is sequential, so it is a fold over the candidates of one key (one entry day, a
    bounded list).
    """
    items = F.array_sort(F.collect_list(F.struct("entry_idx", "exit_idx", (F.col("outcome") == "loss").alias("lost"))))
    zero = F.struct(
        F.lit(-1).cast("bigint").alias("free"), F.lit(0).alias("losses"), F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("kept")
    )

    def step(acc, x):
        go = (x["entry_idx"] > acc["free"]) & (acc["losses"] < max_losses) & (acc["n"] < max_trades)
        free = x["exit_idx"].cast("bigint") + F.when(x["lost"], cooldown).otherwise(0)
        return F.struct(
            F.when(go, free).otherwise(acc["free"]).alias("free"),
            (acc["losses"] + F.when(go & x["lost"], 1).otherwise(0)).alias("losses"),
            (acc["n"] + F.when(go, 1).otherwise(0)).alias("n"),
            F.when(go, F.concat(acc["kept"], F.array(x["entry_idx"].cast("bigint")))).otherwise(acc["kept"]).alias("kept"),
        )

    chain = trades.groupBy(*keys).agg(F.aggregate(items, zero, step, lambda a: a["kept"]).alias("kept"))
    kept = chain.select(*keys, F.explode("kept").alias("entry_idx"))
    return trades.join(kept, [*keys, "entry_idx"], "left_semi")


def breakout_trades(signals: DataFrame, bars: DataFrame, pt: float = 5.0, sl: float = 1.0, max_loss: float = 5.0, close_minute: int = 1200) -> DataFrame:
    """Equal-highs breakouts: enter at the next open inside the session; its close (at the open), floor, target, stop or a close under the ceiling ends it."""
    w = order_window("ticker", "idx")
    nxt = bars.withColumns({"e_idx": F.lead("idx").over(w), "e_ts": F.lead("ts").over(w), "e_px": F.lead("open").over(w)})
    s = signals.where("signal = 'eqh_breakout'").select("ticker", "idx", "ceiling").groupBy("ticker", "idx").agg(F.max("ceiling").alias("ceiling"))
    c = s.join(nxt.select("ticker", "idx", "e_idx", "e_ts", "e_px"), ["ticker", "idx"]).where((F.col("e_px") >= 0.10) & (minute_of_day(F.col("e_ts")) < close_minute))
    c = c.select("ticker", "ceiling", F.col("e_idx").alias("entry_idx"), F.col("e_ts").alias("entry_ts"), F.col("e_px").alias("entry_price"))
    e = F.col("entry_price")
    c = c.withColumns({"target": e * (1 + pt / 100), "stop": F.greatest(e * (1 - sl / 100), F.col("ceiling") * 0.998), "floor": e * (1 - max_loss / 100)})
    keys = c.columns
    j = forward_bars(c, bars, close_minute).withColumn("last_idx", F.max("b_idx").over(Window.partitionBy(*keys)))
    event = (
        F.when(minute_of_day(F.col("b_ts")) >= close_minute, F.struct(F.lit("timeout").alias("outcome"), F.col("b_open").alias("px")))
        .when(F.col("b_low") <= F.col("floor"), F.struct(F.lit("loss").alias("outcome"), F.least("b_open", "floor").alias("px")))
        .when(F.col("b_high") >= F.col("target"), F.struct(F.lit("win").alias("outcome"), F.col("target").alias("px")))
        .when(F.col("b_low") <= F.col("stop"), F.struct(F.lit("loss").alias("outcome"), F.least("b_open", "stop").alias("px")))
        .when(F.col("b_close") < F.col("ceiling"), F.struct(F.lit("loss").alias("outcome"), F.col("b_close").alias("px")))
        .when(F.col("b_idx") == F.col("last_idx"), F.struct(F.lit("timeout").alias("outcome"), F.col("b_close").alias("px")))
    )
    j = j.withColumn("ev", event)
    g = j.groupBy(*keys).agg(F.min_by(F.struct("ev.outcome", "ev.px", "b_ts", "b_idx"), F.when(F.col("ev").isNotNull(), F.col("b_idx"))).alias("x"))
    return g.select(
        "ticker", "entry_ts", "entry_price", "ceiling", F.col("x.outcome").alias("outcome"), F.col("x.b_ts").alias("exit_ts"),
        F.round((F.col("x.px") - e) / e * 100, 4).alias("pnl_pct"), (F.col("x.b_idx") - F.col("entry_idx")).alias("hold_bars"),
    )
