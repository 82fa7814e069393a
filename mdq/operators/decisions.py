"""Row predicates, gates, slots and drawdown episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import div, nz, order_window


def quality(df: DataFrame, min_volume: float = 100, max_bps: float = 200, regular_hours: bool = True) -> DataFrame:
    """Bars with volume, a sane range and regular New York hours."""
    ok = (F.col("volume") >= min_volume) & (div(F.col("high") - F.col("low"), F.col("close")) * 1e4 <= max_bps)
    if regular_hours:
        ny = F.from_utc_timestamp("ts", "America/New_York")
        ok = ok & (F.hour(ny) * 60 + F.minute(ny)).between(570, 960)
    return df.where(ok)


def stale(level: Column, price: Column, limit: float = 0.15) -> Column:
    """Absent, or further than the limit from the price."""
    return level.isNull() | (level <= 0) | (F.abs(price - level) > limit * level)


def stale_support(bars: DataFrame, entries: DataFrame, limit: float = 0.15) -> DataFrame:
    """Entries whose day's median of opens and closes is far above support are left out."""
    px = bars.select("ticker", F.to_date("ts").alias("day"), F.explode(F.array("open", "close")).alias("px"))
    med = px.groupBy("ticker", "day").agg(F.percentile("px", 0.5).alias("median"))
    return entries.join(med, ["ticker", "day"]).where(F.col("median") <= F.col("support") * (1 + limit))


def decide(df: DataFrame, min_score: float = 5.0, max_loss: float = -2.0, max_open: int = 3, budget: float = 1000.0, risk: float = 100.0, atr_times: float = 1.5, by_atr: bool = False) -> DataFrame:
    """First failing gate names the reason; otherwise go with a quantity and a limit price.

    Weekdays from 13:30 to midnight UTC. The quantity is what the budget buys, or with by_atr what
    the risk allows at a stop atr_times the column atr away (where that is over 0); at least 1.
    """
    m = F.hour("ts") * 60 + F.minute("ts")
    low = (F.col("score") < min_score) if min_score > 0 else F.lit(False)
    reason = (
        F.when(F.weekday("ts") >= 5, "weekend").when(m < 810, "outside_hours").when(low, "low_score")
        .when(F.col("day_pnl") <= max_loss, "day_loss").when(F.col("open_positions") >= max_open, "too_many_open").when(F.col("price") <= 0, "no_price").otherwise("ok")
    )
    go = F.col("reason") == "ok"
    units = F.floor(div(F.lit(budget), F.col("price")))
    if by_atr:
        units = F.when(F.col("atr") > 0, F.floor(div(F.lit(risk), F.col("atr") * atr_times))).otherwise(units)
    quantity = F.when(go, F.greatest(units, F.lit(1))).otherwise(0)
    return df.withColumn("reason", reason).withColumns({"go": go, "quantity": quantity, "limit_price": F.when(go, F.round(F.col("price") * 1.002 + 1e-9, 4))})


def touch_gate(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """The bar before dipped to support with its body and this one closes above the break level."""
    w = order_window("ticker", "ts")
    b = bars.withColumn("dip", F.lag(F.least("open", "close")).over(w)).withColumn("day", F.to_date("ts"))
    j = b.join(levels.select("ticker", "day", "support"), ["ticker", "day"])
    return j.where((F.col("dip") <= F.col("support") * 1.02) & (F.col("close") >= F.col("support") * 0.90)).select("ticker", "ts", "support")


def slots(signals: DataFrame, held: DataFrame, limit: int = 3, min_signal: float = 0.5) -> DataFrame:
    """Best signals up to the free slots of each day."""
    open_ = held.groupBy("date").agg(F.count("*").alias("used"))
    w = Window.partitionBy("date").orderBy(F.col("signal").desc(), "ticker")
    s = signals.where(F.col("signal") > min_signal).withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit)
    j = s.join(open_, "date", "left").where(F.col("k") <= limit - nz(F.col("used"), 0))
    return j.select("date", "ticker", "signal", F.col("k").cast("bigint").alias("k"))


def episodes(df: DataFrame, start: float = -0.01, end: float = -0.001) -> DataFrame:
    """Drawdown episodes per ticker: open below `start`, closed at `end` or better."""
    w = order_window()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("dd", div(F.col("close"), F.max("close").over(run)) - 1)
    # hysteresis: the last decisive row says whether an episode is running
    d = d.withColumn("state", F.last(F.when(F.col("dd") < start, 1).when(F.col("dd") >= end, 0), ignorenulls=True).over(run))
    d = d.withColumn("open", ((F.col("state") == 1) & (nz(F.lag("state").over(w), 0) == 0)).cast("int"))
    d = d.withColumn("episode", F.sum("open").over(run)).where("state = 1")
    return d.groupBy("ticker", "episode").agg(
        F.min("date").alias("begin"), F.max("date").alias("until"), F.min("dd").alias("depth"), F.min_by("date", F.struct("dd", "date")).alias("trough"), F.count("*").alias("rows")
    )


def compound(df: DataFrame, keys: list[str], order: list[str], ret: str, capital: float = 1.0) -> DataFrame:
    """Capital after each return in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("equity", capital * F.exp(F.sum(F.log1p(ret)).over(w)))


def vessel_state(df: DataFrame) -> DataFrame:
    """Direction from course over ground and laden state from draught in metres."""
    c = F.col("course")
    direction = F.when(c.isNull(), "unknown").when(c.between(90, 210), "outbound").when(c.between(270, 360), "inbound").otherwise("transit")
    return df.withColumns({"direction": direction, "laden": F.coalesce(F.col("draught"), F.lit(0.0)) > 15.0})


def vessel_counts(df: DataFrame) -> DataFrame:
    """Census of the latest message of each vessel: totals, large, laden and direction counts."""
    one = lambda cond: F.sum(cond.cast("bigint"))
    s = vessel_state(df)
    return s.agg(
        F.count("*").alias("vessels"), one(F.col("length") > 300).alias("large"), one(F.col("laden")).alias("laden"),
        one(F.col("direction") == "outbound").alias("outbound"), one(F.col("direction") == "inbound").alias("inbound"), one(F.col("direction") == "transit").alias("transit"),
    )
