"""Composite setup score of each ticker as of its last bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import div, nz, order_window
from ..functions.ema import ema, span
from . import intraday, levels, patterns


def recent(bars: DataFrame, n: int) -> DataFrame:
    """Last n bars per ticker, k = 1 for the newest."""
    w = Window.partitionBy("ticker").orderBy(F.col("ts").desc())
    return bars.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def pattern_score(strict: DataFrame, exhaustion: DataFrame, absorbed: DataFrame, bars: DataFrame, support: DataFrame, look: int = 30) -> DataFrame:
    """Best of the last bars: twice the confidence at the support (absorption always is), else once the confidence of a twin anywhere; at most 2."""
    r = recent(bars, look).select("ticker", "ts", F.least("open", "close").alias("body_low"))
    found = strict.select("ticker", "ts", "confidence", F.lit(0.005).alias("band"))
    found = found.unionByName(exhaustion.select("ticker", "ts", "confidence", F.lit(0.008).alias("band")))
    found = found.unionByName(absorbed.select("ticker", "ts", "confidence", F.lit(None).cast("double").alias("band")))
    j = found.join(r, ["ticker", "ts"]).join(support, "ticker", "left")
    near = F.col("band").isNull() | (F.abs(F.col("body_low") - F.col("level")) <= F.col("band") * F.col("level"))
    g = j.groupBy("ticker").agg(F.max(F.when(near, 2 * F.col("confidence"))).alias("at"), F.max(F.when(F.col("band").isNotNull(), F.col("confidence"))).alias("any"))
    best = F.round(F.least(F.coalesce("at", "any", F.lit(0.0)), F.lit(2.0)), 2)
    return bars.select("ticker").distinct().join(g, "ticker", "left").select("ticker", best.alias("pattern"))


def adx_score(bars_adx: DataFrame) -> DataFrame:
    last = bars_adx.groupBy("ticker").agg(F.max_by("adx", "ts").alias("adx_value"), F.count("*").alias("n"))
    x = F.col("adx_value")
    return last.select("ticker", "adx_value", F.when(F.col("n") < 30, 0.0).when(x > 25, 2.0).when(x >= 15, 1.0).otherwise(0.0).alias("adx"))


def rr_score(df: DataFrame) -> DataFrame:
    """Reward to risk, capped at 10, of rows with entry, support, resistance and stop."""
    e, s = F.col("entry"), F.when(F.col("stop") > 0, F.col("stop")).otherwise(F.col("entry") * 0.99)
    rr = F.least(div(F.col("resistance") - e, e - s), F.lit(10.0))
    ok = (F.col("support") > 0) & (F.col("resistance") > e) & (e > s)
    rr = F.when(ok, rr).otherwise(0.0)
    return df.withColumn("rr_ratio", rr).withColumn("rr", F.when(F.col("rr_ratio") >= 2, 2.0).when(F.col("rr_ratio") >= 1, 1.0).otherwise(0.0))


def confluence(lv: DataFrame, support: DataFrame, band: float = 0.003, poc_band: float = 0.005) -> DataFrame:
    """Levels at the support; a point of control within the wider band counts if none of them is one."""
    j = support.join(lv, "ticker", "left")
    gap = F.abs(F.col("price") - F.col("level"))
    near, poc = gap <= band * F.col("level"), F.col("method") == "poc"
    g = j.groupBy("ticker").agg(
        F.count(F.when(near, 1)).alias("n"),
        F.max(F.when(poc & (gap <= poc_band * F.col("level")), 1).otherwise(0)).alias("bonus"),
        F.max(F.when(near & poc, 1).otherwise(0)).alias("counted"),
    )
    n = F.col("n") + F.when(F.col("counted") == 0, F.col("bonus")).otherwise(0)
    return g.select("ticker", F.when(n >= 2, 2.0).when(n == 1, 1.0).otherwise(0.0).alias("confluence"))


def relative_volume(bars: DataFrame, look: int = 15, minutes: int = 5, least: int = 3) -> DataFrame:
    """Volume of the largest-body bar of the last ones against the median at that time of day before them."""
    k = bars.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("ts").desc())))
    big = k.where(F.col("k") <= look).groupBy("ticker").agg(F.max_by(F.struct("ts", "volume"), F.struct(F.abs(F.col("close") - F.col("open")), F.col("k"))).alias("x"))
    big = big.select("ticker", F.col("x.ts").alias("at"), F.col("x.volume").alias("v"))
    m = lambda c: F.hour(c) * 60 + F.minute(c)
    j = k.where(F.col("k") > look).join(big, "ticker").where(F.abs(m("ts") - m("at")) <= minutes)
    med = j.groupBy("ticker").agg(F.percentile("volume", 0.5).alias("median"), F.count("*").alias("samples")).where(F.col("samples") >= least)
    r = F.when(F.col("v") > 0, div(F.col("v"), F.col("median")))
    return big.join(med, "ticker", "left").withColumn("ratio", nz(r)).select(
        "ticker", "ratio", F.when(F.col("ratio") >= 2, 2.0).when(F.col("ratio") >= 1.5, 1.0).otherwise(0.0).alias("rel_volume")
    )


def macd_score(bars: DataFrame, least: int = 35) -> DataFrame:
    """2 for a histogram that rose over the last three bars, 1 for one that rose on the last."""
    h = intraday.macd(bars, adjust=False)
    g = recent(h, 3).groupBy("ticker").agg(*[F.max(F.when(F.col("k") == i + 1, F.col("histogram"))).alias(f"h{i}") for i in range(3)])
    n = bars.groupBy("ticker").agg(F.count("*").alias("n"))
    up = F.when(F.col("h0") > F.col("h2"), 2.0).when(F.col("h0") > F.col("h1"), 1.0).otherwise(0.0)
    return g.join(n, "ticker").select("ticker", F.when(F.col("n") >= least, up).otherwise(0.0).alias("macd"))


def rsi_divergence(bars: DataFrame, look: int = 20, last: int = 3, n: int = 14) -> DataFrame:
    """Lowest of the last closes under the lowest before, with a Wilder RSI more than one point higher (2) or flat (1)."""
    step = F.col("close") - F.lag("close").over(order_window("ticker", "ts"))
    d = bars.select("ticker", "ts", "close").withColumn("step", step).where("step is not null")
    gain, loss = F.greatest(F.col("step"), F.lit(0.0)), F.greatest(-F.col("step"), F.lit(0.0))
    e = ema(d, {"g": (gain, 1 / n), "l": (loss, 1 / n)}).select("ticker", "ts", (100 - 100 / (1 + div(F.col("g"), F.col("l")))).alias("rsi"))
    r = recent(bars, look).select("ticker", "ts", "close", "k").join(e, ["ticker", "ts"], "left")
    new = F.col("k") <= last
    low = lambda c: F.min(F.when(c, F.struct("close", "ts", "rsi")))
    g = r.groupBy("ticker").agg(low(new).alias("a"), low(~new).alias("b"), F.count("*").alias("n"))
    lower, gap = F.col("a.close") < F.col("b.close"), F.col("a.rsi") - F.col("b.rsi")
    score = F.when(lower & (gap > 1), 2.0).when(lower & (F.abs(gap) < 1), 1.0).otherwise(0.0)
    return g.select("ticker", F.when(F.col("n") >= look, score).otherwise(0.0).alias("rsi"))


def regime_score(bars: DataFrame, width: str = "30 minutes", n: int = 8, flat: float = 0.005) -> DataFrame:
    """2 for a falling average of the resampled closes over three steps, 1 for a flat one or too little data, 0 for a rising one."""
    c = bars.groupBy("ticker", F.window("ts", width).start.alias("ts")).agg(F.max_by("close", bars["ts"]).alias("close"))
    r = recent(ema(c, {"e": (F.col("close"), span(n))}), 4)
    at = lambda k, x: F.max(F.when(F.col("k") == k, F.col(x)))
    g = r.groupBy("ticker").agg(at(1, "e").alias("e0"), at(4, "e").alias("e3"), at(1, "close").alias("close"))
    size = bars.groupBy("ticker").agg(F.count("*").alias("n")).join(c.groupBy("ticker").agg(F.count("*").alias("steps")), "ticker")
    slope = nz(div(F.col("e0") - F.col("e3"), F.col("close")))
    score = F.when(slope < -flat, 2.0).when(slope < flat, 1.0).otherwise(0.0)
    return g.join(size, "ticker").select("ticker", F.when((F.col("n") >= 40) & (F.col("steps") >= 10), score).otherwise(1.0).alias("regime"))


def support_ok(bars: DataFrame, support: DataFrame, look: int = 12) -> DataFrame:
    """At most half of the last closes lie clearly below the support."""
    j = recent(bars, look).join(support, "ticker")
    return j.groupBy("ticker").agg((F.avg((F.col("close") < 0.99 * F.col("level")).cast("double")) <= 0.5).alias("support_ok"))


def eqh_score(pairs: DataFrame, signals: DataFrame, bars: DataFrame, look: int = 20, approach: float = 0.005, nearby: float = 0.02) -> DataFrame:
    """Equal highs whose two candles lie in the last bars: 2 for a breakout or rejection among these, or a ceiling at the price; 1 for one nearby."""
    r = recent(bars, look).select("ticker", "ts", "k")
    last = F.max("k").over(Window.partitionBy("ticker"))
    inside = r.withColumn("last", last).where(F.col("k") < F.col("last")).select("ticker", "ts")
    own = pairs.select("ticker", "ts", "ceiling").join(inside, ["ticker", "ts"])
    fired = signals.join(own.select("ticker", F.col("ts").alias("pair_ts")), ["ticker", "pair_ts"], "left_semi").join(r, ["ticker", "ts"], "left_semi").select("ticker").distinct().withColumn("fired", F.lit(True))
    px = bars.groupBy("ticker").agg(F.max_by("close", "ts").alias("px"))
    gap = F.min(F.abs(F.col("ceiling") - F.col("px")) / F.col("px"))
    g = px.join(own, "ticker", "left").groupBy("ticker").agg(gap.alias("gap")).join(fired, "ticker", "left")
    return g.select("ticker", F.when(F.col("fired") | (F.col("gap") <= approach), 2.0).when(F.col("gap") <= nearby, 1.0).otherwise(0.0).alias("eqh"))


def role_score(bars: DataFrame, support: DataFrame) -> DataFrame:
    """2 for a confirmed role reversal, 1 for one close above in the last 50 bars."""
    hard = levels.role_reversal(bars, support).select("ticker", F.col("reversed").alias("hard"))
    soft = levels.role_reversal(bars, support, look=50, need=1).select("ticker", F.col("reversed").alias("soft"))
    return hard.join(soft, "ticker").select("ticker", F.when(F.col("hard"), 2.0).when(F.col("soft"), 1.0).otherwise(0.0).alias("role"))


def rejection_score(bars: DataFrame, support: DataFrame) -> DataFrame:
    n = F.col("rejections")
    return levels.rejections(bars, support).select("ticker", F.when(n >= 2, 2.0).when(n == 1, 1.0).otherwise(0.0).alias("rejection"))


def resolve_levels(lv: DataFrame, prices: DataFrame, given: DataFrame, limit: float = 0.15) -> DataFrame:
    """Given support unless stale or broken, else the nearest level within widening bands of the price."""
    j = prices.join(given, "ticker", "left").join(lv, "ticker", "left")
    px, p = F.col("px"), F.col("price")
    near = lambda b, side: F.max(F.when((p < px) & (p >= px * (1 - b)) & F.col("is_support"), p)) if side else F.min(F.when((p > px) & (p <= px * (1 + b)) & ~F.col("is_support"), p))
    g = j.groupBy("ticker", "px", "support", "resistance").agg(*[near(b, s).alias(f"{'s' if s else 'r'}{int(b * 100)}") for b in (0.15, 0.40, 0.60) for s in (True, False)])
    ok_s = (F.col("support") > 0) & (F.abs(px - F.col("support")) <= limit * F.col("support")) & (px >= F.col("support") * 0.99)
    ok_r = (F.col("resistance") > px) & (F.col("resistance") <= px * (1 + limit))
    return g.select(
        "ticker", F.col("px").alias("entry"), F.coalesce(F.when(ok_s, F.col("support")), "s15", "s40", "s60").alias("support"),
        F.coalesce(F.when(ok_r, F.col("resistance")), "r15", "r40", "r60").alias("resistance"), (F.col("support") > px).alias("support_broken"),
    )


PARTS = ["adx", "macd", "regime", "pattern", "confluence", "role", "rejection", "eqh", "rsi", "rel_volume", "history"]


def total(df: DataFrame) -> DataFrame:
    """Base times price-action multiplier times conviction, scaled to 0..10, with a label."""
    c = F.col
    base = c("adx") + c("macd") + c("regime")
    action = 1 + 0.1 * (c("pattern") + c("confluence") + c("role") + c("eqh")) + 0.05 * (c("rejection") + c("rsi"))
    conviction = 1 + 0.1 * (c("rel_volume") + c("history"))
    bonus = F.when((c("eqh") > 0) & (c("confluence") > 0) & (c("role") > 0), 1.5).otherwise(1.0)
    out = df.withColumn("score", F.round(base * action * conviction * bonus / 16.8 * 10 + 1e-9, 2))
    return out.withColumn("label", F.when(c("score") >= 7, "strong").when(c("score") >= 4, "watch").otherwise("skip"))


def setup_scores(bars_adx: DataFrame, strict: DataFrame, exhaustion: DataFrame, absorbed: DataFrame, pairs: DataFrame, signals: DataFrame, lv: DataFrame, support: DataFrame, history: DataFrame) -> DataFrame:
    """All components of every ticker joined on the ticker, then the total."""
    parts = [
        adx_score(bars_adx).select("ticker", "adx"), macd_score(bars_adx), regime_score(bars_adx), pattern_score(strict, exhaustion, absorbed, bars_adx, support),
        confluence(lv, support), role_score(bars_adx, support), rejection_score(bars_adx, support), eqh_score(pairs, signals, bars_adx), rsi_divergence(bars_adx),
        relative_volume(bars_adx).select("ticker", "rel_volume"), history.select("ticker", F.col("history_score").alias("history")),
    ]
    out = bars_adx.select("ticker").distinct()
    for p in parts:
        out = out.join(p, "ticker", "left")
    return total(out.fillna(0.0, subset=PARTS))
