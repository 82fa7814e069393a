"""Intraday indicators over bars(ticker, ts, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import div, last_n, nz, order_window
from ..functions.ema import ema, span, wilder


def _w():
    return order_window("ticker", "ts")


def _last(n: int):
    return last_n(n, "ticker", "ts")


def _full(x: Column, n: int, agg) -> Column:
    """Rolling value that stays null until n rows exist."""
    return F.when(F.count(x).over(_last(n)) == n, agg(x).over(_last(n)))


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def vwap(df: DataFrame, daily: bool = True, out: str = "vwap") -> DataFrame:
    keys = ["ticker", F.to_date("ts")] if daily else ["ticker"]
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, div(F.sum(typical() * F.col("volume")).over(w), F.sum("volume").over(w)))


def vwap_bands(df: DataFrame, width: float = 2.0) -> DataFrame:
    df = vwap(df)
    w = Window.partitionBy("ticker", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    var = div(F.sum(F.pow(typical() - F.col("vwap"), 2) * F.col("volume")).over(w), F.sum("volume").over(w))
    df = df.withColumn("sd", F.sqrt(var))
    return df.withColumns({"upper": F.col("vwap") + width * F.col("sd"), "lower": F.col("vwap") - width * F.col("sd")})


def order_flow(df: DataFrame, n: int = 20) -> DataFrame:
    place = div(F.col("close") - F.col("low"), F.col("high") - F.col("low"))
    df = df.withColumn("imbalance", nz((place - 0.5) * 2))
    ready = F.count("*").over(_last(n)) == n
    weighted = div(F.sum(F.col("imbalance") * F.col("volume")).over(_last(n)), F.sum("volume").over(_last(n)))
    return df.withColumn("weighted_imbalance", F.when(ready, weighted))


def volume_spike(df: DataFrame, k: float = 3.0, n: int = 20) -> DataFrame:
    return df.withColumn("spike", nz((F.col("volume") > k * _full(F.col("volume"), n, F.avg)).cast("int"), 0).cast("int"))


def divergence(df: DataFrame, n: int = 5) -> DataFrame:
    dp = div(F.col("close"), F.lag("close", n).over(_w())) - 1
    dv = div(F.col("volume"), F.lag("volume", n).over(_w())) - 1
    return df.withColumn(
        "divergence", F.when((dp < -0.02) & (dv > 0.5), 1).when((dp > 0.02) & (dv < -0.3), -1).otherwise(0)
    )


def momentum(df: DataFrame, periods=(5, 10, 20)) -> DataFrame:
    return df.withColumns({f"mom_{p}": div(F.col("close"), F.lag("close", p).over(_w())) - 1 for p in periods})


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    df = df.withColumn("step", F.col("close") - F.lag("close").over(_w()))
    gain = F.greatest(nz(F.col("step")), F.lit(0.0))
    loss = F.greatest(nz(-F.col("step")), F.lit(0.0))
    ready = F.count("*").over(_last(n)) == n
    g, l = F.avg(gain).over(_last(n)), F.avg(loss).over(_last(n))
    return df.withColumn("rsi", F.when(ready, F.coalesce(100 - 100 / (1 + div(g, l)), F.when(g > 0, F.lit(100.0))))).drop("step")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, adjust: bool = True) -> DataFrame:
    df = ema(df, {"ema_fast": (F.col("close"), span(fast)), "ema_slow": (F.col("close"), span(slow))}, adjust=adjust)
    df = df.withColumn("macd", F.col("ema_fast") - F.col("ema_slow"))
    df = ema(df, {"signal": (F.col("macd"), span(signal))}, adjust=adjust)
    return df.withColumn("histogram", F.col("macd") - F.col("signal"))


def true_range(df: DataFrame) -> DataFrame:
    pc = F.lag("close").over(_w())
    return df.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """ATR and ADX with Wilder smoothing."""
    up = F.col("high") - F.lag("high").over(_w())
    down = F.lag("low").over(_w()) - F.col("low")
    df = true_range(df).withColumns(
        {
            "up": nz(F.when((up > down) & (up > 0), up)),
            "down": nz(F.when((down > up) & (down > 0), down)),
        }
    )
    a = wilder(n)
    df = ema(df, {"atr": (F.col("tr"), a), "up_s": (F.col("up"), a), "down_s": (F.col("down"), a)})
    plus, minus = 100 * div(F.col("up_s"), F.col("atr")), 100 * div(F.col("down_s"), F.col("atr"))
    df = df.withColumns({"plus_di": plus, "minus_di": minus})
    df = df.withColumn("dx", nz(100 * div(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di"))))
    return ema(df, {"adx": (F.col("dx"), a)}).drop("up", "down", "up_s", "down_s", "dx")


def poc_by_day(df: DataFrame, bins: int = 20) -> DataFrame:
    """Volume per price bin of each (ticker, day) and the busiest bin's middle price."""
    day = df.withColumn("day", F.to_date("ts"))
    edge = day.groupBy("ticker", "day").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    j = day.join(edge, ["ticker", "day"]).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    j = j.withColumn("bin", F.least(F.greatest(F.ceil(div(typical() - F.col("lo"), F.col("width"))), F.lit(1)), F.lit(bins)))
    return j.groupBy("ticker", "day", "bin").agg(
        F.first(F.col("lo") + (F.col("bin") - 0.5) * F.col("width")).alias("price"), F.sum("volume").alias("volume")
    )


def poc(df: DataFrame, bins: int = 20) -> DataFrame:
    prof = poc_by_day(df, bins)
    return prof.groupBy("ticker", "day").agg(F.max_by("price", F.struct("volume", -F.col("bin"))).alias("poc"))


def all_features(df: DataFrame) -> DataFrame:
    out = divergence(volume_spike(order_flow(vwap(df))))
    out = rsi(momentum(out))
    out = macd(out)
    out = out.withColumn("day", F.to_date("ts")).join(poc(df), ["ticker", "day"]).drop("day")
    return out.withColumns({"vs_vwap": div(F.col("close"), F.col("vwap")) - 1, "vs_poc": div(F.col("close"), F.col("poc")) - 1})


def session_regime(df: DataFrame, first: int = 12, limit: int = 4) -> DataFrame:
    """trending/choppy per (ticker, day) from VWAP crossings among the first bars."""
    d = df.withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("ticker", "day").orderBy("ts")
    d = d.withColumn("k", F.row_number().over(w)).where(F.col("k") <= first)
    d = vwap(d).withColumn("gap", F.col("close") - F.col("vwap"))
    d = d.withColumn("cross", (F.lag("gap").over(w) * F.col("gap") < 0).cast("int"))
    return d.groupBy("ticker", "day").agg(nz(F.sum("cross"), 0).cast("bigint").alias("crossings")).withColumn(
        "regime", F.when(F.col("crossings") >= limit, "choppy").otherwise("trending")
    )


def oscillator(df: DataFrame) -> DataFrame:
    """3/10 oscillator, its 16-bar signal, histogram and histogram change."""
    df = df.withColumn("osc", _full(F.col("close"), 3, F.avg) - _full(F.col("close"), 10, F.avg))
    df = df.withColumn("osc_hist", F.col("osc") - _full(F.col("osc"), 16, F.avg))
    return df.withColumn("osc_diff", F.col("osc_hist") - F.lag("osc_hist").over(_w()))
