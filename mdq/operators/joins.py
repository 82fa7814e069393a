"""As-of, nearest and range joins built from equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], tie: str, bucket: Column | None = None) -> DataFrame:
    """Latest right row strictly before each left row of the key.

    Both sides are stacked and the last right value is carried forward.  The carry runs per
    (key, day) and one row per day hands it on, so a key with most of the rows is still
    spread over its days.
    """
    day = F.to_date(at) if bucket is None else bucket
    r = right.select(key, at, tie, F.struct(*values).alias("_v"), F.lit(1).alias("_side"))
    keep = [c for c in left.columns if c not in (key, at, tie)]
    l = left.withColumns({"_v": F.lit(None).cast(r.schema["_v"].dataType), "_side": F.lit(0)})
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_day", day)
    # at equal times left rows come first, so only strictly earlier right rows are seen
    inside = Window.partitionBy(key, "_day").orderBy(at, "_side", tie).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    tails = both.where("_side = 1").groupBy(key, "_day").agg(F.max_by("_v", F.struct(at, tie)).alias("_tail"))
    days = both.select(key, "_day").distinct().join(tails, [key, "_day"], "left")
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carry = days.select(key, "_day", F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    out = both.where("_side = 0").join(carry, [key, "_day"], "left").withColumn("_x", F.coalesce("_in", "_carry"))
    return out.select(key, at, tie, *keep, *[F.col(f"_x.{v}").alias(v) for v in values])


def nearest_date(wanted: DataFrame, stored: DataFrame, key: str, within: int = 5) -> DataFrame:
    """Stored row closest to each wanted date, the earlier one on a tie; fan-out of 2*within+1 dates."""
    w = wanted.select(key, F.col("date").alias("wanted"), F.explode(F.sequence(F.date_sub("date", within), F.date_add("date", within))).alias("date"))
    j = w.join(stored, [key, "date"])
    gap = F.abs(F.datediff("date", "wanted"))
    cols = [c for c in stored.columns if c != key]
    g = j.groupBy(key, "wanted").agg(F.min_by(F.struct(*cols), F.struct(gap, "date")).alias("x"))
    return g.select(key, "wanted", *[F.col(f"x.{c}").alias("stored" if c == "date" else c) for c in cols])


def nearest_bar(points: DataFrame, bars: DataFrame, key: str) -> DataFrame:
    """Bar whose start is closest to each point's ts, however far, the earlier one on a tie.

    A point meets the bars of its own day and the nearest bar before and after that day; these
    come from one row per (key, day), whose list of bars the calendar bounds. Points are joined to
    that row as they are, never copied.
    """
    b = bars.select(key, F.to_date("ts").alias("_day"), F.struct(F.col("ts").alias("bar_ts"), "close").alias("_bar"))
    own = b.groupBy(key, "_day").agg(F.collect_list("_bar").alias("_bars"), F.max("_bar").alias("_last"), F.min("_bar").alias("_first"))
    days = points.select(key, F.to_date("ts").alias("_day")).distinct().join(own, [key, "_day"], "full")
    w = Window.partitionBy(key).orderBy("_day")
    back = Window.partitionBy(key).orderBy(F.col("_day").desc())
    up_to = Window.unboundedPreceding
    days = days.withColumns({"_before": F.last("_last", ignorenulls=True).over(w.rowsBetween(up_to, -1)), "_after": F.last("_first", ignorenulls=True).over(back.rowsBetween(up_to, -1))})
    near = F.concat(F.coalesce("_bars", F.array().cast(own.schema["_bars"].dataType)), F.array("_before", "_after"))
    days = days.select(key, "_day", F.filter(near, lambda x: x.isNotNull()).alias("_near"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    best = F.array_min(F.transform("_near", lambda x: F.struct(F.abs(us(F.col("ts")) - us(x["bar_ts"])).alias("gap"), x["bar_ts"].alias("bar_ts"), x["close"].alias("close"))))
    j = points.withColumn("_day", F.to_date("ts")).join(days, [key, "_day"]).withColumn("_x", best).where("_x is not null")
    return j.select(*points.columns, F.col("_x.bar_ts").alias("bar_ts"), F.col("_x.close").alias("close"))


def within_windows(rows: DataFrame, windows: DataFrame, date: str = "date") -> DataFrame:
    """Rows inside dated windows; each window lists its days (bounded by the calendar), then an equi join."""
    days = windows.withColumn(date, F.explode(F.sequence("start", "end")))
    return rows.join(days, date)
