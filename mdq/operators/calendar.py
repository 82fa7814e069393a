"""Trading calendars: grids, periods, rebalance dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import order_window


def fill_grid(df: DataFrame, values: list[str], limit: int | None = None, step: str = "1 day", order: str = "date") -> DataFrame:
    """One row per ticker and trading date from the ticker's first row on, values carried forward.

    Each ticker generates its own date sequence (bounded by the calendar) and keeps the dates
    the market traded, so no cross product of dates and tickers is formed.  limit bounds how
    many rows a value may be carried.
    """
    last_date = df.agg(F.max(order).alias("hi"))
    spans = df.groupBy("ticker").agg(F.min(order).alias("lo")).join(F.broadcast(last_date))
    days = df.select(order).distinct()
    grid = spans.select("ticker", F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias(order))
    grid = grid.join(days, order, "left_semi").join(df, ["ticker", order], "left")
    w = order_window("ticker", order).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return grid.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def walk_forward_periods(
    span: DataFrame, train_months: int, test_months: int, step_months: int, anchored_test_months: int | None = None
) -> DataFrame:
    """Periods from one-row span(start DATE, end DATE); the test window follows the training one.

    A last period ends at the span's end when the steps do not reach it.
    """
    steps = span.select(
        "start", "end", F.explode(F.sequence("start", "end", F.expr(f"interval {step_months} month"))).alias("train_start")
    )
    out = steps.select(
        "train_start",
        F.add_months("train_start", train_months).alias("train_end"),
        F.add_months("train_start", train_months).alias("test_start"),
        F.add_months("train_start", train_months + test_months).alias("test_end"),
        "end",
    ).where(F.col("test_end") <= F.col("end")).drop("end")
    tail = anchored_test_months or test_months
    last = span.select(
        F.add_months("end", -(train_months + tail)).alias("train_start"),
        F.add_months("end", -tail).alias("train_end"),
        F.add_months("end", -tail).alias("test_start"),
        F.col("end").alias("test_end"),
    ).where(F.col("train_start") >= span["start"])
    reached = out.agg(F.max("test_end").alias("reached"))
    last = last.join(F.broadcast(reached)).where(F.col("reached").isNull() | (F.col("reached") < F.col("test_end"))).drop("reached")
    every = out.unionByName(last).distinct()
    # a handful of rows, bounded by the months of the span
    return every.withColumn("period_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("train_start", "test_start")))


def rebalance_dates(dates: DataFrame, periods: DataFrame, every: int = 21) -> DataFrame:
    """(period_id, date, rebalance): every n-th trading date of each test window, the first included."""
    inside = dates.join(F.broadcast(periods), (F.col("date") >= F.col("test_start")) & (F.col("date") <= F.col("test_end")))
    w = Window.partitionBy("period_id").orderBy("date")
    out = inside.withColumn("day_no", F.row_number().over(w) - 1)
    return out.withColumn("rebalance", (F.col("day_no") % every) == 0)
