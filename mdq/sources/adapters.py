"""Market-shaped inputs derived from the star-schema tables.

Everything downstream of a tick or line-item table first collapses it to one row per
(ticker, day) or (ticker, bar) with a map-side combined aggregation.  After that step the
rows of one ticker are bounded by the calendar, however hot the ticker is in the raw
table, which is what lets the operators use ordered windows per ticker.

Prices are quantised to four decimals (off exact ties) and the log walk is summed in
integers, so the same table gives the same bits on any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _walk(df: DataFrame, base: float, order: str) -> DataFrame:
    """Add close/prev_close of the integer log walk `gi` (millionths) per ticker."""
    w = Window.partitionBy("ticker").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum("gi").over(w)
    return (
        df.withColumn("cum", cum)
        .withColumn("close", F.round(base * F.exp(F.col("cum") / 1e6), 4))
        .withColumn("pc", F.round(base * F.exp((F.col("cum") - F.col("gi")) / 1e6), 4))
    )


def _daily_from(lines: DataFrame) -> DataFrame:
    day = lines.groupBy("ticker", F.to_date("l_shipdate").alias("date")).agg(
        F.expr("(sum(cast(round(l_discount * 100) as bigint)) * 10000) div count(*) - 50000").alias("gi"),
        F.sum("l_quantity").alias("volume"),
        F.max("l_tax").alias("wick"),
    )
    out = _walk(day, 100.0, "date").withColumn("open", F.round(F.col("pc") * F.exp(F.col("gi") / 2e6), 4))
    return out.select(
        "ticker",
        "date",
        "open",
        F.round(F.greatest("open", "close") * (1 + F.col("wick") / 10) + 1.3e-8, 4).alias("high"),
        F.round(F.least("open", "close") * (1 - F.col("wick") / 10) + 1.3e-8, 4).alias("low"),
        "close",
        "volume",
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV per supplier; the number of tickers grows with the data."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), "l_shipdate", "l_discount", "l_quantity", "l_tax"
    )
    return _daily_from(lines)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV per nation of the supplier: a dense panel over a bounded universe."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    who = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    # collapse to (supplier, day) first: the join then moves day rows, not line items
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("date")).agg(
        F.sum(F.expr("cast(round(l_discount * 100) as bigint)")).alias("cents"),
        F.count("*").alias("n"),
        F.sum("l_quantity").alias("qty"),
        F.max("l_tax").alias("tax"),
    )
    day = (
        lines.join(who, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("n_name").alias("ticker"), "date")
        .agg(
            F.expr("(sum(cents) * 10000) div sum(n) - 50000").alias("gi"),
            F.sum("qty").alias("volume"),
            F.max("tax").alias("wick"),
        )
    )
    out = _walk(day, 100.0, "date").withColumn("open", F.round(F.col("pc") * F.exp(F.col("gi") / 2e6), 4))
    return out.select(
        "ticker",
        "date",
        "open",
        F.round(F.greatest("open", "close") * (1 + F.col("wick") / 10) + 1.3e-8, 4).alias("high"),
        F.round(F.least("open", "close") * (1 - F.col("wick") / 10) + 1.3e-8, 4).alias("low"),
        "close",
        "volume",
    )


def bars_from_ticks(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """OHLCV bars from ticks (event_id, ts, event_type, value); one combinable aggregation."""
    cents = F.expr("cast(round(value * 100) as bigint)")
    agg = ticks.groupBy(F.col("event_type").alias("ticker"), F.window("ts", width).start.alias("ts")).agg(
        F.sum(cents).alias("cents"),
        F.count("*").alias("n"),
        F.min_by(cents, "event_id").alias("first_c"),
        (F.max(cents) - F.min(cents)).alias("span"),
    )
    moved = agg.withColumn("gi", F.expr("(cents div n - 5000) * 2"))
    out = _walk(moved, 20.0, "ts").withColumn(
        "open", F.round(F.col("pc") * F.exp(F.floor((F.col("first_c") - 5000) / 10) / 1e6), 4)
    )
    return out.select(
        "ticker",
        "ts",
        "open",
        F.round(F.greatest("open", "close") * (1 + F.col("span") / 2e6) + 1.3e-8, 4).alias("high"),
        F.round(F.least("open", "close") * (1 - F.col("span") / 4e6) + 1.3e-8, 4).alias("low"),
        "close",
        F.expr("cast(cents div 100 + n as double)").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    return bars_from_ticks(table(spark, sf_dir, "events"), width)
