"""Table upkeep: merges, upserts, rolling stores, coverage, partitioned feature store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the latest by order; a combinable aggregate, not a sort of the key's rows."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return g.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest]).select(*df.columns)


def merge_over(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union of both tables where new rows replace old ones of the same key."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return keep_last(both, keys, ["_v"]).drop("_v")


def rolling_store(stored: DataFrame, fresh: DataFrame, keys: list[str], days: int = 30, at: str = "ts") -> DataFrame:
    """Append, keep the last version of a key, prune rows older than `days` before the newest."""
    merged = merge_over(stored, fresh, keys)
    newest = merged.agg(F.max(at).alias("_hi"))
    return merged.join(F.broadcast(newest)).where(F.col(at) >= F.col("_hi") - F.expr(f"interval {days} days")).drop("_hi")


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def update_rows(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join and coalesce: changed columns take the new value where one is given."""
    c = changes.select(key, *[F.col(x).alias(f"_n_{x}") for x in columns])
    j = table.join(c, key, "left")
    return j.select(*[F.coalesce(f"_n_{x}", x).alias(x) if x in columns else F.col(x) for x in table.columns])


def coverage(df: DataFrame, want: float = 0.8, fallback: float = 0.5) -> DataFrame:
    """Tickers with enough of the dates; the lower bar applies when none reaches the first."""
    days = df.agg(F.count_distinct("date").alias("days"))
    g = df.groupBy("ticker").agg(F.count("close").alias("n")).join(F.broadcast(days)).withColumn("coverage", F.col("n") / F.col("days"))
    best = g.agg(F.max("coverage").alias("best"))
    lim = F.when(F.col("best") >= want, want).otherwise(fallback)
    return g.join(F.broadcast(best)).where(F.col("coverage") >= lim).select("ticker", "n", "coverage")


def freshness(df: DataFrame, at: str = "ts") -> DataFrame:
    """Minutes and days each ticker lags behind the newest row of the table."""
    g = df.groupBy("ticker").agg(F.max(at).alias("last"))
    newest = g.agg(F.max("last").alias("now"))
    gap = F.unix_timestamp("now") - F.unix_timestamp("last")
    return g.join(F.broadcast(newest)).select("ticker", "last", F.floor(gap / 60).alias("minutes"), F.floor(gap / 86400).alias("days"))


def fetch_plan(entries: DataFrame, back: int = 3, forward: int = 2) -> DataFrame:
    return entries.select("ticker", F.date_sub("day", back).alias("start"), F.date_add("day", forward).alias("end")).distinct()


def write_features(df: DataFrame, path: str, universe: str) -> None:
    """Partitioned by universe and date; existing dates are left alone."""
    df.withColumn("universe", F.lit(universe)).write.mode("append").partitionBy("universe", "date").parquet(path)


def missing_dates(spark: SparkSession, path: str, universe: str, wanted: DataFrame) -> DataFrame:
    """Wanted dates without a stored partition (partition columns only are read)."""
    have = spark.read.parquet(path).where(F.col("universe") == universe).select("date").distinct()
    return wanted.join(have, "date", "left_anti")


def update_features(df: DataFrame, path: str, universe: str) -> int:
    """Write the dates of df that the store does not have yet and return how many.

    Only partition names are read to tell them; the missing dates' partitions are overwritten one
    by one (dynamic overwrite), so a repeated or interrupted run leaves every date once.
    """
    spark = df.sparkSession
    wanted = df.select("date").distinct()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    todo = missing_dates(spark, path, universe, wanted) if stored else wanted
    n = todo.count()
    if n:
        fresh = df.join(todo, "date", "left_semi").withColumn("universe", F.lit(universe))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("universe", "date").parquet(path)
    return n


def universe_fingerprint(df: DataFrame) -> DataFrame:
    """First eight md5 characters of the sorted ticker list (a fixed universe)."""
    return df.agg(F.substring(F.md5(F.concat_ws(",", F.array_sort(F.collect_set("ticker")))), 1, 8).alias("fingerprint"))


def window_dates(path: Column) -> Column:
    """(start, end) from a file stem like TICKER_2024-01-02_2024-01-05."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z]+)?$", 1)
    parts = F.split(stem, "_")
    at = lambda k: F.try_to_timestamp(F.try_element_at(parts, F.lit(k)), F.lit("yyyy-MM-dd")).cast("date")
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("ticker"), at(2).alias("start"), at(3).alias("end"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
