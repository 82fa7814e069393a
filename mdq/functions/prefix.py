"""Running totals over long groups, split by a bucket so no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_curve(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str) -> DataFrame:
    """Add cum (running sum of value) and peak (its running maximum, at least 0) per keys.

    Each (keys, bucket) is summed on its own; one row per bucket then carries totals forward,
    and a second short pass does the same for the peak.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    part = df.withColumn("_in", F.sum(value).over(inside))
    heads = part.groupBy(*keys, bucket).agg(F.sum(value).alias("_t"), F.max("_in").alias("_m"))
    heads = heads.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0.0)))
    heads = heads.withColumn("_top", F.greatest(F.coalesce(F.max(F.col("_off") + F.col("_m")).over(before), F.lit(0.0)), F.lit(0.0)))
    out = part.join(heads.drop("_t", "_m"), [*keys, bucket]).withColumn("cum", F.col("_off") + F.col("_in"))
    return out.withColumn("peak", F.greatest(F.col("_top"), F.max("cum").over(inside))).drop("_in", "_off", "_top")
