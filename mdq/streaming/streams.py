"""Structured Streaming forms of the bar, census, alert, cooldown and exit operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files as a stream with the files' own schema."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a query over the available input into a Parquet table and read it back.

    With a folder of the caller's the query resumes from its checkpoint and the table grows.
    """
    spark = stream.sparkSession
    folder = folder or _fresh(spark)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _fresh(spark: SparkSession) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drain_table(aggregate: DataFrame, folder: str | None = None) -> DataFrame:
    """Keep the table of a streaming aggregation and read it back.

    The rows live in the aggregation's state. Every micro-batch writes the table as a version
    named by its number, so a batch that is repeated after a failure writes the same version
    again, and a query that resumes from the caller's folder goes on with the next.
    """
    spark = aggregate.sparkSession
    folder = folder or _fresh(spark)

    def each(table: DataFrame, epoch: int) -> None:
        table.write.mode("overwrite").parquet(f"{folder}/table/version={epoch}")

    q = aggregate.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/table")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path)] if fs.exists(path) else []
    if not versions:
        return spark.createDataFrame([], aggregate.schema)
    return spark.read.schema(aggregate.schema).parquet(f"{folder}/table/version={max(versions)}")


def ticks(spark: SparkSession, path: str) -> DataFrame:
    return file_stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_bars(t: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """OHLC and count per event type and window, final once the watermark passes."""
    w = t.withWatermark("ts", late).groupBy("event_type", F.window("ts", width))
    return w.agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").alias("n")
    ).select("event_type", F.col("window.start").alias("start"), "open", "high", "low", "close", "n")


def unique_keys(t: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """First row of each key within the watermark."""
    return t.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys).select(*keys)


def census(t: DataFrame, width: str = "30 minutes", slide: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows, distinct kinds of traffic and severity per sliding window."""
    g = t.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(
        F.count("*").alias("seen"), F.sum((F.col("value") > 50).cast("bigint")).alias("large"), F.sum((F.col("event_type") == "error").cast("bigint")).alias("errors")
    )
    sev = F.when(F.col("errors") >= 4, "high").when(F.col("errors") >= 2, "elevated").otherwise("normal")
    return g.select(F.col("window.start").alias("start"), "seen", "large", "errors", sev.alias("severity"))


def sessions(t: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Activity sessions per user; a small value keeps a session open longer."""
    gap = F.when(F.col("value") < 20, "40 minutes").otherwise("20 minutes")
    g = t.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def last_versions(t: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Newest row of each key by the order column, as a streaming aggregation."""
    rest = [c for c in t.columns if c not in keys]
    g = t.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x"))
    return g.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def last_seen(t: DataFrame, folder: str | None = None) -> DataFrame:
    """Newest timestamp per user."""
    return drain_table(t.groupBy("user_id").agg(F.max("ts").alias("ts")), folder)


def stale(seen: DataFrame, key: str, minutes: int = 6) -> DataFrame:
    """Keys whose newest timestamp is more than `minutes` older than the newest of all."""
    now = seen.agg(F.max("ts").alias("now"))
    age = (F.unix_micros("now") - F.unix_micros("ts")) / 60e6
    return seen.join(F.broadcast(now)).withColumn("minutes_old", age).where(F.col("minutes_old") > minutes).select(key, "ts", "minutes_old")


def merged_messages(t: DataFrame, folder: str | None = None) -> DataFrame:
    """Latest static and latest position message of each user, side by side."""
    rows = t.where("event_type in ('signup', 'view')")
    newest = lambda kind: F.max_by("value", F.when(F.col("event_type") == kind, F.col("event_id")))
    return drain_table(rows.groupBy("user_id").agg(newest("signup").alias("static"), newest("view").alias("position")), folder)


def alerts(bars: DataFrame, levels: DataFrame, found: DataFrame, band: float = 0.01) -> DataFrame:
    """Bars with a pattern that close within the band of the day's support (stream-static joins)."""
    j = bars.withColumn("day", F.to_date("ts")).join(levels.select("ticker", "day", "support"), ["ticker", "day"])
    j = j.where(F.abs(F.col("close") - F.col("support")) <= band * F.col("support"))
    p = found.where("confidence > 0").select("ticker", F.col("ts").cast("timestamp").alias("ts"), "pattern", F.col("confidence").alias("score"))
    return j.join(p, ["ticker", "ts"]).select("ticker", "ts", "support", "pattern", "score")


def _cool(minutes: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the pause is over: nothing left to remember
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("event_id")  # one user, one micro-batch
        kept = []
        for i, ts in zip(rows["event_id"], rows["us"]):
            if last is None or ts - last >= minutes * 60_000_000:
                kept.append(int(i))
                last = int(ts)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]] * len(kept), "event_id": kept})

    return step


def cooldown(t: DataFrame, minutes: int = 30) -> DataFrame:
    """Signals at least `minutes` after the last accepted one of the same user; a user's state goes when the watermark has passed its pause."""
    s = t.withWatermark("ts", f"{minutes} minutes").select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return s.groupBy("user_id").applyInPandasWithState(_cool(minutes), "user_id bigint, event_id bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def _monitor(pt: float, sl: float, fade: float):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, done = state.get if state.exists else (0.0, False)
        out = []
        for row in pd.concat(list(frames)).sort_values("ts").itertuples():
            if done:
                break
            high = max(high, row.close)
            if row.close <= row.entry * (1 - sl):
                reason = "stop"
            elif row.close >= row.entry * (1 + pt):
                reason = "target"
            elif high > row.entry * 1.005 and row.close <= high * (1 - fade):
                reason = "fade"
            else:
                continue
            out.append((key[0], row.ts, row.close, reason))
            done = True
        state.update((float(high), bool(done)))
        yield pd.DataFrame(out, columns=["ticker", "ts", "close", "reason"])

    return step


def exit_monitor(bars: DataFrame, fills: DataFrame, pt: float = 0.03, sl: float = 0.02, fade: float = 0.01) -> DataFrame:
    """First stop, target or fade from the high-water mark of each open position (ticker, entry, since)."""
    j = bars.join(fills, "ticker").where(F.col("ts") > F.col("since")).select("ticker", "ts", "close", "entry")
    return j.groupBy("ticker").applyInPandasWithState(_monitor(pt, sl, fade), "ticker string, ts timestamp, close double, reason string", "high double, done boolean", "append", GroupStateTimeout.NoTimeout)
