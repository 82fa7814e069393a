"""Registered queries that run a stream over the available files and return its table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions.core import tidy
from ..operators import patterns
from ..streaming import stateful, streams
from .inputs import bars
from .q_intraday import candles, levels_daily
from .registry import cte, query, rounded

_NTZ = "timestamp_ntz"
_WM = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def _ticks(spark, sf_dir):
    return streams.ticks(spark, f"{sf_dir}/events*.parquet")


def _bars(spark, sf_dir):
    """The staged bar table read as a stream."""
    path = os.path.dirname(bars(spark, sf_dir).inputFiles()[0])
    return streams.file_stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_tumbling_bars", f"SELECT event_type, start, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS n FROM (SELECT *, date_trunc('hour', ts) AS start FROM events) GROUP BY 1, 2 HAVING start + INTERVAL 1 HOUR <= {_WM}")
def s_bars(spark, sf_dir):
    return streams.drain(streams.tumbling_bars(_ticks(spark, sf_dir))).withColumn("start", F.col("start").cast(_NTZ))


@query("stream_unique_keys", "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events")
def s_unique(spark, sf_dir):
    t = _ticks(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts"))
    return streams.drain(streams.unique_keys(t, ["user_id", "event_type", "hour"])).withColumn("hour", F.col("hour").cast(_NTZ))


@query("stream_census", f"""SELECT start, seen, large, errors, CASE WHEN errors >= 4 THEN 'high' WHEN errors >= 2 THEN 'elevated' ELSE 'normal' END AS severity FROM (SELECT start, count(*) AS seen, count(*) FILTER (value > 50) AS large, count(*) FILTER (event_type = 'error') AS errors FROM (
 SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(k * 10) AS start FROM events, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY 1) WHERE start + INTERVAL 30 MINUTE <= {_WM}""")
def s_census(spark, sf_dir):
    return streams.drain(streams.census(_ticks(spark, sf_dir))).withColumn("start", F.col("start").cast(_NTZ))


@query("stream_sessions", f"""SELECT user_id, start, "end", n FROM (SELECT user_id, min(ts) AS start, max(e) AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
 SELECT *, CASE WHEN ts > max(e) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM (SELECT *, ts + CASE WHEN value < 20 THEN INTERVAL 40 MINUTE ELSE INTERVAL 20 MINUTE END AS e FROM events))) GROUP BY user_id, s) WHERE "end" <= {_WM}""")
def s_sessions(spark, sf_dir):
    t = streams.drain(streams.sessions(_ticks(spark, sf_dir)))
    return t.withColumns({"start": F.col("start").cast(_NTZ), "end": F.col("end").cast(_NTZ)})


@query("stream_last_seen", "SELECT user_id, max(ts) AS ts FROM events GROUP BY 1")
def s_last(spark, sf_dir):
    return streams.last_seen(_ticks(spark, sf_dir)).withColumn("ts", F.col("ts").cast(_NTZ))


@query("stream_last_versions", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def s_versions(spark, sf_dir):
    t = _ticks(spark, sf_dir).select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    return streams.drain_table(streams.last_versions(t, ["user_id", "event_type"], "at")).drop("at")


@query("stream_stale_keys", rounded("user_id ts", "minutes_old", "SELECT user_id, ts, (epoch_us(max(ts) OVER ()) - epoch_us(ts)) / 6e7 AS minutes_old FROM (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1) QUALIFY minutes_old > 6", 4))
def s_stale(spark, sf_dir):
    t = streams.stale(streams.last_seen(_ticks(spark, sf_dir)), "user_id").withColumn("ts", F.col("ts").cast(_NTZ))
    return tidy(t, ["user_id", "ts"], ["minutes_old"], 4)


@query("stream_merged_messages", "SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'signup') AS static, arg_max(value, event_id) FILTER (event_type = 'view') AS position FROM events WHERE event_type IN ('signup', 'view') GROUP BY 1")
def s_merged(spark, sf_dir):
    return streams.merged_messages(_ticks(spark, sf_dir))


@query("stream_alerts", rounded("ticker ts pattern", "support score", """SELECT b.ticker, b.ts, support, p.pattern, p.confidence AS score FROM bi b JOIN levels_daily l ON l.ticker = b.ticker AND l.day = b.day
 JOIN (SELECT ticker, ts, 'eqh_pair' AS pattern, 0.8::DOUBLE AS confidence FROM eqh) p ON p.ticker = b.ticker AND p.ts = b.ts WHERE abs(close - support) <= 0.01 * support""", 4))
def s_alerts(spark, sf_dir):
    found = patterns.equal_highs(candles(spark, sf_dir))
    t = streams.drain(streams.alerts(_bars(spark, sf_dir), levels_daily(spark, sf_dir), found)).withColumn("ts", F.col("ts").cast(_NTZ))
    return tidy(t, ["ticker", "ts", "pattern"], ["support", "score"], 4)


cte("cool_rows", "SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'purchase'")
cte(
    "cool_steps",
    """SELECT user_id, event_id, k, ts AS last, true AS kept FROM cool_rows WHERE k = 1
 UNION ALL SELECT p.user_id, p.event_id, p.k, CASE WHEN p.ts - r.last >= INTERVAL 30 MINUTE THEN p.ts ELSE r.last END, p.ts - r.last >= INTERVAL 30 MINUTE FROM cool_steps r JOIN cool_rows p ON p.user_id = r.user_id AND p.k = r.k + 1""",
)


@query("stream_cooldown", "SELECT user_id, event_id FROM cool_steps WHERE kept")
def s_cooldown(spark, sf_dir):
    return streams.drain(streams.cooldown(_ticks(spark, sf_dir).where("event_type = 'purchase'")))


@query("stream_exit_monitor", rounded("ticker ts reason", "close", """SELECT ticker, ts, close, reason FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS k FROM (
 SELECT *, CASE WHEN close <= entry * 0.98 THEN 'stop' WHEN close >= entry * 1.03 THEN 'target' WHEN hw > entry * 1.005 AND close <= hw * 0.99 THEN 'fade' END AS reason FROM (
 SELECT b.ticker, b.ts, b.close, f.entry, max(b.close) OVER (PARTITION BY b.ticker ORDER BY b.ts) AS hw FROM bars b JOIN (SELECT ticker, arg_min(close, ts) AS entry, min(ts) AS since FROM bars GROUP BY 1) f ON f.ticker = b.ticker AND b.ts > f.since)) WHERE reason IS NOT NULL) WHERE k = 1""", 4))
def s_exit(spark, sf_dir):
    b = bars(spark, sf_dir)
    fills = b.groupBy("ticker").agg(F.min_by("close", "ts").alias("entry"), F.min("ts").cast("timestamp").alias("since"))
    t = streams.drain(streams.exit_monitor(_bars(spark, sf_dir), fills)).withColumn("ts", F.col("ts").cast(_NTZ))
    return tidy(t, ["ticker", "ts", "reason"], ["close"], 4)


# vessels: sign-ups and errors are static messages, all other events positions
_DAYS = 3
cte(
    "fleet",
    f"""SELECT *, coalesce(tanker, false) AND course IS NOT NULL AS counted FROM (SELECT vessel, max(ts) AS seen, arg_max(tanker, (ts, event_id)) FILTER (fixed) AS tanker, arg_max(length, (ts, event_id)) FILTER (fixed) AS length,
 arg_max(draught, (ts, event_id)) FILTER (fixed) AS draught, arg_max(course, (ts, event_id)) FILTER (NOT fixed) AS course FROM (
 SELECT user_id AS vessel, ts, event_id, event_type IN ('signup', 'error') AS fixed, event_type = 'signup' AS tanker, value * 4 AS length, value / 4 AS draught, CAST(floor(value * 100) AS BIGINT) % 360 AS course FROM events) GROUP BY 1) WHERE seen + INTERVAL {_DAYS} DAY > {_WM}""",
)


@query("stream_vessel_census", """SELECT *, CASE WHEN large >= 3 THEN 'NORMAL' WHEN large >= 1 THEN 'MODERATE' ELSE 'CRITICAL' END AS severity FROM (
 SELECT count(*) AS vessels, count(*) FILTER (counted) AS tankers, count(*) FILTER (counted AND length > 300) AS large, count(*) FILTER (counted AND draught > 15) AS laden,
 count(*) FILTER (counted AND course BETWEEN 90 AND 210) AS outbound, count(*) FILTER (counted AND course BETWEEN 270 AND 360) AS inbound FROM fleet)""")
def s_fleet(spark, sf_dir):
    v = F.col("value")
    static = F.col("event_type").isin("signup", "error")
    m = _ticks(spark, sf_dir).select(
        F.col("user_id").alias("vessel"), "ts", F.col("event_id").alias("seq"), static.alias("is_static"), (F.col("event_type") == "signup").alias("tanker"),
        (v * 4).alias("length"), (v / 4).alias("draught"), (F.floor(v * 100) % 360).cast("double").alias("course"),
    )
    return stateful.census_of(streams.drain(stateful.vessel_changes(m, _DAYS * 1440)))


cte("gate_rows", "SELECT user_id, event_id, ts, event_type = 'signup' AS closes, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('purchase', 'signup')")
cte(
    "gate_steps",
    """SELECT user_id, event_id, k, NOT closes AS taken, CASE WHEN NOT closes THEN ts END AS last, NOT closes AS open FROM gate_rows WHERE k = 1
 UNION ALL SELECT user_id, event_id, k, ok, CASE WHEN ok THEN ts ELSE last END, CASE WHEN closes THEN false WHEN ok THEN true ELSE open END FROM (
 SELECT p.*, r.last, r.open, NOT p.closes AND NOT r.open AND (r.last IS NULL OR p.ts - r.last >= INTERVAL 30 MINUTE) AS ok FROM gate_steps r JOIN gate_rows p ON p.user_id = r.user_id AND p.k = r.k + 1)""",
)


@query("stream_gated_signals", "SELECT user_id AS key, event_id AS seq FROM gate_steps WHERE taken")
def s_gated(spark, sf_dir):
    of = lambda kind: _ticks(spark, sf_dir).where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"))
    return streams.drain(stateful.gated_signals(of("purchase"), of("signup")))
