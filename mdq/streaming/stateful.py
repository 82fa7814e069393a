"""Streaming operators with named state variables and timers (transformWithState).

State lives in the RocksDB store, a key at a time. Both operators drop what they know of a key by
an event-time timer, so state is bounded by the keys that are active, not by all keys ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_variables(spark: SparkSession) -> None:
    """State variables need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of one key in one micro-batch, in order."""
    return pd.concat(list(frames)).sort_values(["us", "seq"], kind="stable")


class _Fleet(StatefulProcessor):
    """Latest static and position message of a vessel; tells when its class changes or it falls silent."""

    _FIELDS = ["seen", "static_at", "static_seq", "tanker", "length", "draught", "position_at", "position_seq", "course", "kind"]
    _TYPES = "seen bigint, static_at bigint, static_seq bigint, tanker boolean, length double, draught double, position_at bigint, position_seq bigint, course double, kind string"

    def __init__(self, minutes: int):
        self.silence = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("vessel", self._TYPES)

    @staticmethod
    def kind(v: dict) -> str:
        """The class of a vessel: a tanker needs a static message that says so and a position."""
        if not v["tanker"] or v["position_at"] is None:
            return "other"
        c = v["course"]
        way = "unknown" if c is None else "outbound" if 90 <= c <= 210 else "inbound" if 270 <= c <= 360 else "transit"
        return f"tanker:{int((v['length'] or 0) > 300)}:{int((v['draught'] or 0) > 15)}:{way}"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        v = dict(zip(self._FIELDS, self.known.get() if self.known.exists() else [None] * len(self._FIELDS)))
        was, before = v["kind"], v["seen"]
        for r in _rows(rows).itertuples(index=False):
            v["seen"] = max(int(r.us), v["seen"] or 0)
            part, fields = ("static", ("tanker", "length", "draught")) if r.is_static else ("position", ("course",))
            at = (int(r.us), int(r.seq))
            if v[f"{part}_at"] is None or at >= (v[f"{part}_at"], v[f"{part}_seq"]):
                v[f"{part}_at"], v[f"{part}_seq"] = at
                for f in fields:
                    x = getattr(r, f)
                    v[f] = None if pd.isna(x) else bool(x) if f == "tanker" else float(x)
        v["kind"] = self.kind(v)
        self.known.update(tuple(v[f] for f in self._FIELDS))
        if before is not None and before != v["seen"]:
            self.handle.deleteTimer(before // 1000 + self.silence)
        if before != v["seen"]:
            self.handle.registerTimer(max(v["seen"] // 1000 + self.silence, timerValues.getCurrentWatermarkInMs() + 1))
        if was != v["kind"]:
            yield pd.DataFrame({"vessel": [key[0]], "was": [was], "now": [v["kind"]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        v = dict(zip(self._FIELDS, self.known.get()))
        if v["seen"] // 1000 + self.silence <= timerValues.getCurrentWatermarkInMs():
            self.known.clear()
            yield pd.DataFrame({"vessel": [key[0]], "was": [v["kind"]], "now": [None]})

    def close(self) -> None:
        pass


def vessel_changes(messages: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """(vessel, was, now) whenever a vessel's class changes; now is null when it has been silent for so many minutes.

    messages: vessel, ts, seq, is_static, tanker, length, draught, course.
    """
    use_state_variables(messages.sparkSession)
    m = messages.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    kind = dict(messages.dtypes)["vessel"]
    return m.groupBy("vessel").transformWithStateInPandas(_Fleet(minutes), f"vessel {kind}, was string, now string", "Append", "EventTime")


def census_of(changes: DataFrame) -> DataFrame:
    """The census that changes add up to: every change takes a vessel out of its old class and puts it into its new one."""
    steps = changes.select(F.explode(F.array(F.struct(F.col("now").alias("kind"), F.lit(1).alias("n")), F.struct(F.col("was").alias("kind"), F.lit(-1).alias("n")))).alias("s")).where("s.kind is not null")
    kinds = steps.groupBy("s.kind").agg(F.sum("s.n").alias("n"))  # a handful of classes
    part = F.split("kind", ":")
    tanker = F.col("kind").startswith("tanker")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    large = of(tanker & (part.getItem(1) == "1"))
    out = kinds.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("vessels"), of(tanker).alias("tankers"), large.alias("large"), of(tanker & (F.get(part, F.lit(2)) == "1")).alias("laden"),
        of(tanker & (F.get(part, F.lit(3)) == "outbound")).alias("outbound"), of(tanker & (F.get(part, F.lit(3)) == "inbound")).alias("inbound"),
    )
    return out.withColumn("severity", F.when(F.col("large") >= 3, "NORMAL").when(F.col("large") >= 1, "MODERATE").otherwise("CRITICAL"))


class _Gate(StatefulProcessor):
    """Accepts a key's signals: none while a position is open, none within the pause after the last accepted one."""

    def __init__(self, minutes: int):
        self.pause = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")
        self.position = handle.getValueState("position", "entry bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        entry = self.position.get()[0] if self.position.exists() else None
        taken = []
        for r in _rows(rows).itertuples(index=False):
            if r.closes:
                entry = None
            elif entry is None and (last is None or r.us - last >= self.pause):
                last = int(r.us)
                entry = int(r.seq)
                taken.append(entry)
        if last is not None:
            self.last.update((last,))
            self.handle.registerTimer(max((last + self.pause) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        if entry is None:
            self.position.clear()
        else:
            self.position.update((entry,))
        yield pd.DataFrame({"key": [key[0]] * len(taken), "seq": taken})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the pause is over; an open position is still remembered
        if self.last.exists() and (self.last.get()[0] + self.pause) // 1000 <= timerValues.getCurrentWatermarkInMs():
            self.last.clear()
        yield pd.DataFrame({"key": [], "seq": []})

    def close(self) -> None:
        pass


def gated_signals(signals: DataFrame, exits: DataFrame, minutes: int = 30) -> DataFrame:
    """(key, seq) of the accepted signals; signals and exits are two streams of (key, ts, seq), seq unique and in order of time.

    A signal is refused while the key's position is open (from an accepted signal to the next
    exit) and within `minutes` of the last accepted one.
    """
    use_state_variables(signals.sparkSession)
    cols = ["key", "ts", "seq"]
    both = signals.select(*cols, F.lit(False).alias("closes")).unionByName(exits.select(*cols, F.lit(True).alias("closes")))
    s = both.withWatermark("ts", f"{minutes} minutes").withColumn("us", F.unix_micros("ts"))
    kind = dict(signals.dtypes)["key"]
    return s.groupBy("key").transformWithStateInPandas(_Gate(minutes), f"key {kind}, seq bigint", "Append", "EventTime")
