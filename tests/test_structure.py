"""Structure features against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mdq.functions.scan import state_before
from mdq.operators import structure


def ohlcv(spark, n, seed=1, ticker="A"):
    rng = random.Random(seed)
    rows, c = [], 100.0
    for k in range(n):
        o = c
        c = round(max(1.0, c * (1 + rng.gauss(0, 0.02))), 4)
        hi, lo = round(max(o, c) * (1 + rng.random() * 0.01), 4), round(min(o, c) * (1 - rng.random() * 0.01), 4)
        rows.append((ticker, dt.date(2020, 1, 1) + dt.timedelta(k), o, hi, lo, c, float(rng.randint(1, 50))))
    return rows, spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000])
def test_scan_follows_a_machine(spark, n):
    rng = random.Random(n)
    steps = [[rng.choice([0, 1, 2, s, s, None]) for s in range(3)] for _ in range(n)]
    rows = [(key, k, *(steps[k] if key == "a" else steps[n - 1 - k])) for key in "ab" for k in range(n)]
    df = spark.createDataFrame(rows, "key string, at int, x int, y int, z int")
    got = {(r["key"], r["at"]): r["state"] for r in state_before(df, ["key"], "at", [F.col(c) for c in "xyz"], 1).collect()}
    for key in "ab":
        s = 1
        for k in range(n):
            assert got[key, k] == s
            step = steps[k] if key == "a" else steps[n - 1 - k]
            s = s if step[s] is None else step[s]


def plain_breaks(rows, skip=50, n=5):
    high, low, close = ([r[k] for r in rows] for k in (3, 4, 5))
    inside = range(n, len(rows) - n)
    top = [k in inside and all(high[k] > high[k + d] for d in range(-n, n + 1) if d) for k in range(len(rows))]
    bottom = [k in inside and all(low[k] < low[k + d] for d in range(-n, n + 1) if d) for k in range(len(rows))]
    out, trend, peak, floor = [0.0] * len(rows), 0, None, None
    for k in range(skip, len(rows)):
        if top[k]:
            trend = 1 if peak is not None and high[k] > peak else trend
            peak = high[k]
        if bottom[k]:
            trend = -1 if floor is not None and low[k] < floor else trend
            floor = low[k]
        if trend == 1 and floor is not None and low[k] < floor:
            out[k], trend = -min((floor - low[k]) / close[k] * 50, 1.0), -1
        elif trend == -1 and peak is not None and high[k] > peak:
            out[k], trend = min((high[k] - peak) / close[k] * 50, 1.0), 1
    return out


def test_breaks_of_structure(spark):
    a, one = ohlcv(spark, 700, 1, "A")
    b, other = ohlcv(spark, 40, 2, "B")
    got = {(r["ticker"], r["date"]): r["break_of_structure"] for r in structure.structure_breaks(one.unionByName(other)).collect()}
    want = {(r[0], r[1]): x for rows in (a, b) for r, x in zip(rows, plain_breaks(rows))}
    assert got == pytest.approx(want)
    assert sum(x != 0 for x in want.values()) > 10 and min(want.values()) < 0 < max(want.values())


def plain_profile(rows, n=20):
    out = []
    for k in range(len(rows)):
        if k < n:
            out.append((0.0, 0.0, 0.0))
            continue
        past = rows[k - n : k]
        edges = np.linspace(min(r[4] for r in past), max(r[3] for r in past), 50)
        held = np.zeros(49)
        for r in past:
            held[max(0, min(int(np.searchsorted(edges, r[5])) - 1, 48))] += r[6]
        first = last = int(held.argmax())
        middle, now = (edges[first] + edges[first + 1]) / 2, held[first]
        while now < held.sum() * 0.70:
            left, right = held[first - 1] if first else 0, held[last + 1] if last < 48 else 0
            if left > right and first:
                first, now = first - 1, now + left
            elif last < 48:
                last, now = last + 1, now + right
            else:
                break
        out.append(tuple(x / rows[k][5] - 1 for x in (middle, edges[last + 1], edges[first])))
    return out


def test_value_area(spark):
    rows, df = ohlcv(spark, 150, 3)
    got = {r["date"]: (r["poc_distance"], r["va_high_distance"], r["va_low_distance"]) for r in structure.rolling_profile(df).collect()}
    for r, want in zip(rows, plain_profile(rows)):
        assert got[r[1]] == pytest.approx(want, abs=1e-9)


def test_families_by_name(spark):
    _, df = ohlcv(spark, 80, 4)
    out = structure.family_features(df, ["fvg_bull", "range_position", "ma_20_distance"], lag=1)
    assert out.columns == ["ticker", "date", "fvg_bull", "range_position", "ma_20_distance"] and out.count() == 80
    with pytest.raises(KeyError):
        structure.family_features(df, ["nothing"])


def test_families_take_one_order_of_the_rows(spark):
    rows = [(t, *r[1:]) for t, seed in (("A", 5), ("B", 6), ("C", 7), (None, 8)) for r in ohlcv(spark, 230, seed)[0]]
    rows = [(*r[:5], None, r[6]) if r[0] == "C" and k % 61 == 0 else r for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        sr, smc = structure.support_resistance(df), structure.smart_money(df)
        for d in (sr, smc):
            assert "Join" not in d._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["ticker"], r["date"]): r for r in sr.collect()}
        parts = [structure.rolling_profile(df), structure.bands(df), structure.action_levels(df)]
        parts = [{(r["ticker"], r["date"]): r for r in p.collect()} for p in parts]
        breaks = {(r["ticker"], r["date"]): r["break_of_structure"] for r in structure.structure_breaks(df).collect()}
        assert {(r["ticker"], r["date"]): r["break_of_structure"] for r in smc.collect()} == breaks and len(breaks) == 920
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 690  # those with a ticker
    for t in "ABC":
        own = [r for r in rows if r[0] == t]
        c = np.array([np.nan if r[5] is None else r[5] for r in own])
        for k, r in enumerate(own):
            x = got[t, r[1]]
            profile = parts[0][t, r[1]]
            assert [x[f"sr_{n}"] for n in ("poc_distance", "va_high_distance")] == [profile[n] for n in ("poc_distance", "va_high_distance")]
            assert all(x[n] == p[t, r[1]][n] for p in parts[1:] for n in p[t, r[1]].asDict())
            for m in (20, 200):
                w = c[max(0, k - m + 1) : k + 1]
                full = len(w) == m and not np.isnan(w).any()
                assert x[f"ma_{m}_distance"] == (pytest.approx(w.mean() / c[k] - 1, abs=1e-9) if full else None)
            hi, lo = (max if f == 3 else min for f in (3, 4))
            w = own[max(0, k - 49) : k + 1]
            assert x["range_position"] == (pytest.approx((c[k] - lo(q[4] for q in w)) / (hi(q[3] for q in w) - lo(q[4] for q in w))) if k >= 49 and not np.isnan(c[k]) else None)
        if t != "C":
            want = plain_profile(own)
            assert [got[t, r[1]]["sr_poc_distance"] for r in own] == pytest.approx([w[0] for w in want], abs=1e-9)
            hits = plain_breaks(own)
            assert [breaks[t, r[1]] for r in own] == pytest.approx(list(hits.values()) if isinstance(hits, dict) else hits, abs=1e-9)


def test_scan_in_small_batches_and_with_a_null_key(spark):
    rows = [(key, k, 1, 2, 2) for key in ("a", None) for k in range(150)]
    df = spark.createDataFrame(rows, "key string, at int, x int, y int, z int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r["key"], r["at"]): r["state"] for r in state_before(df, ["key"], "at", [F.col(c) for c in "xyz"], 0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(150):
        assert got["a", k] == min(k, 2)
        assert got[None, k] == (min((k - 1) % 64 + 1, 2) if k else 0)
