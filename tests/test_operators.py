"""Operators against brute force and invariants."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mdq.operators import calendar, cards, factors, joins, levels, outcomes, patterns, population, portfolio, reports, risk, setup_score
from mdq.sources import store


@pytest.fixture(scope="module")
def prices(spark):
    rng = np.random.default_rng(42)
    days = pd.bdate_range("2023-01-02", periods=300)
    rows = []
    for t in range(6):
        c = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.02, 300)))
        rows.append(pd.DataFrame({"ticker": f"T{t}", "date": days.date, "close": c, "volume": rng.integers(1e5, 1e6, 300).astype(float)}))
    pdf = pd.concat(rows)
    return spark.createDataFrame(pdf, "ticker string, date date, close double, volume double").cache(), pdf


def test_factors_against_pandas(prices):
    df, pdf = prices
    got = factors.compute(df, ["mom_21d", "vol_63d", "skew_21d", "kurt_63d", "max_dd_63d", "hurst_proxy_63d", "zscore_21d"]).toPandas()
    for t, g in pdf.groupby("ticker"):
        s = g["close"].reset_index(drop=True)
        r = s.pct_change()
        x = got[got.ticker == t].sort_values("date").reset_index(drop=True)
        for i in (100, 299):
            w = s[i - 62 : i + 1]
            assert np.isclose(x["mom_21d"][i], s[i] / s[i - 21] - 1)
            assert np.isclose(x["vol_63d"][i], r[i - 62 : i + 1].std() * 252**0.5)
            assert np.isclose(x["skew_21d"][i], np.clip(r[i - 20 : i + 1].skew(), -3, 3))
            assert np.isclose(x["kurt_63d"][i], np.clip(r[i - 62 : i + 1].kurt(), -5, 10))
            assert np.isclose(x["max_dd_63d"][i], (w / w.cummax() - 1).min())
            cum = r[i - 62 : i + 1].cumsum()
            h = np.log((cum.max() - cum.min()) / r[i - 62 : i + 1].std()) / np.log(63)
            assert np.isclose(x["hurst_proxy_63d"][i], np.clip(h, 0, 1))
            w = s[i - 20 : i + 1]
            assert np.isclose(x["zscore_21d"][i], np.clip((s[i] - w.mean()) / w.std(), -4, 4))


def test_factors_do_not_look_ahead(prices):
    df, _ = prices
    names = ["mom_63d", "rsi_14", "rel_strength_21d", "market_beta_21d", "breadth_50d"]
    cut = dt.date(2023, 10, 2)
    a = factors.compute(df, names).where(F.col("date") <= cut).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    b = factors.compute(df.where(F.col("date") <= cut), names).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)


def test_short_history_defaults(prices):
    df, _ = prices
    first = factors.compute(df, ["mom_252d", "rsi_14", "vol_ratio_5_21", "fractal_dim_63d"]).orderBy("date", "ticker").first()
    assert (first.mom_252d, first.rsi_14, first.vol_ratio_5_21, first.fractal_dim_63d) == (0.0, 50.0, 1.0, 1.5)


def test_new_feature_type(prices):
    df, _ = prices
    factors.register("spread_to_mean", lambda p: (p, F.col("close") - F.avg("close").over(factors.last_n(p))))
    out = factors.compute(df, ["gap_5"], {"gap_5": ("spread_to_mean", 5)})
    assert out.where("gap_5 <> 0").count() > 0


def test_default_library_size():
    assert len(factors.SPECS) == 137


def test_all_features_equal_single_computation(spark, prices):
    df, _ = prices
    small = df.where("ticker in ('T0','T1')")
    some = ["mom_21d", "vol_63d", "dd_adj_mom_63d"]
    wide = factors.compute(small, some, execution_lag=1).toPandas().sort_values(["ticker", "date"])[some].to_numpy()
    one = factors.compute(small, some).toPandas().sort_values(["ticker", "date"])
    lagged = one.groupby("ticker")[some].shift(1).to_numpy()
    np.testing.assert_allclose(wide.astype(float), lagged.astype(float))


def test_walk_forward_penalises_flat_scores(spark, prices):
    df, _ = prices
    span = spark.createDataFrame([(dt.date(2023, 1, 2), dt.date(2024, 2, 23))], "start date, end date")
    periods = calendar.walk_forward_periods(span, 6, 2, 2)
    specs = {"mom": {"type": "feature", "name": "mom_21d"}, "flat": {"type": "constant", "value": 1}}
    rows = portfolio.walk_forward(df, periods, specs, 0.34).collect()
    flat = [r for r in rows if r.strategy == "flat"]
    assert flat and all(r.total_return == -0.5 and r.sharpe_ratio == -2.0 and r.n_days == 0 for r in flat)
    assert all(r.max_drawdown >= 0 and r.n_days > 5 for r in rows if r.strategy == "mom")


def test_asof_matches_pandas(spark):
    rng = np.random.default_rng(5)
    base = pd.Timestamp("2024-01-01")
    mk = lambda n, o: pd.DataFrame({"k": rng.choice(["a", "a", "a", "b"], n), "ts": base + pd.to_timedelta(rng.integers(0, 6000, n), "min"), "id": np.arange(n) + o})
    left, right = mk(300, 0), mk(200, 1000).drop_duplicates(["k", "ts"])
    right["v"] = rng.normal(size=len(right))
    got = joins.asof_backward(spark.createDataFrame(left), spark.createDataFrame(right), "k", "ts", ["v"], "id").toPandas().sort_values("id")
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts")[["k", "ts", "v"]], on="ts", by="k", allow_exact_matches=False).sort_values("id")
    np.testing.assert_allclose(got["v"].astype(float).to_numpy(), want["v"].to_numpy())


def test_pareto_front_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": range(400), "x": rng.integers(0, 40, 400).astype(float), "y": rng.integers(0, 40, 400).astype(float)})
    got = {r.id for r in population.pareto_front_2d(spark.createDataFrame(pdf), "x", "y", parts=8).collect()}
    v = pdf[["x", "y"]].to_numpy()
    want = {i for i in range(400) if not ((v >= v[i]).all(axis=1) & (v > v[i]).any(axis=1)).any()}
    assert got == want


def test_pairwise_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(m)], "id bigint, vec array<double>")
    monkeypatch.setattr(population, "_BLOCK_ROWS", 20)
    got = population.niches(df, "id", "vec", sigma=1.5, k=4).join(population.mean_distances(df, "id", "vec"), "id").toPandas().sort_values("id")
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.nan)
    share = np.where(d < 1.5, 1 - d / 1.5, 0)
    np.testing.assert_allclose(got["niche_count"], 1 + np.nansum(share, axis=1))
    np.testing.assert_allclose(got["mean_distance"], np.nanmean(d, axis=1))
    np.testing.assert_allclose(got["novelty"], np.sort(d, axis=1)[:, :4].mean(axis=1))


def test_level_dedupe_walk(spark):
    rng = np.random.default_rng(8)
    rows = [("A", float(p), "m", float(s), bool(s > 1)) for p, s in zip(np.sort(rng.uniform(10, 10.4, 60)).round(4), rng.uniform(0.5, 3, 60).round(3))]
    got = [(r.price, r.strength) for r in levels.dedupe(spark.createDataFrame(rows, "ticker string, price double, method string, strength double, is_support boolean")).orderBy("price").collect()]
    kept = []
    for _, p, _, s, _ in sorted(rows, key=lambda r: (r[1], -r[3])):
        if kept and abs(p - kept[-1][0]) / kept[-1][0] < 0.003:
            if s > kept[-1][1]:
                kept[-1] = (p, s)
            continue
        kept.append((p, s))
    assert got == kept


def _bars(spark, rows):
    t0 = dt.datetime(2024, 1, 15, 14, 30)
    return spark.createDataFrame([("A", t0 + dt.timedelta(minutes=5 * i), i + 1, *map(float, r)) for i, r in enumerate(rows)], "ticker string, ts timestamp, idx bigint, open double, high double, low double, close double")


@pytest.mark.parametrize(
    "bar, outcome, price",
    [((10, 10.6, 9.95, 10.5), "win", 10.5), ((10, 10.1, 9.8, 9.9), "loss", 9.9), ((9.4, 9.6, 9.3, 9.5), "loss", 9.4), ((10, 10.1, 9.95, 10.05), "timeout", 10.05)],
)
def test_first_barrier_rules(spark, bar, outcome, price):
    b = _bars(spark, [(10, 10.1, 9.95, 10), bar])
    c = spark.createDataFrame([("A", 1, 10.0, 9.0, 10.5, 9.9, 9.5)], "ticker string, entry_idx bigint, entry_price double, support double, target double, stop double, floor double")
    r = outcomes.first_barrier(c, b).first()
    assert r.outcome == outcome and r.exit_price == pytest.approx(price) and r.hold_bars == 1


def test_trailing_stop_turns_into_a_win(spark):
    b = _bars(spark, [(10, 10, 10, 10), (10.3, 10.4, 10.3, 10.35), (10.35, 10.36, 10.1, 10.2)])
    c = spark.createDataFrame([("A", 1, 10.0, 9.0, 12.0, 9.5, 9.0)], "ticker string, entry_idx bigint, entry_price double, support double, target double, stop double, floor double")
    r = outcomes.first_barrier(c, b, trail=1.0, trail_from=2.0).first()
    assert r.outcome == "win" and r.exit_price == pytest.approx(10.4 * 0.99)


def _at(spark, rows):
    """(ts, open, high, low, close) rows of one ticker as indexed bars."""
    return spark.createDataFrame([("A", t, i + 1, *map(float, r)) for i, (t, *r) in enumerate(rows)], "ticker string, ts timestamp, idx bigint, open double, high double, low double, close double")


def test_trade_stays_open_past_twelve_bars_and_ends_with_the_session(spark):
    t0 = dt.datetime(2024, 1, 15, 14, 0)
    flat = [(t0 + dt.timedelta(minutes=15 * i), 10, 10.1, 9.95, 10) for i in range(40)]
    c = spark.createDataFrame([("A", 1, 10.0, 9.0, 10.5, 9.9, 9.5)], "ticker string, entry_idx bigint, entry_price double, support double, target double, stop double, floor double")
    r = outcomes.first_barrier(c, _at(spark, flat)).first()
    assert r.outcome == "timeout" and r.exit_ts == dt.datetime(2024, 1, 15, 20, 0) and r.hold_bars == 24
    late = flat[:20] + [(flat[20][0], 10, 10.6, 9.95, 10)] + flat[21:]
    r = outcomes.first_barrier(c, _at(spark, late)).first()
    assert r.outcome == "win" and r.hold_bars == 20


def test_trade_without_a_late_bar_meets_the_gap_of_the_next_day(spark):
    a, b = dt.datetime(2024, 1, 15, 19, 0), dt.datetime(2024, 1, 16, 9, 0)
    c = spark.createDataFrame([("A", 1, 10.0, 9.0, 10.5, 9.9, 9.5)], "ticker string, entry_idx bigint, entry_price double, support double, target double, stop double, floor double")
    bars = _at(spark, [(a, 10, 10, 10, 10), (b, 9.2, 9.3, 9.1, 9.2)])
    r = outcomes.first_barrier(c, bars).first()
    assert r.outcome == "loss" and r.exit_price == pytest.approx(9.2) and r.exit_ts == b
    card = spark.createDataFrame([("A", a.date(), 1, a, 10.0)], "ticker string, day date, entry_idx bigint, entry_ts timestamp, entry_price double")
    x = cards.card_outcomes(card, bars).first()
    assert (x.reason, x.exit_ts, x.pnl_pct) == ("close", a, 0.0)  # a card never holds overnight


def test_nearest_bar_has_no_reach(spark):
    day = dt.datetime(2024, 1, 15)
    bars = spark.createDataFrame([("A", day + dt.timedelta(hours=h), float(h)) for h in (8, 14)] + [("A", day + dt.timedelta(days=9), 99.0)], "ticker string, ts timestamp, close double")
    pts = spark.createDataFrame([("A", day + dt.timedelta(hours=11), 1), ("A", day + dt.timedelta(hours=17), 2), ("A", day + dt.timedelta(days=3), 3), ("A", day - dt.timedelta(days=40), 4)], "ticker string, ts timestamp, id int")
    assert {r.id: r.close for r in joins.nearest_bar(pts, bars, "ticker").collect()} == {1: 8.0, 2: 14.0, 3: 14.0, 4: 8.0}


def test_entries_use_history_of_any_age(spark):
    old = [(dt.datetime(2024, 1, 2, 14 + i), 10, 11 + i, 9 - i, 10) for i in range(3)]
    bars = _at(spark, old + [(dt.datetime(2024, 1, 20, 14), 5, 5, 5, 5)]).withColumn("volume", F.lit(0.0))
    got = outcomes.entries_from_bars(bars).collect()
    assert [(r.day, r.support, r.resistance) for r in got] == [(dt.date(2024, 1, 20), pytest.approx(7.3), pytest.approx(12.7))]


def test_admission_walk_matches_loop(spark):
    rng = np.random.default_rng(9)
    t0 = dt.datetime(2024, 1, 15, 14)
    rows = []
    for i in range(80):
        a = t0 + dt.timedelta(minutes=int(rng.integers(0, 360)))
        rows.append((dt.date(2024, 1, 15), f"T{rng.integers(0, 6)}", i, a, a + dt.timedelta(minutes=int(rng.integers(5, 90))), float(rng.normal(0, 0.6))))
    df = spark.createDataFrame(rows, "day date, ticker string, entry_idx bigint, entry_ts timestamp, exit_ts timestamp, pnl_pct double")
    got = {r.entry_idx for r in cards.admit(df, slots=3, day_loss=-2.0).collect()}
    taken = []
    for _, t, i, a, e, p in sorted(rows, key=lambda r: (r[3], r[1], r[4], r[5], r[2])):
        closed = [x for x in taken if x[1] <= a]
        live = [x for x in taken if x[1] > a]
        lost = any(x[0] == t and x[2] < 0 for x in closed)
        busy = any(x[0] == t and x[1] + dt.timedelta(minutes=30) > a for x in taken)
        if len(live) < 3 and not lost and not busy and sum(x[2] for x in closed) > -2.0:
            taken.append((t, e, p, i))
    assert got == {x[3] for x in taken}


def test_non_overlapping_chain(spark):
    rows = [("A", 1, 4, "win"), ("A", 3, 5, "win"), ("A", 5, 6, "loss"), ("A", 9, 10, "win"), ("A", 13, 14, "win")]
    df = spark.createDataFrame(rows, "ticker string, entry_idx bigint, exit_idx bigint, outcome string")
    assert sorted(r.entry_idx for r in outcomes.admissible(df, ["ticker"]).collect()) == [1, 5, 13]


def test_equal_highs_pair(spark):
    c = patterns.candles(_bars(spark, [(12, 12.05, 11.95, 12)] * 12 + [(12, 12.3, 11.9, 12.25), (12.01, 12.05, 11.7, 11.8)]).withColumn("volume", F.lit(1.0)).drop("idx"))
    r = patterns.equal_highs(c).collect()
    assert len(r) == 1 and r[0].idx == 14 and r[0].ceiling == pytest.approx(12.01)


def test_summary_metrics(spark):
    rows = [("win", 2.0, 3, True), ("win", 4.0, 5, True), ("loss", -1.0, 2, False), ("timeout", 0.5, 9, True)]
    r = reports.summary(spark.createDataFrame(rows, "outcome string, pnl_pct double, hold_bars int, support_respected boolean").withColumn("g", F.lit(1)), "g").first()
    assert r.win_rate == 0.5 and r.expectancy == pytest.approx(0.5 * 3 + 0.5 * -1) and r.profit_factor == pytest.approx(6 / 0.5)


def test_setup_total():
    parts = dict.fromkeys(setup_score.PARTS, 2.0)
    base, action, conviction = 6.0, 1 + 0.1 * 8 + 0.05 * 4, 1.4
    assert set(parts) == set(setup_score.PARTS) and round(base * action * conviction * 1.5 / 16.8 * 10, 2) == 15.0


def test_event_groups_are_greedy(spark):
    rows = [("A", dt.date(2024, 1, d), 1, 4.0, -0.2, "technical", 0.5) for d in (1, 4, 6, 8, 20)]
    df = spark.createDataFrame(rows, "ticker string, date date, severity int, volume_spike double, price_drop double, kind string, confidence double")
    got = {(r.date.day, r.n, round(r.confidence, 2)) for r in risk.combine_events(df).collect()}
    assert got == {(1, 3, 0.9)}  # 8 starts a new group of one, 20 another: both under the threshold


def test_feature_store_round_trip(spark, prices, tmp_path):
    df, _ = prices
    path = str(tmp_path / "features")
    f = factors.compute(df, ["mom_5d"]).where("date < '2023-01-20'")
    store.write_features(f, path, "u1")
    wanted = df.select("date").where("date < '2023-01-25'").distinct()
    missing = sorted(str(r.date) for r in store.missing_dates(spark, path, "u1", wanted).collect())
    assert missing == ["2023-01-20", "2023-01-23", "2023-01-24"]
    store.write_csv(f, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == f.count()


def test_stream_table_resumes_over_two_batches_of_files(spark, tmp_path):
    """A query that stopped goes on from the caller's folder with the state and the table it had."""
    from mdq.streaming import streams

    t0 = dt.datetime(2024, 1, 15, 14)
    schema = "user_id bigint, event_type string, event_id bigint, value double, ts timestamp"
    row = lambda u, kind, i, v: (u, kind, i, v, t0 + dt.timedelta(minutes=i))
    src, own = str(tmp_path / "in"), str(tmp_path / "own")
    spark.createDataFrame([row(1, "signup", 1, 1.0), row(1, "view", 2, 2.0), row(2, "view", 3, 3.0)], schema).write.parquet(src)
    got = streams.merged_messages(streams.ticks(spark, src), own).collect()
    assert {r.user_id: (r.static, r.position) for r in got} == {1: (1.0, 2.0), 2: (None, 3.0)}
    spark.createDataFrame([row(1, "view", 9, 9.0), row(3, "signup", 8, 8.0)], schema).write.mode("append").parquet(src)
    got = streams.merged_messages(streams.ticks(spark, src), own).collect()
    assert {r.user_id: (r.static, r.position) for r in got} == {1: (1.0, 9.0), 2: (None, 3.0), 3: (8.0, None)}
    again = streams.merged_messages(streams.ticks(spark, src), own).collect()  # no new files
    assert sorted(again, key=str) == sorted(got, key=str)


def test_stream_cooldown_keeps_its_pause_over_a_restart(spark, tmp_path):
    from mdq.streaming import streams

    t0 = dt.datetime(2024, 1, 15, 14)
    schema = "user_id bigint, event_id bigint, ts timestamp"
    src, own = str(tmp_path / "in"), str(tmp_path / "own")
    spark.createDataFrame([(1, 1, t0), (1, 2, t0 + dt.timedelta(minutes=10))], schema).write.parquet(src)
    assert [r.event_id for r in streams.drain(streams.cooldown(streams.ticks(spark, src)), folder=own).collect()] == [1]
    spark.createDataFrame([(1, 3, t0 + dt.timedelta(minutes=20)), (1, 4, t0 + dt.timedelta(minutes=31))], schema).write.mode("append").parquet(src)
    got = streams.drain(streams.cooldown(streams.ticks(spark, src)), folder=own).collect()
    assert sorted(r.event_id for r in got) == [1, 4]
