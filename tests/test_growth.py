"""Steps that have to hold on large tables: results against brute force, plans without growing parts."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mdq.functions import rank
from mdq.functions.rank import pct_ranks
from mdq.operators import factors, population, reports, risk
from mdq.plans import q_reports

DAY = dt.date(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blacklisted_rows_repeat_no_event(spark):
    rng = np.random.default_rng(3)
    day = lambda: DAY + dt.timedelta(int(rng.integers(0, 120)))
    rows = [(f"T{rng.integers(0, 4)}", day()) for _ in range(200)] + [(None, DAY), ("T0", None), ("T1", DAY), ("T1", DAY)]
    events = [("T0", day()), ("T1", DAY), ("T1", day()), ("T1", day()), ("T9", DAY), (None, DAY), ("T2", None)]
    schema = "ticker string, date date"
    got = risk.blacklisted(spark.createDataFrame(rows, schema), spark.createDataFrame(events, schema))
    hits = lambda t, d: any(e == t and x and d and x <= d <= x + dt.timedelta(20) for e, x in events if e)
    assert sorted((r.ticker, r.date) for r in got.collect()) == sorted(r for r in rows if hits(*r))
    assert got.columns == ["ticker", "date"] and "Generate" not in plan(got)


def test_neighbours_meet_in_blocks(spark, monkeypatch):
    for name, rows in (("_CELL_ROWS", 8), ("_ASK_ROWS", 5), ("_BLOCK_ROWS", 20), ("_MOST_ROWS", 30)):
        monkeypatch.setattr(population, name, rows)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.2, (40, 3)) for c in (0, 3, 9)] + [np.full((50, 3), 4.0)]).astype("float32").astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    other = d[~np.eye(len(x), dtype=bool)].reshape(len(x), -1)
    got = population.niches(df, "id", "vec", sigma=0.5, k=4).join(population.mean_distances(df, "id", "vec"), "id").toPandas().sort_values("id")
    assert np.allclose(got["niche_count"], 1 + np.where(other < 0.5, 1 - other / 0.5, 0).sum(axis=1), atol=1e-6)
    assert np.allclose(got["novelty"], np.sort(other, axis=1)[:, :4].mean(axis=1), atol=1e-6)
    assert np.allclose(got["mean_distance"], other.mean(axis=1))


def test_vectors_are_sent_to_a_bounded_number_of_blocks():
    assert [-(-n // population._block_rows(n)) for n in (1, 4096, 65536, 10**6)] == [1, 1, 16, 16]
    assert population._block_rows(10**8) == population._MOST_ROWS


def prices(spark, n, gap=None):
    rng = np.random.default_rng(n)
    pdf = pd.concat([pd.DataFrame({"ticker": t, "date": [DAY + dt.timedelta(i) for i in range(n + k)], "close": 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n + k)))}) for k, t in enumerate(("A", "B", "C"))])
    pdf.loc[(pdf.ticker == "B") & (pdf.date > DAY + dt.timedelta(30)), "close"] = 7.3  # a price that stands still
    if gap:
        pdf.loc[(pdf.ticker == "A") & (pdf.date == DAY + dt.timedelta(gap)), "close"] = np.nan
    rows = [(t, d, None if np.isnan(c) else float(c), 1.0) for t, d, c in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "ticker string, date date, close double, volume double"), pdf


@pytest.mark.parametrize("gap", [None, 100])
def test_windows_of_closes_against_pandas(spark, gap):
    df, pdf = prices(spark, 150, gap)
    names = ["zscore_5d", "zscore_63d", "drawdown_duration_63d", "recovery_rate_63d", "ulcer_index_63d", "trend_r2_21d", "trend_slope_21d", "trend_deviation_63d"]
    frame = factors.compute(df, names)
    assert "Aggregate" not in plan(frame) and "collect_list" not in plan(frame) and "regr" not in plan(frame) and "stddev" not in plan(frame)
    got = frame.toPandas().sort_values(["ticker", "date"])
    mixed = factors.compute(df, [*names, "vol_21d"]).toPandas().sort_values(["ticker", "date"])
    assert np.allclose(got[names], mixed[names])
    for t, g in pdf.groupby("ticker"):
        x, s = got[got.ticker == t].reset_index(drop=True), g["close"].to_numpy()
        for i in (61, 62, 110, len(s) - 1):
            w = s[max(0, i - 62) : i + 1]
            if len(w) < 63:
                assert x["recovery_rate_63d"][i] == 0.5 and x["zscore_63d"][i] == 0
                continue
            ok, k = ~np.isnan(w), np.arange(63)
            fall = w[ok] / np.maximum.accumulate(w[ok]) - 1
            sd = np.std(w[ok], ddof=1)
            assert np.isclose(x["zscore_63d"][i], 0 if sd < 1e-9 else np.clip((w[-1] - w[ok].mean()) / sd, -4, 4))
            assert np.isclose(x["recovery_rate_63d"][i], (fall > -0.05).sum() / 63)
            assert np.isclose(x["ulcer_index_63d"][i], -np.sqrt((fall**2).sum() / 63))
            assert np.isclose(x["drawdown_duration_63d"][i], np.argmax(np.where(ok, w, -1)[::-1]) / 63)
            b, a = np.polyfit(k[ok], w[ok], 1)
            assert np.isclose(x["trend_deviation_63d"][i], (w[-1] - a - 62 * b) / w[ok].mean())
    still = got[(got.ticker == "B") & (got.date > DAY + dt.timedelta(60))]
    assert (still[["zscore_5d", "trend_r2_21d", "trend_slope_21d"]] == 0).all().all()


def test_windows_cross_batches_and_keys(spark):
    df, pdf = prices(spark, 400)
    names = ["trend_r2_126d", "recovery_rate_126d"]
    whole = factors.compute(df, names).toPandas().sort_values(["ticker", "date"])[names].to_numpy()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert np.allclose(whole, factors.compute(df, names).toPandas().sort_values(["ticker", "date"])[names].to_numpy(), rtol=1e-9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_two_samples_rank_a_ticker_in_one_shuffle(spark):
    rng = np.random.default_rng(1)
    rows = [(t, int(m), float(r)) for t in "AB" for m, r in zip(rng.integers(1, 6, 80), rng.integers(-5, 5, 80) / 100)]
    made = reports.two_sample(spark.createDataFrame(rows, "ticker string, month int, ret double"))
    assert "Join" not in plan(made)
    for r in made.collect():
        d = pd.DataFrame([x[1:] for x in rows if x[0] == r.ticker], columns=["month", "ret"])
        inside = d["month"] == 3
        n1 = inside.sum()
        assert (r.n1, r.n2) == (n1, (~inside).sum()) and np.isclose(r.u, d["ret"].rank()[inside].sum() - n1 * (n1 + 1) / 2)
        x = d["ret"][inside]
        assert np.isclose(r.t_stat, x.mean() / (x.std() / np.sqrt(n1)))


def test_enriched_columns_are_computed_where_they_are_read(spark, tmp_path):
    rows = [(1, DAY + dt.timedelta(i), 0.04, 1.0, 0.1) for i in range(40)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate date, l_discount double, l_quantity double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = plan(q_reports.q_monthly(spark, str(tmp_path)))
    assert "ret" in made and "stddev_samp(volume" not in made and "vol_20d_avg" not in made and "next_open" not in made
    assert "enriched" not in made


def ran(df) -> str:
    """The plan that was carried out."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("names", [["rel_strength_21d", "rel_strength_63d"], ["rel_vol_21d", "rel_vol_63d"]])
def test_ranks_of_dates_move_the_rows_once(spark, names):
    df, pdf = prices(spark, 100, 40)
    frame = factors.compute(df, names)
    done = ran(frame)
    # by ticker, by date, and one row per date to find large ones
    assert "Generate" not in done and "SortMergeJoin" not in done and done.count("Exchange hashpartitioning") <= 3
    if names[0] == "rel_strength_21d":
        got = frame.toPandas().sort_values(["ticker", "date"])
        for name, n in zip(names, (21, 63)):
            mom = pdf.groupby("ticker")["close"].transform(lambda s, n=n: s / s.shift(n) - 1)
            assert np.allclose(got[name], mom.groupby(pdf["date"]).rank(pct=True).fillna(0.5))


def ranked_rows():
    """Groups of 900, 300 and no rows with a value; a value of a third of the rows, null groups, keys and values, keys that repeat."""
    rng = np.random.default_rng(4)
    rows = [(f"T{i}", int(rng.integers(0, 4) // 3), float(rng.normal()), float(rng.integers(0, 5))) for i in range(1200)]
    rows = [(None if i % 31 == 0 else t, None if i % 37 == 0 else g, None if i % 11 == 0 else 0.5 if i % 3 else a, float("nan") if i % 41 == 0 else b) for i, (t, g, a, b) in enumerate(rows)]
    rows += [(t, g, b, a) for t, g, a, b in rows[:50]] + [("Z", 9, None, None)]
    return [(i, *r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("most", [0, 600, 10**6])
def test_ranks_of_large_groups_by_ranges(spark, most):
    rows = ranked_rows()
    df = spark.createDataFrame(rows, "id long, ticker string, date int, a double, b double").repartition(5)
    got = {r.id: r for r in pct_ranks(df, {"a": "ra", "b": "rb"}, ["ticker", "date"], most=most).collect()}
    assert sorted(got) == list(range(len(rows)))
    for place, out in ((3, "ra"), (4, "rb")):
        pdf = pd.DataFrame({"key": [(r[1], r[2]) for r in rows], "date": [r[2] for r in rows], "v": pd.Series([np.inf if r[place] is not None and np.isnan(r[place]) else r[place] for r in rows], dtype=float)})
        pct = pdf.groupby("date")["v"].rank(pct=True)
        pct = pct.groupby(pdf["key"]).transform("max").astype(float)
        for i, r in enumerate(rows):
            if r[1] is None or r[2] is None or np.isnan(pct[i]):
                assert got[i][out] is None
            else:
                assert np.isclose(got[i][out], pct[i])


def test_no_task_ranks_a_large_group(spark, monkeypatch):
    # the last step deals rows by key; without it they lie where they were ranked
    monkeypatch.setattr(rank, "_highest_of_key", lambda df, *_: df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # one date, two rows in three share a value; two rows lie below it
        df = spark.range(6000).selectExpr("concat('T', id) ticker", "0 date", "if(id % 3 = 0, id / 7, 0.5D) v")
        made = pct_ranks(df, {"v": "r"}, ["ticker", "date"], most=1000)
        tasks = made.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert sum(x["count"] for x in tasks) == 6000 and max(x["count"] for x in tasks) < 2000
        assert [x.r for x in made.where("v = 0.5").select("r").distinct().collect()] == [(2 + (4000 + 1) / 2) / 6000]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
