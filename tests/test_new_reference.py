"""Skylines, fronts, niches, expanding ranks and quantiles, documents, stores and stateful streams against plain versions."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mdq.functions.rank import expanding_quantiles, expanding_rank
from mdq.operators import population
from mdq.sources import documents, store
from mdq.streaming import stateful, streams


def _beaten(v):
    return [bool(((v >= x).all(axis=1) & (v > x).any(axis=1)).any()) for x in v]


def test_skyline_of_three_objectives(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(0, 12, (500, 3)), np.full((40, 3), 11) - rng.integers(0, 3, (40, 3))]).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(v)), "a": v[:, 0], "b": -v[:, 1], "c": v[:, 2]}))
    goals = {"a": "max", "b": "min", "c": "max"}
    got = {r.id for r in population.skyline(df, "id", goals, parts=3).collect()}
    assert got == {i for i, lost in enumerate(_beaten(v)) if not lost}
    pairs = {(r.winner, r.loser) for r in population.dominated_by(df.where("id < 150"), "id", goals).collect()}
    w = v[:150]
    assert pairs == {(i, j) for i in range(150) for j in range(150) if (w[i] >= w[j]).all() and (w[i] > w[j]).any()}


def test_fronts_of_several_populations(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(240), "pop": np.arange(240) % 3, "x": rng.integers(0, 9, 240).astype(float), "y": rng.integers(0, 9, 240).astype(float)})
    got = {r.id: r.front for r in population.fronts(spark.createDataFrame(pdf), "id", {"x": "max", "y": "min"}, by="pop").collect()}
    for _, rows in pdf.groupby("pop"):
        left, n = rows, 0
        while len(left):
            lost = np.array(_beaten(np.stack([left.x, -left.y], axis=1)))
            assert all(got[i] == n for i in left.id[~lost])
            left, n = left[lost], n + 1


@pytest.mark.parametrize("cell", [5, 1024])
def test_niches_leave_no_neighbour_out(spark, monkeypatch, cell):
    monkeypatch.setattr(population, "_CELL_ROWS", cell)
    monkeypatch.setattr(population, "_ASK_ROWS", 7)
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.normal(0, 0.2, (60, 3)), rng.normal(6, 0.2, (60, 3)), [[0.0, 0.0, 0.0]] * 5])
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(m)], "id bigint, vec array<double>")
    got = population.niches(df, "id", "vec", sigma=0.4, k=4, sample=30).toPandas().sort_values("id")
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    np.testing.assert_allclose(got["niche_count"], 1 + np.where(d < 0.4, 1 - d / 0.4, 0).sum(axis=1))
    np.testing.assert_allclose(got["novelty"], np.sort(d, axis=1)[:, :4].mean(axis=1))


@pytest.mark.parametrize("n", [1, 64, 65, 700])
def test_expanding_rank(spark, n):
    rng = np.random.default_rng(n)
    v = [None if x == 0 else float(x) for x in rng.integers(0, 40, n)]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(v)], "ticker string, date int, x double")
    got = {r.date: r.p for r in expanding_rank(df, "x", "p").collect()}
    for i, x in enumerate(v):
        past = [y for y in v[: i + 1] if y is not None]
        want = None if x is None else (sum(y < x for y in past) + sum(y <= x for y in past) + 1) / 2 / len(past)
        assert got.get(i) == pytest.approx(want)


def test_expanding_quantiles(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(d), float(x), float(-x * 2)) for k in "ab" for d in range(25) for x in rng.integers(0, 30, rng.integers(1, 9))]
    df = spark.createDataFrame(rows, "ticker string, day int, lo double, hi double")
    got = {(r.ticker, r.day): (r.a, r.b) for r in expanding_quantiles(df, {"a": ("lo", 0.15), "b": ("hi", 0.85)}).collect()}
    assert len(got) == 48
    for (k, d), pair in got.items():
        past = [(r[2], r[3]) for r in rows if r[0] == k and r[1] < d]
        assert pair == pytest.approx((np.quantile([p[0] for p in past], 0.15), np.quantile([p[1] for p in past], 0.85)))


def test_facts_documents(spark, tmp_path):
    value = lambda end, val, form: {"end": end, "val": val, "form": form}
    shares = {"units": {"shares": [value("2023-12-31", 10, "10-K"), value("2024-03-31", 12, "10-Q"), value("2024-06-30", 99, "8-K")]}}
    gaap = {"CommonStockSharesOutstanding": shares, "NotesPayable": {"units": {"USD": [value("2024-01-01", 7, "8-K")]}}, "Cash": {"units": {"shares": [value("2024-01-01", 5, "10-K")]}}}
    one = {"cik": "1", "entityName": "A", "facts": {"us-gaap": gaap, "dei": {"EntityCommonStockSharesOutstanding": shares}}}
    two = {"cik": "2", "facts": {"dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": [value("2024-01-01", 3, "20-F")]}}}}}
    (tmp_path / "facts.txt").write_text("\n".join([json.dumps(one), json.dumps(two), '{"cik": "3", "facts": {', "", "{}"]))
    docs = documents.lines(spark, str(tmp_path / "facts.txt"))
    got = {(r.company, r.metric): (r.concept, r.val, r.as_of) for r in documents.metrics(documents.fact_rows(docs)).collect()}
    assert got == {
        ("1", "shares_outstanding"): ("CommonStockSharesOutstanding", 12.0, "2024-03-31"),
        ("1", "long_term_debt"): ("NotesPayable", 7.0, "2024-01-01"),
        ("2", "shares_outstanding"): ("EntityCommonStockSharesOutstanding", 3.0, "2024-01-01"),
    }
    assert [r.doc for r in documents.malformed(docs, documents.FACTS).collect()] == ['{"cik": "3", "facts": {']


def test_post_documents(spark, tmp_path):
    posts = [{"title": "Pre-market", "content": "$ABC support 1.5", "timestamp": "2024-01-02T00:00:00Z"}, {"title": "x"}]
    (tmp_path / "posts.txt").write_text("\n".join([*map(json.dumps, posts), "{oops"]))
    docs = documents.lines(spark, str(tmp_path / "posts.txt"))
    assert sorted(map(tuple, documents.posts(docs).collect())) == [("Pre-market", "$ABC support 1.5", "2024-01-02T00:00:00Z"), ("x", "", "")]
    assert documents.malformed(docs, documents.POST).count() == 1


def test_feature_store_writes_missing_dates_only(spark, tmp_path):
    path = str(tmp_path / "store")
    day = lambda k: dt.date(2024, 1, 1 + k)
    f = spark.createDataFrame([("A", day(k), float(k)) for k in range(4)], "ticker string, date date, x double")
    assert [store.update_features(p, path, "u") for p in (f.where("x < 2"), f, f)] == [2, 2, 0]
    changed = f.withColumn("x", F.col("x") + 100)
    assert store.update_features(changed, path, "u") == 0 and store.update_features(changed, path, "w") == 4
    got = spark.read.parquet(path).where("universe = 'u'").orderBy("date").collect()
    assert [r.x for r in got] == [0.0, 1.0, 2.0, 3.0]


def _ticks(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


def test_census_subtracts_old_classes_over_a_restart(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 15, 14)
    schema = "vessel bigint, ts timestamp, seq bigint, is_static boolean, tanker boolean, length double, draught double, course double"
    fixed = lambda v, m, tanker, length, draught: (v, t0 + dt.timedelta(minutes=m), m, True, tanker, length, draught, None)
    at = lambda v, m, course: (v, t0 + dt.timedelta(minutes=m), m, False, None, None, None, course)
    src, own = str(tmp_path / "in"), str(tmp_path / "own")
    census = lambda: stateful.census_of(streams.drain(stateful.vessel_changes(_ticks(spark, src, schema), 30), folder=own)).first()
    spark.createDataFrame([fixed(1, 0, True, 320.0, 20.0), at(1, 1, 100.0), at(2, 2, 300.0), fixed(3, 3, True, 200.0, 2.0)], schema).write.parquet(src)
    c = census()
    assert (c.vessels, c.tankers, c.large, c.laden, c.outbound, c.inbound, c.severity) == (3, 1, 1, 1, 1, 0, "MODERATE")
    spark.createDataFrame([at(1, 8, 280.0), fixed(2, 9, True, 350.0, None), fixed(1, 7, True, 100.0, 20.0)], schema).write.mode("append").parquet(src)
    c = census()
    assert (c.vessels, c.tankers, c.large, c.laden, c.outbound, c.inbound) == (3, 2, 1, 1, 0, 2)
    spark.createDataFrame([at(9, 60, 0.0)], schema).write.mode("append").parquet(src)  # the others have been silent
    c = census()
    assert (c.vessels, c.tankers, c.severity) == (1, 0, "CRITICAL")


def test_gate_remembers_position_and_pause_over_a_restart(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 15, 14)
    schema = "key bigint, ts timestamp, seq bigint"
    row = lambda m: (1, t0 + dt.timedelta(minutes=m), m)
    sig, out, own = str(tmp_path / "signals"), str(tmp_path / "exits"), str(tmp_path / "own")
    put = lambda path, *ms: spark.createDataFrame([row(m) for m in ms], schema).write.mode("append").parquet(path)
    taken = lambda: sorted(r.seq for r in streams.drain(stateful.gated_signals(_ticks(spark, sig, schema), _ticks(spark, out, schema)), folder=own).collect())
    put(sig, 1, 5, 40)
    put(out, 3)
    assert taken() == [1, 40]  # 5: pause; at 40 the position of 1 is closed
    put(sig, 80, 90)
    put(out, 85)
    assert taken() == [1, 40, 90]  # 80: the position of 40 is open
