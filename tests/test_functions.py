"""Helpers against pandas and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mdq.functions import score_expr, text
from mdq.functions.core import clip, div
from mdq.functions.ema import ema
from mdq.functions.prefix import running_curve
from mdq.functions.rank import pct_rank, pct_rank_bounded, top_share


def test_ema_matches_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"ticker": ["A"] * 300 + ["B"] * 40, "ts": list(range(300)) + list(range(40)), "x": rng.normal(10, 2, 340)})
    df = spark.createDataFrame(pdf).repartition(5)
    for adjust in (False, True):
        for alpha in (1 / 14, 2 / 27, 0.9):
            got = ema(df, {"e": (F.col("x"), alpha)}, adjust=adjust).toPandas().sort_values(["ticker", "ts"])["e"].to_numpy()
            want = pdf.groupby("ticker")["x"].transform(lambda s: s.ewm(alpha=alpha, adjust=adjust).mean()).to_numpy()
            np.testing.assert_allclose(got, want, rtol=1e-10)


def test_percentile_rank_with_ties_and_nulls(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 12, 400).astype(float)
    pdf = pd.DataFrame({"date": rng.integers(0, 3, 400), "ticker": range(400), "v": v})
    # one value holds a third of the rows
    pdf.loc[::3, "v"] = 5.0
    df = spark.createDataFrame(pdf)
    df = df.withColumn("v", F.when(F.col("ticker") % 17 == 0, None).otherwise(F.col("v")))
    pdf.loc[pdf.ticker % 17 == 0, "v"] = np.nan
    want = pdf.assign(want=pdf.groupby("date")["v"].rank(pct=True)).set_index("ticker")["want"]
    for out in (pct_rank(df, "v", "r"), df.withColumn("r", pct_rank_bounded("v"))):
        got = out.toPandas().set_index("ticker")["r"].astype(float)
        np.testing.assert_allclose(got.sort_index().to_numpy(), want.sort_index().to_numpy())


def test_top_share_breaks_ties_by_name(spark):
    rows = [("d", f"T{i:02d}", float(s)) for i, s in enumerate([5, 5, 5, 4, 3, 3, 2, 1, 1, 1])]
    df = spark.createDataFrame(rows, "date string, ticker string, score double")
    got = sorted(r.ticker for r in top_share(df, "score", 0.2).collect())
    assert got == ["T00", "T01"]
    assert len(top_share(df, "score", 0.01).collect()) == 1


def test_running_curve_equals_cumsum(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": "a", "day": np.sort(rng.integers(0, 9, 200)), "i": range(200), "v": rng.normal(size=200)})
    got = running_curve(spark.createDataFrame(pdf), ["k"], "day", ["i"], "v").toPandas().sort_values("i")
    np.testing.assert_allclose(got["cum"], pdf["v"].cumsum())
    np.testing.assert_allclose(got["peak"], pdf["v"].cumsum().cummax().clip(lower=0))


def test_safe_arithmetic(spark):
    row = spark.range(1).select(div(F.lit(1.0), F.lit(0.0)).alias("a"), clip(F.lit(7.0), 0, 5).alias("b")).first()
    assert row.a is None and row.b == 5.0


def test_score_expressions(spark):
    df = spark.createDataFrame([("d", "A", 1.0, 0.0), ("d", "B", 2.0, 4.0), ("d", "C", 3.0, 2.0)], "date string, ticker string, x double, y double")
    f = lambda n: {"type": "feature", "name": n}
    spec = {"type": "binary", "op": "div", "left": f("x"), "right": f("y")}
    out, col = score_expr.fold(df, spec)
    assert [r.s for r in out.select(col.alias("s")).collect()] == [0.0, 0.5, 1.5]
    ranked, col = score_expr.fold(df, {"type": "unary", "op": "rank", "child": f("y")})
    assert [round(r.s, 3) for r in ranked.orderBy("ticker").select(col.alias("s")).collect()] == [0.333, 1.0, 0.667]
    flat = score_expr.score(df, {"type": "constant", "value": 2})
    assert {r.score for r in flat.collect()} == {0.5}
    assert score_expr.formula(spec) == "(x div y)"
    cond = {"type": "conditional", "condition": {"type": "binary", "op": "sub", "left": f("x"), "right": {"type": "constant", "value": 1.5}}, "if_true": f("x"), "if_false": f("y")}
    out, col = score_expr.fold(df, cond)
    assert [r.s for r in out.select(col.alias("s")).collect()] == [0.0, 2.0, 3.0]
    assert score_expr.features_of(cond) == ["x", "y"]


def test_post_parsing(spark):
    posts = spark.createDataFrame(
        [("Pre-market plays", "$ABCD support 10.5 resistance 12 target 13 stop 9.9\n$WXYZ: support 2.05 resistance 2.6 target 3", "2024-01-15T14:30:00Z"), ("chat", "no symbols here", None)],
        "title string, content string, timestamp string",
    )
    rows = {r.ticker: r for r in text.parse_posts(posts).collect()}
    assert set(rows) == {"ABCD", "WXYZ"}
    assert rows["ABCD"].session == "pre_market" and rows["ABCD"].support == 10.5 and rows["ABCD"].resistance == 12.0
    assert rows["WXYZ"].support == 2.05 and rows["WXYZ"].resistance == 2.6
    assert rows["ABCD"].post_ts.hour == 14


def test_prices_near_keyword_uses_every_match(spark):
    body = "support 1.5 " + "x" * 200 + " support 2.5"
    got = spark.createDataFrame([(body,)], "t string").select(text.prices_near(F.col("t"), text.SUPPORT).alias("p")).first().p
    assert got == [1.5, 2.5]


def test_posts_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(text, "POSTS", 5)
    rows = [(f"Daily list {k}", f"$ABCD support {k}.5 stop {k}\nTHE: $SELL XY: target {k + 9}", "2024-01-15T14:30:00Z") for k in range(60)]
    posts = spark.createDataFrame(rows, "title string, content string, timestamp string").coalesce(1)
    out = text.parse_posts(posts)
    assert out.rdd.getNumPartitions() == 12
    assert sorted((r.title, r.ticker) for r in out.collect()) == sorted((t, s) for t, _, _ in rows for s in ("ABCD", "XY"))
    assert "array_except" not in out._jdf.queryExecution().optimizedPlan().toString()
