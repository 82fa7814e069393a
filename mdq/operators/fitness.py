"""Fitness of strategies over walk-forward periods, one aggregation per strategy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import clip, div, nz

# drawdown tiers per universe: severe, moderate, mild (fixed values)
DRAWDOWN_TIERS = [("general", 0.35, 0.25, 0.15), ("oil_large", 0.40, 0.30, 0.20), ("oil_micro", 0.50, 0.35, 0.20)]


def drawdown_tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DRAWDOWN_TIERS, "universe string, severe double, moderate double, mild double")


def _bound(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def recency_weighted(value: str, age: str, half_life: int = 4) -> Column:
    """Weighted mean whose weights halve every half_life periods of age (0 = newest)."""
    w = F.exp(F.lit(-math.log(2) / max(half_life, 1)) * F.col(age))
    return F.sum(F.col(value) * w) / F.sum(w)


def with_benchmark(results: DataFrame, bench: DataFrame) -> DataFrame:
    """Period results with the benchmark of the same period, excess columns and recency age."""
    b = bench.select(
        "period_id",
        F.col("total_return").alias("b_ret"),
        F.col("sharpe_ratio").alias("b_sharpe"),
        F.col("max_drawdown").alias("b_dd"),
    )
    out = results.join(F.broadcast(b), "period_id", "left").withColumns(
        {"b_ret": nz(F.col("b_ret")), "b_sharpe": nz(F.col("b_sharpe")), "b_dd": nz(F.col("b_dd"), 0.01)}
    )
    return out.withColumns(
        {
            "x_ret": F.col("total_return") - F.col("b_ret"),
            "x_sharpe": F.col("sharpe_ratio") - F.col("b_sharpe"),
            "age": F.row_number().over(Window.partitionBy("strategy").orderBy(F.col("period_id").desc())) - 1,
        }
    )


def _stats(*more) -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.avg("sharpe_ratio").alias("avg_sharpe"),
        F.stddev_pop("sharpe_ratio").alias("sharpe_std"),
        F.avg("total_return").alias("avg_return"),
        F.stddev_pop("total_return").alias("return_std"),
        F.avg("turnover").alias("avg_turnover"),
        F.avg((F.col("x_ret") > 0).cast("double")).alias("win_rate"),
        F.min("total_return").alias("worst_return"),
        F.max("max_drawdown").alias("worst_dd"),
        F.stddev_pop("x_ret").alias("x_std"),
        F.avg("x_ret").alias("mean_x_ret"),
        *more,
    ]


def _shared(df: DataFrame, x_ret: str, x_sharpe: str, cost: float, worst_limit: Column, spread_limit: Column) -> DataFrame:
    ir = F.when(F.col("n") > 1, nz(div(F.col(x_ret), F.col("x_std")))).otherwise(0.0)
    dd = F.when(F.col("worst_dd") > F.col("severe"), 1.0).when(F.col("worst_dd") > F.col("moderate"), 0.6)
    dd = dd.when(F.col("worst_dd") > F.col("mild"), 0.2).otherwise(0.0)
    loss = F.when(F.col("worst_return") < worst_limit, 0.3).otherwise(0.0)
    spread = _bound(F.col("x_std") / spread_limit, 0, 0.4)
    return df.withColumns(
        {
            "information_ratio": ir,
            "sharpe_component": _bound(F.col(x_sharpe) / 0.5, -1, 1) - F.least(F.col("sharpe_std"), F.lit(0.3)),
            "stability_component": _bound((F.col("win_rate") - 0.5) * 2 - 0.5 * dd - 0.25 * loss - 0.25 * spread, -1, 1),
            "cost_penalty": _bound(F.col("avg_turnover") * 12 * cost * 2 / 0.03, 0, 1),
        }
    ).withColumn(
        "return_component", 0.7 * _bound(F.col(x_ret) / 0.10, -1, 1) + 0.3 * _bound(F.col("information_ratio") / 0.5, -0.5, 0.5)
    )


def _total(score: Column) -> Column:
    return _bound(score * F.least(F.col("n") / 4, F.lit(1.0)), -1, 1)


def fitness(results: DataFrame, bench: DataFrame, cost: float = 0.002) -> DataFrame:
    """Excess Sharpe, excess return and stability less cost."""
    g = with_benchmark(results, bench).groupBy("strategy").agg(*_stats(F.avg("x_sharpe").alias("mean_x_sharpe")))
    _, severe, moderate, mild = DRAWDOWN_TIERS[0]
    g = g.withColumns({"severe": F.lit(severe), "moderate": F.lit(moderate), "mild": F.lit(mild)})
    g = _shared(g, "mean_x_ret", "mean_x_sharpe", cost, F.lit(-0.20), F.lit(0.20))
    total = 0.30 * F.col("sharpe_component") + 0.25 * F.col("return_component") + 0.30 * F.col("stability_component") - 0.15 * F.col("cost_penalty")
    return g.withColumn("total", _total(total))


def fitness_recent(results: DataFrame, bench: DataFrame, universe: str = "general", half_life: int = 4, cost: float = 0.002) -> DataFrame:
    """Recency-weighted variant with a Calmar part and drawdown tiers by universe."""
    both = with_benchmark(results, bench)
    calmar = lambda ret, dd: (F.pow(1 + F.col(ret), 4) - 1) / F.greatest(F.col(dd), F.lit(0.01))
    both = both.withColumn("x_calmar", calmar("total_return", "max_drawdown") - calmar("b_ret", "b_dd"))
    g = both.groupBy("strategy").agg(
        *_stats(
            recency_weighted("x_ret", "age", half_life).alias("recent_x_ret"),
            recency_weighted("x_sharpe", "age", half_life).alias("recent_x_sharpe"),
            recency_weighted("x_calmar", "age", half_life).alias("recent_x_calmar"),
        )
    )
    tiers = drawdown_tiers(results.sparkSession).where(F.col("universe") == universe).drop("universe")
    oil = universe.startswith("oil")
    g = g.join(F.broadcast(tiers))
    g = _shared(g, "recent_x_ret", "recent_x_sharpe", cost, F.lit(-0.30 if oil else -0.20), F.lit(0.30 if oil else 0.20))
    g = g.withColumn("calmar_component", _bound(F.col("recent_x_calmar"), -1, 1))
    total = (
        0.25 * F.col("sharpe_component") + 0.20 * F.col("calmar_component") + 0.20 * F.col("return_component")
        + 0.20 * F.col("stability_component") - 0.15 * F.col("cost_penalty")
    )
    return g.withColumn("total", _total(total))


def fitness_calmar(results: DataFrame, bench: DataFrame, target_turnover: float = 0.5) -> DataFrame:
    """Calmar-first fitness with a turnover target."""
    both = with_benchmark(results, bench)
    calmar = lambda ret, dd: (F.pow(1 + F.col(ret), 12) - 1) / F.greatest(F.col(dd), F.lit(0.01))
    both = both.withColumn("calmar", calmar("total_return", "max_drawdown")).withColumn("b_calmar", calmar("b_ret", "b_dd"))
    g = both.groupBy("strategy").agg(
        *_stats(
            F.avg("calmar").alias("avg_calmar"),
            F.stddev_pop("calmar").alias("calmar_std"),
            F.min("calmar").alias("worst_calmar"),
            F.avg(F.col("calmar") - F.col("b_calmar")).alias("x_calmar"),
        )
    )
    low = F.when(F.col("worst_calmar") < -1, 0.5).when(F.col("worst_calmar") < 0.5, 0.2).otherwise(0.0)
    g = g.withColumns(
        {
            "calmar_component": _bound(F.col("x_calmar"), -1, 1) - F.least(F.col("calmar_std") / 2, F.lit(0.3)),
            "return_component": _bound(F.col("mean_x_ret") / 0.10, -1, 1),
            "stability_component": _bound((F.col("win_rate") - 0.5) * 2 - low, -1, 1),
            "turnover_penalty": _bound((F.col("avg_turnover") - target_turnover) / target_turnover, 0, 1),
        }
    )
    total = (
        0.40 * F.col("calmar_component") + 0.25 * F.col("return_component") + 0.20 * F.col("stability_component")
        - 0.15 * F.col("turnover_penalty")
    )
    return g.withColumn("total", _total(total))


def compare_fitness(results: DataFrame, bench: DataFrame) -> DataFrame:
    a = fitness(results, bench).select("strategy", F.col("total").alias("sharpe_total"))
    b = fitness_calmar(results, bench).select("strategy", F.col("total").alias("calmar_total"), "avg_calmar")
    return a.join(b, "strategy").withColumn("difference", F.col("calmar_total") - F.col("sharpe_total"))


def calmar_ratio(df: DataFrame, keys: list[str], order: str, ret: str) -> DataFrame:
    """Annualised return over worst drawdown (at least 1 %) of daily returns."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    curve = df.where(F.col(ret).isNotNull()).withColumn("cum", F.exp(F.sum(F.log1p(ret)).over(w))).withColumn("top", F.max("cum").over(w))
    g = curve.groupBy(*keys).agg(
        F.sum(F.log1p(ret)).alias("lg"), F.count("*").alias("n"), F.max(1 - F.col("cum") / F.col("top")).alias("dd")
    )
    return g.select(*keys, ((F.exp(F.col("lg") * 252 / F.col("n")) - 1) / F.greatest("dd", F.lit(0.01))).alias("calmar"))


def performance_metrics(results: DataFrame, periods_per_year: int = 6) -> DataFrame:
    """Compounded metrics over a strategy's ordered periods."""
    w = Window.partitionBy("strategy").orderBy("period_id").rowsBetween(Window.unboundedPreceding, 0)
    c = results.withColumn("cum", F.exp(F.sum(F.log1p("total_return")).over(w))).withColumn("top", F.max("cum").over(w))
    down = F.when(F.col("total_return") < 0, F.col("total_return"))
    g = c.groupBy("strategy").agg(
        (F.exp(F.sum(F.log1p("total_return"))) - 1).alias("total_return"),
        F.avg("total_return").alias("avg_period_return"),
        F.stddev_pop("total_return").alias("return_std"),
        F.max(1 - F.col("cum") / F.col("top")).alias("max_drawdown"),
        F.avg("sharpe_ratio").alias("sharpe_ratio"),
        F.stddev_pop(down).alias("down_sd"),
        F.count(down).alias("n_down"),
        F.avg((F.col("total_return") > 0).cast("double")).alias("win_rate"),
        F.min("total_return").alias("worst_period"),
        F.max("total_return").alias("best_period"),
        F.avg("turnover").alias("avg_turnover"),
        F.count("*").alias("n_periods"),
    )
    root = math.sqrt(periods_per_year)
    g = g.withColumn("annualized_return", F.pow(1 + F.col("total_return"), periods_per_year / F.col("n_periods")) - 1)
    return g.withColumns(
        {
            "volatility": F.col("return_std") * root,
            "sortino_ratio": F.when(F.col("n_down") > 0, nz(div(F.col("annualized_return"), F.col("down_sd") * root))).otherwise(F.col("annualized_return") * 10),
            "calmar_ratio": F.coalesce(div(F.col("annualized_return"), F.col("max_drawdown")), F.col("annualized_return") * 10),
        }
    ).drop("down_sd", "n_down")


# ---- fixed values: thresholds of findings and recommendations --------------------------
#: (name, measure, limit): found where the measure is over the limit
FINDINGS = [
    ("returns_collapsed", "return_reduction_pct", 50.0), ("returns_decreased", "return_reduction_pct", 20.0), ("sharpe_improved", "sharpe_improvement", 0.2),
    ("calmar_improved", "calmar_improvement", 0.5), ("drawdown_reduced", "drawdown_reduction_pct", 20.0), ("slippage_costs", "total_slippage_cost", 0.05),
    ("dilution_avoided", "dilution_events", 0.0), ("illiquid_filtered", "illiquid_tickers", 0.0),
]
RECOMMENDATIONS = [
    ("expect_after_returns", "return_reduction_pct", 50.0), ("more_robust", "risk_adjusted", 0.0), ("keep_dilution_filter", "dilution_events", 0.0),
    ("raise_minimum_adv", "illiquid_tickers", 2.0), ("reduce_turnover", "avg_slippage_cost", 0.02),
]
DILUTION_COST = 0.20
# ---- end of fixed values --------------------------------------------------------------


def impact(before: DataFrame, after: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """Before/after comparison of performance_metrics rows per strategy, with the findings and recommendations that its measures give.

    costs: (strategy, avg_slippage_cost, total_slippage_cost, dilution_events, illiquid_tickers) of
    the run after; 0 where missing. A collapse of returns takes the place of a mere decrease.
    """
    cols = ["total_return", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "max_drawdown", "volatility", "win_rate", "avg_turnover"]
    j = after.select("strategy", *cols).join(before.select("strategy", *[F.col(c).alias(f"b_{c}") for c in cols]), "strategy")
    less = lambda c: nz(div(F.col(f"b_{c}") - F.col(c), F.col(f"b_{c}")) * 100)
    more = lambda c: F.col(c) - F.col(f"b_{c}")
    extra = ["avg_slippage_cost", "total_slippage_cost", "dilution_events", "illiquid_tickers"]
    if costs is not None:
        j = j.join(costs.select("strategy", *extra), "strategy", "left")
    known = {c: nz(F.col(c)) if costs is not None else F.lit(0.0) for c in extra}
    out = j.select(
        "strategy", *[more(c).alias(f"d_{c}") for c in cols], less("total_return").alias("return_reduction_pct"), less("max_drawdown").alias("drawdown_reduction_pct"),
        less("volatility").alias("volatility_reduction_pct"), more("sharpe_ratio").alias("sharpe_improvement"), more("calmar_ratio").alias("calmar_improvement"),
        F.greatest(more("sharpe_ratio"), more("calmar_ratio")).alias("risk_adjusted"), *[x.alias(c) for c, x in known.items()],
    )
    said = lambda rules: F.array_join(F.array_compact(F.array(*[F.when(F.col(m) > x, n) for n, m, x in rules])), ",")
    found = F.regexp_replace(said(FINDINGS), "returns_collapsed,returns_decreased", "returns_collapsed")
    return out.withColumns({"findings": found, "recommendations": said(RECOMMENDATIONS), "dilution_cost_avoided": F.col("dilution_events") * DILUTION_COST})


