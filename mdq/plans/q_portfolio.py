"""Registered queries: periods, scores, selection, walk-forward, benchmarks, fitness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import settle, tidy
from ..functions.rank import top_share
from ..operators import calendar, factors, fitness, portfolio
from .inputs import daily, grid, once
from .q_factors import O, W, lagc
from .registry import cte, query, rounded


def _f(name):
    return {"type": "feature", "name": name}


def _b(op, left, right):
    return {"type": "binary", "op": op, "left": left, "right": right}


def _u(op, child):
    return {"type": "unary", "op": op, "child": child}


STRATEGIES = {
    "quality": _b("avg", _f("mom_63d"), _u("neg", _f("vol_21d"))),
    "switch": {
        "type": "conditional",
        "condition": _b("sub", _f("mom_21d"), {"type": "constant", "value": 0.5}),
        "if_true": _f("mom_63d"),
        "if_false": _u("neg", _f("zscore_21d")),
    },
    "smooth": _b("sub", _u("zscore", _f("mom_21d")), _u("tanh", _f("vol_21d"))),
    "flat": {"type": "constant", "value": 0.3},
}

PERIOD_KEYS = ["train_start", "train_end", "test_start", "test_end"]


@once("periods")
def periods(spark, sf_dir):
    span = grid(spark, sf_dir).agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return calendar.walk_forward_periods(span, 12, 6, 6)


@once("rebal")
def _dates(spark, sf_dir):
    days = calendar.rebalance_dates(grid(spark, sf_dir).select("date").distinct(), periods(spark, sf_dir))
    return days.where("rebalance").select(F.col("period_id").cast("bigint"), "date", F.floor(F.col("day_no") / 21).alias("rebalance_no"))


cte("span", "SELECT min(date) AS s, max(date) AS e FROM panel")
cte(
    "periods",
    """SELECT *, row_number() OVER (ORDER BY train_start, test_start) AS period_id FROM (
 SELECT CAST(d AS DATE) AS train_start, CAST(d + INTERVAL 12 MONTH AS DATE) AS train_end,
  CAST(d + INTERVAL 12 MONTH AS DATE) AS test_start, CAST(d + INTERVAL 18 MONTH AS DATE) AS test_end
 FROM (SELECT unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 6 MONTH)) AS d FROM span), span
 WHERE d + INTERVAL 18 MONTH <= e
 UNION SELECT CAST(e - INTERVAL 18 MONTH AS DATE), CAST(e - INTERVAL 6 MONTH AS DATE), CAST(e - INTERVAL 6 MONTH AS DATE), e FROM span)""",
)
cte(
    "testdays",
    """SELECT period_id, date, row_number() OVER (PARTITION BY period_id ORDER BY date) - 1 AS day_no
 FROM (SELECT DISTINCT date FROM panel) JOIN periods ON date BETWEEN test_start AND test_end""",
)
cte("rebal", "SELECT period_id, date, day_no // 21 AS rebalance_no FROM testdays WHERE day_no % 21 = 0")


def _lagged(name: str, need: int, expr: str) -> str:
    return f"CASE WHEN rn < {need} THEN 0 ELSE coalesce({expr}, 0) END AS {name}"


cte(
    "gf0",
    f"""SELECT ticker, date, {_lagged('mom_21d', 22, f'close / {lagc(21)} - 1')}, {_lagged('mom_63d', 64, f'close / {lagc(63)} - 1')},
 {_lagged('vol_21d', 21, f'stddev_samp(r) {W(21)} * sqrt(252)')},
 {_lagged('zscore_21d', 21, f'greatest(-4, least(4, coalesce((close - avg(close) {W(21)}) / nullif(stddev_samp(close) {W(21)}, 0), 0)))')}
 FROM gridr""",
)
_RANK = "CASE WHEN {0} IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY date ORDER BY {0} NULLS LAST) + (count(*) OVER (PARTITION BY date, {0}) - 1) / 2.0) / count({0}) OVER (PARTITION BY date) END"
cte(
    "gf",
    "SELECT ticker, date, "
    + ", ".join("coalesce(" + _RANK.format(n) + f", 0) AS {n}" for n in ("mom_21d", "mom_63d", "vol_21d", "zscore_21d"))
    + " FROM (SELECT ticker, date, "
    + ", ".join(f"lag({n}) {O} AS {n}" for n in ("mom_21d", "mom_63d", "vol_21d", "zscore_21d"))
    + " FROM gf0)",
)
_Z = "coalesce((mom_21d - avg(mom_21d) OVER (PARTITION BY date)) / nullif(stddev_samp(mom_21d) OVER (PARTITION BY date), 0), 0)"
cte(
    "rawscores",
    f"""SELECT 'quality' AS strategy, ticker, date, (mom_63d + (-vol_21d)) / 2 AS s FROM gf
 UNION ALL SELECT 'switch', ticker, date, CASE WHEN mom_21d - 0.5 > 0 THEN mom_63d ELSE -zscore_21d END FROM gf
 UNION ALL SELECT 'smooth', ticker, date, {_Z} - tanh(vol_21d) FROM gf
 UNION ALL SELECT 'flat', ticker, date, 0.3 FROM gf""",
)
cte(
    "scores",
    """SELECT strategy, ticker, r.date, period_id, rebalance_no, coalesce((s - lo) / nullif(hi - lo, 0), 0.5) AS score FROM (
 SELECT *, min(s) OVER (PARTITION BY strategy, date) AS lo, max(s) OVER (PARTITION BY strategy, date) AS hi FROM rawscores) x JOIN rebal r USING (date)""",
)
cte(
    "picks",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, period_id, rebalance_no ORDER BY score DESC, ticker) AS pick,
 count(*) OVER (PARTITION BY strategy, period_id, rebalance_no) AS total FROM scores)
 WHERE pick <= greatest(1, CAST(floor(total * 0.2 + 1e-9) AS BIGINT))""",
)
cte(
    "turns",
    """SELECT strategy, period_id, rebalance_no, CASE WHEN was IS NULL THEN 1.0 ELSE (n + was - 2 * kept) / (2.0 * greatest(n, was)) END AS turnover FROM (
 SELECT strategy, period_id, rebalance_no, count(*) AS n, lag(count(*)) OVER (PARTITION BY strategy, period_id ORDER BY rebalance_no) AS was,
  count(b) AS kept FROM (SELECT p.*, q.ticker AS b FROM picks p LEFT JOIN picks q ON p.strategy = q.strategy AND p.period_id = q.period_id
  AND p.ticker = q.ticker AND q.rebalance_no = p.rebalance_no - 1) GROUP BY 1, 2, 3)""",
)


@query("walk_forward_periods", f"SELECT period_id, {', '.join(PERIOD_KEYS)} FROM periods")
def q_periods(spark, sf_dir):
    return periods(spark, sf_dir).select(F.col("period_id").cast("bigint"), *PERIOD_KEYS)


@query("rebalance_calendar", "SELECT period_id, date, rebalance_no FROM rebal")
def q_rebalance(spark, sf_dir):
    return _dates(spark, sf_dir)


@once("scored")
def scored(spark, sf_dir):
    return portfolio.score_table(grid(spark, sf_dir), _dates(spark, sf_dir), STRATEGIES)


@query("score_expressions", rounded("strategy ticker date", "score", "SELECT strategy, ticker, date, score FROM scores"))
def q_scores(spark, sf_dir):
    return tidy(scored(spark, sf_dir), ["strategy", "ticker", "date"], ["score"])


@query("top_share_selection", "SELECT strategy, period_id, rebalance_no, ticker, pick FROM picks")
def q_picks(spark, sf_dir):
    group = ["strategy", "period_id", "rebalance_no"]
    return top_share(scored(spark, sf_dir), "score", 0.2, by=group).select(*group, "ticker", F.col("pick").cast("bigint"))


@query("holdings_turnover", rounded("strategy period_id rebalance_no", "turnover", "SELECT * FROM turns"))
def q_turnover(spark, sf_dir):
    return tidy(portfolio.turnover(q_picks(spark, sf_dir)), ["strategy", "period_id", "rebalance_no"], ["turnover"])


def _wf_sql(stop: float | None) -> str:
    net = "net"
    halt = "NULL"
    if stop is not None:
        net = "CASE WHEN day_no > hit THEN 0.0 ELSE net END"
        halt = f"min(CASE WHEN 1 - value / greatest(1.0, peak) >= {stop} THEN day_no END) OVER (PARTITION BY strategy, period_id)"
    return f"""SELECT strategy, period_id, exp(sum(ln(1 + net))) - 1 AS total_return, coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252), 0) AS sharpe_ratio,
 max(1 - cum / top) AS max_drawdown, count(*) AS n_days, max(hit) AS hit FROM (
 SELECT *, max(cum) OVER (PARTITION BY strategy, period_id ORDER BY day_no) AS top FROM (
 SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY strategy, period_id ORDER BY day_no)) AS cum FROM (
 SELECT strategy, period_id, day_no, hit, {net} AS net FROM (
 SELECT *, {halt} AS hit FROM (
 SELECT *, max(value) OVER (PARTITION BY strategy, period_id ORDER BY day_no) AS peak FROM (
 SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY strategy, period_id ORDER BY day_no)) AS value FROM (
 SELECT h.strategy, h.period_id, d.day_no, avg(g.r) - CASE WHEN d.day_no % 21 = 0 THEN any_value(t.turnover) * 0.004 ELSE 0 END AS net
 FROM picks h JOIN testdays d ON d.period_id = h.period_id AND d.day_no // 21 = h.rebalance_no AND d.day_no > 0
 JOIN gridr g ON g.ticker = h.ticker AND g.date = d.date
 JOIN turns t ON t.strategy = h.strategy AND t.period_id = h.period_id AND t.rebalance_no = h.rebalance_no
 GROUP BY 1, 2, 3))))))) GROUP BY 1, 2"""


def _wf_final(stop: float | None) -> str:
    return f"""SELECT w.strategy, w.period_id, CASE WHEN f.strategy IS NULL THEN total_return ELSE -0.5 END AS total_return,
 CASE WHEN f.strategy IS NULL THEN sharpe_ratio ELSE -2.0 END AS sharpe_ratio, CASE WHEN f.strategy IS NULL THEN max_drawdown ELSE 0.5 END AS max_drawdown,
 CASE WHEN f.strategy IS NULL THEN turnover ELSE 1.0 END AS turnover, CASE WHEN f.strategy IS NULL THEN n_days ELSE 0 END AS n_days
 FROM ({_wf_sql(stop)}) w JOIN (SELECT x.strategy, x.period_id, avg(CASE WHEN rebalance_no = hit // 21 + 1 THEN 1.0 ELSE turnover END) AS turnover
 FROM turns x JOIN ({_wf_sql(stop)}) y ON x.strategy = y.strategy AND x.period_id = y.period_id GROUP BY 1, 2) t
 ON t.strategy = w.strategy AND t.period_id = w.period_id
 LEFT JOIN (SELECT DISTINCT strategy, period_id FROM (SELECT strategy, period_id, rebalance_no FROM scores GROUP BY 1, 2, 3 HAVING count(DISTINCT score) = 1)) f
 ON f.strategy = w.strategy AND f.period_id = w.period_id"""


cte("wf", _wf_final(None))
WF_COLS = ["total_return", "sharpe_ratio", "max_drawdown", "turnover"]


@once("walk")
def walk(spark, sf_dir, stop=None):
    return portfolio.walk_forward(grid(spark, sf_dir), periods(spark, sf_dir), STRATEGIES, stop=stop).withColumn(
        "period_id", F.col("period_id").cast("bigint")
    ).withColumn("n_days", F.col("n_days").cast("bigint"))


@query("walk_forward_results", rounded("strategy period_id n_days", WF_COLS, "SELECT * FROM wf"))
def q_walk(spark, sf_dir):
    return tidy(walk(spark, sf_dir), ["strategy", "period_id", "n_days"], WF_COLS)


@query("walk_forward_with_stop", rounded("strategy period_id n_days", WF_COLS, _wf_final(0.02)))
def q_walk_stop(spark, sf_dir):
    return tidy(walk(spark, sf_dir, 0.02), ["strategy", "period_id", "n_days"], WF_COLS)


def _bench_sql(method: str) -> str:
    inside = "date BETWEEN test_start AND test_end"
    if method == "buy_hold":
        day = f"""SELECT period_id, date, v / lag(v) OVER (PARTITION BY period_id ORDER BY date) - 1 AS ret FROM (
 SELECT period_id, date, avg(v) AS v FROM (SELECT period_id, date, close / first_value(close) OVER (PARTITION BY period_id, ticker ORDER BY date) AS v
 FROM grid JOIN periods ON {inside}) GROUP BY 1, 2)"""
    else:
        src = f"SELECT ticker, date, close, period_id FROM grid JOIN periods ON {inside}"
        if method == "single_ticker":
            src += " WHERE ticker = 'NATION_3'"
        if method == "momentum":
            src = f"""SELECT g.ticker, g.date, g.close, g.period_id FROM ({src}) g JOIN (SELECT period_id, ticker FROM (
 SELECT period_id, ticker, row_number() OVER (PARTITION BY period_id ORDER BY mom DESC, ticker) AS k, count(*) OVER (PARTITION BY period_id) AS n FROM (
 SELECT ticker, date, close / {lagc(252)} - 1 AS mom FROM grid) JOIN (SELECT period_id, min(date) AS date FROM testdays GROUP BY 1) USING (date) WHERE mom IS NOT NULL)
 WHERE k <= greatest(1, CAST(floor(n * 0.2 + 1e-9) AS BIGINT))) c ON c.period_id = g.period_id AND c.ticker = g.ticker"""
        day = f"""SELECT period_id, date, avg(r) AS ret FROM (
 SELECT *, close / lag(close) OVER (PARTITION BY period_id, ticker ORDER BY date) - 1 AS r FROM ({src})) GROUP BY 1, 2"""
    return f"""SELECT period_id, exp(sum(ln(1 + ret))) - 1 AS total_return, (avg(ret) - 0.04 / 252) / stddev_samp(ret) * sqrt(252) AS sharpe_ratio,
 max(1 - cum / top) AS max_drawdown, count(*) AS n_days FROM (SELECT *, max(cum) OVER (PARTITION BY period_id ORDER BY date) AS top FROM (
 SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY period_id ORDER BY date)) AS cum FROM ({day}) WHERE ret IS NOT NULL)) GROUP BY 1"""


cte("bench", _bench_sql("equal_weight"))


@once("bench")
def bench(spark, sf_dir, method="equal_weight"):
    return portfolio.benchmark(grid(spark, sf_dir), periods(spark, sf_dir), method, ticker="NATION_3").withColumn(
        "period_id", F.col("period_id").cast("bigint")
    )


def _bench_query(method: str) -> None:
    @query(f"benchmark_{method}", rounded("period_id n_days", ["total_return", "sharpe_ratio", "max_drawdown"], _bench_sql(method)))
    def run(spark, sf_dir):
        return tidy(bench(spark, sf_dir, method), ["period_id", "n_days"], ["total_return", "sharpe_ratio", "max_drawdown"])


for _m in ("equal_weight", "buy_hold", "momentum", "single_ticker"):
    _bench_query(_m)

cte(
    "wfb",
    """SELECT w.*, coalesce(b.total_return, 0) AS b_ret, coalesce(b.sharpe_ratio, 0) AS b_sharpe, coalesce(b.max_drawdown, 0.01) AS b_dd,
 w.total_return - coalesce(b.total_return, 0) AS x_ret, w.sharpe_ratio - coalesce(b.sharpe_ratio, 0) AS x_sharpe,
 exp(-ln(2) / 4 * (row_number() OVER (PARTITION BY strategy ORDER BY w.period_id DESC) - 1)) AS wt
 FROM wf w LEFT JOIN bench b ON w.period_id = b.period_id""",
)
_AGG = """SELECT strategy, count(*) AS n, stddev_pop(sharpe_ratio) AS s_sd, avg(turnover) AS turn, avg(CASE WHEN x_ret > 0 THEN 1.0 ELSE 0.0 END) AS win,
 min(total_return) AS worst, max(max_drawdown) AS dd, stddev_pop(x_ret) AS xsd, avg(x_ret) AS xr, avg(x_sharpe) AS xs,
 sum(x_ret * wt) / sum(wt) AS rxr, sum(x_sharpe * wt) / sum(wt) AS rxs,
 sum((((1 + total_return) ** 4 - 1) / greatest(max_drawdown, 0.01) - ((1 + b_ret) ** 4 - 1) / greatest(b_dd, 0.01)) * wt) / sum(wt) AS rxc,
 avg(((1 + total_return) ** 12 - 1) / greatest(max_drawdown, 0.01) - ((1 + b_ret) ** 12 - 1) / greatest(b_dd, 0.01)) AS xc,
 stddev_pop(((1 + total_return) ** 12 - 1) / greatest(max_drawdown, 0.01)) AS c_sd, min(((1 + total_return) ** 12 - 1) / greatest(max_drawdown, 0.01)) AS c_min,
 avg(((1 + total_return) ** 12 - 1) / greatest(max_drawdown, 0.01)) AS avg_calmar FROM wfb GROUP BY strategy"""


def _c(x, lo, hi):
    return f"greatest({lo}, least({hi}, {x}))"


def _parts(xr: str, xs: str, severe, moderate, mild, worst, spread) -> str:
    return f"""{_c(f'{xs} / 0.5', -1, 1)} - least(s_sd, 0.3) AS sharpe_component,
 0.7 * {_c(f'{xr} / 0.10', -1, 1)} + 0.3 * {_c(f'coalesce({xr} / nullif(xsd, 0), 0) / 0.5', -0.5, 0.5)} AS return_component,
 {_c(f'''(win - 0.5) * 2 - 0.5 * CASE WHEN dd > {severe} THEN 1.0 WHEN dd > {moderate} THEN 0.6 WHEN dd > {mild} THEN 0.2 ELSE 0 END
  - 0.25 * CASE WHEN worst < {worst} THEN 0.3 ELSE 0 END - 0.25 * {_c(f'xsd / {spread}', 0, 0.4)}''', -1, 1)} AS stability_component,
 {_c('turn * 12 * 0.004 / 0.03', 0, 1)} AS cost_penalty"""


_F1 = ["sharpe_component", "return_component", "stability_component", "cost_penalty", "total"]
FIT1 = f"""SELECT strategy, sharpe_component, return_component, stability_component, cost_penalty,
 {_c('(0.30 * sharpe_component + 0.25 * return_component + 0.30 * stability_component - 0.15 * cost_penalty) * least(n / 4.0, 1)', -1, 1)} AS total
 FROM (SELECT *, {_parts('xr', 'xs', 0.35, 0.25, 0.15, -0.20, 0.20)} FROM ({_AGG}))"""


@query("fitness_sharpe", rounded("strategy", _F1, FIT1))
def q_fitness(spark, sf_dir):
    return tidy(fitness.fitness(walk(spark, sf_dir), bench(spark, sf_dir)), ["strategy"], _F1)


@query(
    "fitness_recency",
    rounded(
        "strategy",
        [*_F1, "calmar_component"],
        f"""SELECT *, {_c('(0.25 * sharpe_component + 0.20 * calmar_component + 0.20 * return_component + 0.20 * stability_component - 0.15 * cost_penalty) * least(n / 4.0, 1)', -1, 1)} AS total
 FROM (SELECT *, {_c('rxc', -1, 1)} AS calmar_component, {_parts('rxr', 'rxs', 0.40, 0.30, 0.20, -0.30, 0.30)} FROM ({_AGG}))""",
    ),
)
def q_fitness_recent(spark, sf_dir):
    return tidy(fitness.fitness_recent(walk(spark, sf_dir), bench(spark, sf_dir), "oil_large"), ["strategy"], [*_F1, "calmar_component"])


_FC = ["calmar_component", "return_component", "stability_component", "turnover_penalty", "avg_calmar", "total"]
FITC = f"""SELECT *, {_c('(0.40 * calmar_component + 0.25 * return_component + 0.20 * stability_component - 0.15 * turnover_penalty) * least(n / 4.0, 1)', -1, 1)} AS total
 FROM (SELECT *, {_c('xc', -1, 1)} - least(c_sd / 2, 0.3) AS calmar_component, {_c('xr / 0.10', -1, 1)} AS return_component,
 {_c('(win - 0.5) * 2 - CASE WHEN c_min < -1 THEN 0.5 WHEN c_min < 0.5 THEN 0.2 ELSE 0 END', -1, 1)} AS stability_component,
 {_c('(turn - 0.5) / 0.5', 0, 1)} AS turnover_penalty FROM ({_AGG}))"""


@query("fitness_calmar", rounded("strategy", _FC, FITC))
def q_fitness_calmar(spark, sf_dir):
    return tidy(fitness.fitness_calmar(walk(spark, sf_dir), bench(spark, sf_dir)), ["strategy"], _FC)


@query(
    "fitness_comparison",
    rounded("strategy", "sharpe_total calmar_total difference",
            f"SELECT a.strategy, a.total AS sharpe_total, b.total AS calmar_total, b.total - a.total AS difference FROM ({FIT1}) a JOIN ({FITC}) b USING (strategy)"),
)
def q_fitness_compare(spark, sf_dir):
    return tidy(fitness.compare_fitness(walk(spark, sf_dir), bench(spark, sf_dir)), ["strategy"], ["sharpe_total", "calmar_total", "difference"])


@query(
    "calmar_of_daily_returns",
    rounded("ticker", "calmar", """SELECT ticker, (exp(sum(ln(1 + r)) * 252 / count(*)) - 1) / greatest(max(1 - cum / top), 0.01) AS calmar FROM (
 SELECT *, max(cum) OVER (PARTITION BY ticker ORDER BY date) AS top FROM (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY ticker ORDER BY date)) AS cum
 FROM fx0 WHERE r IS NOT NULL)) GROUP BY 1"""),
)
def q_calmar(spark, sf_dir):
    return tidy(fitness.calmar_ratio(portfolio.returns(daily(spark, sf_dir)), ["ticker"], "date", "r"), ["ticker"], ["calmar"])


_PM = ["total_return", "annualized_return", "avg_period_return", "volatility", "max_drawdown", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "win_rate", "worst_period", "best_period", "return_std", "avg_turnover"]


def _pm_sql(src: str) -> str:
    return f"""SELECT *, return_std * sqrt(6) AS volatility,
 CASE WHEN nd > 0 THEN coalesce(annualized_return / nullif(dsd * sqrt(6), 0), 0) ELSE annualized_return * 10 END AS sortino_ratio,
 coalesce(annualized_return / nullif(max_drawdown, 0), annualized_return * 10) AS calmar_ratio FROM (SELECT *, (1 + total_return) ** (6.0 / n_periods) - 1 AS annualized_return FROM (
 SELECT strategy, exp(sum(ln(1 + total_return))) - 1 AS total_return, avg(total_return) AS avg_period_return, stddev_pop(total_return) AS return_std,
 max(1 - cum / top) AS max_drawdown, avg(sharpe_ratio) AS sharpe_ratio, stddev_pop(total_return) FILTER (total_return < 0) AS dsd,
 count(*) FILTER (total_return < 0) AS nd, avg(CASE WHEN total_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, min(total_return) AS worst_period,
 max(total_return) AS best_period, avg(turnover) AS avg_turnover, count(*) AS n_periods FROM (
 SELECT *, max(cum) OVER (PARTITION BY strategy ORDER BY period_id) AS top FROM (
 SELECT *, exp(sum(ln(1 + total_return)) OVER (PARTITION BY strategy ORDER BY period_id)) AS cum FROM ({src}))) GROUP BY 1))"""


@query("performance_metrics", rounded("strategy n_periods", _PM, _pm_sql("SELECT * FROM wf")))
def q_metrics(spark, sf_dir):
    return tidy(fitness.performance_metrics(walk(spark, sf_dir)), ["strategy", "n_periods"], _PM)


IM = ["return_reduction_pct", "drawdown_reduction_pct", "sharpe_improvement", "calmar_improvement", "total_slippage_cost"]
_FOUND = [
    ("returns_collapsed", "return_reduction_pct > 50"), ("returns_decreased", "return_reduction_pct > 20 AND NOT return_reduction_pct > 50"), ("sharpe_improved", "sharpe_improvement > 0.2"),
    ("calmar_improved", "calmar_improvement > 0.5"), ("drawdown_reduced", "drawdown_reduction_pct > 20"), ("slippage_costs", "total_slippage_cost > 0.05"), ("illiquid_filtered", "illiquid_tickers > 0"),
]
_ADVICE = [
    ("expect_after_returns", "return_reduction_pct > 50"), ("more_robust", "sharpe_improvement > 0 OR calmar_improvement > 0"),
    ("raise_minimum_adv", "illiquid_tickers > 2"), ("reduce_turnover", "avg_slippage_cost > 0.02"),
]


def _said(rules) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules) + ")"


# what the second run pays for: its turnover at 50 basis points, and a ticker filtered in every sixth period
_COSTS = "SELECT strategy, avg(turnover) * 0.005 AS avg_slippage_cost, sum(turnover) * 0.005 AS total_slippage_cost, CAST(count(*) // 6 AS DOUBLE) AS illiquid_tickers"
_IMPACT = f"""SELECT a.strategy, coalesce((b.total_return - a.total_return) / nullif(b.total_return, 0) * 100, 0) AS return_reduction_pct,
 coalesce((b.max_drawdown - a.max_drawdown) / nullif(b.max_drawdown, 0) * 100, 0) AS drawdown_reduction_pct, a.sharpe_ratio - b.sharpe_ratio AS sharpe_improvement,
 a.calmar_ratio - b.calmar_ratio AS calmar_improvement, c.avg_slippage_cost, c.total_slippage_cost, c.illiquid_tickers
 FROM ({_pm_sql(_wf_final(0.02))}) a JOIN ({_pm_sql('SELECT * FROM wf')}) b USING (strategy) JOIN ({_COSTS} FROM ({_wf_final(0.02)}) GROUP BY 1) c USING (strategy)"""


@query("impact_before_after", rounded("strategy findings recommendations", IM, f"SELECT *, {_said(_FOUND)} AS findings, {_said(_ADVICE)} AS recommendations FROM ({_IMPACT})", 4))
def q_impact(spark, sf_dir):
    before, second = fitness.performance_metrics(walk(spark, sf_dir)), walk(spark, sf_dir, 0.02)
    paid = F.col("turnover") * 0.005
    costs = second.groupBy("strategy").agg(
        F.avg(paid).alias("avg_slippage_cost"), F.sum(paid).alias("total_slippage_cost"), F.floor(F.count("*") / 6).cast("double").alias("illiquid_tickers"), F.lit(0.0).alias("dilution_events")
    )
    return tidy(fitness.impact(before, fitness.performance_metrics(second), costs), ["strategy", "findings", "recommendations"], IM, 4)
