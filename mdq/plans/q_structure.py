"""Registered queries: smart-money, level and commodity-linked features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import settle, tidy
from ..operators import structure
from .inputs import daily, grid, panel
from .q_reports import _O, _w
from .q_risk import prior
from .registry import SQL, cte, query, rounded

K = ["ticker", "date"]


def full(x: str, n: int, f: str) -> str:
    return f"CASE WHEN count({x}) {_w(n)} = {n} THEN {f}({x}) {_w(n)} END"


def _last(x: str, lo: int, hi: int) -> str:
    return f"last_value({x} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {lo} PRECEDING AND {hi} PRECEDING)"


cte(
    "moves",
    f"""SELECT *, least(volume / nullif(CASE WHEN count(*) {prior(20)} = 20 THEN avg(volume) {prior(20)} END, 0) * (high - low) / close * 10, 1) AS force FROM (
 SELECT *, close / lag(close) {_O} - 1 AS chg, row_number() {_O} AS rn FROM daily)""",
)


def _last_move(sign: str) -> str:
    """The force of the last row of the 19 before that moved this way, null where it has none."""
    return f"list_extract(list(force) FILTER (chg {sign} 0) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING), -1)"


@query("smc_order_blocks", rounded("ticker date", "order_block_bull order_block_bear", f"""SELECT ticker, date, CASE WHEN rn > 20 AND chg > 0.02 THEN coalesce(fell, 0) ELSE 0 END AS order_block_bull,
 CASE WHEN rn > 20 AND chg < -0.02 THEN coalesce(rose, 0) ELSE 0 END AS order_block_bear FROM (SELECT *, {_last_move('<')} AS fell, {_last_move('>')} AS rose FROM moves)""", 5))
def q_blocks(spark, sf_dir):
    return tidy(structure.order_blocks(daily(spark, sf_dir)), K, ["order_block_bull", "order_block_bear"], 5)


@query("smc_fair_value_gaps", rounded("ticker date", "fvg_bull fvg_bear", f"""SELECT ticker, date, CASE WHEN u > 0.001 THEN least(u * 100, 1) ELSE 0 END AS fvg_bull, CASE WHEN d > 0.001 THEN least(d * 100, 1) ELSE 0 END AS fvg_bear
 FROM (SELECT *, (low - lag(high, 2) {_O}) / close AS u, (lag(low, 2) {_O} - high) / close AS d FROM daily)""", 5))
def q_gaps(spark, sf_dir):
    return tidy(structure.fair_value_gaps(daily(spark, sf_dir)), K, ["fvg_bull", "fvg_bear"], 5)


@query("smc_liquidity_sweeps", rounded("ticker date", "liquidity_sweep", f"""SELECT ticker, date, CASE WHEN ph > phi AND pc < ppc AND close > pc AND pv / nullif(pav, 0) > 1.5 THEN least((close - pc) / pc * 50, 1)
 WHEN NOT ph > phi AND pl < plo AND pc > ppc AND close < pc AND pv / nullif(pav, 0) > 1.5 THEN greatest((close - pc) / pc * 50, -1) ELSE 0 END AS liquidity_sweep FROM (
 SELECT *, lag(high) {_O} AS ph, lag(low) {_O} AS pl, lag(close) {_O} AS pc, lag(close, 2) {_O} AS ppc, lag(volume) {_O} AS pv, lag(hi) {_O} AS phi, lag(lo) {_O} AS plo, lag(av) {_O} AS pav FROM (
 SELECT *, CASE WHEN count(*) {prior(20)} = 20 THEN max(high) {prior(20)} END AS hi, CASE WHEN count(*) {prior(20)} = 20 THEN min(low) {prior(20)} END AS lo, avg(volume) {_w(20)} AS av FROM daily))""", 5))
def q_sweeps(spark, sf_dir):
    return tidy(structure.liquidity_sweeps(daily(spark, sf_dir)), K, ["liquidity_sweep"], 5)


_AFT = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
cte(
    "swings",
    f"""SELECT *, CASE WHEN high > max(high) {prior(5)} AND high > max(high) {_AFT} AND count(*) {prior(5)} = 5 AND count(*) {_AFT} = 5 THEN 1 ELSE 0 END AS swing_high,
 CASE WHEN low < min(low) {prior(5)} AND low < min(low) {_AFT} AND count(*) {prior(5)} = 5 AND count(*) {_AFT} = 5 THEN 1 ELSE 0 END AS swing_low FROM daily""",
)


@query("smc_swing_points", "SELECT ticker, date, swing_high, swing_low FROM swings")
def q_swings(spark, sf_dir):
    return structure.swings(daily(spark, sf_dir)).select("ticker", "date", "swing_high", "swing_low")


_UPTO = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BEFORE = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
# swings count from the 51st row of a ticker on
cte(
    "live_swings",
    f"""SELECT ticker, date, high, low, close, rn, CASE WHEN rn > 50 AND swing_high = 1 THEN high END AS sh, CASE WHEN rn > 50 AND swing_low = 1 THEN low END AS sl
 FROM (SELECT *, row_number() {_O} AS rn FROM swings)""",
)
cte(
    "swing_levels",
    f"""SELECT *, last_value(sh IGNORE NULLS) {_UPTO} AS lh, last_value(sl IGNORE NULLS) {_UPTO} AS ll,
 last_value(sh IGNORE NULLS) {_BEFORE} AS oh, last_value(sl IGNORE NULLS) {_BEFORE} AS ol FROM live_swings""",
)
# one row after the other, the trend carried along
cte(
    "break_steps",
    """SELECT r.ticker, r.rn, r.date, 0 AS trend, CAST(0 AS DOUBLE) AS hit FROM swing_levels r WHERE r.rn = 50
 UNION ALL
 SELECT ticker, rn, date, CASE WHEN side = 1 AND low < ll THEN -1 WHEN side = -1 AND high > lh THEN 1 ELSE side END,
  CASE WHEN side = 1 AND low < ll THEN -least((ll - low) / close * 50, 1) WHEN side = -1 AND high > lh THEN least((high - lh) / close * 50, 1) ELSE 0 END
 FROM (SELECT n.*, CASE WHEN n.sl < n.ol THEN -1 WHEN n.sh > n.oh THEN 1 ELSE b.trend END AS side FROM break_steps b JOIN swing_levels n ON n.ticker = b.ticker AND n.rn = b.rn + 1)""",
)


@query("smc_break_of_structure", rounded("ticker date", "break_of_structure", "SELECT d.ticker, d.date, coalesce(b.hit, 0) AS break_of_structure FROM daily d LEFT JOIN break_steps b ON b.ticker = d.ticker AND b.date = d.date", 5))
def q_breaks(spark, sf_dir):
    return tidy(structure.structure_breaks(daily(spark, sf_dir)), K, ["break_of_structure"], 5)


@query("smc_change_of_character", rounded("ticker date", "change_of_character", f"""SELECT ticker, date, CASE WHEN sign(mom - pm) * sign(pm) < 0 AND volume > av AND rn > 20 THEN greatest(least((mom - pm) * 50, 1), -1) ELSE 0 END AS change_of_character FROM (
 SELECT *, lag(mom) {_O} AS pm FROM (SELECT *, CASE WHEN count(chg) {_w(10)} = 10 THEN avg(chg) {_w(10)} END AS mom, avg(volume) {_w(20)} AS av FROM moves))""", 5))
def q_choch(spark, sf_dir):
    return tidy(structure.character_changes(daily(spark, sf_dir)), K, ["change_of_character"], 5)


_FAMILY = ["smc_order_blocks", "smc_fair_value_gaps", "smc_liquidity_sweeps", "smc_break_of_structure", "smc_change_of_character"]


@query("smc_all_features", "SELECT * FROM " + " JOIN ".join(f"({SQL[n]})" + (" USING (ticker, date)" if i else "") for i, n in enumerate(_FAMILY)))
def q_smc(spark, sf_dir):
    return tidy(structure.smart_money(daily(spark, sf_dir)), K, ["order_block_bull", "order_block_bear", "fvg_bull", "fvg_bear", "liquidity_sweep", "break_of_structure", "change_of_character"], 5)


_BIN = "least(greatest(coalesce(ceil((c - lo) / nullif((hi - lo) / 49, 0) - 1e-9) - 1, 0), 0), 48)"
# per row the volumes of the 49 bins of the 20 rows before it
cte(
    "profiles",
    f"""SELECT ticker, date, close, lo, (hi - lo) / 49 AS step, list_transform(range(49), lambda b: coalesce(list_sum(list_transform(list_filter(list_zip(bins, vs), lambda x: x[1] = b), lambda x: x[2])), 0)) AS held
 FROM (SELECT ticker, date, close, lo, hi, vs, list_transform(cs, lambda c: CAST({_BIN} AS INTEGER)) AS bins FROM (
 SELECT ticker, date, close, list(close) {prior(20)} AS cs, list(CAST(volume AS DOUBLE)) {prior(20)} AS vs, min(low) {prior(20)} AS lo, max(high) {prior(20)} AS hi FROM daily) WHERE len(cs) = 20)""",
)
# the value area, one bin further in each step
cte(
    "value_areas",
    """SELECT ticker, date, held, top AS first, top AS last, held[top] AS now, 0.70 * list_sum(held) AS goal FROM (SELECT *, CAST(list_position(held, list_max(held)) AS INTEGER) AS top FROM profiles)
 UNION ALL
 SELECT ticker, date, held, CASE WHEN l > r AND first > 1 THEN first - 1 ELSE first END, CASE WHEN l > r AND first > 1 THEN last ELSE last + 1 END, CASE WHEN l > r AND first > 1 THEN now + l ELSE now + r END, goal
 FROM (SELECT *, CASE WHEN first > 1 THEN held[first - 1] ELSE 0 END AS l, CASE WHEN last < 49 THEN held[last + 1] ELSE 0 END AS r FROM value_areas WHERE now < goal)
 WHERE l > r AND first > 1 OR last < 49""",
)


@query("sr_rolling_volume_profile", rounded("ticker date", "poc_distance va_high_distance va_low_distance", """SELECT d.ticker, d.date, coalesce((p.lo + (list_position(p.held, list_max(p.held)) - 0.5) * p.step - d.close) / d.close, 0) AS poc_distance,
 coalesce((p.lo + v.last * p.step - d.close) / d.close, 0) AS va_high_distance, coalesce((p.lo + (v.first - 1) * p.step - d.close) / d.close, 0) AS va_low_distance
 FROM daily d LEFT JOIN profiles p ON p.ticker = d.ticker AND p.date = d.date
 LEFT JOIN (SELECT ticker, date, min(first) AS first, max(last) AS last FROM value_areas GROUP BY 1, 2) v ON v.ticker = d.ticker AND v.date = d.date""", 5))
def q_profile(spark, sf_dir):
    return tidy(structure.rolling_profile(daily(spark, sf_dir)), K, ["poc_distance", "va_high_distance", "va_low_distance"], 5)


_P, _WP, _R = "((h + l + c) / 3)", "((h + l + 2 * c) / 4)", "(h - l)"


def _plain(p: str) -> tuple[str, ...]:
    return p, f"2 * {p} - l", f"{p} + {_R}", f"h + 2 * ({p} - l)", f"2 * {p} - h", f"{p} - {_R}", f"l - 2 * (h - {p})"


_PIVOTS = {
    "traditional": _plain(_P),
    "fibonacci": (_P, *[f"{_P} {s} {k} * {_R}" for s in "+-" for k in ("0.382", "0.618", "1.0")]),
    "camarilla": (_P, *[f"c {s} {_R} * 1.1 / {k}" for s in "+-" for k in (12, 6, 4)]),
    "woodie": _plain(_WP),
}
PIVOTS = structure.PIVOTS


def _pivot_sql(method: str) -> str:
    cols = ", ".join(f"coalesce(({x} - close) / close, 0) AS {n}" for n, x in zip(PIVOTS, _PIVOTS[method]))
    return f"SELECT ticker, date, '{method}' AS method, {cols} FROM (SELECT *, lag(high) {_O} AS h, lag(low) {_O} AS l, lag(close) {_O} AS c FROM daily)"


@query("sr_pivot_distances", rounded("ticker date method", PIVOTS, " UNION ALL ".join(map(_pivot_sql, _PIVOTS))))
def q_pivots(spark, sf_dir):
    return tidy(structure.pivot_distances(daily(spark, sf_dir)), [*K, "method"], PIVOTS)


BV = [f"ma_{m}_distance" for m in structure.AVERAGES] + [f"{x}_{y}" for x in ("bb", "kc") for y in ("upper_distance", "lower_distance", "width", "position")]
FLAGS = [f"above_ma_{m}" for m in structure.AVERAGES] + ["squeeze"]


def _band(name: str, half: str) -> str:
    return f"""(ma + 2 * {half} - close) / close AS {name}_upper_distance, (ma - 2 * {half} - close) / close AS {name}_lower_distance, 4 * {half} / ma AS {name}_width,
 (close - (ma - 2 * {half})) / nullif(4 * {half}, 0) AS {name}_position"""


_BANDS = f"""SELECT ticker, date, {', '.join(f'(m{m} - close) / close AS ma_{m}_distance, coalesce(CAST(close > m{m} AS INTEGER), 0) AS above_ma_{m}' for m in structure.AVERAGES)},
 {_band('bb', 'sd')}, {_band('kc', 'atr')}, coalesce(CAST(ma + 2 * sd < ma + 2 * atr AND ma - 2 * sd > ma - 2 * atr AS INTEGER), 0) AS squeeze
 FROM (SELECT *, m20 AS ma FROM (SELECT *, {full('close', 20, 'stddev_samp')} AS sd, {full('tr', 20, 'avg')} AS atr, {', '.join(f"{full('close', m, 'avg')} AS m{m}" for m in structure.AVERAGES)}
 FROM (SELECT *, greatest(high - low, abs(high - lag(close) {_O}), abs(low - lag(close) {_O})) AS tr FROM daily)))"""


@query("sr_bands", rounded(" ".join(["ticker date", *FLAGS]), BV, _BANDS, 5))
def q_bands(spark, sf_dir):
    return tidy(structure.bands(daily(spark, sf_dir)), [*K, *FLAGS], BV, 5)


AV = ["distance_to_high", "distance_to_low", "range_position", *[f"distance_to_round_{k}" for k in structure.ROUND]]
_ACTION = f"""SELECT ticker, date, (hi - close) / close AS distance_to_high, (lo - close) / close AS distance_to_low, (close - lo) / nullif(hi - lo, 0) AS range_position,
 CASE WHEN vol < {full('vol', 100, 'avg')} * 0.5 THEN 1 ELSE 0 END AS consolidation, {', '.join(f'(round_even(close / {k}, 0) * {k} - close) / close AS distance_to_round_{k}' for k in structure.ROUND)}
 FROM (SELECT *, {full('high', 50, 'max')} AS hi, {full('low', 50, 'min')} AS lo, {full('r', 20, 'stddev_samp')} AS vol FROM (SELECT *, close / lag(close) {_O} - 1 AS r FROM daily))"""


@query("sr_price_action_levels", rounded("ticker date consolidation", AV, _ACTION, 5))
def q_levels(spark, sf_dir):
    return tidy(structure.action_levels(daily(spark, sf_dir)), [*K, "consolidation"], AV, 5)


def _as(name: str, old: list[str], prefix: str, where: str = "") -> str:
    cols = ", ".join(f"{x} AS {prefix}{x}" for x in old)
    return f"(SELECT ticker, date, {cols} FROM ({SQL[name]}) {where})"


_SR = [_as("sr_rolling_volume_profile", ["poc_distance", "va_high_distance", "va_low_distance"], "sr_"), _as("sr_pivot_distances", PIVOTS, "sr_pivot_", "WHERE method = 'traditional'"), f"({SQL['sr_bands']})", f"({SQL['sr_price_action_levels']})"]


@query("sr_all_features", "SELECT * FROM " + " JOIN ".join(x + (" USING (ticker, date)" if i else "") for i, x in enumerate(_SR)))
def q_sr(spark, sf_dir):
    d = structure.support_resistance(daily(spark, sf_dir))
    whole = [*FLAGS, "consolidation"]
    six = [f"sr_pivot_{x}" for x in PIVOTS]  # rounded as in their own query
    five = [c for c in d.columns if c not in (*K, *whole, *six)]
    return d.select(*K, *whole, *[settle(F.col(c), 5).alias(c) for c in five], *[settle(F.col(c), 6).alias(c) for c in six])


_N = "NATION_5"
_LINK = f"SELECT x.ticker, x.date, x.r, b FROM (SELECT *, close / lag(close) {_O} - 1 AS r FROM panel) x JOIN (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS b FROM panel WHERE ticker = '{_N}') USING (date) WHERE r IS NOT NULL AND b IS NOT NULL"


@query("oil_link_correlation_beta", rounded("ticker date", "correlation beta", f"SELECT ticker, date, CASE WHEN count(*) {_w(60)} = 60 THEN coalesce(covar_samp(r, b) {_w(60)} / nullif(stddev_samp(r) {_w(60)} * stddev_samp(b) {_w(60)}, 0), 0) END AS correlation, CASE WHEN count(*) {_w(60)} = 60 THEN coalesce(covar_samp(r, b) {_w(60)} / nullif(var_samp(b) {_w(60)}, 0), 0) END AS beta FROM ({_LINK})", 5))
def q_link(spark, sf_dir):
    p = panel(spark, sf_dir)
    return tidy(structure.linked(p, p.where(F.col("ticker") == _N).select("date", F.col("close").alias("price"))), K, ["correlation", "beta"], 5)


CV = [*[f"momentum_{p}" for p in (5, 10, 20, 60)], "volatility", "trend_strength"]


def _trend_sql(value: str, source: str) -> str:
    moms = ", ".join(f"{value} / lag({value}, {p}) {_O} - 1 AS momentum_{p}" for p in (5, 10, 20, 60))
    return f"""SELECT *, {moms}, {full('r', 20, 'stddev_samp')} * sqrt(252) AS volatility, ({full('u', 20, 'sum')} - 10) / 10.0 AS trend_strength
 FROM (SELECT *, CASE WHEN r > 0 THEN 1 ELSE 0 END AS u FROM (SELECT *, {value} / lag({value}) {_O} - 1 AS r FROM {source}))"""


@query("oil_commodity_trend", rounded("ticker date", CV, _trend_sql("close", "panel"), 5))
def q_commodity(spark, sf_dir):
    return tidy(structure.commodity(panel(spark, sf_dir)), K, CV, 5)


IV = [f"inventory_{x}" for x in ("deviation", "change", "change_pct", "trend", "surprise")]
UV = [f"utilisation_{x}" for x in ("change", "deviation", "trend")]


def _slope(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {_w(n)} = {n} THEN regr_slope({x}, rn) {_w(n)} END"


def _inventory_sql(value: str, source: str) -> str:
    return f"""SELECT *, {value} / {full(value, 100, 'avg')} - 1 AS inventory_deviation, {_slope(value, 20)} AS inventory_trend, inventory_change - {full('inventory_change', 4, 'avg')} AS inventory_surprise
 FROM (SELECT *, {value} - lag({value}) {_O} AS inventory_change, {value} / lag({value}) {_O} - 1 AS inventory_change_pct, row_number() {_O} AS rn FROM {source})"""


def _utilisation_sql(value: str, source: str) -> str:
    return f"SELECT *, {value} / {full(value, 52, 'avg')} - 1 AS utilisation_deviation, {_slope(value, 12)} AS utilisation_trend FROM (SELECT *, {value} - lag({value}) {_O} AS utilisation_change, row_number() {_O} AS rn FROM {source})"


@query("oil_inventory_and_utilisation", rounded("ticker date", [*IV, *UV], f"SELECT * FROM ({_inventory_sql('volume', 'panel')}) JOIN (SELECT ticker, date, {', '.join(UV)} FROM ({_utilisation_sql('close', 'panel')})) USING (ticker, date)", 4))
def q_inventory(spark, sf_dir):
    p = panel(spark, sf_dir)
    return tidy(structure.utilisation_features(structure.inventory_features(p, "volume"), "close"), K, [*IV, *UV], 4)


def _rank(x: str) -> str:
    """Mean rank of x among its last 252 values; l_x is the list of them."""
    return f"CASE WHEN len(l_{x}) = 252 THEN (len(list_filter(l_{x}, lambda y: y < {x})) + len(list_filter(l_{x}, lambda y: y <= {x})) + 1) / 2.0 / 252 END"


# a commodity market out of the panel: one row a date on which all its parts are known
_PARTS = {"crude": ("NATION_5", "close"), "other_crude": ("NATION_6", "close"), "gasoline": ("NATION_7", "close"), "diesel": ("NATION_8", "close"), "inventory": ("NATION_9", "volume"), "utilisation": ("NATION_10", "volume")}
cte(
    "market",
    "SELECT 'market' AS ticker, * FROM (SELECT date, " + ", ".join(f"max(CAST({v} AS DOUBLE)) FILTER (ticker = '{t}') AS {n}" for n, (t, v) in _PARTS.items()) + " FROM grid GROUP BY 1) WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in _PARTS),
)


def market(spark, sf_dir):
    p = grid(spark, sf_dir)
    parts = [F.max(F.when(F.col("ticker") == t, F.col(v).cast("double"))).alias(n) for n, (t, v) in _PARTS.items()]
    return p.where(F.col("ticker").isin([t for t, _ in _PARTS.values()])).groupBy("date").agg(*parts).dropna()


SV = ["spread", "spread_pct", "spread_momentum", "spread_percentile"]


def _spread_sql(one: str, other: str, source: str) -> str:
    return f"SELECT *, spread / nullif(lag(spread, 20) {_O}, 0) - 1 AS spread_momentum, {_rank('spread')} AS spread_percentile FROM (SELECT *, list(spread) {_w(252)} AS l_spread FROM (SELECT *, {one} - {other} AS spread, ({one} - {other}) / {other} AS spread_pct FROM {source}))"


@query("oil_price_spread", rounded("ticker date", SV, _spread_sql("close", "other", f"(SELECT p.*, o.close AS other FROM panel p JOIN panel o ON o.date = p.date AND o.ticker = '{_N}' WHERE p.ticker IN ('NATION_6', 'NATION_7'))"), 4))
def q_spread(spark, sf_dir):
    p = panel(spark, sf_dir)
    other = p.where(F.col("ticker") == _N).select("date", F.col("close").alias("other"))
    return tidy(structure.spread_series(p.where("ticker in ('NATION_6', 'NATION_7')").join(other, "date"), "close", "other"), K, SV, 4)


_CRACKS = ["crack_321", "crack_gasoline", "crack_diesel"]
XV = [*_CRACKS, "crack_momentum", *[f"{x}_percentile" for x in _CRACKS]]


def _crack_sql(source: str) -> str:
    return f"""SELECT *, crack_321 / nullif(lag(crack_321, 20) {_O}, 0) - 1 AS crack_momentum, {', '.join(f'{_rank(x)} AS {x}_percentile' for x in _CRACKS)} FROM (SELECT *, {', '.join(f'list({x}) {_w(252)} AS l_{x}' for x in _CRACKS)} FROM (
 SELECT *, (2 * gasoline + diesel) / 3 - crude AS crack_321, gasoline - crude AS crack_gasoline, diesel - crude AS crack_diesel FROM {source}))"""


@query("oil_crack_spreads", rounded("date", XV, _crack_sql("market"), 4))
def q_crack(spark, sf_dir):
    return tidy(structure.crack_spreads(market(spark, sf_dir).withColumn("ticker", F.lit("market")), "crude", "gasoline", "diesel"), ["date"], XV, 4)


_SEASONS = f"""SELECT ticker, date, CASE WHEN month(date) BETWEEN 5 AND 9 THEN 1 ELSE 0 END AS driving, CASE WHEN month(date) IN (11, 12, 1, 2, 3) THEN 1 ELSE 0 END AS heating, CASE WHEN month(date) IN (4, 10) THEN 1 ELSE 0 END AS shoulder,
 avg(r) OVER (PARTITION BY ticker, month(date)) AS month_avg FROM (SELECT *, close / lag(close) {_O} - 1 AS r FROM panel)"""


@query("oil_seasonality", rounded("ticker date driving heating shoulder", "month_avg", _SEASONS))
def q_season(spark, sf_dir):
    return tidy(structure.seasonal(panel(spark, sf_dir)), [*K, "driving", "heating", "shoulder"], ["month_avg"])


cte("market_trend", _trend_sql("crude", "market"))
cte(
    "market_rest",
    f"""SELECT *, volatility / nullif({full('volatility', 60, 'avg')}, 0) AS vol_spike, {full('large_move', 5, 'sum')} AS large_move_5 FROM (SELECT *, CASE WHEN abs(r) > 0.03 THEN 1 ELSE 0 END AS large_move FROM market_trend)""",
)
_MARKET_PARTS = [
    "SELECT ticker, date, large_move, vol_spike, large_move_5, " + ", ".join(CV) + " FROM market_rest",
    f"SELECT date, {', '.join(IV)} FROM ({_inventory_sql('inventory', 'market')})",
    f"SELECT date, {', '.join(UV)} FROM ({_utilisation_sql('utilisation', 'market')})",
    f"SELECT date, {', '.join(XV)} FROM ({_crack_sql('market')})",
    f"SELECT date, {', '.join(SV)} FROM ({_spread_sql('crude', 'other_crude', 'market')})",
]
_CORR = f"""SELECT ticker, date, CASE WHEN count(x) {_w(60)} = 60 THEN coalesce(covar_samp(x, y) {_w(60)} / nullif(stddev_samp(x) {_w(60)} * stddev_samp(y) {_w(60)}, 0), 0) ELSE 0 END AS correlation,
 CASE WHEN count(x) {_w(60)} = 60 THEN coalesce(covar_samp(x, y) {_w(60)} / nullif(var_samp(y) {_w(60)}, 0), 0) ELSE 0 END AS beta
 FROM (SELECT ticker, date, CASE WHEN b IS NOT NULL THEN r END AS x, CASE WHEN r IS NOT NULL THEN b END AS y FROM (SELECT *, close / lag(close) {_O} - 1 AS r FROM panel) JOIN (SELECT date, crude / lag(crude) {_O} - 1 AS b FROM market) USING (date))"""
cte("market_features", "SELECT * EXCLUDE (ticker) FROM " + " JOIN ".join(f"({x})" + (" USING (date)" if i else "") for i, x in enumerate(_MARKET_PARTS)))
_WHOLE = ["driving", "heating", "shoulder", "large_move", "large_move_5"]
OV = ["correlation", "beta", "month_avg", *[x for x in structure.MARKET if x not in _WHOLE]]


@query("oil_all_features", rounded(" ".join([*K, *_WHOLE]), OV, f"SELECT * FROM ({_CORR}) JOIN ({_SEASONS}) USING (ticker, date) JOIN market_features USING (date)", 4))
def q_oil(spark, sf_dir):
    return tidy(structure.commodity_linked(panel(spark, sf_dir), market(spark, sf_dir)), [*K, *_WHOLE], OV, 4)


_PICKED = ["break_of_structure", "sr_poc_distance", "squeeze", "momentum_20", "crack_321_percentile"]


_FAMILY_SQL = [
    f"(SELECT ticker, date, break_of_structure FROM ({SQL['smc_break_of_structure']}))",
    f"(SELECT ticker, date, sr_poc_distance, squeeze FROM ({SQL['sr_all_features']}))",
]


def _settled(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE) + CAST(3.7e-08 AS DOUBLE), 4) + 0.0" if x in structure.MARKET else f"CAST({x} AS DOUBLE)"


@query("features_by_family", "SELECT ticker, date, " + ", ".join(f"lag(coalesce({_settled(x)}, 0)) {_O} AS {x}" for x in _PICKED) + f" FROM {_FAMILY_SQL[0]} JOIN {_FAMILY_SQL[1]} USING (ticker, date) LEFT JOIN market_features USING (date)")
def q_families(spark, sf_dir):
    d = structure.family_features(daily(spark, sf_dir), _PICKED, market(spark, sf_dir), lag=1)
    return d.select(*K, *[settle(F.col(x), 4 if x in structure.MARKET else 5).alias(x) for x in _PICKED])


@query("oil_risk_proxy", rounded("ticker date large large_5", "risk", f"SELECT ticker, date, large, CAST(sum(large) {_w(5)} AS BIGINT) AS large_5, vol / nullif({full('vol', 60, 'avg')}, 0) AS risk FROM (SELECT *, {full('r', 10, 'stddev_samp')} AS vol, CASE WHEN abs(r) > 0.03 THEN 1 ELSE 0 END AS large FROM (SELECT *, close / lag(close) {_O} - 1 AS r FROM daily))", 5))
def q_proxy(spark, sf_dir):
    return tidy(structure.risk_proxy(daily(spark, sf_dir)), [*K, "large", "large_5"], ["risk"], 5)
