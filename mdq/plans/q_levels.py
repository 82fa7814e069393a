"""Registered queries: levels, candidates, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import tidy
from ..operators import levels, outcomes, patterns
from .inputs import bars, once
from .q_intraday import _BEAR3, _EXH, _TWIN, T, candles, eqh_signals, levels_daily
from .registry import cte, query, rounded

_R = f"OVER ({T} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
_LOW = "lag(p) OVER (PARTITION BY ticker, s ORDER BY p, age)"


def _union(specs, src):
    return " UNION ALL ".join(f"SELECT ticker, round({p}, 4) AS price, '{m}' AS method, {s}::DOUBLE AS strength, {str(b).lower()} AS is_support FROM {src}" for p, m, s, b in specs)


_PIVOT = "(h + l + c) / 3"
_PIVOTS = [(_PIVOT, "pivot_p", "2.0", False), (f"2 * ({_PIVOT}) - l", "pivot_r1", "1.5", False), (f"{_PIVOT} + (h - l)", "pivot_r2", "1.2", False), (f"2 * ({_PIVOT}) - h", "pivot_s1", "1.5", True), (f"{_PIVOT} - (h - l)", "pivot_s2", "1.2", True)]


def level_ctes(x: str, bars: str, prices: str) -> None:
    """The levels of every ticker of `bars` as sub-selects whose names start with x; prices has (ticker, px)."""
    cte(f"{x}nyday", f"SELECT *, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS ny FROM {bars}")
    cte(f"{x}hl", f"SELECT ticker, ny, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c, row_number() OVER (PARTITION BY ticker ORDER BY ny DESC) AS age FROM {x}nyday GROUP BY 1, 2")
    cte(f"{x}pivots", f"SELECT * FROM ({_union(_PIVOTS, f'{x}hl WHERE age = 2')}) WHERE price > 0")
    cte(f"{x}anchors", f"SELECT * FROM ({_union([('h', 'daily_high', '(7.0 - age)', False), ('l', 'daily_low', '(7.0 - age)', True)], f'{x}hl WHERE age BETWEEN 2 AND 6')}) WHERE price > 0")
    cte(
        f"{x}ext",
        f"""SELECT * FROM (SELECT *, count(*) {_R} AS n, max(high) {_R} AS mx, min(low) {_R} AS mn,
 greatest(epoch_us(max(ts) OVER (PARTITION BY ticker)) - epoch_us(ts), 43200000000) / 86400e6 AS age FROM {bars}) WHERE n = 11""",
    )
    cte(f"{x}points", f"SELECT ticker, high AS p, false AS s, age FROM {x}ext WHERE high = mx UNION ALL SELECT ticker, low, true, age FROM {x}ext WHERE low = mn")
    cte(
        f"{x}extremes",
        f"""SELECT ticker, round(avg(p), 4) AS price, CASE WHEN s THEN 'local_low' ELSE 'local_high' END AS method, round(sum(1 / age), 4) AS strength, s AS is_support FROM (
 SELECT *, sum(far) OVER (PARTITION BY ticker, s ORDER BY p, age ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM (
 SELECT *, CASE WHEN p - {_LOW} > 0.003 * {_LOW} OR {_LOW} IS NULL THEN 1 ELSE 0 END AS far FROM {x}points)) GROUP BY ticker, s, cluster""",
    )
    cte(
        f"{x}prof100",
        f"""SELECT ticker, bin, sum(v) AS volume, any_value(lo + (bin + 0.5) * w) AS price FROM (
 SELECT ticker, lo, w, unnest(range(b0, b1 + 1)) AS bin, volume / (b1 - b0 + 1) AS v FROM (
 SELECT *, greatest(b0, CAST(least(floor((high - lo) / w), 99) AS BIGINT)) AS b1 FROM (
 SELECT *, CAST(greatest(ceil((low - lo) / w) - 1, 0) AS BIGINT) AS b0 FROM (
 SELECT b.*, e.lo, (e.hi - e.lo) / 100 AS w FROM {bars} b JOIN (SELECT ticker, min(low) AS lo, max(high) AS hi FROM {bars} GROUP BY 1) e USING (ticker) WHERE volume > 0 AND high > low)))) GROUP BY 1, 2""",
        kept=True,
    )
    # the area grows from the busiest bin; held has the volumes of all bins
    cte(
        f"{x}grow",
        f"""SELECT ticker, held, mn, mx, total, top AS lo, top AS hi, held[top + 1] AS acc, top AS poc, 0 AS step FROM (
  SELECT ticker, list_transform(range(100), lambda b: coalesce(m[b], 0)) AS held, mn, mx, total, top FROM (
  SELECT ticker, map_from_entries(list((bin, volume))) AS m, min(bin) AS mn, max(bin) AS mx, sum(volume) AS total, arg_max(bin, (round(volume, 9), -bin)) AS top FROM {x}prof100 GROUP BY 1))
 UNION ALL SELECT ticker, held, mn, mx, total, CASE WHEN dn >= up THEN lo - 1 ELSE lo END, CASE WHEN dn >= up THEN hi ELSE hi + 1 END, acc + greatest(dn, up), poc, step + 1 FROM (
 SELECT *, CASE WHEN lo > mn THEN held[lo] ELSE -1 END AS dn, CASE WHEN hi < mx THEN held[hi + 2] ELSE -1 END AS up FROM {x}grow)
 WHERE acc < total * 0.7 AND greatest(dn, up) >= 0""",
    )
    cte(
        f"{x}area",
        f"""SELECT ticker, m[z.poc] AS poc, m[z.hi] AS vah, m[z.lo] AS val FROM (SELECT ticker, arg_max({{'lo': lo, 'hi': hi, 'poc': poc}}, step) AS z FROM {x}grow GROUP BY 1)
 JOIN (SELECT ticker, map_from_entries(list((bin, price))) AS m FROM {x}prof100 GROUP BY 1) USING (ticker)""",
    )
    soft = f"SELECT * FROM {x}extremes UNION ALL " + _union([("poc", "poc", "3.0", False), ("vah", "vah", "2.0", False), ("val", "val", "2.0", True)], f"{x}area")
    cte(
        f"{x}boosted",
        f"""SELECT s.ticker, s.price, s.method, s.strength * CASE WHEN EXISTS (SELECT 1 FROM {x}anchors a WHERE a.ticker = s.ticker AND abs(s.price - a.price) / a.price <= 0.003) THEN 2 ELSE 1 END AS strength, s.is_support
 FROM ({soft}) s WHERE s.price > 0""",
    )
    # numbered by price; then one after the other, the levels kept so far in a list
    cte(
        f"{x}walk",
        f"""SELECT ticker, {{'price': price, 'method': method, 'strength': strength, 'is_support': is_support}} AS v, row_number() OVER (PARTITION BY ticker ORDER BY price, strength DESC, method, is_support) AS i
 FROM (SELECT * FROM {x}pivots UNION ALL SELECT * FROM {x}anchors UNION ALL SELECT * FROM {x}boosted) JOIN {prices} USING (ticker) WHERE strength >= 0.5 AND price BETWEEN px * (1 - 0.30) AND px * (1 + 0.30)""",
        kept=True,
    )
    cte(
        f"{x}kept",
        f"""SELECT ticker, i, [v] AS kept FROM {x}walk WHERE i = 1
 UNION ALL
 SELECT k.ticker, n.i, CASE WHEN abs(n.v.price - k.kept[-1].price) / k.kept[-1].price >= 0.003 THEN list_append(k.kept, n.v) WHEN n.v.strength > k.kept[-1].strength THEN list_append(k.kept[:-2], n.v) ELSE k.kept END
 FROM {x}kept k JOIN {x}walk n ON n.ticker = k.ticker AND n.i = k.i + 1""",
    )
    cte(f"{x}merged", f"SELECT ticker, v.price AS price, v.method AS method, v.strength AS strength, v.is_support AS is_support FROM (SELECT ticker, unnest(kept) AS v FROM (SELECT ticker, arg_max(kept, i) AS kept FROM {x}kept GROUP BY 1))")
    cte(
        f"{x}nearest",
        f"SELECT ticker, px, max(price) FILTER (price < px AND is_support) AS support, min(price) FILTER (price > px AND NOT is_support) AS resistance FROM {prices} LEFT JOIN {x}merged USING (ticker) GROUP BY 1, 2",
    )


cte("last_px", "SELECT ticker, arg_max(close, ts) AS px FROM bi GROUP BY 1")
level_ctes("", "bi", "last_px")
# a ticker as of a day is a ticker of its own
cte("asof_bi", "SELECT d.ticker || '|' || d.day AS ticker, b.ts, b.open, b.high, b.low, b.close, b.volume FROM (SELECT DISTINCT ticker, day FROM bi) d JOIN bi b ON b.ticker = d.ticker AND b.day < d.day", kept=True)
cte("asof_px", "SELECT ticker || '|' || day AS ticker, arg_max(close, ts) AS px FROM bi GROUP BY ticker, day")
level_ctes("asof_", "asof_bi", "asof_px")
LV = "ticker method is_support"


@query("levels_floor_pivots", rounded(LV, "price strength", "SELECT * FROM pivots", 4))
def q_pivots(spark, sf_dir):
    return tidy(levels.pivots(bars(spark, sf_dir)), LV.split(), ["price", "strength"], 4)


@query("levels_daily_anchors", rounded(LV, "price strength", "SELECT * FROM anchors", 4))
def q_anchors(spark, sf_dir):
    return tidy(levels.anchors(bars(spark, sf_dir)), LV.split(), ["price", "strength"], 4)


@query("levels_fractal_clusters", rounded(LV, "price strength", "SELECT * FROM extremes", 3))
def q_extremes(spark, sf_dir):
    return tidy(levels.extremes(bars(spark, sf_dir)), LV.split(), ["price", "strength"], 3)


@query("levels_volume_profile", rounded("ticker bin", "volume price", "SELECT * FROM prof100", 4))
def q_profile(spark, sf_dir):
    return tidy(levels.profile(bars(spark, sf_dir)), ["ticker", "bin"], ["volume", "price"], 4)


@query("levels_value_area", rounded("ticker", "poc vah val", "SELECT * FROM area", 4))
def q_area(spark, sf_dir):
    return tidy(levels.value_area(levels.profile(bars(spark, sf_dir))), ["ticker"], ["poc", "vah", "val"], 4)


# Lloyd steps on the same points
cte("spots", "SELECT ticker, p, row_number() OVER (PARTITION BY ticker ORDER BY p) AS k, count(*) OVER (PARTITION BY ticker) AS total FROM points")
cte(
    "lloyd",
    """SELECT ticker, 0 AS step, list_transform(range(6), lambda j: ps[CAST(floor((2 * j + 1) * len(ps) / 12) AS BIGINT) + 1]) AS c, median(ps) AS middle, ps FROM (SELECT ticker, list(p ORDER BY p) AS ps FROM spots WHERE total >= 6 GROUP BY 1)
 UNION ALL
 SELECT ticker, step + 1, list_transform(range(6), lambda j: coalesce(list_avg(list_filter(ps, lambda p: len(list_filter(range(1, 6), lambda m: p > (c[m] + c[m + 1]) / 2)) = j)), c[j + 1])), middle, ps FROM lloyd WHERE step < 20""".replace("median(ps)", "list_median(ps)"),
)


@query("levels_cluster_centres", rounded("ticker method is_support", "price strength", "SELECT ticker, 'kmeans' AS method, round(v, 4) AS price, 1.5 AS strength, v <= middle AS is_support FROM (SELECT ticker, middle, unnest(c) AS v FROM lloyd WHERE step = 20)", 3))
def q_centres(spark, sf_dir):
    return tidy(levels.centres(bars(spark, sf_dir)), ["ticker", "method", "is_support"], ["price", "strength"], 3)


@once("levels_merged")
def merged(spark, sf_dir):
    return levels.merged(bars(spark, sf_dir))


@query("levels_merged", rounded(LV, "price strength", "SELECT * FROM merged", 3))
def q_merged(spark, sf_dir):
    return tidy(merged(spark, sf_dir), LV.split(), ["price", "strength"], 3)


@query("levels_nearest", rounded("ticker", "px support resistance", "SELECT * FROM nearest", 4))
def q_nearest(spark, sf_dir):
    px = bars(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "ts").alias("px"))
    return tidy(levels.nearest(merged(spark, sf_dir), px), ["ticker"], ["px", "support", "resistance"], 4)


cte("lastday", "SELECT ticker, support AS level FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS k FROM levels_daily) WHERE k = 1")


def last_support(spark, sf_dir):
    return levels_daily(spark, sf_dir).groupBy("ticker").agg(F.max_by("support", "day").alias("level"))


@query("level_role_reversal", """SELECT ticker, level, (n_up >= 3 AND coalesce(last_up, 0) > 1 AND last BETWEEN level * 0.997 AND level * 1.003 * 1.01) AS reversed FROM (
 SELECT ticker, level, count(*) FILTER (close > level * 1.003) AS n_up, min(k) FILTER (close > level * 1.003) AS last_up, arg_min(close, k) AS last FROM (
 SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS k FROM bi) JOIN lastday USING (ticker) WHERE k <= 100 GROUP BY 1, 2)""")
def q_reversal(spark, sf_dir):
    return levels.role_reversal(bars(spark, sf_dir), last_support(spark, sf_dir))


@query("level_rejections", """SELECT ticker, level, count(*) FILTER (low <= level * 1.003 AND close > level) AS rejections FROM (
 SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS k FROM bi) JOIN lastday USING (ticker) WHERE k <= 60 GROUP BY 1, 2""")
def q_rejections(spark, sf_dir):
    return levels.rejections(bars(spark, sf_dir), last_support(spark, sf_dir))


# ---- candidates and outcomes ----------------------------------------------------------

# the entry days that a bar is in reach of, and its best pattern as seen from each
cte(
    "reached",
    """SELECT c.*, l.day AS entry_day, l.support FROM (SELECT *, coalesce(lead(day, 20) OVER (PARTITION BY ticker ORDER BY idx), last_value(day) OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS far FROM canda) c
 JOIN levels_daily l ON l.ticker = c.ticker AND l.day BETWEEN c.day AND c.far""",
)
cte(
    "gated",
    f"""SELECT ticker, day, idx, arg_max(pattern, (confidence, pattern)) AS pattern FROM (
 SELECT ticker, entry_day AS day, idx, 'strict' AS pattern, 1.0 AS confidence FROM reached WHERE {_TWIN.replace('0.03', '0.01')} AND {_BEAR3} AND adx >= 20
 UNION ALL SELECT r.ticker, r.entry_day, r.idx, 'exhaustion', 0.6 FROM reached r JOIN ({_EXH.replace('ticker, ts, lead_idx', 'ticker, idx', 1)}) e ON e.ticker = r.ticker AND e.idx = r.idx
 UNION ALL SELECT ticker, entry_day, idx, 'absorption', 0.7 FROM reached WHERE idx >= 3 AND close_2 < open_2 AND mean_body_2 > 0 AND body_2 >= 1.5 * mean_body_2 AND abs(least(close_2, low_2) - support) <= 0.015 * support
  AND low_1 >= low_2 * 0.998 AND low >= low_2 * 0.998 AND (mean_body IS NULL OR mean_body <= 0 OR (body_1 <= 0.8 * mean_body AND body <= 0.8 * mean_body)) AND (close_1 > open_1 OR close > open) AND adx >= 15) GROUP BY 1, 2, 3""",
)
# one bar of a session after the other: a touch arms, a break or a refused entry disarms
cte(
    "session_bars",
    """SELECT *, row_number() OVER (PARTITION BY ticker, day ORDER BY idx) AS k, least(open, close) <= support * 1.02 AS touch,
 close < support * 0.90 OR (ready AND (next_open < 0.1 OR (next_open - support) / next_open * 100 > 5)) AS reset FROM (
 SELECT *, last_p IS NOT NULL AND coalesce(hour(next_ts) * 60 + minute(next_ts) <= 1199 AND CAST(next_ts AS DATE) = day, false) AS ready FROM (
 SELECT b.*, l.support, l.resistance, (SELECT max(g.idx) FROM gated g WHERE g.ticker = b.ticker AND g.day = b.day AND g.idx BETWEEN b.idx - 20 AND b.idx) AS last_p
 FROM (SELECT *, lead(open) OVER (PARTITION BY ticker ORDER BY ts) AS next_open, lead(ts) OVER (PARTITION BY ticker ORDER BY ts) AS next_ts FROM bi) b JOIN levels_daily l ON l.ticker = b.ticker AND l.day = b.day
 WHERE hour(b.ts) * 60 + minute(b.ts) BETWEEN 810 AND 1199))""",
    kept=True,
)
cte(
    "armings",
    """SELECT ticker, day, k, 0 AS armed, CASE WHEN touch THEN 1 ELSE 0 END AS after, CASE WHEN touch THEN 1 ELSE 0 END AS attempt FROM session_bars WHERE k = 1
 UNION ALL
 SELECT n.ticker, n.day, n.k, a.after, CASE WHEN a.after = 0 THEN CASE WHEN n.touch THEN 1 ELSE 0 END WHEN n.reset THEN 0 ELSE 1 END, a.attempt + CASE WHEN a.after = 0 AND n.touch THEN 1 ELSE 0 END
 FROM armings a JOIN session_bars n ON n.ticker = a.ticker AND n.day = a.day AND n.k = a.k + 1""",
)
cte(
    "cands",
    """SELECT s.ticker, s.day, s.support, s.resistance, s.idx + 1 AS entry_idx, s.next_ts AS entry_ts, s.next_open AS entry_price, g.pattern, s.idx - s.last_p AS bars_since, CAST(a.attempt AS BIGINT) AS attempt
 FROM session_bars s JOIN armings a ON a.ticker = s.ticker AND a.day = s.day AND a.k = s.k JOIN gated g ON g.ticker = s.ticker AND g.day = s.day AND g.idx = s.last_p WHERE a.armed = 1 AND s.ready AND NOT s.reset""",
    kept=True,
)
GRID = [(p, s) for p in (0.6, 1.2, 2.4) for s in (0.4, 0.8, 1.6)]


@once("cands")
def cands(spark, sf_dir):
    c = candles(spark, sf_dir)
    entries = levels_daily(spark, sf_dir)
    return outcomes.candidates(c.select("ticker", "ts", "idx", "open", "high", "low", "close"), entries, outcomes.gate_patterns(c, entries))


@query("entry_candidates", rounded("ticker day entry_idx entry_ts pattern bars_since attempt", "entry_price support", "SELECT * FROM cands", 4))
def q_cands(spark, sf_dir):
    return tidy(cands(spark, sf_dir), ["ticker", "day", "entry_idx", "entry_ts", "pattern", "bars_since", "attempt"], ["entry_price", "support"], 4)


cte("gridp", "SELECT * FROM (VALUES " + ", ".join(f"({p}::DOUBLE, {s}::DOUBLE)" for p, s in GRID) + ") g(pt, sl)")
cte(
    "barr",
    """SELECT *, CASE WHEN resistance > entry_price * 1.005 THEN least(resistance, entry_price * (1 + pt / 100) * 1.5) ELSE entry_price * (1 + pt / 100) END AS target,
 CASE WHEN support * 0.999 > entry_price * (1 - sl / 100) AND support * 0.999 < entry_price THEN support * 0.999 ELSE entry_price * (1 - sl / 100) END AS stop,
 entry_price * (1 - 5.0 / 100) AS floor FROM cands, gridp""",
)


cte(
    "be",
    """SELECT *, coalesce(min(idx) FILTER (hour(ts) * 60 + minute(ts) >= 1200) OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
 max(idx) OVER (PARTITION BY ticker)) AS end_idx FROM bi""",
)


def _trades_sql(trail: bool) -> str:
    eff = "stop"
    if trail:
        eff = """CASE WHEN (greatest(entry_price, max(b_high) OVER w) - entry_price) / entry_price * 100 >= 0.5
  THEN greatest(stop, greatest(entry_price, max(b_high) OVER w) * (1 - 0.5 / 100)) ELSE stop END"""
    return f"""SELECT ticker, day, pattern, attempt, support, pt, sl, entry_idx, entry_ts, entry_price, target, stop, outcome, exit_price, exit_ts, exit_idx, exit_idx - entry_idx AS hold_bars,
 round((exit_price - entry_price) / entry_price * 100, 4) AS pnl_pct, (weak_idx IS NULL OR weak_idx > least(exit_idx, entry_idx + 12)) AS support_respected FROM (
 SELECT ticker, day, pattern, attempt, support, pt, sl, entry_idx, entry_ts, entry_price, target, stop, arg_min(oc, b_idx) FILTER (oc IS NOT NULL) AS outcome, arg_min(px, b_idx) FILTER (oc IS NOT NULL) AS exit_price,
  arg_min(b_ts, b_idx) FILTER (oc IS NOT NULL) AS exit_ts, min(b_idx) FILTER (oc IS NOT NULL) AS exit_idx, min(b_idx) FILTER (b_close < support * 0.99) AS weak_idx FROM (
 SELECT *, CASE WHEN b_low <= floor THEN 'loss' WHEN b_low <= eff THEN CASE WHEN eff > entry_price THEN 'win' ELSE 'loss' END WHEN b_high >= target THEN 'win' WHEN b_idx = last_idx THEN 'timeout' END AS oc,
  CASE WHEN b_low <= floor THEN least(b_open, floor) WHEN b_low <= eff THEN least(b_open, eff) WHEN b_high >= target THEN target WHEN b_idx = last_idx THEN b_close END AS px FROM (
 SELECT *, {eff} AS eff, max(b_idx) OVER (PARTITION BY ticker, day, pt, sl, entry_idx) AS last_idx FROM (
 SELECT c.*, b.idx AS b_idx, b.ts AS b_ts, b.open AS b_open, b.high AS b_high, b.low AS b_low, b.close AS b_close
 FROM barr c JOIN be n ON n.ticker = c.ticker AND n.idx = c.entry_idx JOIN bi b ON b.ticker = c.ticker AND b.idx > c.entry_idx AND b.idx <= n.end_idx)
 WINDOW w AS (PARTITION BY ticker, day, pt, sl, entry_idx ORDER BY b_idx))) GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)"""


cte("trades", _trades_sql(False))


@once("trades")
def trades(spark, sf_dir):
    c = candles(spark, sf_dir)
    return outcomes.first_barrier(outcomes.barriers(outcomes.with_grid(cands(spark, sf_dir), GRID)), c)


TK = ["ticker", "entry_ts", "pt", "sl", "outcome", "exit_ts", "hold_bars", "support_respected"]


@query("outcomes_first_barrier", rounded(" ".join(TK), "entry_price exit_price pnl_pct", "SELECT * FROM trades", 4))
def q_trades(spark, sf_dir):
    return tidy(trades(spark, sf_dir), TK, ["entry_price", "exit_price", "pnl_pct"], 4)


@query("outcomes_trailing_stop", rounded(" ".join(TK), "entry_price exit_price pnl_pct", _trades_sql(True), 4))
def q_trail(spark, sf_dir):
    c = outcomes.barriers(outcomes.with_grid(cands(spark, sf_dir), GRID))
    t = outcomes.first_barrier(c, candles(spark, sf_dir), trail=0.5, trail_from=0.5)
    return tidy(t, TK, ["entry_price", "exit_price", "pnl_pct"], 4)


@query("outcome_barriers", rounded("ticker entry_ts pt sl", "target stop floor", "SELECT * FROM barr", 4))
def q_barriers(spark, sf_dir):
    return tidy(outcomes.barriers(outcomes.with_grid(cands(spark, sf_dir), GRID)), ["ticker", "entry_ts", "pt", "sl"], ["target", "stop", "floor"], 4)


cte(
    "chain",
    """SELECT ticker, day, pt, sl, entry_idx, exit_idx + CASE WHEN outcome = 'loss' THEN 6 ELSE 0 END AS free, CASE WHEN outcome = 'loss' THEN 1 ELSE 0 END AS losses, 1 AS n, k FROM tk WHERE k = 1
 UNION ALL SELECT ticker, day, pt, sl, entry_idx, CASE WHEN go THEN x_free ELSE free END, losses + CASE WHEN go THEN lost ELSE 0 END, n + CASE WHEN go THEN 1 ELSE 0 END, k FROM (
 SELECT t.ticker, t.day, t.pt, t.sl, t.entry_idx, c.free, c.losses, c.n, t.k, t.entry_idx > c.free AND c.losses < 5 AND c.n < 10 AS go,
  t.exit_idx + CASE WHEN t.outcome = 'loss' THEN 6 ELSE 0 END AS x_free, CASE WHEN t.outcome = 'loss' THEN 1 ELSE 0 END AS lost
 FROM chain c JOIN tk t ON t.ticker = c.ticker AND t.day = c.day AND t.pt = c.pt AND t.sl = c.sl AND t.k = c.k + 1)""",
)
cte("tk", "SELECT *, row_number() OVER (PARTITION BY ticker, day, pt, sl ORDER BY entry_idx) AS k FROM trades")


@query("outcomes_non_overlapping", """SELECT ticker, day, pt, sl, entry_idx FROM (SELECT *, lag(n, 1, 0) OVER (PARTITION BY ticker, day, pt, sl ORDER BY k) AS pn FROM chain) WHERE n > pn""")
def q_chain(spark, sf_dir):
    return outcomes.admissible(trades(spark, sf_dir), ["ticker", "day", "pt", "sl"]).select("ticker", "day", "pt", "sl", "entry_idx")


@query("outcomes_breakout", rounded("ticker entry_ts outcome exit_ts hold_bars", "pnl_pct", """SELECT ticker, entry_ts, outcome, exit_ts, exit_idx - entry_idx AS hold_bars, round((px - entry_price) / entry_price * 100, 4) AS pnl_pct FROM (
 SELECT ticker, entry_ts, entry_idx, entry_price, arg_min(oc, b_idx) FILTER (oc IS NOT NULL) AS outcome, arg_min(px, b_idx) FILTER (oc IS NOT NULL) AS px, arg_min(b_ts, b_idx) FILTER (oc IS NOT NULL) AS exit_ts, min(b_idx) FILTER (oc IS NOT NULL) AS exit_idx FROM (
 SELECT *, CASE WHEN hour(b_ts) * 60 + minute(b_ts) >= 1200 THEN 'timeout' WHEN low <= floor THEN 'loss' WHEN high >= target THEN 'win' WHEN low <= stop THEN 'loss' WHEN close < ceiling THEN 'loss' WHEN b_idx = last_idx THEN 'timeout' END AS oc,
 CASE WHEN hour(b_ts) * 60 + minute(b_ts) >= 1200 THEN open WHEN low <= floor THEN least(open, floor) WHEN high >= target THEN target WHEN low <= stop THEN least(open, stop) WHEN close < ceiling THEN close WHEN b_idx = last_idx THEN close END AS px FROM (
 SELECT c.*, b.idx AS b_idx, b.ts AS b_ts, b.open, b.high, b.low, b.close, max(b.idx) OVER (PARTITION BY c.ticker, c.entry_idx) AS last_idx FROM (
 SELECT s.ticker, s.ceiling, n.end_idx, n.idx AS entry_idx, n.ts AS entry_ts, n.open AS entry_price, n.open * 1.05 AS target, greatest(n.open * 0.99, s.ceiling * 0.998) AS stop, n.open * 0.95 AS floor
 FROM (SELECT ticker, idx, max(ceiling) AS ceiling FROM eqhsig WHERE signal = 'eqh_breakout' GROUP BY 1, 2) s JOIN be n ON n.ticker = s.ticker AND n.idx = s.idx + 1 WHERE n.open >= 0.1 AND hour(n.ts) * 60 + minute(n.ts) < 1200) c
 JOIN bi b ON b.ticker = c.ticker AND b.idx > c.entry_idx AND b.idx <= c.end_idx)) GROUP BY 1, 2, 3, 4)""", 3))
def q_breakout(spark, sf_dir):
    t = outcomes.breakout_trades(eqh_signals(spark, sf_dir), candles(spark, sf_dir))
    return tidy(t, ["ticker", "entry_ts", "outcome", "exit_ts", "hold_bars"], ["pnl_pct"], 3)
