"""Support and resistance levels per ticker as of its last bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import div, nz, order_window
from ..session import stage

_COLS = ["ticker", "price", "method", "strength", "is_support"]
NEW_YORK = "America/New_York"


def market_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, NEW_YORK))


def _days(bars: DataFrame) -> DataFrame:
    d = bars.groupBy("ticker", market_day(F.col("ts")).alias("day")).agg(
        F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "ts").alias("c")
    )
    return d.withColumn("age", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("day").desc())))


def _rows(df: DataFrame, *specs) -> DataFrame:
    arr = F.array(
        *[
            F.struct(F.round(p, 4).alias("price"), F.lit(m).alias("method"), _num(s).alias("strength"), F.lit(sup).alias("is_support"))
            for p, m, s, sup in specs
        ]
    )
    return df.select("ticker", F.explode(arr).alias("v")).select("ticker", "v.*").where("price > 0")


def _num(s):
    return (s if isinstance(s, Column) else F.lit(float(s))).cast("double")


def pivots(bars: DataFrame) -> DataFrame:
    """Floor pivots of the day before the last one."""
    d = _days(bars).where("age = 2")
    p = (F.col("h") + F.col("l") + F.col("c")) / 3
    rng = F.col("h") - F.col("l")
    return _rows(
        d,
        (p, "pivot_p", 2.0, False),
        (2 * p - F.col("l"), "pivot_r1", 1.5, False),
        (p + rng, "pivot_r2", 1.2, False),
        (2 * p - F.col("h"), "pivot_s1", 1.5, True),
        (p - rng, "pivot_s2", 1.2, True),
    )


def anchors(bars: DataFrame, n: int = 5) -> DataFrame:
    """High and low of the last completed days; the newest is strongest."""
    d = _days(bars).where(F.col("age").between(2, n + 1))
    s = F.lit(n + 2.0) - F.col("age")
    return _rows(d, (F.col("h"), "daily_high", s, False), (F.col("l"), "daily_low", s, True))


def extremes(bars: DataFrame, reach: int = 5, band: float = 0.003) -> DataFrame:
    """Fractal highs and lows chained into clusters by price; strength decays with age."""
    w = order_window("ticker", "ts")
    around = w.rowsBetween(-reach, reach)
    last = Window.partitionBy("ticker")
    b = bars.withColumns(
        {
            "full": F.count("*").over(around) == 2 * reach + 1,
            "top": F.max("high").over(around),
            "low_": F.min("low").over(around),
            "end": F.max("ts").over(last),
        }
    ).where("full")
    age = F.greatest((F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400e6, F.lit(0.5))
    pts = b.select(
        "ticker",
        age.alias("age"),
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("high") == F.col("top"), F.struct(F.col("high").alias("p"), F.lit(False).alias("s"))),
                    F.when(F.col("low") == F.col("low_"), F.struct(F.col("low").alias("p"), F.lit(True).alias("s"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("x"),
    ).select("ticker", "age", "x.p", "x.s")
    pw = Window.partitionBy("ticker", "s").orderBy("p", "age")
    far = nz((F.col("p") - F.lag("p").over(pw) > band * F.lag("p").over(pw)).cast("int"), 1)
    c = pts.withColumn("far", far).withColumn("cluster", F.sum("far").over(pw.rowsBetween(Window.unboundedPreceding, 0)))
    g = c.groupBy("ticker", "s", "cluster").agg(F.round(F.avg("p"), 4).alias("price"), F.round(F.sum(1 / F.col("age")), 4).alias("strength"))
    return g.select("ticker", "price", F.when(F.col("s"), "local_low").otherwise("local_high").alias("method"), "strength", F.col("s").alias("is_support"))


def profile(bars: DataFrame, bins: int = 100, since: Column | None = None) -> DataFrame:
    """Volume per price bin, each bar's volume spread evenly over the bins it spans."""
    b = bars if since is None else bars.where(since)
    edge = b.groupBy("ticker").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    j = b.join(edge, "ticker").where("hi > lo and volume > 0 and high > low").withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    first = F.greatest(F.ceil((F.col("low") - F.col("lo")) / F.col("width")) - 1, F.lit(0))
    last = F.least(F.floor((F.col("high") - F.col("lo")) / F.col("width")), F.lit(bins - 1))
    j = j.withColumns({"b0": first, "b1": F.greatest(first, last)})
    spread = j.select("ticker", "lo", "width", F.explode(F.sequence("b0", "b1")).alias("bin"), (F.col("volume") / (F.col("b1") - F.col("b0") + 1)).alias("v"))
    return spread.groupBy("ticker", "bin").agg(F.sum("v").alias("volume"), F.first(F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("price"))


def value_area(prof: DataFrame, share: float = 0.70) -> DataFrame:
    """POC, VAH and VAL: grow from the busiest bin towards the heavier neighbour until `share` is inside.

    A fold over the bins of one ticker, whose number is the `bins` parameter.
    """
    bin_ = prof.groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.struct("bin", F.round("volume", 9).alias("volume"), "price"))).alias("a"),
        F.sum("volume").alias("total"),
        F.max_by("bin", F.struct(F.round("volume", 9), -F.col("bin"))).alias("poc"),
    )
    vol = lambda k: nz(F.element_at(F.transform(F.filter("a", lambda x: x["bin"] == k), lambda x: x["volume"]), 1), 0.0)
    lo_edge, hi_edge = F.element_at("a", 1)["bin"], F.element_at("a", -1)["bin"]
    zero = F.struct(F.col("poc").alias("lo"), F.col("poc").alias("hi"), vol(F.col("poc")).alias("acc"))

    def grow(acc, _):
        down = F.when(acc["lo"] > lo_edge, vol(acc["lo"] - 1)).otherwise(-1.0)
        up = F.when(acc["hi"] < hi_edge, vol(acc["hi"] + 1)).otherwise(-1.0)
        go = (acc["acc"] < F.col("total") * share) & ((down >= 0) | (up >= 0))
        take_down = go & (down >= up)
        take_up = go & (down < up)
        return F.struct(
            (acc["lo"] - F.when(take_down, 1).otherwise(0)).alias("lo"),
            (acc["hi"] + F.when(take_up, 1).otherwise(0)).alias("hi"),
            (acc["acc"] + F.when(take_down, down).when(take_up, up).otherwise(0.0)).alias("acc"),
        )

    area = bin_.withColumn("area", F.aggregate(F.sequence(F.lit(1), F.size("a")), zero, grow))
    at = lambda k: F.element_at(F.transform(F.filter("a", lambda x: x["bin"] == k), lambda x: x["price"]), 1)
    return area.select("ticker", at(F.col("poc")).alias("poc"), at(F.col("area.hi")).alias("vah"), at(F.col("area.lo")).alias("val"))


def profile_levels(bars: DataFrame, bins: int = 100) -> DataFrame:
    v = value_area(profile(bars, bins))
    return _rows(v, (F.col("poc"), "poc", 3.0, False), (F.col("vah"), "vah", 2.0, False), (F.col("val"), "val", 2.0, True))


def centres(bars: DataFrame, k: int = 6, reach: int = 5, rounds: int = 20) -> DataFrame:
    """Centres of k clusters of each ticker's fractal extremes, all tickers at once.

    Lloyd steps on the distinct prices with their counts, from evenly spread order statistics; on a
    line the nearest centre is told by the midpoints. A step is one join of the prices with their
    ticker's few centres and one aggregation. Tickers with fewer than k extremes have none.
    """
    around = order_window("ticker", "ts").rowsBetween(-reach, reach)
    b = bars.withColumns({"full": F.count("*").over(around) == 2 * reach + 1, "top": F.max("high").over(around), "bot": F.min("low").over(around)}).where("full")
    both = F.array(F.when(F.col("high") == F.col("top"), F.col("high")), F.when(F.col("low") == F.col("bot"), F.col("low")))
    pts = b.select("ticker", F.explode(both).alias("p")).where("p is not null").groupBy("ticker", "p").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("ticker").orderBy("p"))
    pts = stage(pts.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy("ticker"))).where(F.col("total") >= k), "centre_points")
    # the value at a rank: the first price whose running count is over it
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("p")))
    start = [at(F.floor((2 * j + 1) * F.col("total") / (2 * k))).alias(f"c{j}") for j in range(k)]
    middle = (at(F.floor((F.col("total") - 1) / 2)) + at(F.floor(F.col("total") / 2))) / 2
    now = stage(pts.groupBy("ticker").agg(*start, middle.alias("middle")), "centres_0")
    for r in range(1, rounds + 1):
        mids = [(F.col(f"c{j}") + F.col(f"c{j + 1}")) / 2 for j in range(k - 1)]
        own = sum(((F.col("p") > m).cast("int") for m in mids), F.lit(0))
        d = pts.select("ticker", "p", "n").join(now, "ticker").withColumn("own", own)
        mean = lambda j: div(F.sum(F.when(F.col("own") == j, F.col("p") * F.col("n"))), F.sum(F.when(F.col("own") == j, F.col("n"))))
        now = d.groupBy("ticker").agg(*[F.coalesce(mean(j), F.first(f"c{j}")).alias(f"c{j}") for j in range(k)], F.first("middle").alias("middle"))
        if r % 5 == 0:
            now = stage(now, f"centres_{r}")
    c = now.select("ticker", "middle", F.explode(F.array(*[f"c{j}" for j in range(k)])).alias("c"))
    return c.select("ticker", F.round("c", 4).alias("price"), F.lit("kmeans").alias("method"), F.lit(1.5).alias("strength"), (F.col("c") <= F.col("middle")).alias("is_support"))


def merged(bars: DataFrame, prices: DataFrame | None = None, min_strength: float = 0.5, band: float = 0.30, near: float = 0.003) -> DataFrame:
    """All levels: anchors nearby double a level, weak and far ones go, close ones keep the strongest.

    Far is told from prices (ticker, px), by default each ticker's last close.
    """
    anchor = anchors(bars)
    raw = pivots(bars).unionByName(anchor)
    soft = extremes(bars).unionByName(profile_levels(bars))
    marks = anchor.groupBy("ticker").agg(F.collect_set("price").alias("marks"))  # ten prices at most
    boosted = soft.join(marks, "ticker", "left").withColumn(
        "strength", F.col("strength") * F.when(F.exists(nz_array("marks"), lambda a: F.abs(F.col("price") - a) / a <= near), 2.0).otherwise(1.0)
    )
    every = raw.unionByName(boosted.select(*_COLS))
    last = prices if prices is not None else bars.groupBy("ticker").agg(F.max_by("close", "ts").alias("px"))
    ok = every.join(last, "ticker").where((F.col("strength") >= min_strength) & F.col("price").between(F.col("px") * (1 - band), F.col("px") * (1 + band)))
    return dedupe(ok, near)


def nz_array(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<double>"))


def dedupe(levels: DataFrame, near: float = 0.003) -> DataFrame:
    """Walk levels by price; one within `near` of the last kept level replaces it only when stronger.

    Clustered points of one ticker, a few hundred at most, so the walk is an array fold.
    """
    item = F.struct("price", (-F.col("strength")).alias("weak"), "method", "strength", "is_support")
    g = levels.groupBy("ticker").agg(F.array_sort(F.collect_list(item)).alias("a"))
    empty = F.slice(F.col("a"), 1, 0)

    def step(acc, x):
        prev = F.try_element_at(acc, F.lit(-1))
        close = prev.isNotNull() & (F.abs(x["price"] - prev["price"]) / F.coalesce(prev["price"], F.lit(1.0)) < near)
        swap = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(x))
        return F.when(close & (x["strength"] > prev["strength"]), swap).when(close, acc).otherwise(F.concat(acc, F.array(x)))

    out = g.select("ticker", F.explode(F.aggregate("a", empty, step)).alias("v"))
    return out.select("ticker", "v.price", "v.method", "v.strength", "v.is_support")


def nearest(levels: DataFrame, prices: DataFrame) -> DataFrame:
    """Nearest support below and resistance above a price per ticker."""
    j = prices.join(levels, "ticker", "left")
    return j.groupBy("ticker", "px").agg(
        F.max(F.when((F.col("price") < F.col("px")) & F.col("is_support"), F.col("price"))).alias("support"),
        F.min(F.when((F.col("price") > F.col("px")) & ~F.col("is_support"), F.col("price"))).alias("resistance"),
    )


def role_reversal(bars: DataFrame, levels: DataFrame, band: float = 0.003, look: int = 100, need: int = 3) -> DataFrame:
    """Closes above a level, a descent back to it and a last close at it; levels is (ticker, level)."""
    recent = bars.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("ts").desc()))).where(F.col("k") <= look)
    j = recent.join(levels, "ticker").withColumn("up", F.col("close") > F.col("level") * (1 + band))
    g = j.groupBy("ticker", "level").agg(
        F.sum(F.col("up").cast("int")).alias("n_up"),
        F.min(F.when(F.col("up"), F.col("k"))).alias("last_up"),
        F.min_by("close", "k").alias("last"),
    )
    near = F.col("last").between(F.col("level") * (1 - band), F.col("level") * (1 + band) * 1.01)
    return g.select("ticker", "level", (near & (F.col("n_up") >= need) & (nz(F.col("last_up"), 0) > 1)).alias("reversed"))


def rejections(bars: DataFrame, levels: DataFrame, band: float = 0.003, look: int = 60) -> DataFrame:
    """Bars that touched a level and closed above it among the last ones."""
    recent = bars.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("ts").desc()))).where(F.col("k") <= look)
    j = recent.join(levels, "ticker")
    hit = (F.col("low") <= F.col("level") * (1 + band)) & (F.col("close") > F.col("level"))
    return j.groupBy("ticker", "level").agg(F.sum(hit.cast("int")).alias("rejections"))
