"""Recursive averages as windows over blocks, without a per-ticker loop.

A block of rows maps the state s it starts with to a*s + b.  Inside a block the average is a
decayed running sum; blocks are chained by a decayed sum over the few earlier blocks whose
weight is still above double precision.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = 64


def ema(df: DataFrame, columns: dict[str, tuple[Column, float]], key=("ticker",), order: str = "ts", adjust: bool = False) -> DataFrame:
    """Add {out: average of x with weight alpha}; rows of a key must have distinct order values.

    adjust=False starts at the first value; adjust=True divides by the weights seen so far.
    """
    key = list(key)
    w = Window.partitionBy(*key).orderBy(order)
    df = df.withColumns({f"x:{o}": x for o, (x, _) in columns.items()})
    df = df.withColumn("_i", F.row_number().over(w) - 1)
    df = df.withColumns({"_b": F.floor(F.col("_i") / _BLOCK), "_j": F.col("_i") % _BLOCK})
    inside = Window.partitionBy(*key, "_b").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for o, (_, a) in columns.items():
        x = F.col(f"`x:{o}`")
        part = x if adjust else F.when(F.col("_i") == 0, x).otherwise(x * a)
        grow = F.pow(F.lit(1 - a), -F.col("_j"))
        local[f"l:{o}"] = F.sum(part * grow).over(inside) / grow
    df = df.withColumns(local)
    tails = df.groupBy(*key, "_b").agg(*[F.max_by(F.col(f"`l:{o}`"), "_j").alias(f"t:{o}") for o in columns])
    carry = []
    for o, (_, a) in columns.items():
        decay = (1 - a) ** _BLOCK
        reach = max(1, math.ceil(42 / -math.log(decay)))
        past = F.collect_list(F.col(f"`t:{o}`")).over(Window.partitionBy(*key).orderBy("_b").rowsBetween(-reach, -1))
        carry.append(F.aggregate(past, F.lit(0.0), _chain(decay)).alias(f"c:{o}"))
    df = df.join(tails.select(*key, "_b", *carry), [*key, "_b"])
    out = {}
    for o, (_, a) in columns.items():
        total = F.col(f"`l:{o}`") + F.pow(F.lit(1 - a), F.col("_j") + 1) * F.col(f"`c:{o}`")
        out[o] = total * a / (1 - F.pow(F.lit(1 - a), F.col("_i") + 1)) if adjust else total
    df = df.withColumns(out)
    return df.drop("_i", "_b", "_j", *[f"{p}:{o}" for o in columns for p in ("x", "l", "c")])


def _chain(decay: float):
    return lambda acc, t: acc * decay + t


def span(n: int) -> float:
    return 2 / (n + 1)


def wilder(n: int) -> float:
    return 1 / n
