"""Score expressions: a JSON spec folded into one Column over feature columns.

Node kinds: feature{name}, constant{value}, binary{op,left,right}, unary{op,child},
conditional{condition,if_true,if_false}.  Undefined values count as 0.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import div, nz
from .rank import pct_rank_bounded

# operator names that are not features (fixed values)
OPERATORS = [
    "add", "sub", "mul", "div", "max", "min", "avg", "neg", "abs", "sign", "sqrt", "square", "inv", "log",
    "sigmoid", "tanh", "rank", "zscore", "and", "or", "not", "if",
]

_BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": div,
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "avg": lambda a, b: (a + b) / 2,
}
_UNARY = {
    "neg": lambda x: -x,
    "abs": F.abs,
    "sign": F.signum,
    "sqrt": lambda x: F.sqrt(F.abs(x)),
    "square": lambda x: x * x,
    "inv": lambda x: div(F.lit(1.0), x),
    "log": lambda x: F.log(F.abs(x) + 1e-10),
    "sigmoid": lambda x: 1 / (1 + F.exp(-F.greatest(F.lit(-10.0), F.least(F.lit(10.0), x)))),
    "tanh": F.tanh,
}


def _clean(x: Column) -> Column:
    return F.when(F.abs(x) == float("inf"), 0.0).otherwise(nz(F.nanvl(x.cast("double"), F.lit(0.0))))


def parse(spec) -> dict:
    return json.loads(spec) if isinstance(spec, str) else spec


def features_of(spec) -> list[str]:
    """Feature names a spec reads, in first-seen order."""
    spec, out = parse(spec), []

    def walk(node):
        if node["type"] == "feature" and node["name"] not in out:
            out.append(node["name"])
        for key in ("left", "right", "child", "condition", "if_true", "if_false"):
            if key in node:
                walk(node[key])

    walk(spec)
    return out


def fold(df: DataFrame, spec, by=("date",)) -> tuple[DataFrame, Column]:
    """(frame, Column) for a spec; cross-section operators materialise their argument first."""
    node = parse(spec)
    kind = node["type"]
    if kind == "feature":
        return df, nz(F.col(node["name"]))
    if kind == "constant":
        return df, F.lit(float(node["value"]))
    if kind == "binary":
        df, a = fold(df, node["left"], by)
        df, b = fold(df, node["right"], by)
        return df, _clean(_BINARY[node["op"]](a, b))
    if kind == "conditional":
        df, c = fold(df, node["condition"], by)
        df, a = fold(df, node["if_true"], by)
        df, b = fold(df, node["if_false"], by)
        return df, F.when(c > 0, a).otherwise(b)
    df, x = fold(df, node["child"], by)
    if node["op"] not in ("rank", "zscore"):
        return df, _clean(_UNARY[node["op"]](x))
    name = f"arg_{len(df.columns)}"
    df = df.withColumn(name, x)
    if node["op"] == "rank":
        out = pct_rank_bounded(name, list(by))
    else:
        w = Window.partitionBy(*by)
        out = div(F.col(name) - F.avg(name).over(w), F.stddev_samp(name).over(w))
    return df.withColumn(f"{name}_x", nz(out)), F.col(f"{name}_x")


def score(df: DataFrame, spec, out: str = "score", by=("date",)) -> DataFrame:
    """Evaluate a spec and scale to 0..1 within each date; 0.5 where all scores agree."""
    df, col = fold(df, spec, by)
    w = Window.partitionBy(*by)
    df = df.withColumn(out, col)
    lo, hi = F.min(out).over(w), F.max(out).over(w)
    return df.withColumn(out, nz(div(F.col(out) - lo, hi - lo), 0.5))


def formula(spec) -> str:
    """Printed form of a spec."""
    n = parse(spec)
    t = n["type"]
    if t == "feature":
        return n["name"]
    if t == "constant":
        return f"{n['value']:.2f}"
    if t == "binary":
        return f"({formula(n['left'])} {n['op']} {formula(n['right'])})"
    if t == "unary":
        return f"{n['op']}({formula(n['child'])})"
    return f"if({formula(n['condition'])} > 0, {formula(n['if_true'])}, {formula(n['if_false'])})"


def tree_size(tree_json: Column) -> Column:
    """Number of nodes of a stored spec."""
    return F.regexp_count(tree_json, F.lit('"type"'))


def tree_depth(tree_json: Column) -> Column:
    """Deepest nesting of a stored spec, a running count over its braces."""
    braces = F.regexp_extract_all(tree_json, F.lit("([{}])"), 1)
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, ch):
        now = acc["now"] + F.when(ch == "{", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(braces, zero, step, lambda a: a["most"])


def features_in_formula(text: Column) -> Column:
    """Feature names in a printed formula, with repeats."""
    words = F.regexp_extract_all(text, F.lit(r"\b([a-zA-Z][a-zA-Z0-9_]*)\b"), 1)
    return F.filter(words, lambda w: ~w.isin(OPERATORS))
