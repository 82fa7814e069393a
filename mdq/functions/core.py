"""Small Column helpers: ANSI-safe arithmetic, row windows, output rounding."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252
ROOT_YEAR = YEAR ** 0.5


def div(a, b) -> Column:
    """a / b, null when b is zero or null (ANSI division raises)."""
    return F.try_divide(_c(a), _c(b))


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def nz(x: Column, default=0.0) -> Column:
    return F.coalesce(x, F.lit(float(default)))


def order_window(key="ticker", order="date"):
    return Window.partitionBy(*_names(key)).orderBy(*_names(order))


def last_n(n: int, key="ticker", order="date"):
    """The n rows ending at the current one."""
    return order_window(key, order).rowsBetween(-(n - 1), 0)


def prior_n(n: int, key="ticker", order="date"):
    """The n rows before the current one."""
    return order_window(key, order).rowsBetween(-n, -1)


def so_far(key="ticker", order="date"):
    return order_window(key, order).rowsBetween(Window.unboundedPreceding, 0)


def _names(x) -> list:
    return [x] if isinstance(x, (str, Column)) else list(x)


def settle(x: Column, digits: int = 6) -> Column:
    """Round a double for output.

    Sums of doubles depend on order, so results are rounded; a nudge far below the last
    digit keeps exact decimal ties from falling either way, and + 0.0 drops negative zero.
    """
    return F.round(x.cast("double") + F.lit(0.37 * 10 ** -(digits + 3)), digits) + F.lit(0.0)


def tidy(df: DataFrame, keys: Iterable[str], values: Iterable[str], digits: int = 6) -> DataFrame:
    """Select keys and settled doubles."""
    return df.select(*keys, *[settle(F.col(v), digits).alias(v) for v in values])


def safe_corr(cov: Column, va: Column, vb: Column) -> Column:
    """Correlation from its parts; null instead of an error for a constant side."""
    return div(cov, F.sqrt(va) * F.sqrt(vb))


def first_true(*pairs, otherwise=None) -> Column:
    """Ordered rule table: the value of the first condition that holds."""
    (cond, val), *rest = pairs
    out = F.when(cond, val)
    for cond, val in rest:
        out = out.when(cond, val)
    return out.otherwise(otherwise)
