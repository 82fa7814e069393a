"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}
KEPT: set[str] = set()


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under a name, with the SQL text that must agree with it."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def cte(name: str, body: str, kept: bool = False) -> None:
    """A shared sub-select; kept: computed once a statement, however often it is mentioned."""
    CTES[name] = body
    if kept:
        KEPT.add(name)


def with_ctes(body: str) -> str:
    """Prefix the shared sub-selects a statement mentions, dependencies first."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        words = set(re.findall(r"\w+", text))
        for name in CTES:
            if name in words and name not in seen:
                seen.add(name)
                visit(CTES[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in KEPT else ''}({CTES[n]})" for n in needed)
    return f"WITH RECURSIVE {head}\n{body}"


def rounded(keys: str, values, body: str, digits: int = 6) -> str:
    """Outer select that rounds like mdq.functions.core.tidy."""
    names = values.split() if isinstance(values, str) else list(values)
    nudge = repr(0.37 * 10 ** -(digits + 3))
    cols = ", ".join(f"round(CAST({v} AS DOUBLE) + CAST({nudge} AS DOUBLE), {digits}) + 0.0 AS {v}" for v in names)
    keys = ", ".join(keys.split())
    head = f"{keys}, {cols}" if keys else cols
    return f"SELECT {head} FROM ({body})"


# ---- shared inputs, the SQL twins of mdq.sources.adapters ----------------------------

_OHLC = """SELECT ticker, date, open, round(greatest(open, close) * (1 + wick / 10) + 1.3e-8, 4) AS high,
 round(least(open, close) * (1 - wick / 10) + 1.3e-8, 4) AS low, close, volume FROM (
 SELECT *, round(pc * exp(gi / 2e6), 4) AS open FROM (
 SELECT *, round(100.0 * exp(cum / 1e6), 4) AS close, round(100.0 * exp((cum - gi) / 1e6), 4) AS pc FROM (
 SELECT *, CAST(sum(gi) OVER (PARTITION BY ticker ORDER BY date) AS BIGINT) AS cum FROM ({src}))))"""

cte(
    "daily",
    _OHLC.format(
        src="""SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date,
 CAST((sum(CAST(round(l_discount * 100) AS BIGINT)) * 10000) // count(*) - 50000 AS BIGINT) AS gi,
 sum(l_quantity) AS volume, max(l_tax) AS wick FROM lineitem GROUP BY 1, 2"""
    ),
)
cte(
    "panel",
    _OHLC.format(
        src="""SELECT n_name AS ticker, CAST(l_shipdate AS DATE) AS date,
 CAST((sum(CAST(round(l_discount * 100) AS BIGINT)) * 10000) // count(*) - 50000 AS BIGINT) AS gi,
 sum(l_quantity) AS volume, max(l_tax) AS wick FROM lineitem
 JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2"""
    ),
)
cte(
    "bars",
    """SELECT ticker, ts, open, round(greatest(open, close) * (1 + span / 2e6) + 1.3e-8, 4) AS high,
 round(least(open, close) * (1 - span / 4e6) + 1.3e-8, 4) AS low, close, CAST(cents // 100 + n AS DOUBLE) AS volume FROM (
 SELECT *, round(pc * exp(floor((first_c - 5000) / 10) / 1e6), 4) AS open FROM (
 SELECT *, round(20.0 * exp(cum / 1e6), 4) AS close, round(20.0 * exp((cum - gi) / 1e6), 4) AS pc FROM (
 SELECT *, CAST(sum(gi) OVER (PARTITION BY ticker ORDER BY ts) AS BIGINT) AS cum FROM (
 SELECT *, CAST((cents // n - 5000) * 2 AS BIGINT) AS gi FROM (
 SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, CAST(sum(c) AS BIGINT) AS cents, count(*) AS n,
  arg_min(c, event_id) AS first_c, max(c) - min(c) AS span
 FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY 1, 2)))))""",
)
