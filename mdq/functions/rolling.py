"""Statistics of the last n rows that no running sum gives: whole blocks of windows at a time.

Spark's sliding frames evaluate an aggregate or a fold anew over all n rows of every row, by an
interpreted expression. Here the windows are views of one array.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rows whose windows are held at once
_ROWS = 2048


def _ratios(w: np.ndarray) -> np.ndarray:
    """Values against their running peak, which restarts in every window."""
    return w / np.fmax(np.fmax.accumulate(w, axis=1), 1e-300)


def _parts(w: np.ndarray) -> tuple[np.ndarray, ...]:
    """(known values, their mean, deviations from it, the mean place, the deviations of places); missing values deviate by 0, equal values exactly by 0."""
    places = np.arange(w.shape[1], dtype=float)
    known = ~np.isnan(w)
    if known.all():
        y = w - w[:, :1]
        mean = y.mean(axis=1)
        return np.float64(w.shape[1]), w[:, 0] + mean, y - mean[:, None], places.mean(), places - places.mean()
    low, n = np.fmin.reduce(w, axis=1), known.sum(axis=1).astype(float)
    y = w - low[:, None]
    mean, at = np.nansum(y, axis=1) / n, (known * places).sum(axis=1) / n
    return n, low + mean, np.where(known, y - mean[:, None], 0.0), at, np.where(known, places - at[:, None], 0.0)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b if b.ndim == 1 else np.einsum("ij,ij->i", a, b)


def _line(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, mean, dy, at, dx = _parts(w)
    sxx = (dx * dx).sum(axis=-1)
    slope = np.where(sxx > 0, _product(dy, dx) / sxx, np.nan)
    return slope, mean + slope * (w.shape[1] - 1 - at)


def _score(w: np.ndarray) -> np.ndarray:
    """Distance of the last value from the mean in standard deviations; none where all are equal."""
    n, _, dy, _, _ = _parts(w)
    sd = np.sqrt(_product(dy, dy) / (n - 1))
    return np.where(sd > 0, dy[:, -1] / sd, np.nan)


def _r2(w: np.ndarray) -> np.ndarray:
    """Squared correlation with the row number, whose variance counts every row of the window."""
    n, _, dy, _, dx = _parts(w)
    p, syy = w.shape[1], _product(dy, dy)
    return np.where(syy > 0, (_product(dy, dx) / (n - 1)) ** 2 / (syy / (n - 1) * (p * (p + 1) / 12)), np.nan)


#: name -> function of (rows, n) windows, missing values NaN, to one value a row
KINDS = {
    "near": lambda w: (_ratios(w) - 1 > -0.05).sum(axis=1).astype(float),
    "square": lambda w: np.nansum((_ratios(w) - 1) ** 2, axis=1),
    "age": lambda w: np.where(np.isnan(w), -np.inf, w)[:, ::-1].argmax(axis=1).astype(float),
    "mean": lambda w: _parts(w)[1],
    "score": _score,
    # of n known values, else none
    "full_mean": lambda w: w[:, 0] + (w - w[:, :1]).mean(axis=1),
    "full_max": lambda w: w.max(axis=1),
    "full_min": lambda w: w.min(axis=1),
    "full_sd": lambda w: (w - w[:, :1]).std(axis=1, ddof=1),
    "slope": lambda w: _line(w)[0],
    "fit": lambda w: _line(w)[1],
    "r2": _r2,
}


def windows(x: np.ndarray, n: int, kind: str) -> np.ndarray:
    """KINDS[kind] of the n values up to and with each one; the first n - 1 have none (NaN)."""
    if len(x) < n:
        return np.full(len(x), np.nan)
    views = np.lib.stride_tricks.sliding_window_view(x, n)
    with np.errstate(all="ignore"):
        return np.concatenate([np.full(n - 1, np.nan), *[KINDS[kind](views[at : at + _ROWS]) for at in range(0, len(views), _ROWS)]])


def with_windows(df: DataFrame, out: dict[str, tuple[str, int, str]], key: str = "ticker", at: str = "date", row: str = "rn", more: tuple[Callable, tuple[str, ...], int, tuple[str, ...]] | None = None) -> DataFrame:
    """df plus its row number in the key's order of `at`, and {name: (kind, n, column)} of the last n values, null in the first n - 1 rows.

    Rows are dealt by key and sorted; a task takes them batch by batch and carries over the last few.
    Windows that reach back into another key are those of the first n - 1 rows. A column may also be
    an earlier name of out. `more` adds columns from several at once: a function of ({column: the last
    n - 1 values before and those of a batch}, row numbers), the columns it reads, n, and its names.
    """
    extra, reads, reach, names = more or (None, (), 1, ())
    d = df.repartition(key).withColumn(row, F.row_number().over(Window.partitionBy(key).orderBy(at))).sortWithinPartitions(key, row)
    schema = T.StructType([*d.schema.fields, *[T.StructField(name, T.DoubleType()) for name in (*out, *names)]])
    most = max([reach, *[n for _, n, _ in out.values()]])
    place = {c: d.columns.index(c) for c in (row, *reads, *(c for _, _, c in out.values())) if c not in out}

    def run(batches):
        tails: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(place[row]).to_numpy()
            whole = {c: np.concatenate([tails.get(c, np.zeros(0)), batch.column(place[c]).cast(pa.float64()).to_numpy(zero_copy_only=False)]) for c in place}
            found = []
            for name, (kind, n, c) in out.items():
                x = windows(whole[c], n, kind)[len(whole[c]) - len(number) :]
                found.append(np.where(number < n, np.nan, x))
                whole[name] = np.concatenate([tails.get(name, np.zeros(0)), found[-1]])
            if extra:
                found += extra({c: whole[c] for c in reads}, number)
            tails = {c: x[max(0, len(x) - most + 1) :] for c, x in whole.items()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, from_pandas=True) for x in found]], names=schema.names)

    return d.mapInArrow(run, schema)
