"""Jaro similarity as an Arrow-batched column function.

Spark has no built-in for it. The UDF scores whole batches of pairs at once with numpy:
texts become rows of code points, and one step handles one character position of every
pair of the batch.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Cells (pairs × characters) worked on at once; bounds the memory of a task.
_CELLS = 1 << 18


def _code_points(texts: list[str], width: int) -> np.ndarray:
    return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)


def _matched_first(grid: np.ndarray, matched: np.ndarray, width: int) -> np.ndarray:
    order = np.argsort(~matched, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(grid, order, axis=1)


def _score(left: list[str], right: list[str], la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    wa, wb = int(la.max()), int(lb.max())
    a, b = _code_points(left, wa), _code_points(right, wb)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    free_b = np.arange(wb)[None, :] < lb[:, None]
    hit_a = np.zeros(a.shape, dtype=bool)
    hit_b = np.zeros(b.shape, dtype=bool)
    place = np.arange(wb)
    widest = int(reach.max())
    for i in range(wa):
        lo, hi = max(i - widest, 0), min(i + widest + 1, wb)
        if lo >= hi:
            break
        options = (b[:, lo:hi] == a[:, i, None]) & free_b[:, lo:hi]
        options &= np.abs(place[lo:hi] - i)[None, :] <= reach[:, None]
        options &= (i < la)[:, None]
        first = options.argmax(axis=1)
        rows = np.nonzero(options[np.arange(len(first)), first])[0]
        cols = first[rows] + lo
        hit_a[rows, i] = True
        hit_b[rows, cols] = True
        free_b[rows, cols] = False
    m = hit_a.sum(axis=1)
    width = min(wa, wb)
    out_of_order = _matched_first(a, hit_a, width) != _matched_first(b, hit_b, width)
    out_of_order &= np.arange(width)[None, :] < m[:, None]
    swaps = out_of_order.sum(axis=1) // 2
    safe = np.maximum(m, 1)
    score = (m / la + m / lb + (m - swaps) / safe) / 3.0
    return np.where(m > 0, score, 0.0)


def jaro_scores(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Jaro similarity of each pair; NaN where either text is missing."""
    scores = np.full(len(left), np.nan)
    a, b = left.to_numpy(dtype=object), right.to_numpy(dtype=object)
    present = np.nonzero((left.notna() & right.notna()).to_numpy())[0]
    if not len(present):
        return scores
    la = np.fromiter((len(a[i]) for i in present), dtype=np.int64, count=len(present))
    lb = np.fromiter((len(b[i]) for i in present), dtype=np.int64, count=len(present))
    scores[present] = np.where((la == 0) & (lb == 0), 1.0, 0.0)

    # Pairs of like length go together, so that little padding is scored.
    todo = np.nonzero((la > 0) & (lb > 0))[0]
    todo = todo[np.argsort(np.maximum(la, lb)[todo], kind="stable")]
    start = 0
    while start < len(todo):
        longest = np.maximum(la, lb)[todo[start:]]
        fits = longest * np.arange(1, len(longest) + 1) <= _CELLS
        stop = start + max(int(fits.sum()), 1)
        chunk = todo[start:stop]
        where = present[chunk]
        scores[where] = _score([a[i] for i in where], [b[i] for i in where], la[chunk], lb[chunk])
        start = stop
    return scores


@F.pandas_udf(DoubleType())
def _jaro_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(jaro_scores(left, right))


def jaro_where(condition: Column, a: Column, b: Column) -> Column:
    """Jaro similarity in [0, 1] where the condition holds, else null.

    The UDF sees nulls for the other rows, so they cost next to nothing in Python.
    """
    return _jaro_udf(F.when(condition, a), F.when(condition, b))


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity: 1 for equal texts, 0 if just one is empty, null if one is null."""
    return F.when(a == b, F.lit(1.0)).otherwise(jaro_where(a != b, a, b))


# Send the code of this module along with the UDF: executors then need numpy and pandas,
# but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
