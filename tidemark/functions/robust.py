"""Numeric kernels for robust outlier detection on ordered readings."""

from __future__ import annotations

import math

import numpy as np

#: Makes a median absolute deviation comparable with a standard deviation for normal data.
MAD_TO_SIGMA = 1.4826


def rolling_median(x: np.ndarray, half: int) -> np.ndarray:
    """Windows of 2*half+1 values around each, as a matrix; the ends repeat the edge value."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, half, mode="edge"), 2 * half + 1)


def _median(x: np.ndarray, half: int) -> np.ndarray:
    return np.partition(rolling_median(x, half), half, axis=1)[:, half]


def hampel_of_changes(x: np.ndarray, half: int, half_scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Deviation of each value from the rolling median of `2*half+1` values, and the rolling median absolute change from value to value of `2*half_scale+1`.

    NaN stays NaN and is passed over, so windows hold values only.
    """
    dev, scale = np.full(len(x), np.nan), np.full(len(x), np.nan)
    known = ~np.isnan(x)
    y = x[known]
    if len(y):
        dev[known] = y - _median(y, half)
        change = np.abs(np.diff(y))
        scale[known] = _median(np.concatenate((change[:1], change)), half_scale) if len(change) else 0.0
    return dev, scale


def comes_back(x: np.ndarray, out: np.ndarray, dev: np.ndarray, level: int, longest: int) -> np.ndarray:
    """Of the values marked in `out`, those in runs of at most `longest` after which the former level is back.

    The level before and after a run is the median of the `level` nearest unmarked values that exist; they may differ by half of
    the deviation. A run at an end of the data is judged by the side that is there.
    """
    res = np.zeros(len(x), bool)
    known = ~np.isnan(x)
    marked = np.flatnonzero(out)
    if not len(marked):
        return res
    good = np.flatnonzero(known & ~out)
    runs = np.split(marked, np.flatnonzero(np.diff(np.searchsorted(good, marked))) + 1)
    for run in runs:
        # `run` holds marked values with no good one between them
        at = np.searchsorted(good, run[0])
        before, after = good[max(0, at - level):at], good[at:at + level]
        if len(run) > longest or not (len(before) or len(after)):
            continue
        gap = abs(np.median(x[after]) - np.median(x[before])) if len(before) and len(after) else 0.0
        if gap <= 0.5 * np.min(np.abs(dev[run])):
            res[run] = True
    return res


def repeat_limit(fresh: float, runs: float, n1: float, n2: float, n3: float, rarest: float = 1e-3, least: int = 5) -> int:
    """Number of repeats from which a run is far longer than normal: the first length of which fewer than `rarest` runs are expected.

    Of `runs` runs of repeats among `fresh` readings that repeat none, a share p**(L-1) has L repeats or more. p, the chance that a run goes on, is read from the runs of
    exactly one, two and three repeats (`n1`, `n2`, `n3`), which stuck stretches aren't among, and is at least the chance that one begins. There is no upper bound.
    """
    begins = runs / fresh if fresh > 0 else 0.0
    goes_on = (n2 + n3 + 0.1) / (n1 + n2 + 2.0)
    p = min(max(begins, goes_on), 1 - 1 / (runs + 2.0))
    return max(least, 1 + math.ceil(math.log(max(runs, 1.0) / rarest) / -math.log(p)))


def long_repeats(rows: np.ndarray, limit: int, head: int = 0, tail: int = 0, linked: bool = False) -> np.ndarray:
    """Rows that repeat the row before in a run of at least `limit` repeats; rows with NaN are passed over.

    `rows` may be a part of a longer series: `head` and `tail` are then the numbers of rows of the whole runs that its first and last full row belong to, and `linked`
    tells that the first one repeats a row before the part.
    """
    res = np.zeros(len(rows), bool)
    full = np.flatnonzero(~np.isnan(rows).any(axis=1))
    if not len(full):
        return res
    new = np.concatenate(([True], (rows[full][1:] != rows[full][:-1]).any(axis=1)))
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    size[-1] = max(size[-1], tail)
    size[0] = max(size[0], head)
    first = new.copy()
    first[0] = not linked
    res[full] = (size[run] - 1 >= limit) & ~first
    return res
