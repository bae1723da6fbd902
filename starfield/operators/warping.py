"""Time warping of many pairs of series, exact or within a band that is refined from coarser levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def series(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key and values, a key's values in the order of ``order`` (equal ones by value). Rows without key, order or value
    are left out. A series is one row."""
    kept = df.select(F.col(key).alias("key"), F.col(order).alias("_o"), F.col(value).alias("_v")).dropna()
    return kept.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"]).alias("values"))


def _halved(a: np.ndarray) -> np.ndarray:
    """Means of neighbours; the last of an odd number stays."""
    even = len(a) // 2 * 2
    return np.concatenate(((a[0:even:2] + a[1:even:2]) / 2, a[even:]))


def _within(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, p: float, path: bool) -> tuple[float, list]:
    """Cheapest way through rows whose columns are low .. high, and that way from its end to its begin if asked for."""
    rows, before, start = [], None, 0
    for i in range(len(a)):
        lo, hi = int(low[i]), int(high[i]) + 1
        cost = (np.abs(a[i] - b[lo:hi]) ** p).sum(1) ** (1 / p)
        enter = np.full(hi - lo, np.inf)
        if before is None:
            enter[0] = 0.0
        else:
            for shift in (0, 1):  # from the same column, and from the one before it
                first, last = max(lo, start + shift), min(hi, start + shift + len(before))
                if first < last:
                    part = slice(first - lo, last - lo)
                    enter[part] = np.minimum(enter[part], before[first - start - shift : last - start - shift])
        total = np.cumsum(cost)
        # A row's own steps: the least entry so far, with the costs since then.
        before, start = total + np.minimum.accumulate(enter - (total - cost)), lo
        rows.append((lo, before))
    way = []
    if path:
        at = lambda i, j: rows[i][1][j - rows[i][0]] if i >= 0 and 0 <= j - rows[i][0] < len(rows[i][1]) else np.inf
        i, j = len(a) - 1, len(b) - 1
        while True:
            way.append((i, j))
            if i == j == 0:
                break
            i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda c: at(*c))
    return float(rows[-1][1][-1]), way


def warp(a, b, radius: int | None = None, p: float = 2) -> float | None:
    """Distance of two series of numbers or points; None if one is empty. Without ``radius`` exact; with it, the way is sought
    within ``radius`` cells around the best way of the halved series, and so on down. Never less than the exact one."""
    if not len(a) or not len(b):
        return None
    a, b = (np.asarray([np.atleast_1d(x) for x in s], float).reshape(len(s), -1) for s in (a, b))
    levels = [(a, b)]
    while radius is not None and min(map(len, levels[-1])) > radius + 2:
        levels.append(tuple(map(_halved, levels[-1])))
    low, high = np.zeros(len(levels[-1][0]), int), np.full(len(levels[-1][0]), len(levels[-1][1]) - 1)
    for depth in range(len(levels) - 1, -1, -1):
        x, y = levels[depth]
        total, way = _within(x, y, low, high, p, depth > 0)
        if not depth:
            return total
        n, m = map(len, levels[depth - 1])
        least, most = np.full(len(x), len(y)), np.full(len(x), -1)
        at = np.array(way)
        np.minimum.at(least, at[:, 0], at[:, 1])
        np.maximum.at(most, at[:, 0], at[:, 1])
        row = np.arange(n) // 2
        low = np.clip(2 * (least[np.maximum(row - radius, 0)] - radius), 0, m - 1)
        high = np.clip(2 * (most[np.minimum(row + radius, len(x) - 1)] + radius) + 1, 0, m - 1)


def warped(all_series: DataFrame, pairs: DataFrame, radius: int | None = 5, p: float = 2) -> DataFrame:
    """left, right, distance of each pair (left, right) of keys of ``all_series`` (key, values: numbers, or points as
    arrays). Null where a key is null or has no series, or a series is empty or null. Repeated pairs give repeated rows.

    A pair carries both series to its task: memory is that of a few pairs, time of a pair its lengths' product, or with a
    radius their sum. A key in many pairs is split by Spark's handling of skewed joins, which repeats its one row.
    """
    side = lambda name, values: all_series.select(F.col("key").alias(name), F.col("values").alias(values))
    both = pairs.select("left", "right").join(side("left", "_a"), "left", "left").join(side("right", "_b"), "right", "left")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [None if a is None or b is None else warp(a, b, radius, p) for a, b in zip(frame["_a"], frame["_b"], strict=True)]
            yield frame[["left", "right"]].assign(distance=pd.Series(found, dtype=float, index=frame.index).astype(object).where(lambda x: x.notna(), None))

    return both.mapInPandas(run, f"left {kinds['left']}, right {kinds['right']}, distance double")
