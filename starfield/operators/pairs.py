"""All pairs of two tables by pairs of groups: a task holds two groups of bounded bytes and returns what it found of them,
never the pairs themselves."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the features that a task holds of one side.
GROUP_BYTES = 1 << 25


def groups_for(spark: SparkSession, n: int, width: int, block: int | None = None) -> int:
    """How many groups ``n`` rows of ``width`` doubles are dealt to: as few as the bytes allow, but enough of them to keep all
    cores busy; or groups of ``block`` rows."""
    if block:
        return max(1, -(-n // block))
    busy = int(np.ceil((4 * spark.sparkContext.defaultParallelism) ** 0.5))
    return max(1, min(max(busy, -(-8 * n * max(width, 1) // GROUP_BYTES)), -(-n // 256)))


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def met(left: DataFrame, right: DataFrame, parts: tuple[int, int], meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``meet`` of each group of ``left`` with each group of ``right``, dealt by the hash of their ids to ``parts``, or by a column
    ``_deal``. The columns of ``left`` begin with q_ there. ``meet`` may get a side that is empty."""
    of = lambda df, n: F.col("_deal") if "_deal" in df.columns else F.pmod(F.xxhash64("id"), F.lit(n).cast("long"))
    own = left.select(*[F.col(c).alias(f"q_{c}") for c in left.columns], of(left, parts[0]).alias("q__a"), _every(parts[1]).alias("q__b"))
    other = right.select("*", of(right, parts[1]).alias("_b"), _every(parts[0]).alias("_a"))
    return own.groupBy("q__a", "q__b").cogroup(other.groupBy("_a", "_b")).applyInArrow(meet, schema)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Squares:
    """Squared distances of rows by products, with the limits of their rounding; differences do not depend on the origin, so
    it is put amid ``y``, where products cancel least."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        middle = y.mean(0)
        self.x, self.y = x - middle, y - middle
        self.s, self.t = (self.x * self.x).sum(1), (self.y * self.y).sum(1)
        self.unit = 8 * (y.shape[1] + 8) * np.finfo(float).eps
        self.most = self.t.max()

    def of(self, part: slice) -> np.ndarray:
        g = self.x[part] @ self.y.T
        g *= -2
        g += self.s[part][:, None]
        g += self.t
        return g

    def slack(self, part: slice) -> np.ndarray:
        """How far a row's values may be off."""
        return self.unit * (self.s[part] + self.most) + 1e-300

    def exact(self, row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of the given pairs without the rounding of products."""
        step = max(1, (1 << 21) // max(1, y.shape[1]))
        return np.concatenate([np.zeros(0), *(np.sqrt(((x[row[i : i + step]] - y[col[i : i + step]]) ** 2).sum(1)) for i in range(0, len(row), step))])
