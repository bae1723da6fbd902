"""Expressions over array columns, distances by name, SQL expression or function, and hashes that any engine can
recompute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("euclidean", "sqeuclidean", "inner_product", "cosine", "manhattan")
EPSILON = 1e-8


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def squared(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def metric_name(metric) -> str | None:
    """The built-in metric meant, or None for an expression or function. No metric means Euclidean."""
    if metric is None:
        return "euclidean"
    if isinstance(metric, str):
        name = metric.strip().lower()
        name = {"l2": "euclidean", "": "euclidean", "l1": "manhattan"}.get(name, name)
        return name if name in NAMES else None
    if callable(metric):
        return None
    raise ValueError(f"metric must be a name, a SQL expression over x and y, or a function of two columns, not {type(metric).__name__}")


def distance(metric: str | Callable[[Column, Column], Column] | None, x: str = "x", y: str = "y") -> Column:
    """The distance of array columns ``x`` and ``y``. An expression names its operands x and y."""
    name, a, b = metric_name(metric), F.col(x), F.col(y)
    if name == "euclidean":
        return F.sqrt(squared(a, b))
    if name == "sqeuclidean":
        return squared(a, b)
    if name == "inner_product":
        return -dot(a, b)
    if name == "manhattan":
        return total(F.zip_with(a, b, lambda u, v: F.abs(u - v)))
    if name == "cosine":
        return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + EPSILON)
    return F.expr(metric).cast("double") if isinstance(metric, str) else metric(a, b)


def metric_meant(points: DataFrame, metric: str | Callable[[Column, Column], Column] | None) -> str | None:
    """As ``metric_name``, but also of an expression or function that Spark finds to mean the same as a built-in metric."""
    if name := metric_name(metric):
        return name
    two = points.select(F.col("features").alias("x"), F.col("features").alias("y"))
    meant = two.select(distance(metric).alias("d"))
    # Expressions are cast to double, functions are not.
    forms = lambda name: (distance(name), distance(name).cast("double"))
    return next((name for name in NAMES if any(meant.sameSemantics(two.select(form.alias("d"))) for form in forms(name))), None)


def keyed_hash(*parts: Column | int | str) -> Column:
    """48 bits of md5 over the parts: the same in Spark, DuckDB or any other engine, whatever the partitions."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) from ``keyed_hash``."""
    return keyed_hash(*parts) / F.lit(float(16**12))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def key_name(x: Column) -> Column:
    """A name as a key: lower case, all else an underscore."""
    return F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9_]+", "_")
