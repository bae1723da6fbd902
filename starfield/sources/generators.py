"""Synthetic point clouds. Every number follows from the row's id, the seed and a slot, so a cloud is the same in any
number of partitions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAU = 2 * math.pi


def _u(seed: int, slot: int | Column) -> Column:
    """Uniform in (0, 1)."""
    slot = slot if isinstance(slot, Column) else F.lit(slot)
    return (F.pmod(F.xxhash64("id", F.lit(seed), slot), F.lit(1 << 53)) + 0.5) / F.lit(float(1 << 53))


def _n(seed: int, slot: int | Column) -> Column:
    """Standard normal."""
    slot = slot if isinstance(slot, Column) else F.lit(slot)
    return F.sqrt(-2 * F.log(_u(seed, slot * 2 + 1000))) * F.cos(TAU * _u(seed, slot * 2 + 1001))


def _normals(seed: int, d: int, first: int = 0) -> Column:
    return F.transform(F.sequence(F.lit(first), F.lit(first + d - 1)), lambda k: _n(seed, k))


def _unit(x: Column) -> Column:
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(x, lambda v: v / norm)


def _points(spark: SparkSession, n: int, features: list[Column] | Column, label: Column | None = None) -> DataFrame:
    array = features if isinstance(features, Column) else F.array(*[f.cast("double") for f in features])
    return spark.range(n).select("id", array.alias("features"), (F.lit(0) if label is None else label).cast("int").alias("label"))


def disk_uniform(spark, n=1000, d=10, seed=42):
    """Directions of a sphere with radius sqrt(u)."""
    return _points(spark, n, F.transform(_unit(_normals(seed, d)), lambda v: v * F.sqrt(_u(seed, 999_999))))


def sphere_uniform(spark, n=1000, d=10, seed=42):
    return _points(spark, n, _unit(_normals(seed, d)))


def ellipsoid_uniform(spark, n=1000, d=10, seed=42, axes: list[float] | None = None):
    """A sphere stretched along the axes (1 .. d unless given)."""
    axes = [float(a) for a in axes or range(1, d + 1)]
    return _points(spark, n, F.zip_with(_unit(_normals(seed, len(axes))), F.array(*map(F.lit, axes)), lambda v, a: v * a))


def gaussian(spark, n=1000, d=10, seed=42):
    return _points(spark, n, _normals(seed, d))


def blobs(spark, n=1000, d=2, centers=3, seed=42, std=1.0, box=10.0):
    """Gaussian balls around random centres; label: the ball."""
    c = np.random.default_rng(seed).uniform(-box, box, (centers, d))
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in c])
    label = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(7)), F.lit(centers)).cast("int")
    return _points(spark, n, F.zip_with(table[label], _normals(seed, d), lambda m, z: m + std * z), label)


def circle(spark, n=1000, seed=42, noise=0.0):
    t = TAU * _u(seed, 0)
    return _points(spark, n, [F.cos(t) + noise * _n(seed, 1), F.sin(t) + noise * _n(seed, 2)])


def circles(spark, n=1000, seed=42, noise=0.0, factor=0.5):
    label = F.pmod("id", F.lit(2))
    t, r = TAU * _u(seed, 0), F.when(label == 1, F.lit(factor)).otherwise(F.lit(1.0))
    return _points(spark, n, [r * F.cos(t) + noise * _n(seed, 1), r * F.sin(t) + noise * _n(seed, 2)], label)


def moons(spark, n=1000, seed=42, noise=0.0):
    label = F.pmod("id", F.lit(2))
    t = math.pi * _u(seed, 0)
    return _points(spark, n, [F.when(label == 1, 1 - F.cos(t)).otherwise(F.cos(t)) + noise * _n(seed, 1), F.when(label == 1, 0.5 - F.sin(t)).otherwise(F.sin(t)) + noise * _n(seed, 2)], label)


def swiss_roll(spark, n=1000, seed=42, noise=0.0):
    t = 1.5 * math.pi * (1 + 2 * _u(seed, 0))
    return _points(spark, n, [t * F.cos(t) + noise * _n(seed, 1), 21 * _u(seed, 3) + noise * _n(seed, 2), t * F.sin(t) + noise * _n(seed, 4)], F.floor(t))


def s_curve(spark, n=1000, seed=42, noise=0.0):
    t = 3 * math.pi * (_u(seed, 0) - 0.5)
    return _points(spark, n, [F.sin(t) + noise * _n(seed, 1), 2 * _u(seed, 3) + noise * _n(seed, 2), F.signum(t) * (F.cos(t) - 1) + noise * _n(seed, 4)])


def flat_torus(spark, n=1000, seed=42):
    a, b = TAU * _u(seed, 0), TAU * _u(seed, 1)
    return _points(spark, n, [F.cos(a), F.sin(a), F.cos(b), F.sin(b)])


def triple_circle(spark, n=1000, seed=42):
    t = [TAU * _u(seed, k) for k in range(3)]
    return _points(spark, n, [f(x) for x in t for f in (F.cos, F.sin)])


def torus(spark, n=1000, seed=42, noise=0.0, big=2.0, small=0.7):
    a, b = TAU * _u(seed, 0), TAU * _u(seed, 1)
    r = big + small * F.cos(b)
    return _points(spark, n, [r * F.cos(a) + noise * _n(seed, 2), r * F.sin(a) + noise * _n(seed, 3), small * F.sin(b) + noise * _n(seed, 4)])


def sphere(spark, n=1000, seed=42, noise=0.0):
    return _points(spark, n, F.zip_with(_unit(_normals(seed, 3)), _normals(seed, 3, 10), lambda v, z: v + noise * z))


def linked_rings(spark, n=1000, seed=42, noise=0.0):
    label, t = F.pmod("id", F.lit(2)), TAU * _u(seed, 0)
    second = label == 1
    xyz = [F.when(second, 1 + F.cos(t)).otherwise(F.cos(t)), F.when(second, F.lit(0.0)).otherwise(F.sin(t)), F.when(second, F.sin(t)).otherwise(F.lit(0.0))]
    return _points(spark, n, [x + noise * _n(seed, 1 + k) for k, x in enumerate(xyz)], label)


def figure_8(spark, n=1000, seed=42, noise=0.0):
    t = TAU * _u(seed, 0)
    return _points(spark, n, [F.sin(t) + noise * _n(seed, 1), F.sin(t) * F.cos(t) + noise * _n(seed, 2)])


def _glow(x: Column, y: Column, r: Column, side: int) -> Callable[[Column], Column]:
    return lambda k: F.exp(-((F.pmod(k, F.lit(side)) - x) ** 2 + (F.floor(k / side) - y) ** 2) / (2 * r * r))


def ball_flight(spark, n=500, seed=42, side=12, radius: tuple[float, float] = (1.5, 1.5), balls: int = 1):
    """Frames of ``side`` squared pixels of balls on an arc; with two radii the size varies too."""
    cells = F.sequence(F.lit(0), F.lit(side * side - 1))
    images = None
    for b in range(balls):
        t, r = _u(seed, 3 * b), radius[0] + (radius[1] - radius[0]) * _u(seed, 3 * b + 1)
        x, y = 1 + t * (side - 3), 1 + 4 * t * (1 - t) * (side - 3)
        image = F.transform(cells, _glow(x, y, r, side))
        images = image if images is None else F.zip_with(images, image, lambda p, q: p + q)
    return _points(spark, n, images)


def two_balls(spark, n=500, seed=42, side=12):
    return ball_flight(spark, n, seed, side, balls=2)


def lifted(points: DataFrame, dimensions: int, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """Turned into ``dimensions`` by orthonormal columns, with Gaussian noise."""
    d = len(points.first()["features"])
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, d)))[0]
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in q])
    turned = F.transform(rows, lambda r, k: F.aggregate(F.zip_with(r, "features", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + noise * _n(seed, k + 5000))
    return points.withColumn("features", turned)


GENERATORS: dict[str, Callable] = {f.__name__: f for f in (disk_uniform, sphere_uniform, ellipsoid_uniform, gaussian, blobs, circle, circles, moons, swiss_roll, s_curve, flat_torus, triple_circle, torus, sphere, linked_rings, figure_8, ball_flight, two_balls)}


def generate(spark: SparkSession, name: str, **options) -> DataFrame:
    """By name; ``make_`` before it is accepted, and any unambiguous end of it."""
    key = re.sub(r"[^a-z0-9_]+", "_", name.strip().lower()).removeprefix("make_")
    found = [key] if key in GENERATORS else [g for g in GENERATORS if g.endswith(key)]
    if len(found) != 1:
        raise ValueError(f"{name!r} is " + (f"ambiguous: {found}" if found else f"none of {sorted(GENERATORS)}"))
    return GENERATORS[found[0]](spark, **options)


def catalogue(spark: SparkSession) -> DataFrame:
    """scheme, name, about."""
    rows = [("generate", n, (f.__doc__ or "").strip().split("\n")[0]) for n, f in sorted(GENERATORS.items())]
    return spark.createDataFrame(rows, "scheme string, name string, about string")
