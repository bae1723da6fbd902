"""Time warping of pairs against the plain table of all cells."""

import numpy as np

from starfield.operators import topology, warping


def test_exact_and_wide_bands_equal_all_cells():
    rng = np.random.default_rng(3)
    for n, m, d in ((1, 1, 1), (1, 9, 1), (13, 5, 2), (40, 37, 1), (33, 64, 3)):
        a, b = rng.normal(size=(n, d)), rng.normal(size=(m, d))
        want = topology.dtw(a, b)
        assert np.isclose(warping.warp(a, b), want) and np.isclose(warping.warp(a, b, 64), want)
        assert np.isclose(warping.warp(a, b, p=1), topology.dtw(a, b, 1))
    assert warping.warp([], [1.0]) is None and warping.warp([1, 2, 3], [1, 2, 2, 3]) == 0


def test_band_is_near_and_never_below():
    rng = np.random.default_rng(4)
    for _ in range(12):
        a = np.cumsum(rng.normal(size=rng.integers(60, 200)))
        b = np.interp(np.linspace(0, len(a) - 1, 150) ** 1.02 % len(a), range(len(a)), a) + rng.normal(size=150) * 0.1
        exact, banded = warping.warp(a, b), warping.warp(a, b, 5)
        assert exact - 1e-9 <= banded <= 1.25 * exact
        assert warping.warp(a, b, 200) <= banded + 1e-9


def test_pairs(spark):
    ticks = spark.createDataFrame([("x", 2, 2.0, 0), ("x", 1, 1.0, 0), ("y", 1, 1.0, 0), ("y", 2, 4.0, 0), ("y", None, 9.0, 0), (None, 1, 1.0, 0)], "k string, t int, v double, key int")
    made = warping.series(ticks, "k", "t", "v")
    assert {r.key: r["values"] for r in made.collect()} == {"x": [1, 2], "y": [1, 4]}
    pairs = spark.createDataFrame([("x", "y"), ("x", "y"), ("x", "z"), (None, "x"), ("y", "y")], "left string, right string")
    got = sorted(map(tuple, warping.warped(made, pairs).collect()), key=repr)
    assert got == sorted([("x", "y", 2.0), ("x", "y", 2.0), ("x", "z", None), (None, "x", None), ("y", "y", 0.0)], key=repr)
    assert warping.warped(made, pairs.limit(0)).collect() == []
    points = spark.createDataFrame([(1, [[0.0, 0.0], [3.0, 4.0]]), (2, [[0.0, 0.0]]), (3, [])], "key long, values array<array<double>>")
    assert sorted(map(tuple, warping.warped(points, spark.createDataFrame([(1, 2), (1, 3)], "left long, right long")).collect())) == [(1, 2, 5.0), (1, 3, None)]
