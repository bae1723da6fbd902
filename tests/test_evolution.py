"""Search by evolution on goals whose front is known, and over layouts."""

import numpy as np
import pytest

from starfield.operators import evolution, intrinsic
from starfield.sources import generators


def test_fronts_and_crowding():
    goals = np.array([[1, 4], [2, 2], [4, 1], [3, 3], [2, 2], [5, 5]], float)
    assert evolution.fronts(goals).tolist() == [0, 0, 0, 1, 0, 2]
    free = evolution.crowding(np.array([[0, 4], [1, 2], [4, 0]], float))
    assert np.isinf(free[[0, 2]]).all() and free[1] == 2


def test_known_front(spark):
    """Squares of the distances to (0, 0) and (2, 0): the front is x between 0 and 2, y = 0. Found goals are at most 0.1 (2.5 %
    of their range) from it, nine of ten at most 0.05, and any of its places is within 0.35 of a found one."""
    judge = lambda s: (s["x"] ** 2 + s["y"] ** 2, (s["x"] - 2) ** 2 + s["y"] ** 2)
    run = lambda seed, abreast: evolution.evolved(judge, {"x": (-10.0, 10.0), "y": (-5.0, 5.0)}, 30, 25, seed, abreast)
    trials = run(1, 4)
    assert trials == run(1, 1) and trials != run(2, 4)
    x = np.linspace(0, 2, 401)
    front = np.stack((x**2, (x - 2) ** 2), 1)
    for found in (np.array([g for _, _, g in run(seed, 4)]) for seed in (1, 2, 3)):
        best = found[evolution.fronts(found) == 0]
        apart = np.linalg.norm(best[:, None] - front[None], axis=2)
        assert apart.min(1).max() < 0.1 and np.quantile(apart.min(1), 0.9) < 0.05 and apart.min(0).max() < 0.35


def test_kinds_and_nan(spark):
    trials = evolution.evolved(lambda s: (float("nan"), s["n"]), {"n": (1, 3), "kind": ["a", "b"]}, 3, 6)
    assert {s["n"] for _, s, _ in trials} <= {1, 2, 3} and all(g[0] == np.inf for _, _, g in trials)
    assert len({repr(s) for _, s, _ in trials}) == len(trials) <= 6
    with pytest.raises(ValueError):
        evolution.evolved(lambda s: (0, 0), {}, 1)


def test_layouts(spark):
    p = generators.blobs(spark, 60, 4)
    rows = intrinsic.evolve(p, {"n_neighbors": (5, 12), "max_iter": [4, 8]}, generations=2, population=3, k=5).collect()
    assert 3 <= len(rows) <= 6 and {r.generation for r in rows} <= {0, 1} and all(0 <= r.score <= 1 for r in rows)
