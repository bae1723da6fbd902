"""Search for parameters with two goals by evolution: fronts, crowding, crossover and mutation of small populations.

A population is a handful of parameter sets, so ranking it is plain NumPy; what each trial does is Spark's work, and the
trials of a generation are submitted side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def fronts(goals: np.ndarray) -> np.ndarray:
    """Each row's front, from 0: rows that no row outside earlier fronts beats (no goal larger, one smaller)."""
    beats = (goals[:, None] <= goals[None]).all(2) & (goals[:, None] < goals[None]).any(2)
    level, found = np.full(len(goals), -1), 0
    while (level < 0).any():
        open_ = level < 0
        level[open_ & ~beats[open_].any(0)] = found
        found += 1
    return level


def crowding(goals: np.ndarray) -> np.ndarray:
    """The gaps between a row's neighbours in each goal, as shares of the goal's range, added up; ends are infinite."""
    total = np.zeros(len(goals))
    for column in goals.T:
        known = column[np.isfinite(column)]
        column = np.where(np.isfinite(column), column, known.max() + 1 if len(known) else 0.0)
        order = np.argsort(column, kind="stable")
        spread = column[order[-1]] - column[order[0]] or 1.0
        total[order[[0, -1]]] = np.inf
        total[order[1:-1]] += (column[order[2:]] - column[order[:-2]]) / spread
    return total


def ordered(goals: np.ndarray) -> np.ndarray:
    """Rows from best to worst: by front, then the least crowded first."""
    level, free = fronts(goals), np.zeros(len(goals))
    for f in range(level.max() + 1):
        free[level == f] = crowding(goals[level == f])
    return np.lexsort((np.arange(len(goals)), -free, level))


class Space:
    """Parameter sets as points of the unit cube: a pair (low, high) is a range, of whole numbers if both ends are; a list
    is a choice."""

    def __init__(self, space: dict) -> None:
        self.space = space

    def read(self, at: np.ndarray) -> dict:
        out = {}
        for (name, values), x in zip(self.space.items(), at, strict=True):
            if not isinstance(values, tuple):
                out[name] = values[min(int(x * len(values)), len(values) - 1)]
            elif all(isinstance(v, int) for v in values):
                out[name] = values[0] + min(int(x * (values[1] - values[0] + 1)), values[1] - values[0])
            else:
                out[name] = float(values[0] + x * (values[1] - values[0]))
        return out


def crossed(a: np.ndarray, b: np.ndarray, draw: np.random.Generator, spread: float) -> np.ndarray:
    """A child of two points by simulated binary crossover, each place with a chance of one half."""
    u = draw.random(len(a))
    beta = np.where(u < 0.5, 2 * u, 1 / (2 * (1 - u))) ** (1 / (spread + 1))
    child = ((1 + beta) * a + (1 - beta) * b) / 2
    return np.clip(np.where(draw.random(len(a)) < 0.5, child, a), 0, 1)


def mutated(a: np.ndarray, draw: np.random.Generator, spread: float) -> np.ndarray:
    """Polynomial mutation, of one place on average."""
    u = draw.random(len(a))
    step = np.where(u < 0.5, (2 * u) ** (1 / (spread + 1)) - 1, 1 - (2 * (1 - u)) ** (1 / (spread + 1)))
    return np.clip(a + np.where(draw.random(len(a)) < 1 / len(a), step, 0), 0, 1)


def evolved(judge: Callable[[dict], tuple[float, float]], space: dict, generations: int = 8, population: int = 25, seed: int = 42, abreast: int = 4, spread: float = 15.0, session: SparkSession | None = None) -> list[tuple[int, dict, tuple]]:
    """All trials as (generation, params, goals), goals to be made small; NaN counts as infinite.

    Parents win a tournament of two; the best half of parents and children lives on. Parameter sets met before are not
    judged again. Up to ``abreast`` trials run at once, and the draws depend on the seed and the goals alone. An error
    in a trial ends the search. Trials inherit the local properties of ``session``, such as its job group.
    """
    if population < 2 or not space:
        raise ValueError("a search needs a population of two and a parameter")
    draw, reader, known, trials = np.random.default_rng(seed), Space(space), {}, []

    def judged(cube: np.ndarray, generation: int) -> np.ndarray:
        sets = [reader.read(x) for x in cube]
        fresh = {repr(s): s for s in sets if repr(s) not in known}
        with ThreadPoolExecutor(abreast) as pool:
            # One wrapper per trial: each carries a copy of the caller's Spark properties.
            running = {name: pool.submit(inheritable_thread_target(session)(judge) if session else judge, s) for name, s in fresh.items()}
            for name, found in running.items():
                known[name] = tuple(float(g) if g == g else np.inf for g in found.result())
                trials.append((generation, fresh[name], known[name]))
        return np.array([known[repr(s)] for s in sets])

    cube = draw.random((population, len(space)))
    goals = judged(cube, 0)
    for generation in range(1, generations):
        place = np.empty(population, int)
        place[ordered(goals)] = np.arange(population)
        parents = [min(draw.integers(population, size=2), key=lambda k: place[k]) for _ in range(2 * population)]
        children = np.array([mutated(crossed(cube[a], cube[b], draw, spread), draw, spread) for a, b in zip(parents[::2], parents[1::2], strict=True)])
        cube, goals = np.vstack((cube, children)), np.vstack((goals, judged(children, generation)))
        ranked, met = ordered(goals), set()
        names = [repr(reader.read(x)) for x in cube[ranked]]
        twin = np.array([name in met or met.add(name) is not None for name in names])
        best = np.concatenate((ranked[~twin], ranked[twin]))[:population]  # copies only where nothing else is left
        cube, goals = cube[best], goals[best]
    return trials
