"""Intrinsic dimension by sweeps of the target dimension, and comparisons of reducers and of clouds."""

from __future__ import annotations

import json
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfield.operators.cluster import kneedle, line_elbow, share_elbow
from starfield.operators.embedding import Parameters, Reducer, explained_variance, pca, projected, random_axes, replace
from starfield.operators.evolution import evolved
from starfield.operators.knn import auto_knn
from starfield.operators.points import balanced
from starfield.operators.quality import as_points, evaluate, neighbour_score, stress
from starfield.plans.materialize import checkpoint


def sweep(points: DataFrame, dimensions: range, params: Parameters | None = None) -> DataFrame:
    """dimension, stress, neighbor, seconds of a layout in each target dimension; the neighbours are found once."""
    params = params or Parameters()
    k = min(params.n_neighbors, points.count() - 1)
    high = checkpoint(auto_knn(points, k))
    rows = []
    for d in dimensions:
        began = time.time()
        layout = Reducer(replace(params, n_components=d)).fit_transform(points, high)
        seconds = time.time() - began
        rows.append((d, stress(high, layout).first()[0], neighbour_score(high, auto_knn(as_points(layout), k), k).first()[0], seconds))
    return points.sparkSession.createDataFrame(rows, "dimension int, stress double, neighbor double, seconds double")


def intrinsic_dimension(points: DataFrame, most: int = 5, params: Parameters | None = None) -> dict:
    """The dimensions that stress, neighbourhoods and principal components each point to."""
    rows = sweep(points, range(1, most + 1), params).orderBy("dimension").collect()
    return {"stress": kneedle([r["stress"] for r in rows], increasing=False), "neighbor": kneedle([r["neighbor"] for r in rows]), "pca": share_elbow(explained_variance(points, most))}


def compare_clouds(a: DataFrame, b: DataFrame, most: int = 5, params: Parameters | None = None) -> dict:
    """The neighbourhood elbows of two clouds cut to one size."""
    out = {}
    for name, cloud in zip(("first", "second"), balanced(a, b), strict=True):
        rows = sweep(cloud, range(1, most + 1), params).orderBy("dimension").collect()
        out[name] = line_elbow([r["neighbor"] for r in rows])
    return out


def reducers(k: int = 2, **params) -> dict:
    """The methods that are compared by default."""

    def flat(points: DataFrame) -> DataFrame:
        return projected(points, random_axes(len(points.first()["features"]), k, 42))

    return {"force": Reducer(Parameters(n_components=k, **params)).fit_transform, "spectral": Reducer(Parameters(n_components=k, init="spectral", max_iter=0)).fit_transform, "pca": lambda points: pca(points, k), "random": flat}


def _known(points: DataFrame, k: int, wanted: list[int]) -> DataFrame:
    """The neighbours that judging and all layouts need, found once."""
    return checkpoint(auto_knn(points, max(k, min(max(wanted), points.count() - 1))))


def _judged(points: DataFrame, known: DataFrame, k: int, parameters: Parameters) -> tuple[float, float, float]:
    """Score, error and seconds of one layout."""
    began = time.time()
    high = known.filter(F.col("rank") <= k)
    layout = Reducer(parameters).fit_transform(points, known)
    seconds = time.time() - began
    score = neighbour_score(high, auto_knn(as_points(layout), k), k).first()[0]
    return round(score, 6), round(stress(high, layout).first()[0], 6), seconds


def search(points: DataFrame, space: dict, trials: int = 20, seed: int = 42, base: Parameters | None = None, k: int = 16) -> DataFrame:
    """A row for each random draw of parameters: trial, params (JSON), score (neighbours kept), error (stress), seconds.

    ``space`` gives for each parameter a list to choose from or a pair (low, high): whole numbers if both are, both ends
    included. All trials are judged by one table of ``k`` neighbours; ``cluster.pareto`` gives the best ones. Score and
    error are rounded to six digits, since the order of Spark's sums varies in the last ones.
    """
    base, draw = base or Parameters(), np.random.default_rng(seed)
    if unknown := set(space) - set(base.__dataclass_fields__):
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    k, drawn = min(k, points.count() - 1), []
    for _ in range(trials):
        params = {}
        for name, values in space.items():
            if isinstance(values, tuple):
                low, most = values
                params[name] = int(draw.integers(low, most + 1)) if isinstance(low, int) and isinstance(most, int) else float(draw.uniform(low, most))
            else:
                params[name] = values[int(draw.integers(len(values)))]
        drawn.append(params)
    known = _known(points, k, [base.n_neighbors, *[p["n_neighbors"] for p in drawn if "n_neighbors" in p]])
    rows = [(trial, json.dumps(params, sort_keys=True), *_judged(points, known, k, replace(base, **params))) for trial, params in enumerate(drawn)]
    return points.sparkSession.createDataFrame(rows, "trial int, params string, score double, error double, seconds double")


def evolve(points: DataFrame, space: dict, generations: int = 8, population: int = 25, seed: int = 42, base: Parameters | None = None, k: int = 16, abreast: int = 4) -> DataFrame:
    """As ``search``, by evolution (``evolution.evolved``): a row for each trial with its generation. Score is to be large, error
    small; ``abreast`` layouts are made at once."""
    base = base or Parameters()
    if unknown := set(space) - set(base.__dataclass_fields__):
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    k = min(k, points.count() - 1)
    known, seconds = _known(points, k, [base.n_neighbors, *space.get("n_neighbors", [])]), {}

    def judge(params: dict) -> tuple[float, float]:
        score, error, seconds[repr(params)] = _judged(points, known, k, replace(base, **params))
        return -score, error

    trials = evolved(judge, space, generations, population, seed, abreast, session=points.sparkSession)
    rows = [(n, g, json.dumps(p, sort_keys=True), -goals[0], goals[1], seconds[repr(p)]) for n, (g, p, goals) in enumerate(trials)]
    return points.sparkSession.createDataFrame(rows, "trial int, generation int, params string, score double, error double, seconds double")


METRICS = ("distortion", "context", "topology")


def compare(spark: SparkSession, points: DataFrame, methods: dict | None = None, metrics: tuple[str, ...] = METRICS, **options) -> DataFrame:
    """A row for each method: method, seconds, stress, neighbor, svm, knn, dtw_beta_0, dtw_beta_1, error. A method that
    fails gives its error and does not stop the others."""
    if unknown := set(metrics) - set(METRICS):
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    rows, high = [], None
    for name, method in (methods or reducers()).items():
        began = time.time()
        try:
            layout = checkpoint(method(points))
            seconds = time.time() - began
            if high is None and "distortion" in metrics:
                high = checkpoint(auto_knn(points, options.get("k", 16)))
            found = evaluate(points, layout, high=high, local="distortion" in metrics, context="context" in metrics, topology="topology" in metrics, **options)
            local, context, topology = (found.get(g, {}) for g in ("local", "context", "topology"))
            rows.append((name, seconds, local.get("stress"), (local.get("neighbor") or [None])[0], (context.get("svm") or [None] * 3)[2], (context.get("knn") or [None] * 3)[2], topology.get("dtw_beta_0"), topology.get("dtw_beta_1"), None))
        except Exception as e:  # noqa: BLE001  reported in the row
            rows.append((name, time.time() - began, *[None] * 6, str(e)[:500]))
    return spark.createDataFrame(rows, "method string, seconds double, stress double, neighbor double, svm double, knn double, dtw_beta_0 double, dtw_beta_1 double, error string")
