"""Runs a reducer on a named dataset."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfield.operators.embedding import Parameters, Reducer, kernel, standardized
from starfield.operators.knn import auto_knn
from starfield.operators.points import centred, fixed_sample, label_codes
from starfield.operators.quality import stress
from starfield.plans.materialize import checkpoint
from starfield.sources.files import parse_selector, read_cytometry, read_points
from starfield.sources.generators import generate


@dataclass
class Run:
    embedding: DataFrame
    labels: DataFrame
    reducer: object
    fit_time_sec: float
    dataset_info: dict


@dataclass
class ReducerRunner:
    """``reducer`` is a class or factory of objects with ``fit_transform``; ``transform`` changes the points first."""

    reducer: Callable = Reducer
    reducer_options: dict = field(default_factory=dict)
    transform: Callable[[DataFrame], DataFrame] = staticmethod(lambda points: points)

    def run(self, spark: SparkSession, selector: str, **options) -> Run:
        scheme, name = parse_selector(selector)
        if scheme == "openml":
            raise ValueError("no network: give a local file instead")
        if scheme == "file":
            points = read_points(spark, name, **options)
        elif scheme == "cytometry":
            points = read_cytometry(spark, name, **options)
        else:
            points = generate(spark, name, **options)
        points = checkpoint(self.transform(points))
        method = self.reducer(**self.reducer_options)
        began = time.time()
        layout = checkpoint(method.fit_transform(points))  # the time is that of the work, not of its plan
        seconds = time.time() - began
        first = points.select(F.size("features")).first()
        return Run(layout, points.select("id", "label"), method, seconds, {"selector": selector, "n_samples": points.count(), "n_features": first[0] if first else 0})


def profiled(points: DataFrame, params: Parameters | None = None) -> DataFrame:
    """How long each stage of a layout takes, and its result's rows: stage, seconds, rows. Every stage is computed once,
    on the stored result of the ones before."""
    p = params or Parameters()
    rows, done = [], {}

    def stage(name: str, work: Callable[[], DataFrame]) -> None:
        began = time.time()
        done[name] = checkpoint(work())
        rows.append((name, time.time() - began, done[name].count()))

    stage("points", lambda: points.select("id", "features"))
    stage("scale", lambda: centred(done["points"]) if p.normalize else done["points"])
    stage("neighbours", lambda: auto_knn(done["scale"], p.n_neighbors, p.metric))
    reducer = Reducer(p)
    reducer.knn, (reducer.a, reducer.b) = done["neighbours"], kernel(p.min_dist, p.spread)
    n = done["points"].count()
    stage("start", lambda: standardized(reducer._initial(done["scale"])))
    stage("layout", lambda: reducer._moved(done["start"], n, p.n_neighbors))
    stage("standardise", lambda: standardized(done["layout"], sample=True))
    stage("quality", lambda: stress(done["neighbours"], done["standardise"]))
    return points.sparkSession.createDataFrame(rows, "stage string, seconds double, rows long")


def plot_frame(run: Run, most: int = 10_000, seed: int = 42) -> DataFrame:
    """What a scatter plot needs: id, coords, label, code (null for more than 20 classes: use a colour scale)."""
    rows = fixed_sample(run.embedding.join(run.labels, "id"), most, seed)
    coded = label_codes(rows)
    return coded.withColumn("code", F.when(F.lit(rows.select("label").distinct().count() <= 20), F.col("code")))
