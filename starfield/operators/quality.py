"""How well a layout keeps its points' neighbourhoods, classes and shape."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfield.functions.vectors import finite, squared, uniform
from starfield.operators.knn import auto_knn, exact_distances, knn
from starfield.operators.pairs import Squares, groups_for, matrix, met
from starfield.operators.points import bernoulli, label_codes, z_scores
from starfield.plans.materialize import checkpoint, written


def as_points(layout: DataFrame) -> DataFrame:
    return layout.select("id", F.col("coords").alias("features"))


def pair_errors(graph: DataFrame, layout: DataFrame) -> DataFrame:
    """For each edge |d_high / max(d_low, 1e-6) - 1|: src, dst, error."""
    x = graph.join(layout.select(F.col("id").alias("src"), F.col("coords").alias("_x")), "src")
    x = x.join(layout.select(F.col("id").alias("dst"), F.col("coords").alias("_y")), "dst")
    return x.select("src", "dst", F.abs(F.col("dist") / F.greatest(F.sqrt(squared(F.col("_x"), F.col("_y"))), F.lit(1e-6)) - 1).alias("error"))


def stress(graph: DataFrame, layout: DataFrame) -> DataFrame:
    """The errors' population deviation over their mean: one row, stress; 0 where the mean is below 1e-6."""
    both = pair_errors(graph, layout).agg(F.avg("error").alias("m"), F.stddev_pop("error").alias("s"))
    return both.select(F.when(F.col("m") < 1e-6, F.lit(0.0)).otherwise(F.col("s") / F.col("m")).alias("stress"))


def kept_neighbours(high: DataFrame, low: DataFrame, k: int) -> DataFrame:
    """Per src, the share of the ``k`` neighbours that both graphs have."""
    both = high.select("src", "dst").join(low.select("src", "dst"), ["src", "dst"]).groupBy("src").agg(F.count("*").alias("n"))
    return high.select("src").distinct().join(both, "src", "left").select("src", (F.coalesce("n", F.lit(0)) / k).alias("share"))


def neighbour_score(high: DataFrame, low: DataFrame, k: int) -> DataFrame:
    """One row: the shares' mean and population deviation."""
    return kept_neighbours(high, low, k).agg(F.avg("share").alias("mean"), F.stddev_pop("share").alias("std"))


def trustworthiness(points: DataFrame, layout: DataFrame, k: int) -> float:
    """1 less a penalty for layout neighbours that are far in the original ranks. All points are compared by groups, and a task
    counts for each of its points' layout neighbours how many are nearer; ranks of other pairs are not kept."""
    spark, n = points.sparkSession, points.count()
    usable = written(points.select("id", F.col("features").cast("array<double>").alias("features")).filter(F.forall("features", finite)), "ranked")
    near = knn(as_points(layout), k).select("src", "dst").join(usable.select(F.col("id").alias("dst"), F.col("features").alias("y")), "dst")
    asked = near.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("dst"), F.flatten(F.collect_list("y")).alias("y"))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = pa.table(batch)
                dst = rows["dst"].combine_chunks()
                there = np.asarray(rows["y"].combine_chunks().flatten(), float).reshape(len(dst.flatten()), -1)
                x = np.repeat(matrix(rows["features"]), np.diff(np.asarray(dst.offsets)), axis=0)
                limits = pa.ListArray.from_arrays(dst.offsets, pa.array(exact_distances(x, there, "euclidean")))
                yield from rows.select(["id", "features", "dst"]).append_column("far", limits).to_batches()

    asked = written(usable.join(asked, "id").mapInArrow(far, "id long, features array<double>, dst array<long>, far array<double>"), "ranked")
    width = usable.agg(F.max(F.size("features"))).first()[0] or 1

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(left) and len(right):
            own, others = np.asarray(left["q_id"], np.int64), np.asarray(right["id"], np.int64)
            x, y = matrix(left["q_features"]), matrix(right["features"])
            size = np.diff(np.asarray(left["q_dst"].combine_chunks().offsets))
            ids = np.repeat(own, size)
            dst = np.asarray(left["q_dst"].combine_chunks().flatten(), np.int64)
            limit = np.asarray(left["q_far"].combine_chunks().flatten(), float)
            count, squares, ends = np.zeros(len(dst), np.int64), Squares(x, y), np.concatenate([[0], np.cumsum(size)])
            for begin in range(0, len(x), 64):
                part = slice(begin, min(begin + 64, len(x)))
                g, slack = squares.of(part), squares.slack(part)
                g[own[part][:, None] == others[None]] = np.inf
                for row, values in enumerate(g):
                    first, last = ends[begin + row], ends[begin + row + 1]
                    most = limit[first:last] ** 2
                    off = slack[row] + 1e-15 * most
                    inside = np.flatnonzero(values <= (most + off).max())
                    values = values[inside]
                    for pair, middle, by in zip(range(first, last), most, off, strict=True):
                        sure = np.count_nonzero(values < middle - by)
                        count[pair] += sure
                        if np.count_nonzero(values <= middle + by) > sure:
                            col = inside[np.abs(values - middle) <= by]
                            if len(col) > 1 or others[col[0]] != dst[pair]:  # mostly it is the neighbour itself
                                d = squares.exact(np.full(len(col), begin + row), col, x, y)
                                count[pair] += np.count_nonzero((d < limit[pair]) | (d == limit[pair]) & (others[col] < dst[pair]))
        else:
            dst = np.zeros(0, np.int64)
        return pa.table({"src": ids, "dst": dst, "n": count})

    parts = groups_for(spark, max(n, 1), width)
    found = met(asked, usable, (parts, parts), meet, "src long, dst long, n long")
    ranks = found.groupBy("src", "dst").agg((F.sum("n") + 1).alias("high"))
    penalty = ranks.agg(F.sum(F.greatest(F.col("high") - k, F.lit(0)))).first()[0]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * (penalty or 0)


def split(points: DataFrame, share: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    mark = uniform(F.col("id"), "split", seed) < share
    return points.filter(mark), points.filter(~mark)


def voted(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """The most frequent label among each src's neighbours, the smallest of equal ones: src, label."""
    votes = graph.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))


def knn_accuracy(points: DataFrame, k: int = 16, seed: int = 42) -> DataFrame:
    """Share of held-out points (30 %) whose label their ``k`` nearest training points vote for: one row, accuracy."""
    train, test = split(points, seed=seed)
    guess = voted(knn(train, k, queries=test), train).withColumnRenamed("label", "_guess")
    both = test.select(F.col("id").alias("src"), "label").join(guess, "src")
    return both.agg(F.avg((F.col("label") == F.col("_guess")).cast("double")).alias("accuracy"))


def svm_accuracy(points: DataFrame, seed: int = 42) -> float:
    """Held-out accuracy of linear support vector machines, one for each class, on standardised features."""
    coded = label_codes(points.filter("label IS NOT NULL")).withColumn("label", F.col("code").cast("double"))
    coded = checkpoint(z_scores(coded)).withColumn("vector", array_to_vector("features"))
    train, test = split(coded, seed=seed)
    svm = LinearSVC(featuresCol="vector", labelCol="label", regParam=1.0 / max(train.count(), 1), maxIter=15)
    model = OneVsRest(classifier=svm, featuresCol="vector", labelCol="label").fit(train)
    return model.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def signed_score(high: float, low: float) -> list[float]:
    """Both accuracies and the log of their ratio. An accuracy of 0 counts as 1e-12."""
    return [high, low, math.log(max(low, 1e-12) / max(high, 1e-12))]


def folded_score(high: float, low: float) -> list[float]:
    """Both accuracies and the log of their smaller ratio, 0 at most."""
    return [high, low, -abs(signed_score(high, low)[2])]


def _with_labels(layout: DataFrame, points: DataFrame) -> DataFrame:
    return as_points(layout).join(points.select("id", "label"), "id")


def local_metrics(points: DataFrame, layout: DataFrame, k: int = 16, subsample: float | None = None, seed: int = 42, high: DataFrame | None = None) -> dict:
    """``high``: the ``k`` neighbours of all points, where they have been found already."""
    if subsample is not None:
        points, layout = bernoulli(points, subsample, seed), bernoulli(layout, subsample, seed)
    if high is None or subsample is not None:
        high = checkpoint(auto_knn(points, k))
    mean, std = neighbour_score(high, auto_knn(as_points(layout), k), k).first()
    return {"stress": stress(high, layout).first()[0], "neighbor": [mean, std], "n_samples": points.count()}


def context_metrics(points: DataFrame, layout: DataFrame, k: int = 16, subsample: float = 0.5, seed: int = 42) -> dict:
    points, layout = bernoulli(points, subsample, seed), bernoulli(layout, subsample, seed)
    flat = _with_labels(layout, points)
    return {
        "svm": folded_score(svm_accuracy(points, seed), svm_accuracy(flat, seed)),
        "knn": signed_score(knn_accuracy(points, k, seed).first()[0], knn_accuracy(flat, k, seed).first()[0]),
    }


def evaluate(points: DataFrame, layout: DataFrame, k: int = 16, subsample: float = 0.5, seed: int = 42, local: bool = True, context: bool = True, topology: bool = True, n_steps: int = 100, high: DataFrame | None = None) -> dict:
    """All groups of metrics; context only where there are labels."""
    from starfield.operators.topology import global_metrics

    if not 0 <= subsample <= 1:
        raise ValueError("subsample must be between 0 and 1")
    out = {}
    if local:
        out["local"] = local_metrics(points, layout, k, seed=seed, high=high)
    if context and not points.filter("label IS NOT NULL").isEmpty():
        out["context"] = context_metrics(points, layout, k, subsample, seed)
    if topology:
        out["topology"] = global_metrics(points, layout, k, subsample, n_steps, seed)
    return out


def grouped_stats(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each group, such as a noise level and a method: the keys, n, mean and population deviation of ``value``."""
    return values.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def procrustes(a: DataFrame, b: DataFrame) -> float:
    """What remains of the squared distances of two layouts after moving, scaling and turning them (0: same shape)."""
    both = a.select("id", F.col("coords").alias("x")).join(b.select("id", F.col("coords").alias("y")), "id")
    d = both.select(F.size("x"), F.size("y")).first()
    names = [f"x[{i}]" for i in range(d[0])] + [f"y[{i}]" for i in range(d[1])]
    sums = both.agg(F.count("*").alias("n"), *[F.sum(F.expr(s)).alias(f"s{i}") for i, s in enumerate(names)], *[F.sum(F.expr(s) * F.expr(t)).alias(f"g{i}_{j}") for i, s in enumerate(names) for j, t in enumerate(names) if i <= j]).first()
    s = np.array([sums[f"s{i}"] for i in range(len(names))])
    g = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))]) - np.outer(s, s) / sums["n"]
    x, y, cross = g[: d[0], : d[0]], g[d[0] :, d[0] :], g[: d[0], d[0] :]
    singular = np.linalg.svd(cross / math.sqrt(np.trace(x) * np.trace(y)), compute_uv=False)
    return float(max(0.0, 1 - singular.sum() ** 2))
