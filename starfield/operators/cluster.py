"""Clusters and how well they agree with labels."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starfield.functions.vectors import finite, squared
from starfield.operators.components import components
from starfield.operators.pairs import Squares, groups_for, matrix, met
from starfield.operators.points import numbered
from starfield.plans.materialize import checkpoint, written


def kmeans(points: DataFrame, k: int, seed: int = 42, rounds: int = 40, starts: int = 10) -> DataFrame:
    """id, cluster, of the start with the least sum of squared distances; of equal ones the first."""
    vectors = checkpoint(points.select("id", array_to_vector("features").alias("vector")))
    models = [KMeans(k=k, seed=seed + n, maxIter=rounds, featuresCol="vector", predictionCol="cluster").fit(vectors) for n in range(starts)]
    return min(models, key=lambda m: m.summary.trainingCost).transform(vectors).select("id", "cluster")


def _cells(spots: DataFrame, eps: float, d: int) -> tuple[DataFrame, list[list[int]]]:
    """``spots`` with their grid cell, so small that all points of a cell are within ``eps`` of each other, and the steps to the
    cells that may hold others within ``eps``."""
    side = eps / math.sqrt(d) * (1 - 1e-6)
    reach, steps = math.ceil(eps / side), [[]]
    for _ in range(d):
        steps = [[*s, k] for s in steps for k in range(-reach, reach + 1)]
    gap = lambda s: sum((max(abs(k) - 1, 0) * side) ** 2 for k in s)
    return spots.withColumn("cell", F.transform("coords", lambda x: F.floor(x / side).cast("long"))), [s for s in steps if gap(s) <= eps * eps]


def _beside(spots: DataFrame, steps: list[list[int]]) -> DataFrame:
    """A row for each spot and each cell around it: its own columns, and the cell as ``at``."""
    near = F.array(*[F.array(*[F.lit(k).cast("long") for k in s]) for s in steps])
    return spots.withColumn("at", F.explode(F.transform(near, lambda s: F.zip_with("cell", s, lambda x, k: x + k))))


def _linked(core: DataFrame, steps: list[list[int]], eps: float, block: int) -> DataFrame:
    """Pairs of cells (a, b by ``first``, their smallest core id) of which two core points are within ``eps``: a row for each pair.
    ``core`` has cell, coords and first."""

    def touch(left: pa.Table, right: pa.Table) -> pa.Table:
        found = False
        if len(left) and len(right):
            x, y = matrix(left["q_coords"]), matrix(right["coords"])
            # Those nearest to the other cell's box come first, and none farther from it than eps.
            away = lambda u, v: (np.maximum(np.maximum(v.min(0) - u, u - v.max(0)), 0) ** 2).sum(1)
            p, q = away(x, y), away(y, x)
            x, y = (u[np.argsort(w, kind="stable")][: np.count_nonzero(w <= eps * eps * (1 + 1e-9))] for u, w in ((x, p), (y, q)))
            for size in (16, 512):
                for at in range(0, len(x) if size > 16 else min(len(x), size), size):
                    for to in range(0, len(y) if size > 16 else min(len(y), size), size * 8):
                        square = sum((x[at : at + size, None, c] - y[None, to : to + size * 8, c]) ** 2 for c in range(x.shape[1]))
                        if (square <= eps * eps).any():
                            found = True
                            break
                    if found:
                        break
                if found:
                    break
        rows = [(left["q_first"][0].as_py(), right["first"][0].as_py())] if found else []
        return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})

    # Cells of more than ``block`` points meet in parts, so that no task holds a hot cell.
    sizes = core.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    part = F.pmod(F.xxhash64("coords"), F.col("parts"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    parted = written(core.join(sizes, "cell").withColumn("part", part), "cells")
    half = [s for s in steps if s > [0] * len(s)]
    there = sizes.select(F.col("cell").alias("at"), F.col("parts").alias("there"))
    left = _beside(parted, half).join(there, "at").withColumn("q_p", every("there"))
    left = left.select(F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), F.col("at").alias("q_at"), "q_p", F.col("coords").alias("q_coords"), F.col("first").alias("q_first"))
    back = [[-k for k in s] for s in half]
    here = sizes.select(F.col("cell").alias("at"), F.col("parts").alias("there"))
    right = _beside(parted, back).join(here, "at").withColumn("p", every("there")).select("cell", "part", "at", "p", "coords", "first")
    pairs = left.groupBy("q_cell", "q_part", "q_at", "q_p").cogroup(right.groupBy("at", "p", "cell", "part"))
    return pairs.applyInArrow(touch, "a long, b long").distinct()


def dbscan(points: DataFrame, eps: float = 0.5, least: int = 5, block: int = 20_000) -> DataFrame:
    """id, cluster (numbered from 0 by their smallest core id; -1: noise), of points of two or three coordinates. A point
    counts itself; a border point goes to the cluster of the smallest root (smallest core id) among its core neighbours. Points of
    equal coordinates are one place with a count.

    Cells of a grid are so small that their points are all neighbours. So the points of a cell of ``least`` are core points of
    one cluster, only the few of other cells are compared one by one, and of two cells only whether they touch is kept: no
    table of pairs is stored."""
    spots = points.groupBy("coords").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    d = points.select(F.size("coords")).first()
    if d is None:
        return points.select("id", F.lit(-1).alias("cluster"))
    celled, steps = _cells(spots, eps, d[0])
    full = celled.groupBy("cell").agg(F.sum("n").alias("_all"))
    spots = written(celled.join(full, "cell").withColumn("dense", F.col("_all") >= least).drop("_all"), "spots")
    # At most ``least`` - 1 points of a cell are asked about, whatever the others hold.
    asked = _beside(spots.filter("NOT dense").select(F.col("id").alias("a"), F.col("coords").alias("x"), "cell"), steps).drop("cell")
    near = lambda others: asked.join(others.withColumnRenamed("cell", "at"), "at").filter(squared(F.col("x"), F.col("coords")) <= eps * eps)
    counted = near(spots.select("cell", "coords", "n")).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("_near"))
    core = spots.join(counted.filter(F.col("_near") >= least), "id", "left").filter("dense OR _near IS NOT NULL").select("id", "coords", "cell")
    first = core.groupBy("cell").agg(F.min("id").alias("first"))
    core = written(core.join(first, "cell"), "core")
    links = components(_linked(core.select("cell", "coords", "first"), steps, eps, block), "a", "b")
    roots = core.select("first").distinct().join(links.withColumnRenamed("node", "first"), "first", "left").select("first", F.coalesce("component", "first").alias("root"))
    cores = written(core.join(roots, "first").select("id", "coords", "cell", "root"), "core")
    border = near(cores.select("cell", "coords", "root")).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("root"))
    every = cores.select("id", "root").unionByName(border.join(cores.select("id"), "id", "left_anti"))
    # The window sees the clusters, not the points.
    numbers = cores.select("root").distinct().withColumn("cluster", (F.row_number().over(Window.orderBy("root")) - 1).cast("int"))
    found = spots.select("id", "coords").join(every.join(numbers, "root"), "id").select("coords", "cluster")
    return points.join(found, "coords", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def contingency(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster", "label").agg(F.count("*").alias("n"))


def purity(clusters: DataFrame) -> DataFrame:
    """One row: the share of points whose label is the most frequent of their cluster."""
    return contingency(clusters).groupBy("cluster").agg(F.max("n").alias("most"), F.sum("n").alias("n")).agg((F.sum("most") / F.sum("n")).alias("purity"))


def adjusted_rand(clusters: DataFrame) -> DataFrame:
    """One row: agreement of clusters and labels, 0 by chance, 1 if equal."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = contingency(clusters)
    both = cells.agg(pairs("n").alias("s"), F.sum("n").alias("n"))
    rows = cells.groupBy("cluster").agg(F.sum("n").alias("n")).agg(pairs("n").alias("a"))
    cols = cells.groupBy("label").agg(F.sum("n").alias("n")).agg(pairs("n").alias("b"))
    x = both.join(rows).join(cols)
    expected = F.col("a") * F.col("b") / (F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("a") + F.col("b")) / 2 - expected
    return x.select(F.when(top == 0, F.lit(1.0)).otherwise((F.col("s") - expected) / top).alias("ari"))


def silhouette(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: the mean silhouette by Euclidean distance. All pairs are compared by groups of points: a task adds up the
    distances of its points to each cluster. Clusters lie one after another in the groups, so most of a group are whole, and of
    those a point returns its own and the nearest one only."""
    spark = points.sparkSession
    usable = points.select("id", "features").filter(F.forall("features", finite)).join(clusters.select("id", "cluster"), "id", "left")
    sizes = checkpoint(usable.groupBy("cluster").agg(F.count("*").alias("n")))
    codes = checkpoint(numbered(sizes, "cluster").select(F.col("cluster").alias("_name"), F.when(F.col("cluster").isNotNull(), F.col("idx")).alias("c"), "n"))
    table = written(numbered(usable.join(codes, F.col("cluster").eqNullSafe(F.col("_name"))).select("id", "features", F.coalesce("c", F.lit(-1)).alias("c"), "n"), "c", "id"), "silhouette")
    n, width = table.agg(F.count("*"), F.max(F.size("features"))).first()
    if not n:
        return spark.createDataFrame([(None,)], "silhouette double")
    parts = groups_for(spark, n, width)
    per = -(-n // parts)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("id", "own", "c", "sum", "n", "whole")
        kinds = (np.int64, np.int64, np.int64, float, np.int64, bool)
        out = [[np.zeros(0, k)] for k in kinds]
        if len(left) and len(right):
            right = right.sort_by("c")
            ids, own, others, c, total = (np.asarray(t[k], np.int64) for t, k in ((left, "q_id"), (left, "q_c"), (right, "id"), (right, "c"), (right, "n")))
            x, y = matrix(left["q_features"]), matrix(right["features"])
            begin = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            here = np.diff(np.r_[begin, len(c)])
            whole = (here == total[begin]) & (c[begin] >= 0)
            squares = Squares(x, y)
            for at in range(0, len(x), 256):
                part = slice(at, min(at + 256, len(x)))
                g = squares.of(part)
                # Where products cancel, the distance is that of the differences.
                row, col = np.nonzero(g <= 1e9 * squares.slack(part)[:, None])
                with np.errstate(invalid="ignore"):
                    np.sqrt(g, out=g)
                g[row, col] = squares.exact(row + at, col, x, y)
                same = ids[part][:, None] == others[None]
                g[same] = 0
                sums, counts = np.add.reduceat(g, begin, 1), here[None] - np.add.reduceat(same.astype(int), begin, 1)
                mine = c[begin][None] == own[part][:, None]
                # Of whole clusters the own one, and the nearest of the others; of the rest all.
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = np.where(whole[None] & ~mine & (counts > 0), sums / counts, np.inf)
                first = np.zeros_like(mine)
                first[np.arange(len(mean)), mean.argmin(1)] = np.isfinite(mean.min(1))
                row, col = np.nonzero((counts > 0) & (c[begin] >= 0)[None] & (~whole[None] | mine | first))
                for place, values in enumerate((ids[part][row], own[part][row], c[begin][col], sums[row, col], counts[row, col], whole[col])):
                    out[place].append(values)
        return pa.table({k: np.concatenate(v) for k, v in zip(names, out, strict=True)})

    # Numbers by cluster are dealt in stretches, not by the hash of ids, so that clusters stay together.
    found = met(table.select("id", "features", "c"), table.withColumn("_deal", F.floor(F.col("idx") / per)).select("id", "features", "c", "n", "_deal"), (parts, parts), meet, "id long, own long, c long, sum double, n long, whole boolean")
    means = found.groupBy("id", "own", "c").agg((F.sum("sum") / F.sum("n")).alias("d"))
    each = means.groupBy("id").agg(F.max(F.when(F.col("c") == F.col("own"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("own"), F.col("d"))).alias("b"))
    top = F.greatest("a", "b")
    # A point that has no cluster, or is alone in it, counts 0, and so do points all at one place.
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / top)
    return table.select("id").join(each, "id", "left").agg(F.avg(value if n > 1 else F.lit(None).cast("double")).alias("silhouette"))


def separation(points: DataFrame) -> DataFrame:
    """One row: the deviation of class centres over the mean deviation within classes, over all dimensions."""
    x = points.select("label", F.posexplode("features").alias("pos", "v"))
    each = x.groupBy("label", "pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    inside = each.agg(F.avg("s").alias("within"))
    between = each.groupBy("pos").agg(F.stddev_pop("m").alias("s")).agg(F.avg("s").alias("between"))
    return between.join(inside).select((F.col("between") / F.col("within")).alias("separation"))


def pareto(trials: DataFrame) -> DataFrame:
    """Trials (trial, score, error) that no other one beats: higher score and error no higher, or the reverse. Trials without
    score or error are not beaten.

    The least error of each score is dealt out by ranges of the score; a score is on the front if its least error is below
    that of all higher scores: a running minimum within its range, and the minimum of the ranges above, a row each.
    """
    least = trials.filter("score IS NOT NULL AND error IS NOT NULL").groupBy(F.col("score").alias("_s")).agg(F.min("error").alias("_e"))
    ranged = checkpoint(least.repartitionByRange(F.desc("_s")).withColumn("_part", F.spark_partition_id()))
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(F.min("_e").alias("_m")).select(F.col("_part").alias("_of"), F.min("_m").over(above).alias("_above"))
    higher = Window.partitionBy("_part").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("_higher", F.min("_e").over(higher)).join(F.broadcast(parts), F.col("_part") == F.col("_of"))
    front = rows.filter(F.coalesce(F.least("_higher", "_above") > F.col("_e"), F.lit(True))).select("_s", "_e")
    kept = trials.join(front, (F.col("score") == F.col("_s")) & (F.col("error") == F.col("_e")), "left_semi")
    return kept.unionByName(trials.filter("score IS NULL OR error IS NULL"))


def dominance(trials: DataFrame, score: float, error: float) -> DataFrame:
    """One row: how many trials are better than a given one in both, strictly."""
    return trials.agg(F.count(F.when((F.col("score") > score) & (F.col("error") < error), 1)).alias("n"))


def kneedle(curve: list[float], increasing: bool = True) -> int:
    """The elbow of a curve, counted from 1: the largest gap to the diagonal of both axes scaled to 0 .. 1."""
    if len(curve) < 3 or max(curve) == min(curve):
        return 1
    low, span = min(curve), max(curve) - min(curve)
    y = [(v - low) / span for v in curve]
    y = y if increasing else [1 - v for v in y]
    gaps = [v - k / (len(y) - 1) for k, v in enumerate(y)]
    return max(range(len(gaps)), key=lambda k: (gaps[k], -k)) + 1


def line_elbow(curve: list[float]) -> int:
    """The largest distance of the scaled curve from the line between its ends, counted from 1."""
    if len(curve) < 3 or max(curve) == min(curve):
        return 1
    low, span = min(curve), max(curve) - min(curve)
    y = [(v - low) / span for v in curve]
    gaps = [abs(v - (y[0] + (y[-1] - y[0]) * k / (len(y) - 1))) for k, v in enumerate(y)]
    return max(range(len(gaps)), key=lambda k: (gaps[k], -k)) + 1


def share_elbow(cumulative: list[float], share: float = 0.95) -> int:
    """The first dimension that reaches ``share``, or the last."""
    return next((k + 1 for k, v in enumerate(cumulative) if v >= share or math.isclose(v, share)), len(cumulative))
