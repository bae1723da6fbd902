"""Lengths of the least spanning tree of points without a table of all pairs.

Rounds join every component to its nearest other one. A point's nearest neighbours, found once, tell this as long as the
nearest point outside that they show is no farther than the last neighbour of every point that has only neighbours inside.
Where they tell it for no component, those points are compared with all others, a pair of groups to a task, which returns a row
for each component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfield.functions.vectors import finite
from starfield.operators.components import SMALL, components, spanning_forest
from starfield.operators.knn import knn
from starfield.operators.pairs import Squares, groups_for, matrix, met
from starfield.plans.materialize import checkpoint, written


def _contracted(picks: pd.DataFrame) -> pd.DataFrame:
    """The components after all picks (u, v, length), and the lengths of those picks that join two."""
    above: dict = {}

    def root(x):
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    kept = []
    for u, v, length in picks.sort_values(["length", "u", "v"])[["u", "v", "length"]].itertuples(index=False):
        a, b = root(u), root(v)
        if a != b:
            above[max(a, b)] = min(a, b)
            kept.append(length)
    nodes = np.unique(np.concatenate([picks["u"], picks["v"]]))
    return pd.DataFrame({"node": [*nodes, *[None] * len(kept)], "component": [*map(root, nodes), *[None] * len(kept)], "length": [*[np.nan] * len(nodes), *kept]}).astype({"node": "Int64", "component": "Int64"})


def _joined(picks: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """node and component after the picks (u, v, length), and the lengths that join two components."""
    if picks.count() <= small:
        found = checkpoint(picks.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(_contracted, "node long, component long, length double"))
        return found.filter("node IS NOT NULL").select("node", "component"), found.filter("node IS NULL").select("length")
    nodes = picks.select(F.col("u").alias("id")).union(picks.select("v")).distinct()
    # Each component picks its shortest edge, so only equal lengths can close a circle.
    forest = spanning_forest(nodes, picks, small)
    return components(forest, "u", "v"), forest.select("length")


def _outwards(asked: DataFrame, held: DataFrame, parts: tuple[int, int]) -> DataFrame:
    """The shortest way out of each component of ``asked`` that is no longer than the component's ``limit``: c, dist, d (the component
    there). Both sides have id, features and c."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict = {}
        if len(left) and len(right):
            own, other, limit = np.asarray(left["q_c"]), np.asarray(right["c"]), np.asarray(left["q_limit"], float)
            order = np.argsort(own, kind="stable")
            x, y = matrix(left["q_features"])[order], matrix(right["features"])
            own, limit = own[order], limit[order]
            squares = Squares(x, y)
            for at in range(0, len(x), 256):
                part = slice(at, min(at + 256, len(x)))
                g, slack = squares.of(part), squares.slack(part)
                g[own[part][:, None] == other[None]] = np.inf
                near, c = g.min(1), own[part]
                begin = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                # A component's least value, and how far it and another may be off.
                most = np.minimum.reduceat(np.minimum(near + 2 * slack, limit[part] ** 2 * (1 + 1e-9) + slack), begin)
                most = np.repeat(most, np.diff(np.r_[begin, len(c)]))
                rows = np.flatnonzero(near <= most + 2 * slack)
                row, col = np.nonzero(g[rows] <= (most + 2 * slack)[rows][:, None])
                row = rows[row]
                d = squares.exact(row + at, col, x, y)
                for k in np.lexsort((other[col], d, c[row]))[::-1]:
                    found = (d[k], int(other[col[k]]))
                    out[int(c[row[k]])] = min(out.get(int(c[row[k]]), found), found)
        return pa.table({"c": pa.array(list(out), pa.int64()), "dist": pa.array([v[0] for v in out.values()], pa.float64()), "d": pa.array([v[1] for v in out.values()], pa.int64())})

    found = met(asked, held, parts, meet, "c long, dist double, d long")
    return found.groupBy("c").agg(F.min(F.struct("dist", "d")).alias("best"))


def spanning_lengths(points: DataFrame, k: int = 16, small: int = SMALL) -> DataFrame:
    """length of every edge of the least spanning tree of the points (id, features), which is one component; copies are joined by
    lengths of 0. Points that are not finite are left out."""
    spark = points.sparkSession
    usable = points.select("id", "features").filter(F.forall("features", finite))
    spots = written(usable.groupBy("features").agg(F.min("id").alias("id"), F.count("*").alias("n")), "spanning-spots")
    n, copies, width = spots.agg(F.count("*"), F.sum(F.col("n") - 1), F.max(F.size("features"))).first()
    lengths = spark.range(copies or 0).select(F.lit(0.0).alias("length"))
    if n < 2:
        return lengths
    spots = spots.select("id", "features")
    edges = written(knn(spots, min(k, n - 1)).select("src", "dst", "dist"), "spanning-edges")
    state, left = spots.select(F.col("id").alias("node"), F.col("id").alias("c")), n
    while left > 1:
        near = edges.join(state.select(F.col("node").alias("src"), "c"), "src").join(state.select(F.col("node").alias("dst"), F.col("c").alias("d")), "dst")
        # The nearest neighbour outside; where all are inside, those outside are no nearer than the last.
        each = near.groupBy("src", "c").agg(F.min(F.when(F.col("c") != F.col("d"), F.struct("dist", "d"))).alias("out"), F.max("dist").alias("last"))
        each = written(each.select("src", "c", "out", F.when(F.col("out").isNull(), F.col("last")).alias("last")), "spanning-out")
        least = checkpoint(each.groupBy("c").agg(F.min("out").alias("best"), F.min("last").alias("last"), F.count("*").alias("n")))
        picks = least.filter("best IS NOT NULL AND (last IS NULL OR best.dist <= last)")
        if picks.isEmpty():
            largest = least.orderBy(F.desc("n"), "c").first()["c"]  # its way out is that of another one
            limits = least.filter(F.col("c") != largest).select("c", F.coalesce("best.dist", F.lit(float("inf"))).alias("limit"))
            open_ = each.join(F.broadcast(limits) if left <= small else limits, "c").filter("last <= limit").select("c", "limit", F.col("src").alias("id"))
            asked = written(spots.join(open_, "id"), "spanning-asked")
            held = spots.join(state.select(F.col("node").alias("id"), "c"), "id")
            parts = groups_for(spark, max(asked.count(), 1), width), groups_for(spark, n, width)
            found = _outwards(asked, held, parts).unionByName(least.filter((F.col("c") != largest) & F.col("best").isNotNull()).select("c", "best"))
            picks = checkpoint(found.groupBy("c").agg(F.min("best").alias("best")))
        after, new = _joined(picks.select(F.col("c").alias("u"), F.col("best.d").alias("v"), F.col("best.dist").alias("length")), small)
        lengths = lengths.unionByName(new)
        state = written(state.join(after.select(F.col("node").alias("c"), "component"), "c", "left").select("node", F.coalesce("component", "c").alias("c")), "spanning-state")
        left = state.select("c").distinct().count()
    return lengths
