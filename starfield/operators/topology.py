"""Topology of point clouds: atlas complex, filtrations, Betti curves, persistence bars and their comparison."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfield.functions.vectors import squared
from starfield.operators.cohomology import loop_bars
from starfield.operators.components import spanning_forest
from starfield.operators.knn import knn
from starfield.operators.points import bernoulli, numbered
from starfield.operators.quantiles import quantiles
from starfield.operators.spanning import spanning_lengths
from starfield.plans.materialize import checkpoint


def atlas(points: DataFrame, k: int, density: float = 0.8, overlap: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The union of all neighbourhoods: edges (u, v, step, length) and triangles (a, b, c), a < b < c.

    A point's star joins it to its ``k`` neighbours; neighbours nearer to each other than the ``density`` quantile of
    its distances times ``overlap`` are joined too. ``step`` is the smallest centre that gives an edge, ``length`` its
    length there. A triangle needs an edge between two neighbours of one centre that this or a smaller centre gave.
    """
    star = checkpoint(knn(points, k).select(F.col("src").alias("i"), F.col("dst").alias("j"), "dist"))
    limits = star.groupBy("i").agg((F.percentile("dist", F.lit(density)) * overlap).alias("limit"))
    # Pairs of one point's k neighbours: k * (k - 1) / 2 per point, whatever the input.
    wedge = star.select("i", "j").join(star.select("i", F.col("j").alias("k")), "i").filter("j < k")
    at = lambda c, name: points.select(F.col("id").alias(c), F.col("features").alias(name))
    near = wedge.join(at("j", "_x"), "j").join(at("k", "_y"), "k").withColumn("d", F.sqrt(squared(F.col("_x"), F.col("_y"))))
    patch = near.join(limits, "i").filter("d < limit").select(F.col("j").alias("u"), F.col("k").alias("v"), F.col("i").alias("step"), F.col("d").alias("length"))
    own = star.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), F.col("i").alias("step"), F.col("dist").alias("length"))
    edges = checkpoint(own.unionByName(patch).groupBy("u", "v").agg(F.min("step").alias("step"), F.min_by("length", "step").alias("length")))
    closed = wedge.join(edges, (F.col("j") == F.col("u")) & (F.col("k") == F.col("v")) & (F.col("step") <= F.col("i"))).select(F.sort_array(F.array("i", "j", "k")).alias("t"))
    return edges, closed.select(*[F.col("t")[n].alias(c) for n, c in enumerate("abc")]).distinct()


def valued_triangles(edges: DataFrame, triangles: DataFrame) -> DataFrame:
    """Triangles with ``value``, the length of their longest edge; those without all edges are left out."""
    out = triangles
    for n, (x, y) in enumerate((("a", "b"), ("a", "c"), ("b", "c"))):
        out = out.join(edges.select(F.col("u").alias(x), F.col("v").alias(y), F.col("length").alias(f"_l{n}")), [x, y])
    return out.select("a", "b", "c", F.greatest("_l0", "_l1", "_l2").alias("value"))


def boundary_1(edges: DataFrame) -> DataFrame:
    """Entries of the edge boundary: row (vertex), u, v, val."""
    ends = F.array(F.struct(F.col("u").alias("row"), F.lit(-1).alias("val")), F.struct(F.col("v").alias("row"), F.lit(1).alias("val")))
    return edges.select("u", "v", F.explode(ends).alias("e")).select("e.row", "u", "v", "e.val")


def boundary_2(triangles: DataFrame) -> DataFrame:
    """Entries of the triangle boundary: u, v (the edge), a, b, c, val."""
    faces = F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v"), F.lit(s).alias("val")) for x, y, s in (("a", "b", 1), ("a", "c", -1), ("b", "c", 1))])
    return triangles.select("a", "b", "c", F.explode(faces).alias("e")).select("e.u", "e.v", "a", "b", "c", "e.val")


def laplacian(boundary: DataFrame, row: list[str], column: list[str]) -> DataFrame:
    """B times its transpose as entries (row, col, val), rows numbered by their order."""
    index = numbered(boundary.select(*row).distinct(), *row)
    coded = boundary.join(index, row).select("idx", *column, "val")
    both = coded.join(coded.select(F.col("idx").alias("col"), *column, F.col("val").alias("_w")), column)
    return both.groupBy(F.col("idx").alias("row"), "col").agg(F.sum(F.col("val") * F.col("_w")).alias("val")).filter("val <> 0")


def matrix_structure(entries: DataFrame) -> DataFrame:
    """One row: n_rows, nonzeros, density, bandwidth, mean_span (of a row's columns), max_span."""
    rows = entries.groupBy("row").agg((F.max("col") - F.min("col")).alias("span"), F.count("*").alias("n"), F.max(F.abs(F.col("row") - F.col("col"))).alias("band"))
    return rows.agg(F.count("*").alias("n_rows"), F.sum("n").alias("nonzeros"), (F.sum("n") / (F.count("*") * F.count("*"))).alias("density"), F.max("band").alias("bandwidth"), F.avg("span").alias("mean_span"), F.max("span").alias("max_span"))


def thresholds(edges: DataFrame, n_steps: int) -> DataFrame:
    """step and filtration: exact quantiles of the lengths from the largest down, by counting."""
    found = quantiles(edges, "length", [1 - s / max(n_steps - 1, 1) for s in range(n_steps)])
    return edges.sparkSession.createDataFrame(list(enumerate(found or [])), "step int, filtration double")


def active_counts(steps: DataFrame, edges: DataFrame, triangles: DataFrame) -> DataFrame:
    """step, filtration, n_edges, n_triangles at each threshold; there are few thresholds, so they go to all tasks."""
    t = F.broadcast(steps)
    e = t.join(edges.select("length"), F.col("length") <= F.col("filtration"), "left").groupBy("step", "filtration").agg(F.count("length").alias("n_edges"))
    f = t.join(triangles.select("value"), F.col("value") <= F.col("filtration"), "left").groupBy("step").agg(F.count("value").alias("n_triangles"))
    return e.join(f, "step")


def beta_0(points: DataFrame, steps: DataFrame, forest: DataFrame) -> DataFrame:
    """step, beta_0: points less the spanning forest's edges up to the threshold."""
    n = points.count()
    return F.broadcast(steps).join(forest, F.col("length") <= F.col("filtration"), "left").groupBy("step").agg((F.lit(n) - F.count("length")).alias("beta_0"))


def rank_steps(triangles: DataFrame, edges: DataFrame | None = None, forest: DataFrame | None = None) -> DataFrame:
    """value, once for each unit by which the rank of the triangle boundary rises. Without ``edges`` the triangles' own
    faces are taken, each from its first triangle on, which changes no rank."""
    if edges is None:
        faces = F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])
        edges = triangles.select(F.explode(faces).alias("f"), F.col("value").alias("length")).select("f.*", "length")
    return loop_bars(edges, triangles, forest).filter("death < double('inf')").select(F.col("death").alias("value"))


def betti_curve(points: DataFrame, k: int = 15, density: float = 0.8, overlap: float = 1.0, n_steps: int = 10) -> DataFrame:
    """step, filtration (falling), beta_0, beta_1, n_edges, n_triangles of the atlas. Two points or fewer give one
    step with beta_0 of 1."""
    points = points.select("id", "features")
    n = points.count()
    if n <= 2:
        return points.sparkSession.createDataFrame([(0, 0.0, 1, 0, 0, 0)], "step int, filtration double, beta_0 long, beta_1 long, n_edges long, n_triangles long")
    edges, triangles = atlas(points, min(k, n - 1), density, overlap)
    valued = checkpoint(valued_triangles(edges, triangles))
    steps = checkpoint(thresholds(edges, n_steps))
    forest = spanning_forest(points, edges)
    ranks = F.broadcast(steps).join(rank_steps(valued, edges, forest), F.col("value") <= F.col("filtration"), "left").groupBy("step").agg(F.count("value").alias("rank"))
    out = active_counts(steps, edges, valued).join(beta_0(points, steps, forest), "step").join(ranks, "step")
    beta_1 = F.greatest(F.lit(0).cast("long"), F.col("n_edges") - (n - F.col("beta_0")) - F.col("rank"))
    return out.select("step", "filtration", "beta_0", beta_1.alias("beta_1"), "n_edges", "n_triangles")


METHODS = ("atlas", "rips")


def curve(points: DataFrame, method: str = "atlas", n_steps: int = 10, **options) -> DataFrame:
    """step, filtration, beta_0 and beta_1 of a cloud: by the atlas complex (``betti_curve``), or by the bars of the Rips
    filtration (``rips_curve``). The method is chosen by the caller alone."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    found = betti_curve(points, n_steps=n_steps, **options) if method == "atlas" else rips_curve(checkpoint(rips_bars(points, **options)), n_steps)
    return found.select("step", "filtration", "beta_0", "beta_1")


def topology_error(reduce: Callable[[DataFrame], DataFrame], clouds: dict[str, tuple[DataFrame, int]], share: float = 0.3) -> DataFrame:
    """How far layouts are from the loops that their clouds are known to have: cloud, loops, found, error. ``reduce``
    gives a layout (id, coords); ``clouds`` the points and the number of loops by name."""
    rows = []
    for name, (points, loops) in clouds.items():
        layout = checkpoint(reduce(points)).select("id", F.col("coords").alias("features"))
        found = significant(checkpoint(rips_bars(layout)), 1, share).count()
        rows.append((name, loops, found, abs(found - loops)))
    spark = next(iter(clouds.values()))[0].sparkSession
    return spark.createDataFrame(rows, "cloud string, loops int, found int, error int")


def full_complex(points: DataFrame, k: int = 15, **options) -> tuple[int, int]:
    """beta_0 and beta_1 of the whole atlas."""
    row = betti_curve(points, k, n_steps=1, **options).first()
    return row["beta_0"], row["beta_1"]


def h0_bars(points: DataFrame) -> DataFrame:
    """Bars of the Rips filtration in dimension 0: dim, birth, death (the spanning tree's lengths, and one infinite).

    Exact at every size: ``spanning_lengths`` keeps no table of pairs. Points that are not finite have an infinite bar each."""
    n = points.count()
    if not n:
        return points.sparkSession.createDataFrame([], "dim int, birth double, death double")
    tree = checkpoint(spanning_lengths(points))
    bars = tree.select(F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), F.col("length").alias("death"))
    ends = points.sparkSession.range(n - tree.count()).select(F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), F.lit(float("inf")).alias("death"))
    return bars.unionByName(ends)


def _h1(pairs: pd.DataFrame) -> pd.DataFrame:
    """Bars in dimension 1 of the Rips complex of all pairs, by column reduction over two elements."""
    pairs = pairs.sort_values(["length", "u", "v"]).reset_index(drop=True)
    ids = {v: k for k, v in enumerate(sorted({*pairs["u"], *pairs["v"]}))}
    n, lengths = len(ids), pairs["length"].to_numpy()
    at = np.full((n, n), -1)
    u, v = pairs["u"].map(ids).to_numpy(), pairs["v"].map(ids).to_numpy()
    at[u, v] = at[v, u] = np.arange(len(pairs))
    joined, tree = list(range(n)), []

    def root(x: int) -> int:
        while joined[x] != x:
            joined[x] = joined[joined[x]]
            x = joined[x]
        return x

    for a, b in zip(u, v, strict=True):
        ra, rb = root(a), root(b)
        tree.append(ra != rb)
        joined[ra] = rb
    triangles = []
    for e in range(len(pairs)):  # a triangle is born with its longest edge
        both = np.flatnonzero((at[u[e]] >= 0) & (at[u[e]] < e) & (at[v[e]] >= 0) & (at[v[e]] < e))
        triangles += [(e, frozenset((e, int(at[u[e], w]), int(at[v[e], w])))) for w in both]
    low: dict[int, frozenset] = {}
    dead: dict[int, int] = {}
    for e, column in triangles:
        while column and (pivot := max(column)) in low:
            column = column ^ low[pivot]
        if column:
            low[pivot], dead[pivot] = column, e
    bars = [(1, lengths[e], lengths[dead[e]] if e in dead else np.inf) for e in range(len(pairs)) if not tree[e]]
    return pd.DataFrame([b for b in bars if b[2] > b[1]], columns=["dim", "birth", "death"]).astype({"dim": "int32", "birth": float, "death": float})


def rips_bars(points: DataFrame, most: int = 400) -> DataFrame:
    """Bars of dimensions 0 and 1 of at most ``most`` points (one task for dimension 1): dim, birth, death."""
    n = points.count()
    if n > most:
        raise ValueError(f"{n} points are more than {most}; take a smaller sample")
    pairs = knn(points, max(n - 1, 1)).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("dist").alias("length")).filter("u < v")
    return h0_bars(points).unionByName(pairs.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda x: _h1(x[["u", "v", "length"]]), "dim int, birth double, death double"))


def rips_curve(bars: DataFrame, n_steps: int = 100) -> DataFrame:
    """Bars alive (birth <= t < death) on a rising grid up to 1.05 times the longest finite death."""
    top = bars.filter(F.col("death") < float("inf")).agg(F.coalesce(F.max("death"), F.lit(1.0))).first()[0] * 1.05
    grid = bars.sparkSession.range(n_steps).select(F.col("id").alias("step"), (F.col("id") * top / max(n_steps - 1, 1)).alias("filtration"))
    alive = F.broadcast(grid).join(bars, (F.col("birth") <= F.col("filtration")) & (F.col("filtration") < F.col("death")), "left")
    return alive.groupBy("step", "filtration").agg(*[F.count(F.when(F.col("dim") == d, 1)).alias(f"beta_{d}") for d in (0, 1)])


def significant(bars: DataFrame, dim: int = 1, share: float = 0.3) -> DataFrame:
    """Bars that last at least ``share`` of the longest finite one; infinite ones always do."""
    own = bars.filter(F.col("dim") == dim).withColumn("persistence", F.col("death") - F.col("birth"))
    longest = own.filter(F.col("persistence") < float("inf")).agg(F.coalesce(F.max("persistence"), F.lit(0.0)).alias("_most"))
    return own.join(F.broadcast(longest)).filter(F.col("persistence") >= share * F.col("_most")).drop("_most")


def islands(bars: DataFrame) -> DataFrame:
    """One row: longest finite bar of dimension 0, and the mean of the five longest over the median."""
    finite = bars.filter((F.col("dim") == 0) & (F.col("death") < float("inf")))
    top = finite.orderBy(F.desc("death")).limit(5).agg(F.avg("death").alias("_top"))
    median = (quantiles(finite, "death", [0.5]) or [None])[0]
    longest = finite.agg(F.max("death").alias("longest")).join(F.broadcast(top))  # two single rows
    return longest.select("longest", (F.col("_top") / F.lit(median).cast("double")).alias("top_ratio"))


def dtw(a: np.ndarray, b: np.ndarray, p: float = 2) -> float:
    """Exact dynamic time warping of two short series of numbers or points."""
    a, b = (np.asarray(x, float).reshape(len(x), -1) for x in (a, b))
    cost = (np.abs(a[:, None] - b[None]) ** p).sum(2) ** (1 / p)
    total = np.full((len(a) + 1, len(b) + 1), np.inf)
    total[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            total[i, j] = cost[i - 1, j - 1] + min(total[i - 1, j], total[i, j - 1], total[i - 1, j - 1])
    return float(total[-1, -1])


def global_metrics(points: DataFrame, layout: DataFrame, k: int = 15, subsample: float = 0.5, n_steps: int = 100, seed: int = 42) -> dict:
    """Distances of the Betti curves of the same sample of both clouds, by its size."""
    high = bernoulli(points.select("id", "features"), subsample, seed)
    low = bernoulli(layout.select("id", F.col("coords").alias("features")), subsample, seed)
    n = max(high.count(), 1)
    curves = [[(r["filtration"], r["beta_0"], r["beta_1"]) for r in betti_curve(c, k, n_steps=n_steps).orderBy("filtration").collect()] for c in (high, low)]
    return {f"dtw_beta_{d}": dtw(*[np.array([(r[0], r[1 + d]) for r in c]) for c in curves]) / n for d in (0, 1)} | {"n_samples": n}
