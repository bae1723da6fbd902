"""Low-dimensional layouts: kernel fit, initial coordinates, forces, and the reducer that puts them together."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfield.functions.vectors import keyed_hash, metric_name
from starfield.operators.knn import _matrix, auto_knn, knn, normalized_adjacency, symmetric
from starfield.operators.pairs import Squares, groups_for, matrix, met
from starfield.operators.points import _array, _per_dimension, centred, finite_only, fixed_sample, numbered
from starfield.operators.stretches import Stretches
from starfield.plans.materialize import checkpoint, written
from starfield.plans.sums import added

#: Points that one task may lay out, and the dimensions of which a covariance matrix is formed.
LOCAL, DIMENSIONS = 20_000, 2048
#: Points that kernel components compare all others with.
LANDMARKS = 512


def kernel_target(min_dist: float, spread: float, points: int = 300) -> tuple[np.ndarray, np.ndarray]:
    x = np.linspace(0, 3 * spread, points)
    return x, np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))


def kernel(min_dist: float = 0.01, spread: float = 1.0) -> tuple[float, float]:
    """a and b with 1 / (1 + a x^2b) closest to the target in squares (damped least squares)."""
    x, y = kernel_target(min_dist, spread)
    log = np.log(np.maximum(x, 1e-12))
    p, damping = np.array([1.0, 1.0]), 1e-3

    def residual(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power = np.where(x > 0, np.exp(2 * p[1] * log), 0)
        f = 1 / (1 + p[0] * power)
        return f - y, np.stack([-f * f * power, -f * f * p[0] * power * 2 * log], 1)

    r, j = residual(p)
    for _ in range(500):
        h = j.T @ j
        step = np.linalg.solve(h + damping * np.diag(np.diag(h)), -j.T @ r)
        trial = p + step
        r2, j2 = residual(trial) if trial[0] > 0 and trial[1] > 0 else (np.full_like(r, np.inf), j)
        if (r2 @ r2) < (r @ r):
            done = abs(r @ r - r2 @ r2) < 1e-15
            p, r, j, damping = trial, r2, j2, damping / 3
            if done:
                break
        else:
            damping *= 4
            if damping > 1e12:
                break
    return float(p[0]), float(p[1])


def covariance(points: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, population covariance and count. Each batch gives its sums; only the summed matrix reaches the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("features"))
                x = np.column_stack([np.ones(len(x)), x])
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            d = len(total)
            yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "v": total.ravel()})

    first = points.select(F.size("features")).first()
    if first is None:
        return np.zeros(0), np.zeros((0, 0)), 0
    if first[0] > DIMENSIONS:
        raise ValueError(f"covariance of more than {DIMENSIONS} dimensions")
    rows = points.select("features").mapInArrow(sums, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = max(r["i"] for r in rows) + 1
    g = np.zeros((d, d))
    for r in rows:
        g[r["i"], r["j"]] = r["v"]
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    return mean, g[1:, 1:] / n - np.outer(mean, mean), int(n)


def subspace_axes(points: DataFrame, k: int, rounds: int = 8, spare: int = 10, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the first ``k`` principal axes and their variances by randomised subspace iteration, for any number of
    dimensions: each round is one pass that adds up dimensions times ``k + spare`` numbers; no covariance matrix is
    formed. Errors fall by the ratio of later to kept variances in every round."""
    d = points.select(F.size("features")).first()[0]
    width = min(k + spare, d)

    def passed(axes: np.ndarray, mean: np.ndarray) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, products = 0, np.zeros(d), np.zeros((d, axes.shape[1]))
            for batch in batches:
                step = max(1, (1 << 22) // d)
                for at in range(0, batch.num_rows, step):
                    x = _matrix(batch.column("features").slice(at, step)) - mean
                    n, total = n + len(x), total + x.sum(0)
                    products += x.T @ (x @ axes)
            yield pa.RecordBatch.from_pydict({"v": [np.concatenate([[n], total, products.ravel()]).tobytes()]})

        return added(points.select("features").mapInArrow(sums, "v binary"))

    found = passed(np.zeros((d, 0)), np.zeros(d))
    n, mean = found[0], found[1 : d + 1] / found[0]
    axes = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    for turn in range(rounds + 1):
        products = passed(axes, mean)[d + 1 :].reshape(d, width) / n
        if turn < rounds:
            axes = np.linalg.qr(products)[0]
    values, turns = np.linalg.eigh(axes.T @ products)
    order = np.argsort(-values)[:k]
    return mean, (axes @ turns[:, order]).T, values[order]


def principal_axes(points: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, axes (k rows; the largest loading of each is positive) and variances along them.

    Up to ``DIMENSIONS`` from the covariance matrix, beyond from ``subspace_axes``."""
    first = points.select(F.size("features")).first()
    if first is not None and first[0] > DIMENSIONS:
        mean, axes, values = subspace_axes(points, k)
        order = np.arange(len(values))
    else:
        mean, cov, _ = covariance(points)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values)[: min(k, len(values))]
        axes = vectors[:, order].T
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return mean, axes * np.where(sign == 0, 1, sign)[:, None], np.maximum(values[order], 0)


def projected(points: DataFrame, axes: np.ndarray, mean: np.ndarray | None = None) -> DataFrame:
    """id and coords: features less the mean times the axes."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("features"))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "coords": list((x - (0 if mean is None else mean)) @ axes.T)})

    return points.select("id", "features").mapInArrow(project, "id long, coords array<double>")


def pca(points: DataFrame, k: int, whiten: bool = False) -> DataFrame:
    mean, axes, variances = principal_axes(points, k)
    return projected(points, axes / np.sqrt(np.maximum(variances, 1e-300))[:, None] if whiten else axes, mean)


def explained_variance(points: DataFrame, k: int) -> list[float]:
    """Cumulative shares of the variance of the first ``k`` components, of their own sum."""
    values = principal_axes(points, k)[2]
    return list(np.cumsum(values) / max(values.sum(), 1e-300))


def _landmark_components(points: DataFrame, k: int, gamma: float | None, landmarks: int, seed: int) -> DataFrame:
    """id and coords: components from the kernel values to sampled points (Nystroem)."""
    rows = fixed_sample(points.select("id", "features"), landmarks, seed).collect()  # ``landmarks`` at most
    if not rows:
        return points.sparkSession.createDataFrame([], "id long, coords array<double>")
    base = np.array([r["features"] for r in rows], float)
    gamma = gamma or 1 / base.shape[1]

    def kernel_values(x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(1)[:, None] + (base * base).sum(1) - 2 * x @ base.T
        return np.exp(-gamma * np.maximum(square, 0))

    values, vectors = np.linalg.eigh(kernel_values(base))
    firm = values > 1e-10 * values.max()
    axes = vectors[:, firm] / np.sqrt(values[firm])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "features": list(kernel_values(_matrix(batch.column("features"))) @ axes)})

    return pca(points.select("id", "features").mapInArrow(mapped, "id long, features array<double>"), k)


def _landmark_values(points: DataFrame, gamma: float, landmarks: int, seed: int) -> np.ndarray:
    """Eigenvalues of the centred kernel of sampled points, from the largest."""
    base = np.array([r["features"] for r in fixed_sample(points.select("id", "features"), landmarks, seed).collect()], float)
    square = (base * base).sum(1)[:, None] + (base * base).sum(1) - 2 * base @ base.T
    kernel = np.exp(-gamma * np.maximum(square, 0))
    kernel -= kernel.mean(0)
    return np.linalg.eigvalsh(kernel - kernel.mean(1)[:, None])[::-1]


def _kernel_times(table: DataFrame, gamma: float, block: int | None) -> DataFrame:
    """id and w: the kernel matrix of all points times the columns of ``r``. A task holds two groups, and gives what each
    gives to the other, so a pair of points is compared once."""
    n, width, columns = table.agg(F.count("*"), F.max(F.size("features")), F.max(F.size("r"))).first()
    groups = groups_for(table.sparkSession, n, width + 2 * columns, block)

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left["q_deal"][0].as_py() if len(left) else -1, right["deal"][0].as_py() if len(right) else -1
        # Of the two tasks of a pair of groups, that which is first by the parity of their numbers.
        if a < 0 or b < 0 or (a != b and (a < b) != ((a + b) % 2 == 0)):
            return pa.table({"id": pa.array([], pa.int64()), "w": pa.array([], pa.binary())})
        x, y, r, t = matrix(left["q_features"]), matrix(right["features"]), matrix(right["r"]), matrix(left["q_r"])
        squares, out, back = Squares(x, y), np.zeros((len(x), r.shape[1])), np.zeros((len(y), r.shape[1]))
        for at in range(0, len(x), 128):
            part = slice(at, min(at + 128, len(x)))
            g = squares.of(part)
            np.maximum(g, 0, out=g)
            g *= -gamma
            np.exp(g, out=g)
            out[part] = g @ r
            if a != b:
                back += g.T @ t[part]
        ids, w = np.asarray(left["q_id"], np.int64), out
        if a != b:
            ids, w = np.concatenate([ids, np.asarray(right["id"], np.int64)]), np.concatenate([out, back])
        return pa.table({"id": ids, "w": pa.array([row.tobytes() for row in np.ascontiguousarray(w)], pa.binary())})

    dealt = table.select("id", "features", "r", F.pmod(F.xxhash64("id"), F.lit(groups).cast("long")).alias("deal"))
    parts = met(dealt.withColumn("_deal", F.col("deal")), dealt.withColumn("_deal", F.col("deal")), (groups, groups), product, "id long, w binary")

    def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = None, None
        for batch in batches:
            ids = batch.column("id").to_numpy()
            w = np.frombuffer(b"".join(batch.column("w").to_pylist()), float).reshape(len(ids), -1)
            begin = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            ids, w = ids[begin], np.add.reduceat(w, begin, 0)
            if own is not None:
                if ids[0] == own:
                    w[0] += sums
                else:
                    ids, w = np.concatenate([[own], ids]), np.concatenate([sums[None], w])
            own, sums = ids[-1], w[-1]
            yield pa.RecordBatch.from_pydict({"id": ids[:-1], "w": pa.array(list(w[:-1]), pa.list_(pa.float64()))})
        if own is not None:
            yield pa.RecordBatch.from_pydict({"id": np.array([own]), "w": pa.array([sums], pa.list_(pa.float64()))})

    return parts.repartition("id").sortWithinPartitions("id").mapInArrow(added_up, "id long, w array<double>")


def _width(values: np.ndarray, k: int, most: int = 96) -> int:
    """How many columns a round should have, from sampled eigenvalues: errors fall by the ratio of the first left out to the
    ``k``-th, and a round costs about as much as a hundred columns besides them."""
    values = np.maximum(values, 1e-300)
    widths = range(k + 2, max(k + 3, min(most, len(values) - 1)))
    return min(widths, key=lambda w: (1 + w / 100) * (1 + 15 / max(math.log(values[k - 1] / values[w]), 1e-3)) if w < len(values) else math.inf)


def _products(table: DataFrame) -> np.ndarray:
    """Sums of products of 1, the columns of ``b`` and those of ``ab``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                z = np.column_stack([np.ones(batch.num_rows), _matrix(batch.column("b")), _matrix(batch.column("ab"))])
                total = z.T @ z + total
        if not np.isscalar(total):
            yield pa.RecordBatch.from_pydict({"g": [total.ravel()]})

    total = sum(np.array(r["g"]) for r in table.select("b", "ab").mapInArrow(sums, "g array<double>").toLocalIterator())
    return total.reshape(int(len(total) ** 0.5), -1)


def kernel_pca(points: DataFrame, k: int, gamma: float | None = None, landmarks: int | None = None, seed: int = 42, block: int | None = None) -> DataFrame:
    """id and coords: principal components under the kernel exp(-gamma * squared distance); gamma is 1 / dimensions.

    Exact at every size: leading eigenvectors of the centred kernel matrix of all points, by block Lanczos rounds with
    restarts until the residuals are below 3e-7 of the largest eigenvalue. A round multiplies all pairs of groups, and has as
    many columns as the landmarks' eigenvalues ask for, since those near the wanted ones slow it down; only Gram matrices of the few columns reach the driver. The largest coordinate of a component is positive. With
    ``landmarks``, kernel values to so many sampled points stand for the others' (Nystroem). An empty table gives none.
    """
    first = points.select(F.size("features")).first()
    if landmarks is not None or first is None:
        return _landmark_components(points, k, gamma, landmarks or LANDMARKS, seed)
    gamma = gamma or 1 / first[0]
    width = _width(_landmark_values(points, gamma, LANDMARKS, seed), k)
    # The landmarks' components are a near start, and random columns hold what the sample may lack.
    start = _landmark_components(points, width, gamma, LANDMARKS, seed)
    chance = F.array(*[keyed_hash(F.col("id"), seed, c) / F.lit(float(16**12)) - 0.5 for c in range(k + 2)])
    table = written(points.select("id", "features").join(start, "id").select("id", "features", F.concat("coords", chance).alias("r")), "kernel")
    n, size = table.count(), len(table.select("r").first()[0])
    mean = table.agg(*[F.avg(F.col("r")[c]) for c in range(size)]).first()
    table = table.withColumn("r", F.array(*[F.col("r")[c] - mean[c] for c in range(size)])).withColumn("b", F.array().cast("array<double>")).withColumn("ab", F.array().cast("array<double>"))
    for _ in range(500):
        moved = _kernel_times(table, gamma, block)
        table = written(table.join(moved, "id").select("id", "features", F.concat("b", "r").alias("b"), F.concat("ab", "w").alias("ab")), "kernel")
        g = _products(table)
        j = len(g) // 2
        shift = g[0, j + 1 :] / n
        g = (g - np.outer(g[0], g[0]) / n)[1:, 1:]
        scale = 1 / np.sqrt(np.maximum(np.diag(g)[:j], 1e-300))
        sizes, turn = np.linalg.eigh(g[:j, :j] * np.outer(scale, scale))
        firm = sizes > 1e-6
        basis = scale[:, None] * turn[:, firm] / np.sqrt(sizes[firm])
        cross = basis.T @ (g[:j, j:] + g[j:, :j]) @ basis / 2
        values, vectors = np.linalg.eigh(cross)
        values, s = values[::-1], basis @ vectors[:, ::-1]
        off = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", s, g[j:, j:], s) - values**2, 0))
        if not len(values) or (off[:k] <= 3e-7 * values[0]).all() or len(values) >= n - 1:
            break
        keep = s[:, : max(3 * (k + 2), width)] if j > max(8 * (k + 2), 3 * width) else np.eye(j)
        lead = [c for c in range(min(width, len(values))) if off[c] > 1e-8 * values[0]]
        table = _combined(table, shift, keep, s[:, lead] / off[lead], values[lead])
    else:
        raise ValueError("kernel components do not converge")
    found = min(k, n)
    s = np.column_stack([s[:, :found] * np.sqrt(np.maximum(values[:found], 0)), np.zeros((j, max(0, found - len(values))))])
    coords = [sum((F.col("b")[i] * float(s[i, c]) for i in range(j)), F.lit(0.0)) for c in range(found)]
    layout = table.select("id", F.array(*coords).alias("coords"))
    signs = layout.agg(*[F.max_by(F.signum(F.col("coords")[c]), F.struct(F.abs(F.col("coords")[c]), -F.col("id"))) for c in range(found)]).first()
    return layout.select("id", F.array(*[F.col("coords")[c] * (signs[c] or 1.0) for c in range(found)]).alias("coords"))


def _combined(table: DataFrame, shift: np.ndarray, keep: np.ndarray, lead: np.ndarray, values: np.ndarray) -> DataFrame:
    """The columns ``b`` and ``ab`` (less their mean) times ``keep``, and the residuals ``r`` of the leading ones."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b, ab = _matrix(batch.column("b")), _matrix(batch.column("ab")) - shift
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "features": batch.column("features"), "b": list(b @ keep), "ab": list(ab @ keep), "r": list(ab @ lead - b @ lead * values)})

    kind = table.schema["features"].dataType.simpleString()
    return written(table.mapInArrow(combine, f"id long, features {kind}, b array<double>, ab array<double>, r array<double>"), "kernel")


def random_axes(dimensions: int, k: int, seed: int) -> np.ndarray:
    axes = np.random.default_rng(seed).standard_normal((k, dimensions))
    return axes / np.linalg.norm(axes, axis=1, keepdims=True)


def spectral(points: DataFrame, edges: DataFrame, k: int, rounds: int = 60, seed: int = 42) -> DataFrame:
    """Leading eigenvectors of the normalised adjacency of the symmetric graph, without the first.

    Subspace iteration over stretches of places; the small Gram matrix is factored on the driver."""
    m = k + 1
    start = points.select("id", F.array(*[keyed_hash(F.col("id"), seed, c) / F.lit(float(16**12)) - 0.5 for c in range(m)]).alias("coords"))
    held = Stretches(start, checkpoint(normalized_adjacency(symmetric(edges))), points.count(), m)

    def move(own: np.ndarray, first: int, held: tuple, others: np.ndarray, lead: int, turn: int) -> np.ndarray:
        _, begins, dst, val = held
        near = np.where((dst >= lead) & (dst < lead + len(others)), val, 0)[:, None] * others[np.clip(dst - lead, 0, len(others) - 1)]
        out, size = np.zeros_like(own), np.diff(begins)
        if len(dst):
            out[size > 0] = np.add.reduceat(near, begins[:-1][size > 0])
        return out

    for turn in range(rounds):
        # (A + I) / 2 has no negative eigenvalues, so its largest in size are those of A.
        held.moved(move, lambda own, moved, turn: (own + moved) / 2)
        if turn % 4 == 3 or turn == rounds - 1:
            gram = held.gram()
            held.turned(np.linalg.inv(np.linalg.cholesky(gram + 1e-14 * np.trace(gram) * np.eye(m))).T)
    return held.layout("coords").select("id", F.slice("coords", 2, k).alias("coords"))


def standardized(layout: DataFrame, sample: bool = False) -> DataFrame:
    """Mean 0 and deviation 1 (of the population, or of the sample) in every coordinate; a constant one becomes 0."""
    means, stds = _per_dimension(layout.withColumnRenamed("coords", "features"), "mean", "std_sample" if sample else "std")
    z = F.zip_with(F.zip_with("coords", _array(means), lambda x, m: x - m), _array([s or 0.0 for s in stds]), lambda x, s: F.when(s > 0, x / s).otherwise(F.lit(0.0)))
    return layout.withColumn("coords", z)


def _between(a: str, b: str) -> tuple[Column, Column]:
    """The vector from a to b, and its squared length plus 1e-10."""
    diff = F.zip_with(b, a, lambda x, y: x - y)
    return diff, F.aggregate(diff, F.lit(0.0), lambda s, d: s + d * d) + 1e-10


def _summed(pairs: DataFrame, factor: Column, c: int) -> DataFrame:
    pairs = pairs.withColumn("_f", factor)
    return pairs.groupBy("src").agg(F.array(*[F.sum(F.col("_f") * F.col("_diff")[k]) for k in range(c)]).alias("force"))


def _pairs(edges: DataFrame, layout: DataFrame) -> DataFrame:
    here, there = layout.select(F.col("id").alias("src"), F.col("coords").alias("_p")), layout.select(F.col("id").alias("dst"), F.col("coords").alias("_q"))
    pairs = edges.join(here, "src").join(there, "dst")
    diff, square = _between("_p", "_q")
    return pairs.withColumn("_diff", diff).withColumn("_s", square)


def attraction(edges: DataFrame, layout: DataFrame, a: float, b: float, c: int = 2) -> DataFrame:
    """Sum over neighbours: src, force."""
    power = F.pow("_s", F.lit(b))
    return _summed(_pairs(edges, layout), power / (power + a) / F.sqrt("_s"), c)


def negatives(layout: DataFrame, n: int, count: int, turn: int, seed: int) -> DataFrame:
    """``count`` random places for each point, with replacement, from a keyed hash; ``layout`` has idx, dense from 0."""
    drawn = layout.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("slot"))
    drawn = drawn.withColumn("idx", F.pmod(keyed_hash(F.col("src"), turn, F.col("slot"), seed), F.lit(n)))
    return drawn.join(layout.select("idx", F.col("id").alias("dst")), "idx").select("src", "dst", "slot")


def repulsion(pairs: DataFrame, layout: DataFrame, a: float, b: float, cutoff: float, c: int = 2) -> DataFrame:
    """Sum over drawn pairs: src, force. A point drawn for itself gives nothing."""
    d = F.sqrt("_s")
    return _summed(_pairs(pairs, layout), -F.exp(-d / cutoff) / (1 + a * F.pow("_s", F.lit(b))) / d, c)


def clamped(force: Column, cutoff: float) -> Column:
    return F.transform(force, lambda x: F.least(F.greatest(x, F.lit(-cutoff)), F.lit(cutoff)))


def net_force(edges: DataFrame, pairs: DataFrame, layout: DataFrame, a: float, b: float, cutoff: float, c: int = 2) -> DataFrame:
    pull, push = attraction(edges, layout, a, b, c), repulsion(pairs, layout, a, b, cutoff, c).withColumnRenamed("force", "_push")
    zero = _array([0.0] * c)
    both = pull.join(push, "src", "full").select("src", F.zip_with(F.coalesce("force", zero), F.coalesce("_push", zero), lambda x, y: x + y).alias("force"))
    return both.withColumn("force", clamped(F.col("force"), cutoff))


def _drawn(ids: np.ndarray, count: int, n: int, turn: int, seed: int) -> np.ndarray:
    """As ``negatives``, by a fast mixer for one task."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(count, dtype=np.uint64)[None] * np.uint64(0xD1B54A32D192ED03)
        x += np.uint64((turn * 0x8CB92BA72F3D8DD7 + seed * 0xABC98388FB8FAC03) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


def _stretch(pos: np.ndarray, first: int, ids: np.ndarray, begins: np.ndarray, dst: np.ndarray, others: np.ndarray, a: float, b: float, p: Parameters, n: int, count: int, turn: int, lead: int = 0) -> np.ndarray:
    """The force on the points at ``first`` on, from the positions ``others`` of the places from ``lead`` on: pull of those neighbours
    (``dst`` from ``begins``) and push of those drawn that lie there."""
    out = np.zeros_like(pos)
    for at in range(0, len(pos), 1024):
        own = pos[at : at + 1024]
        cuts = begins[at : at + len(own) + 1]
        size = np.diff(cuts)
        if size.any():
            diff = others[dst[cuts[0] : cuts[-1]] - lead] - np.repeat(own, size, axis=0)
            s = (diff * diff).sum(1) + 1e-10
            power = s**b
            pull = diff * (power / (power + a) / np.sqrt(s))[:, None]
            out[at : at + 1024][size > 0] = np.add.reduceat(pull, (cuts[:-1] - cuts[0])[size > 0])
        if p.repulsion == "exact":
            drawn = np.broadcast_to(np.arange(lead, lead + len(others)), (len(own), len(others)))
        else:
            drawn = _drawn(ids[at : at + 1024], count, n, turn, p.seed)
        there = None if lead == 0 and len(others) == n else (drawn >= lead) & (drawn < lead + len(others))
        diff = others[drawn if there is None else np.where(there, drawn - lead, 0)] - own[:, None]
        s = (diff * diff).sum(2) + 1e-10
        d = np.sqrt(s)
        weight = np.exp(-d / p.cutoff) / (1 + a * s**b) / d
        if there is not None:
            weight[~there] = 0
        out[at : at + 1024] -= (diff * weight[:, :, None]).sum(1)
    return out


def relaxed(pos: np.ndarray, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, a: float, b: float, p: Parameters, k: int) -> np.ndarray:
    """All rounds in memory; ``src`` and ``dst`` are places in ``pos``, by src."""
    n = len(pos)
    count = min(int(p.neg_ratio * k), n - 1)
    begins = np.searchsorted(src, np.arange(n + 1))
    for turn in range(p.max_iter):
        force = _stretch(pos, 0, ids, begins, dst, pos, a, b, p, n, count, turn)
        pos = pos + (1 - turn / p.max_iter) * np.clip(force, -p.cutoff, p.cutoff)
    return pos


@dataclass(frozen=True)
class Parameters:
    n_components: int = 2
    n_neighbors: int = 16
    init: str = "pca"
    max_iter: int = 128
    min_dist: float = 0.01
    spread: float = 1.0
    cutoff: float = 42.0
    neg_ratio: float = 8.0
    normalize: bool = True
    metric: object = None
    repulsion: str = "sampled"
    strategy: str = "auto"
    seed: int = 42


#: Parameters that keep loops and holes better.
TOPOLOGY_TUNED = {"init": "spectral", "n_neighbors": 15, "spread": 3.6, "max_iter": 150}
INITS = ("pca", "random", "spectral")
STRATEGIES = ("auto", "local", "distributed")


@dataclass
class Reducer:
    """Lays points out: ``fit`` keeps ``embedding`` (id, coords), the neighbour table and the kernel."""

    params: Parameters = field(default_factory=Parameters)

    def __post_init__(self) -> None:
        p = self.params
        if p.n_components < 1 or p.n_neighbors < 1:
            raise ValueError("n_components and n_neighbors must be positive")
        if p.init not in INITS:
            raise ValueError(f"init must be one of {INITS}")
        if p.strategy not in STRATEGIES or p.repulsion not in ("sampled", "exact"):
            raise ValueError("unknown strategy or repulsion")

    def fit(self, points: DataFrame, known: DataFrame | None = None) -> Reducer:
        """``known``: Euclidean neighbours of the points (src, dst, rank, dist), as many as are wanted or more, where they have been
        found already. Moving and scaling the points does not change them."""
        p = self.params
        points = checkpoint(points.select("id", "features"))
        n = points.count()
        if not n:
            raise ValueError("no points")
        if finite_only(points).count() < n:
            raise ValueError("features with null, NaN or infinite values")
        k = p.n_neighbors
        if k > n - 1:
            warnings.warn(f"n_neighbors {k} is cut to {n - 1}", stacklevel=2)
            k = n - 1
        self.n_neighbors, (self.a, self.b) = k, kernel(p.min_dist, p.spread)
        if n == 1:
            self.knn, self.embedding = None, points.select("id", _array([0.0] * p.n_components).alias("coords"))
            return self
        scaled = checkpoint(centred(points)) if p.normalize else points
        if known is not None and metric_name(p.metric) in ("euclidean", "sqeuclidean"):
            self.knn = known.filter(F.col("rank") <= k)
        else:
            self.knn = checkpoint(auto_knn(scaled, k, p.metric))
        start = standardized(self._initial(scaled))
        self.embedding = checkpoint(standardized(self._moved(start, n, k), sample=True))
        return self

    def _moved(self, start: DataFrame, n: int, k: int) -> DataFrame:
        p = self.params
        local = p.strategy == "local" or p.strategy == "auto" and n <= LOCAL
        return self._local(start, k) if local else self._distributed(start, n, k)

    def fit_transform(self, points: DataFrame, known: DataFrame | None = None) -> DataFrame:
        return self.fit(points, known).embedding

    def _initial(self, points: DataFrame) -> DataFrame:
        p = self.params
        if p.init == "spectral":
            return spectral(points, self.knn, p.n_components, seed=p.seed)
        d = points.select(F.size("features")).first()[0]
        if p.init == "random" or d < p.n_components:
            return projected(points, random_axes(d, p.n_components, p.seed))
        return pca(points, p.n_components)

    def _local(self, start: DataFrame, k: int) -> DataFrame:
        """One task of bounded size: it does all rounds without a job for each."""
        a, b, p = self.a, self.b, self.params
        edges = self.knn.select(F.lit(0).alias("_g"), "src", "dst")

        def lay(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            left, right = left.sort_values("id"), right.sort_values(["src", "dst"])
            ids = left["id"].to_numpy()
            pos = relaxed(np.stack(left["coords"].to_numpy()), ids, np.searchsorted(ids, right["src"]), np.searchsorted(ids, right["dst"]), a, b, p, k)
            return pd.DataFrame({"id": ids, "coords": list(pos)})

        return start.withColumn("_g", F.lit(0)).groupBy("_g").cogroup(edges.groupBy("_g")).applyInPandas(lay, "id long, coords array<double>")

    def _distributed(self, start: DataFrame, n: int, k: int) -> DataFrame:
        """Rounds over stretches of places, the points' numbers by id: a task moves one stretch by the positions of all, of
        at most ``HELD`` points at a time. Draws are those of ``relaxed``, so both ways agree but for the order of sums."""
        p, c = self.params, self.params.n_components
        if p.repulsion == "exact":
            raise ValueError("exact repulsion needs the local strategy")
        a, b, count = self.a, self.b, min(int(p.neg_ratio * k), n - 1)

        def move(own: np.ndarray, first: int, held: tuple, others: np.ndarray, lead: int, turn: int) -> np.ndarray:
            ids, begins, dst, _ = held
            low, high = lead, lead + len(others)
            if low > 0 or high < n:
                inside = (dst >= low) & (dst < high)
                begins = np.concatenate([[0], np.cumsum(inside)])[begins]
                dst = dst[inside]
            return _stretch(own, first, ids, begins, dst, others, a, b, p, n, count, turn, lead)

        def step(own: np.ndarray, force: np.ndarray, turn: int) -> np.ndarray:
            return own + (1 - turn / p.max_iter) * np.clip(force, -p.cutoff, p.cutoff)

        rounds = Stretches(start, self.knn, n, c)
        for turn in range(p.max_iter):
            rounds.moved(move, step, turn)
        return rounds.layout("coords")


def create_reducer(strategy: str = "auto", **params) -> Reducer:
    return Reducer(replace(Parameters(), strategy=strategy, **params))


def anchors(points: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The points of a coarse level."""
    return fixed_sample(points, n, seed)


def topped_up(chosen: DataFrame, points: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``chosen`` and as many others at random as are missing to ``n``."""
    rest = points.join(chosen.select("id"), "id", "left_anti")
    return chosen.unionByName(fixed_sample(rest, max(0, n - chosen.count()), seed))


def propagated(points: DataFrame, placed: DataFrame, noise: float = 0.01, seed: int = 42) -> DataFrame:
    """Coordinates for all points: their own where placed, else those of the nearest placed point and some noise."""
    own = points.join(placed.select("id"), "id", "left_semi")
    rest = points.join(placed.select("id"), "id", "left_anti")
    near = knn(own, 1, queries=rest).select(F.col("src").alias("id"), F.col("dst").alias("_anchor"))
    moved = near.join(placed.select(F.col("id").alias("_anchor"), "coords"), "_anchor")
    # A normal number from two uniform ones, keyed by point and coordinate.
    u = lambda k, i: (keyed_hash(F.col("id"), seed, k, i) + 1) / F.lit(float(16**12 + 1))
    jitter = F.transform("coords", lambda x, i: x + noise * F.sqrt(-2 * F.log(u(0, i))) * F.cos(2 * math.pi * u(1, i)))
    return placed.select("id", "coords").unionByName(moved.select("id", jitter.alias("coords")))


def hierarchical(points: DataFrame, levels: list[int], **params) -> DataFrame:
    """Embeds growing samples, each from its own level; the rest follows its nearest placed point."""
    placed = None
    for n in levels:
        sample = anchors(points, n, params.get("seed", 42))
        if placed is not None:
            sample = topped_up(points.join(placed.select("id"), "id", "left_semi"), points, n, params.get("seed", 42))
        placed = create_reducer(**params).fit_transform(sample)
    return propagated(points, placed)
