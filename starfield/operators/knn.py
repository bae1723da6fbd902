"""Nearest neighbours as an edge table: src, dst, rank (from 1), dist; ties go to the smaller dst, self is left out by id.

Exact search deals the points to the cells of pivots and stores them in blocks of bounded bytes, one row each, with each
point's ``k``-th distance within its own block. A group of blocks then meets only those groups of which some cell's ball
may hold a nearer point, by the triangle inequality, for some of its points; a task holds two groups and returns what is
within the distances known. Approximate search (inverted lists) compares a point with the ``probes`` nearest cells only,
and only where it is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starfield.functions.vectors import EPSILON, distance, finite, metric_meant, metric_name
from starfield.operators.pairs import groups_for
from starfield.operators.points import fixed_sample
from starfield.plans.materialize import checkpoint, written

BLOCK = 4096
#: Bytes of the features that one side of an exact search holds in a task.
GROUP_BYTES = 1 << 25
#: Cells of pivots, at most.
CELLS = 1024
_SCHEMA = "src long, dst long, dist double"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = np.asarray(column.flatten(), float)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def exact_distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Row by row (the last axis), without the rounding of the product form."""
    if metric in ("euclidean", "sqeuclidean"):
        d = ((x - y) ** 2).sum(-1)
        return np.sqrt(d) if metric == "euclidean" else d
    if metric == "inner_product":
        return -(x * y).sum(-1)
    if metric == "manhattan":
        return np.abs(x - y).sum(-1)
    return 1 - (x * y).sum(-1) / (np.sqrt((x * x).sum(-1)) * np.sqrt((y * y).sum(-1)) + EPSILON)


def _without_late_copies(others: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows of ``y`` that can be among the ``k`` nearest of a point: of equal rows, those of the ``k + 1``
    smallest ids (one of them may be the point itself)."""
    seen: dict[bytes, int] = {}
    group = np.array([seen.setdefault(row.tobytes(), len(seen)) for row in y], int)
    if len(seen) == len(y):
        return np.arange(len(y))
    order = np.lexsort((others, group))
    group, ids = group[order], others[order]
    first = np.r_[True, group[1:] != group[:-1]]
    number = np.cumsum(first | np.r_[True, ids[1:] != ids[:-1]])
    return np.sort(order[number - number[first][group] <= k])


class _Products:
    """The distances of two blocks as products of single precision: row i and column j are within a limit only if
    ``p[i] @ q[j] - half[j]`` is not below ``least``, which allows for all rounding. Of Manhattan distances it is their sums,
    turned around."""

    def __init__(self, x: np.ndarray, y: np.ndarray, metric: str):
        self.metric = metric
        self.unit = 8 * (y.shape[1] + 8) * float(np.finfo(np.float32).eps)
        straight = metric in ("euclidean", "sqeuclidean")
        # Differences do not depend on the origin; near it the product form cancels least.
        centre = y.mean(0) if (straight or metric == "manhattan") and len(y) else 0.0
        centre = np.where(np.isfinite(centre), centre, 0.0)
        p, q = x - centre, y - centre
        # So that single precision neither overflows nor vanishes.
        size = max(np.abs(p).max(initial=0), np.abs(q).max(initial=0)) if metric != "cosine" else 1.0
        self.size = size if 0 < size < np.inf else 1.0
        p, q = p / self.size, q / self.size
        self.s, self.t = (np.abs(p).sum(1), np.abs(q).sum(1)) if metric == "manhattan" else ((p * p).sum(1), (q * q).sum(1))
        half = self.t / 2 if straight else np.zeros(len(y))
        if metric == "cosine":
            p, q = p / np.where(self.s > 0, np.sqrt(self.s), 1)[:, None], q / np.where(self.t > 0, np.sqrt(self.t), 1)[:, None]
        self.p, self.q, self.half = p.astype(np.float32), q.astype(np.float32), half.astype(np.float32)
        self.most = self.t.max(initial=0)
        self.short = np.sqrt(self.t[self.t > 0].min(initial=np.inf))

    def _near(self, part: slice) -> np.ndarray:
        """The larger, the nearer."""
        if self.metric != "manhattan":
            g = self.p[part] @ self.q.T
            g -= self.half
            return g
        p, g = self.p[part], np.zeros((part.stop - part.start, len(self.q)), np.float32)
        columns = np.ascontiguousarray(self.q.T)
        for at in range(0, len(p), 32):  # so few rows that all stays in the cache
            rows, own = p[at : at + 32], g[at : at + 32]
            away = np.empty_like(own)
            for c, column in enumerate(columns):
                np.abs(np.subtract(rows[:, c, None], column[None], out=away), out=away)
                own -= away
        return g

    def _slack(self, part: slice, limit: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":  # the small constant of the divisor matters for short vectors
            own = np.sqrt(self.s[part])
            return self.unit + np.where(own > 0, EPSILON / (own * self.short + EPSILON), 0)
        return self.unit * (self.s[part] + self.most + np.abs(np.where(np.isfinite(limit), limit, 0))) + 1e-30

    def least(self, part: slice, limit: np.ndarray) -> np.ndarray:
        """From limits of the distance (of its square for Euclidean ones), in units of ``size`` squared."""
        wide = limit + self._slack(part, limit)
        if self.metric == "cosine":
            return 1 - wide
        return -wide if self.metric in ("inner_product", "manhattan") else (self.s[part] - wide) / 2

    def limit(self, part: slice, ids: np.ndarray, others: np.ndarray, k: int, asked: np.ndarray | None = None) -> np.ndarray:
        """A limit of each row's ``k``-th distance, from the products, of the columns that it asks."""
        g = self._near(part)
        g[ids[part][:, None] == others[None]] = -np.inf
        if asked is not None:
            g[~asked] = -np.inf
        kth = -np.partition(-g, k - 1, axis=1)[:, k - 1].astype(float)
        limit = 1 - kth if self.metric == "cosine" else -kth if self.metric in ("inner_product", "manhattan") else self.s[part] - 2 * kth
        return limit + self._slack(part, limit)

    def near(self, part: slice, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows (within the part) and columns that may be within the limit. Comparisons with values that are not numbers
        are false, so such pairs stay in."""
        g = self._near(part)
        return np.divmod(np.flatnonzero(~(g < least.astype(np.float32)[:, None])), g.shape[1])


def best(
    ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, metric: str, limits: np.ndarray | None = None, within: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of ``y`` for each row of ``x``, of those within ``limits`` where these are given. Products of
    single precision leave all those that may be among them, however many; exact distances and ids order these. ``within``:
    which cells each row asks, and the cell of each row of ``y``."""
    out: list[tuple] = []
    keep = _without_late_copies(others, y, k)
    others, y = others[keep], y[keep]
    asks, cell = (None, None) if within is None else (within[0], within[1][keep])
    with np.errstate(invalid="ignore", over="ignore"):
        products = _Products(x, y, metric)
        for at in range(0, len(x) if len(y) else 0, 512):
            part = slice(at, min(at + 512, len(x)))
            if limits is not None:
                limit = limits[part] / products.size if metric in ("euclidean", "manhattan") else limits[part] / products.size**2
                limit = limit**2 * (1 + 1e-12) if metric == "euclidean" else limit * (1 + 1e-12) if metric == "manhattan" else limit
            else:
                limit = np.full(part.stop - at, np.inf)
            if k < len(y) and np.isinf(limit).any():
                limit = np.minimum(limit, products.limit(part, ids, others, k, None if asks is None else asks[part][:, cell]))
            row, col = products.near(part, products.least(part, limit))
            other = ids[part][row] != others[col]
            if asks is not None:
                other &= asks[part][row, cell[col]]
            row, col = row[other], col[other]
            step = max(1, (1 << 21) // max(1, y.shape[1]))
            d = np.concatenate([np.zeros(0), *(exact_distances(x[part][row[i : i + step]], y[col[i : i + step]], metric) for i in range(0, len(row), step))])
            order = np.lexsort((others[col], d, row))
            order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
            out.append((ids[part][row[order]], others[col[order]], d[order]))
    src, dst, d = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    ok = np.isfinite(d)
    return src[ok], dst[ok], d[ok]


def _joined(queries: DataFrame, points: DataFrame, keys: list[str], k: int, metric: str) -> DataFrame:
    """The best of each group of ``keys``, which both sides have."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        src, dst, d = best(np.asarray(left["q_id"]), _matrix(left["q_features"]), np.asarray(right["id"]), _matrix(right["features"]), k, metric) if len(left) and len(right) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"src": src.astype(np.int64), "dst": dst.astype(np.int64), "dist": d.astype(float)})

    # Both sides may stem from one table: new names keep them apart.
    asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in keys], F.col("id").alias("q_id"), F.col("features").alias("q_features"))
    return asked.groupBy(*[f"q_{c}" for c in keys]).cogroup(points.select(*keys, "id", "features").groupBy(*keys)).applyInArrow(search, _SCHEMA)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("src", "dst", "rank", "dist")


class Cells:
    """Pivots with, for each cell, the radius around its pivot, the least norm, and where its blocks begin."""

    def __init__(self, centres: np.ndarray, metric: str):
        self.centres, self.metric = centres, metric
        self.radius = np.zeros(len(centres))
        self.norm = np.full(len(centres), np.inf)
        self.first = np.zeros(len(centres) + 1, np.int64)

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Where the triangle inequality is applied: on the sphere for cosines."""
        return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None] if self.metric == "cosine" else x

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row, and its distance."""
        z = self.placed(x)
        with np.errstate(invalid="ignore", over="ignore"):
            cell = np.argmin((self.centres * self.centres).sum(1)[None] - 2 * z @ self.centres.T, axis=1)
            return cell, np.sqrt(((z - self.centres[cell]) ** 2).sum(1))

    def bounds(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """For each row and cell a distance that no point of the cell is below."""
        z, c, r = self.placed(x), self.centres[cells], self.radius[cells][None]
        with np.errstate(invalid="ignore", over="ignore"):
            if self.metric == "inner_product":
                most = z @ c.T + np.sqrt((z * z).sum(1))[:, None] * r
                return -most - 1e-9 * (np.abs(most) + np.sqrt((z * z).sum(1))[:, None] * (r + np.sqrt((c * c).sum(1))[None]))
            away = np.sqrt(np.maximum((z * z).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * z @ c.T, 0))
            # The product form may be off by this much.
            off = np.sqrt(4 * (z.shape[1] + 8) * np.finfo(float).eps * ((z * z).sum(1)[:, None] + (c * c).sum(1)[None]))
            least = np.maximum(away - r - off - 1e-9 * (away + r), 0)
            if self.metric in ("euclidean", "manhattan"):  # a Manhattan distance is no less than the Euclidean one
                return least
            if self.metric == "sqeuclidean":
                return least * least
            # The small constant of the cosine's divisor matters for short vectors.
            norms = np.sqrt((x * x).sum(1))[:, None] * self.norm[cells][None]
            return least * least / 2 - 2 * EPSILON / (norms + EPSILON) - 1e-9


def _x(rows: pa.Table, k: int, d: int, side: str = "") -> np.ndarray:
    return np.frombuffer(rows[side + "x"][k].as_buffer(), rows[side + "kind"][k].as_py()).reshape(-1, d).astype(float)


def _celled(points: DataFrame, cells: Cells) -> DataFrame:
    """id, features, cell, away (the distance from its pivot) and norm."""
    kind = points.schema["features"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("features"))
            if not len(x):
                continue
            cell, away = cells.nearest(x)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "features": batch.column("features"), "cell": cell.astype(np.int64), "away": away, "norm": np.sqrt((x * x).sum(1))})

    return points.select("id", "features").mapInArrow(assign, f"id long, features {kind}, cell long, away double, norm double")


def _blocks(celled: DataFrame, first: np.ndarray, per: int, k: int, metric: str) -> DataFrame:
    """A row for each block, written: part (a group of ``per`` blocks), cell, ids and x (bytes; single precision where that is
    exact), kind, limits (the k-th distance of each point within the block)."""
    parts = celled.sparkSession.createDataFrame([(c, int(first[c]), int(first[c + 1] - first[c])) for c in range(len(first) - 1)], "cell long, _first long, _n long")
    numbered = celled.join(F.broadcast(parts), "cell").withColumn("block", F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_n")))

    def pack(rows: pa.Table) -> pa.Table:
        ids, x = np.asarray(rows["id"], np.int64), _matrix(rows["features"])
        src, _, dist = best(ids, x, ids, x, k, metric)
        limits = np.full(len(ids), np.inf)
        order = np.argsort(ids, kind="stable")
        by = np.lexsort((dist, src))
        own, begin, count = np.unique(src[by], return_index=True, return_counts=True)
        full = count >= k
        # Of points that share an id the last one gets the limit, so the others have none, which is safe.
        limits[order[np.searchsorted(ids[order], own[full], "right") - 1]] = dist[by][begin[full] + k - 1]
        narrow = bool(np.array_equal(x.astype(np.float32).astype(float), x))
        kind = "<f4" if narrow else "<f8"
        return pa.table({"part": [rows["block"][0].as_py() // per], "cell": [rows["cell"][0].as_py()], "ids": [ids.tobytes()], "x": [x.astype(kind).tobytes()], "kind": [kind], "limits": [limits.tobytes()]})

    rows = numbered.groupBy("block").applyInArrow(pack, "part long, cell long, ids binary, x binary, kind string, limits binary")
    return written(rows, "knn-blocks")


def _exact(points: DataFrame, k: int, metric: str, queries: DataFrame | None, block: int) -> DataFrame:
    spark = points.sparkSession
    usable = lambda df: df.select("id", "features").filter(F.forall("features", finite))
    points, queries = usable(points), None if queries is None else usable(queries)
    n, d = points.agg(F.count("*"), F.max(F.size("features"))).first()
    if not n:
        return spark.createDataFrame([], _SCHEMA)
    if n <= block and 8 * n * d <= GROUP_BYTES:
        # The points are one block, so there is nothing to prune: each block of queries meets them.
        asked = points if queries is None else queries
        blocks = max(1, -(-asked.count() // block))
        own = asked.withColumn("_a", F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long")))
        other = points.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return _joined(own, other, ["_a"], k, metric)
    cells = Cells(centroids(points, min(CELLS, max(1, n // block)), sphere=metric == "cosine"), metric)

    def dealt(df: DataFrame, own: bool) -> tuple[DataFrame, np.ndarray]:
        """The blocks of a side, and where each cell's begin."""
        celled = written(_celled(df, cells), "knn-cells")
        counts = np.zeros(len(cells.centres), np.int64)
        # One row for each cell.
        for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.min("norm").alias("norm")).collect():
            counts[r["cell"]] = r["n"]
            if own:
                cells.radius[r["cell"]], cells.norm[r["cell"]] = r["away"], r["norm"]
        first = np.concatenate([[0], np.cumsum(-(-counts // block))])
        # Groups as large as the bytes allow, but enough of them to keep all cores busy.
        busy = int(np.ceil((4 * spark.sparkContext.defaultParallelism) ** 0.5))
        per = int(max(1, min(GROUP_BYTES // (8 * d * block), -(-first[-1] // busy))))
        return _blocks(celled, first, per, k, metric), first // per, (first[1:] - 1) // per

    held, begins, ends = dealt(points, own=True)
    asked = held if queries is None else dealt(queries, own=False)[0]
    if queries is not None:
        # What queries have within their own blocks says nothing about the points.
        asked = asked.withColumn("limits", F.lit(None).cast("binary"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.flatnonzero(np.isfinite(cells.norm))
        for batch in batches:
            rows, found = pa.table(batch), set()
            for at in range(len(rows)):
                x, limits = _x(rows, at, d), _limits(rows, at)
                need = every[(~(cells.bounds(x, every) > limits[:, None])).any(0)] if limits is not None else every
                found |= {(rows["part"][at].as_py(), p) for c in need for p in range(begins[c], ends[c] + 1)}
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        blocks = [(right["cell"][j].as_py(), np.frombuffer(right["ids"][j].as_buffer(), np.int64), _x(right, j, d)) for j in range(len(right))]
        for at in range(len(left)):
            ids, x, limits = np.frombuffer(left["q_ids"][at].as_buffer(), np.int64), _x(left, at, d, "q_"), _limits(left, at)
            if not blocks:
                continue
            least = cells.bounds(x, np.array([c for c, *_ in blocks])) if limits is not None else None
            for j, (_, others, y) in enumerate(blocks):
                near = np.flatnonzero(~(least[:, j] > limits)) if limits is not None else np.arange(len(ids))
                if len(near):
                    out.append(best(ids[near], x[near], others, y, k, metric, None if limits is None else limits[near]))
        src, dst, dist = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        order = np.lexsort((dst, dist, src))
        src = src[order]
        keep = np.arange(len(src)) - np.searchsorted(src, src) < k
        return pa.table({"src": src[keep].astype(np.int64), "dst": dst[order][keep].astype(np.int64), "dist": dist[order][keep].astype(float)})

    needed = checkpoint(asked.select("part", "x", "kind", "limits").mapInArrow(pairs, "a long, b long").distinct())
    # Both sides may stem from one table: new names keep them apart.
    left = asked.select(F.col("part").alias("a"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.col("kind").alias("q_kind"), "limits").join(needed, "a")
    right = held.select(F.col("part").alias("_b"), "cell", "ids", "x", "kind").join(needed.select(F.col("a").alias("_a"), F.col("b").alias("_b")), "_b")
    return left.groupBy("a", "b").cogroup(right.groupBy("_a", "_b")).applyInArrow(search, _SCHEMA)


def _limits(rows: pa.Table, at: int) -> np.ndarray | None:
    value = rows["limits"][at]
    return np.frombuffer(value.as_buffer(), float) if value.is_valid else None


def knn(points: DataFrame, k: int, metric: str | Callable[[Column, Column], Column] | None = None, queries: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest points of each point, or of each query (which is not its own neighbour if the ids agree).

    ``metric``: a name, a SQL expression over arrays ``x`` and ``y``, or a function of two columns. Where fewer than
    ``k`` others exist, there are fewer rows. Points with features that are null or not finite are no neighbours and
    have none.
    """
    if k < 1:
        raise ValueError("k must be positive")
    name = metric_meant(points, metric)
    if name:
        return _ranked(_exact(points, k, name, queries, block), k)
    queries = points if queries is None else queries
    n = points.count()
    blocks = max(1, -(-n // block))
    of = lambda df, col: df.withColumn(col, F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    own = of(queries.select("id", "features"), "_a").withColumn("_b", every)
    other = of(points.select("id", "features"), "_b").withColumn("_a", every)
    pairs = own.select("_a", "_b", F.col("id").alias("src"), F.col("features").alias("x")).join(other.select("_a", "_b", F.col("id").alias("dst"), F.col("features").alias("y")), ["_a", "_b"])
    return _ranked(_fewer(pairs.filter("src <> dst").select("src", "dst", distance(metric).alias("dist")).filter(finite(F.col("dist"))), k), k)


def _fewer(found: DataFrame, k: int, most: int = 1 << 20) -> DataFrame:
    """Without rows that are not among the first ``k`` of their src within a stretch of a task's rows, so that pairs of all are
    neither shuffled nor sorted."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def kept() -> pa.Table:
            rows = pa.Table.from_batches(held).sort_by([("src", "ascending"), ("dist", "ascending"), ("dst", "ascending")])
            src = np.asarray(rows["src"])
            return rows.filter(np.arange(len(src)) - np.searchsorted(src, src) < k)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > most:
                rows = kept()
                if len(rows) > most // 2:
                    yield from rows.to_batches()
                    rows = rows.slice(0, 0)
                held, n = rows.to_batches(), len(rows)
        if held:
            yield from kept().to_batches()

    return found.mapInArrow(first, found.schema)


def centroids(points: DataFrame, cells: int, sample: int = 20_000, rounds: int = 10, seed: int = 42, sphere: bool = False) -> np.ndarray:
    """Centres of cells, by Lloyd's rounds on a sample of ``sample`` points at most, of unit length with ``sphere``."""
    x = np.array([r["features"] for r in fixed_sample(points.select("id", "features"), sample, seed).collect()], float)
    if sphere:
        x = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]
    return lloyd(x, cells, rounds)


def lloyd(x: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Centres of rows by Lloyd's rounds, which begin at the first rows."""
    centres = x[:cells].copy()
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1)[None] - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def with_cells(points: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """A row for each point and each of its ``probes`` nearest cells: id, features, cell, probe (0: the nearest)."""
    kind = points.schema["features"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("features"))
            d = (centres * centres).sum(1)[None] - 2 * x @ centres.T
            near = np.argsort(d, axis=1, kind="stable")[:, :probes]
            rows = np.repeat(np.arange(len(x)), near.shape[1])
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(pa.array(rows)), "features": batch.column("features").take(pa.array(rows)), "cell": near.ravel().astype(np.int64), "probe": np.tile(np.arange(near.shape[1]), len(x))})

    return points.select("id", "features").mapInArrow(assign, f"id long, features {kind}, cell long, probe long")


def probes_for(points: DataFrame, k: int, metric: str | None = None, cells: int | None = None, target: float = 0.95, every: int = 50, seed: int = 42) -> int:
    """How many cells to probe for a recall of ``target`` at least, measured with every ``every``-th id as a query against
    all points; doubled from 1 until it is reached. All cells give recall 1."""
    cells = cells or default_cells(points)
    asked = points.filter(F.col("id") % every == 0)
    truth = checkpoint(knn(points, k, metric, queries=asked))
    probes = 1
    while probes < cells:
        found = ivf_knn(points, k, metric, cells, probes, seed=seed, queries=asked)
        reached = recall(found, truth).agg(F.avg("recall")).first()[0]
        if reached is None or reached >= target:
            break
        probes *= 2
    return min(probes, cells)


def default_cells(points: DataFrame) -> int:
    return max(1, min(int(points.count() ** 0.5), 1024))


def cell_groups(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first group and how many groups it has: cells one after another, of ``most`` points a group; a cell of
    more is cut."""
    first, parts, at, filled = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for c, n in enumerate(sizes):
        if filled and filled + n > most:
            at, filled = at + 1, 0
        first[c], parts[c] = at, max(1, -(-n // most))
        if n > most:
            at, filled = at + parts[c], 0
        else:
            filled += n
    return first, parts


def met_by_cells(queries: DataFrame, held: DataFrame, sizes: np.ndarray, asked: Callable[[np.ndarray], np.ndarray], meet: Callable, block: int | None) -> DataFrame:
    """``meet`` of the queries (id, features) with each group of cells that they ask. A query goes once to a group, however many of
    its cells it asks (``asked`` gives each row's cells), and ``meet`` sees which those are."""
    spark = queries.sparkSession
    n, d = queries.agg(F.count("*"), F.max(F.size("features"))).first()
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    dealt = lambda rows: block or -(-int(rows) // groups_for(spark, int(rows), d or 1))
    first, parts = cell_groups(sizes, max(1, dealt(sizes.sum())))
    sides = max(1, -(-n // max(1, dealt(n))))
    kind = queries.schema["features"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = asked(_matrix(batch.column("features")))
                found = [np.unique(np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in row])) for row in near]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(rows), "features": batch.column("features").take(rows), "group": np.concatenate(found)})

    places = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in range(len(sizes))], "cell long, _first long, _parts long")
    left = queries.select("id", "features").mapInArrow(ask, f"id long, features {kind}, group long")
    left = left.select(F.col("id").alias("q_id"), F.col("features").alias("q_features"), F.col("group").alias("q_group"), F.pmod(F.xxhash64("id"), F.lit(sides).cast("long")).alias("q_side"))
    right = held.join(F.broadcast(places), "cell").withColumn("group", F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_parts"))).withColumn("side", every(F.lit(sides).cast("long")))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        src, dst, dist = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if len(left) and len(right):
            right = right.sort_by("cell")
            x = _matrix(left["q_features"])
            asks = np.zeros((len(x), len(sizes)), bool)
            np.put_along_axis(asks, asked(x), True, 1)
            src, dst, dist = meet(np.asarray(left["q_id"]), x, asks, right)
        return pa.table({"src": src.astype(np.int64), "dst": dst.astype(np.int64), "dist": dist.astype(float)})

    return left.groupBy("q_group", "q_side").cogroup(right.drop("_first", "_parts").groupBy("group", "side")).applyInArrow(search, _SCHEMA)


def cell_sizes(home: DataFrame, cells: int) -> np.ndarray:
    sizes = np.zeros(cells, np.int64)
    for r in home.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row for each cell
        sizes[r["cell"]] = r["n"]
    return sizes


def ivf_knn(points: DataFrame, k: int, metric: str | None = None, cells: int | None = None, probes: int | None = None, block: int | None = None, seed: int = 42, queries: DataFrame | None = None) -> DataFrame:
    """Approximate neighbours by inverted lists, of ``probes`` cells or as many as ``probes_for`` finds. Cells lie in groups of
    bounded bytes (or of ``block`` points) that a query meets once, and a larger cell is cut, so no task holds a whole hot cell."""
    name = metric_name(metric)
    if name is None:
        raise ValueError("inverted lists need a built-in metric")
    cells = cells or default_cells(points)
    probes = min(probes or probes_for(points, k, metric, cells, seed=seed), cells)
    centres = centroids(points, cells, seed=seed)
    home = written(with_cells(points, centres, 1).drop("probe"), "ivf-cells")

    def asked(x: np.ndarray) -> np.ndarray:
        return np.argsort((centres * centres).sum(1)[None] - 2 * x @ centres.T, axis=1, kind="stable")[:, :probes]

    def meet(ids: np.ndarray, x: np.ndarray, asks: np.ndarray, right: pa.Table) -> tuple:
        others, y, cell = np.asarray(right["id"]), _matrix(right["features"]), np.asarray(right["cell"])
        place = np.arange(len(ids))  # of rows, as ids may be there twice
        row, dst, dist, limits = np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.full(len(ids), np.inf)
        for at in range(0, len(y), BLOCK):
            part = slice(at, at + BLOCK)
            rows = place[asks[:, np.unique(cell[part])].any(1)]
            if not len(rows):
                continue
            order = np.argsort(ids[rows], kind="stable")
            rows = rows[order]
            found = best(ids[rows], x[rows], others[part], y[part], k, name, limits[rows], (asks[rows], cell[part]))
            row, dst, dist = (np.concatenate(c) for c in zip((row, dst, dist), (rows[np.searchsorted(ids[rows], found[0])], *found[1:]), strict=True))
            order = np.lexsort((dst, dist, row))
            order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
            row, dst, dist = row[order], dst[order], dist[order]
            own, begin, count = np.unique(row, return_index=True, return_counts=True)
            limits[own[count >= k]] = dist[begin[count >= k] + k - 1]
        return ids[row], dst, dist

    return _ranked(met_by_cells(points if queries is None else queries, home, cell_sizes(home, len(centres)), asked, meet, block), k)


def auto_knn(points: DataFrame, k: int, metric=None) -> DataFrame:
    """The search of layouts and scores: exact at every size, whatever the metric."""
    return knn(points, k, metric)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per src: the share of its true neighbours that were found."""
    hit = truth.select("src", "dst").join(found.select("src", "dst").withColumn("_hit", F.lit(1)), ["src", "dst"], "left")
    return hit.groupBy("src").agg((F.count("_hit") / F.count("*")).alias("recall"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Each undirected edge in both directions once, no loops: src, dst."""
    one = edges.select("src", "dst")
    return one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def normalized_adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, val of D^-1/2 A D^-1/2."""
    d = degrees(edges)
    return edges.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("degree").alias("_d")), "dst").select("src", "dst", (1 / F.sqrt(F.col("degree") * F.col("_d"))).alias("val"))


def times(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """Matrix (src, dst, val) times vectors (id, v): id, v."""
    return matrix.join(vector.select(F.col("id").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("val") * F.col("v")).alias("v"))
