"""Neighbours from inverted lists of coded points (product quantisation) with exact re-ranking.

A point is stored as its cell and, for each slice of its residual from the cell's centre, the nearest entry of that
slice's codebook: a byte a slice. A query meets the codes of its nearest cells in groups, by products with the points that
the codes stand for. The best ``refine`` times ``k`` of a group are ranked by exact distances in the same task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfield.functions.vectors import finite
from starfield.operators.knn import _matrix, _ranked, cell_sizes, default_cells, exact_distances, knn, lloyd, met_by_cells, recall
from starfield.operators.points import fixed_sample
from starfield.plans.materialize import checkpoint, written

#: Entries of a codebook: a code is a byte.
ENTRIES = 256


@dataclass(frozen=True)
class Codebooks:
    """Centres of the cells, and for each slice of the dimensions (from ``cuts``) the entries of residuals."""

    centres: np.ndarray
    books: tuple[np.ndarray, ...]
    cuts: tuple[int, ...]

    def slices(self):
        return zip(self.books, self.cuts, self.cuts[1:], strict=False)

    def cells(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells of each row."""
        return np.argsort((self.centres**2).sum(1)[None] - 2 * x @ self.centres.T, axis=1, kind="stable")[:, :probes]

    def codes(self, residual: np.ndarray) -> np.ndarray:
        near = [np.argmin((book**2).sum(1)[None] - 2 * residual[:, a:b] @ book.T, axis=1) for book, a, b in self.slices()]
        return np.stack(near, 1).astype(np.uint8) if near else np.zeros((len(residual), 0), np.uint8)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances of each row's slices to all entries: rows x slices x ``ENTRIES``."""
        out = np.full((len(residual), len(self.books), ENTRIES), np.inf, np.float32)
        for m, (book, a, b) in enumerate(self.slices()):
            r = residual[:, a:b]
            out[:, m, : len(book)] = (r * r).sum(1)[:, None] + (book**2).sum(1)[None] - 2 * r @ book.T
        return out


def codebooks(points: DataFrame, cells: int | None = None, slices: int | None = None, sample: int = 20_000, rounds: int = 10, seed: int = 42) -> Codebooks:
    """Fits cells and codebooks on a sample of ``sample`` points at most. ``slices`` are two dimensions each unless given."""
    usable = points.select("id", "features").filter(F.forall("features", finite))
    x = np.array([r["features"] for r in fixed_sample(usable, sample, seed).collect()], float)
    if not len(x):
        raise ValueError("no points to fit on")
    centres = lloyd(x, min(cells or default_cells(points), len(x)), rounds)
    fitted = Codebooks(centres, (), (0,))
    residual = x - centres[fitted.cells(x, 1)[:, 0]]
    d = x.shape[1]
    cuts = np.linspace(0, d, min(d, slices or -(-d // 2)) + 1).round().astype(int)
    books = tuple(lloyd(np.ascontiguousarray(residual[:, a:b]), ENTRIES, rounds) for a, b in zip(cuts, cuts[1:], strict=False))
    return Codebooks(centres, books, tuple(int(c) for c in cuts))


def coded(points: DataFrame, books: Codebooks) -> DataFrame:
    """The index, written: id, cell, code (a byte for each slice). Points that are not finite are left out."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("features"))
                cell = books.cells(x, 1)[:, 0]
                codes = books.codes(x - books.centres[cell])
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "cell": cell.astype(np.int64), "code": pa.array([c.tobytes() for c in codes], pa.binary())})

    usable = points.select("id", "features").filter(F.forall("features", finite))
    return written(usable.mapInArrow(code, "id long, cell long, code binary"), "pq-codes")


def pq_knn(points: DataFrame, k: int, books: Codebooks | None = None, probes: int = 64, refine: int = 8, queries: DataFrame | None = None, block: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """Approximate Euclidean neighbours: src, dst, rank, dist, the distances being exact. ``index`` is a stored ``coded`` table
    of the same ``books``, to be used again. Ties go to the smaller dst; a point is not its own neighbour by id.

    A task holds a group of cells and ranks what ``refine`` times ``k`` points of smallest coded distance it has for a query, so no
    fewer are ranked than of all groups together, and no candidates are shuffled."""
    if k < 1:
        raise ValueError("k must be positive")
    books = books or codebooks(points)
    usable = lambda df: df.select("id", "features").filter(F.forall("features", finite))
    points, queries = usable(points), usable(points if queries is None else queries)
    index = coded(points, books) if index is None else index
    probes, most = min(probes, len(books.centres)), refine * k

    def meet(ids: np.ndarray, x: np.ndarray, asks: np.ndarray, right: pa.Table) -> tuple:
        others, y, cell = np.asarray(right["id"]), _matrix(right["features"]), np.asarray(right["cell"])
        codes = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(len(others), -1)
        # The coded distance is that of the point that the code stands for.
        meant = np.column_stack([np.zeros((len(others), 0)), *(book[codes[:, m]] for m, (book, _, _) in enumerate(books.slices()))]) + books.centres[cell]
        middle = meant.mean(0)
        meant, z = (meant - middle).astype(np.float32), (x - middle).astype(np.float32)
        half, keep, out = (meant * meant).sum(1) / 2, min(most, len(others)), []
        for at in range(0, len(x), 128):
            d = half - z[at : at + 128] @ meant.T
            d[~asks[at : at + 128][:, cell] | (ids[at : at + 128, None] == others[None])] = np.inf
            found = np.argpartition(d, keep - 1, axis=1)[:, :keep]
            row, col = np.nonzero(np.isfinite(np.take_along_axis(d, found, 1)))
            col = found[row, col]
            step = max(1, (1 << 21) // max(1, y.shape[1]))
            exact = np.concatenate([np.zeros(0), *(exact_distances(x[at + row[i : i + step]], y[col[i : i + step]], "euclidean") for i in range(0, len(row), step))])
            order = np.lexsort((others[col], exact, row))
            order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
            out.append((ids[at + row[order]], others[col[order]], exact[order]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    held = index.join(points, "id")
    return _ranked(met_by_cells(queries, held, cell_sizes(index, len(books.centres)), lambda x: books.cells(x, probes), meet, block), k)


def tuned(points: DataFrame, k: int, books: Codebooks, index: DataFrame, target: float = 0.95, every: int = 50) -> tuple[int, int, float]:
    """Probes and refinement for a recall of ``target`` at least, doubled until it is measured, and that recall. Every
    ``every``-th id is a query, against all points."""
    asked = points.filter(F.col("id") % every == 0)
    truth = checkpoint(knn(points, k, queries=asked))
    probes, refine = 8, 4
    while True:
        found = recall(pq_knn(points, k, books, probes, refine, asked, index=index), truth).agg(F.avg("recall")).first()[0]
        if found is None or found >= target or (probes >= len(books.centres) and refine >= 64):
            return min(probes, len(books.centres)), refine, found
        probes, refine = min(2 * probes, len(books.centres)), min(2 * refine, 64)
