"""Approximate neighbours: coded lists and descent, against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfield.operators import descent, knn, quantize
from starfield.sources import generators


def mean_recall(found, truth):
    return knn.recall(found, truth).agg(F.avg("recall")).first()[0]


@pytest.fixture(scope="module")
def cloud(spark):
    p = generators.blobs(spark, 900, 9, centers=5).select("id", "features")
    odd = spark.createDataFrame([(5000, [float("nan")] * 9), (5001, None)], "id long, features array<double>")
    return p.unionByName(odd).repartition(5), knn.knn(p, 6)


def test_codes_add_up_to_distances():
    rng = np.random.default_rng(2)
    books = quantize.Codebooks(rng.normal(size=(3, 5)), tuple(rng.normal(size=(20, w)) for w in (2, 2, 1)), (0, 2, 4, 5))
    residual, other = rng.normal(size=(4, 5)), rng.normal(size=(6, 5))
    codes, tables = books.codes(other), books.tables(residual)
    whole = np.concatenate([book[codes[:, m]] for m, book in enumerate(books.books)], 1)
    got = sum(tables[:, m, codes[:, m]] for m in range(3))
    assert np.allclose(got, ((residual[:, None] - whole[None]) ** 2).sum(2), atol=1e-4)
    assert np.array_equal(codes[:, 2], np.argmin((other[:, 4:] - books.books[2].T) ** 2, axis=1))


def test_coded_lists(spark, cloud):
    p, truth = cloud
    books = quantize.codebooks(p, cells=12)
    index = quantize.coded(p, books)
    probes, refine, reached = quantize.tuned(p, 6, books, index)
    found = quantize.pq_knn(p, 6, books, probes, refine, index=index)
    assert reached >= 0.95 and mean_recall(found, truth) > 0.93
    exact = {(r.src, r.dst): r.dist for r in truth.collect()}
    rows = found.collect()
    assert all(abs(exact[r.src, r.dst] - r.dist) < 1e-9 for r in rows if (r.src, r.dst) in exact)
    assert all(r.src != r.dst for r in rows) and {r.src for r in rows} == set(range(900))
    # Small blocks split a cell's points and its queries; all cells and a wide refinement leave nothing out.
    split = quantize.pq_knn(p, 6, books, 12, 40, queries=p.filter("id % 7 = 0"), block=20, index=index)
    assert mean_recall(split, truth.filter("src % 7 = 0")) == 1
    with pytest.raises(ValueError):
        quantize.codebooks(p.limit(0))


def test_coded_lists_of_few_points(spark):
    p = spark.createDataFrame([(k, [float(k // 2), 0.0, 1.0]) for k in range(9)], "id long, features array<double>")
    got = {(r.src, r.dst, r["rank"]) for r in quantize.pq_knn(p, 2).collect()}
    assert got == {(r.src, r.dst, r["rank"]) for r in knn.knn(p, 2).collect()}


def test_descent(spark, cloud):
    p, truth = cloud
    found = descent.descent_knn(p, 6)
    assert mean_recall(found, truth) > 0.95
    rows = found.collect()
    assert {r.src for r in rows} == set(range(900)) and all(r.src != r.dst for r in rows)
    exact = {(r.src, r.dst): r.dist for r in truth.collect()}
    assert all(abs(exact[r.src, r.dst] - r.dist) < 1e-9 for r in rows if (r.src, r.dst) in exact)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, descent.descent_knn(p.repartition(2), 6).collect()))
    assert descent.descent_knn(p.limit(0), 6).collect() == []


def test_descent_of_copies_and_hubs(spark):
    """One point that all others have as a neighbour, many copies of a place, and fewer points than neighbours."""
    x = [[0.0, 0.0]] + [[1.0, 1.0]] * 60 + [[np.cos(k), np.sin(k)] for k in range(60)]
    p = spark.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(x)], "id long, features array<double>")
    assert mean_recall(descent.descent_knn(p.filter("id > 60 OR id = 0"), 5), knn.knn(p.filter("id > 60 OR id = 0"), 5)) > 0.9
    near = descent.descent_knn(p, 5).filter("src BETWEEN 1 AND 60").agg(F.max("dist")).first()[0]
    assert near == 0
    assert descent.descent_knn(p.limit(3), 5).count() <= 6


def test_a_query_meets_a_group_of_cells_once(spark, monkeypatch):
    """With all cells asked, a query is sent once for each group, not for each cell, and the neighbours are exact."""
    rows = [(i * 3, [float(v) for v in x]) for i, x in enumerate(np.random.default_rng(2).normal(0, 1, (120, 4)))]
    p = spark.createDataFrame(rows, "id long, features array<double>")
    truth = sorted(map(tuple, knn.knn(p, 4).select("src", "dst", "rank").collect()))
    found = knn.ivf_knn(p, 4, cells=12, probes=12, block=50)
    assert sorted(map(tuple, found.select("src", "dst", "rank").collect())) == truth
    first, parts = knn.cell_groups(np.array([30, 30, 5, 130, 20]), 50)
    assert list(first) == [0, 1, 1, 2, 5] and list(parts) == [1, 1, 1, 3, 1]
    books = quantize.codebooks(p, cells=12)
    coded = quantize.pq_knn(p, 4, books, probes=12, refine=30, block=50)
    assert sorted(map(tuple, coded.select("src", "dst", "rank").collect())) == truth
