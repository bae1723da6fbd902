"""Rounds over stretches of places against the same rounds in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfield.functions.vectors import keyed_hash
from starfield.operators import embedding, intrinsic, knn, quality, stretches
from starfield.sources import generators


@pytest.mark.parametrize("held", [1 << 20, 300])
def test_distributed_layout_equals_local(spark, held, monkeypatch):
    """Ids with gaps, several stretches, all or a part of the positions at a time."""
    p = generators.gaussian(spark, 700, 5).withColumn("id", F.col("id") * 7 + 3)
    made = stretches.Stretches
    monkeypatch.setattr(embedding, "Stretches", lambda *a: made(*a, held=held, size=150))
    options = {"n_neighbors": 6, "neg_ratio": 3.0, "max_iter": 5}
    one, other = (np.array([r["coords"] for r in embedding.create_reducer(s, **options).fit_transform(p).orderBy("id").collect()]) for s in ("local", "distributed"))
    assert one.shape == (700, 2) and np.allclose(one, other, atol=1e-8)


def test_spectral_equals_rounds_in_memory(spark, monkeypatch):
    p = generators.gaussian(spark, 90, 3)
    made = stretches.Stretches
    monkeypatch.setattr(embedding, "Stretches", lambda *a: made(*a, held=40, size=20))
    edges = knn.knn(p, 5)
    got = np.array([r["coords"] for r in embedding.spectral(p, edges, 2, rounds=6).orderBy("id").collect()])
    a = np.zeros((90, 90))
    for r in knn.normalized_adjacency(knn.symmetric(edges)).collect():
        a[r["src"], r["dst"]] = r["val"]
    v = np.array(p.orderBy("id").select(*[keyed_hash(F.col("id"), 42, c) / F.lit(float(16**12)) - 0.5 for c in range(3)]).collect())
    for turn in range(6):
        v = (v + a @ v) / 2
        if turn in (3, 5):
            v = v @ np.linalg.inv(np.linalg.cholesky(v.T @ v)).T
    assert np.allclose(got, v[:, 1:], atol=1e-8)


def test_neighbours_are_found_once(spark, monkeypatch):
    """A sweep, a search and a comparison look for the neighbours of the points themselves once; layouts have fewer dimensions."""
    asked = []
    for module in (embedding, intrinsic, quality):
        monkeypatch.setattr(module, "auto_knn", lambda p, k, metric=None: asked.append(len(p.first()["features"])) or knn.knn(p, k, metric))
    p, few = generators.gaussian(spark, 60, 5), embedding.Parameters(max_iter=1, n_neighbors=4)
    assert intrinsic.sweep(p, range(1, 3), few).count() == 2
    assert asked == [5, 1, 2]
    asked.clear()
    assert intrinsic.search(p, {"n_neighbors": (3, 20)}, 2, base=few, k=6).count() == 2
    assert asked == [5, 2, 2]
    asked.clear()
    methods = {k: v for k, v in intrinsic.reducers().items() if k in ("pca", "random")}
    rows = intrinsic.compare(spark, p, methods, ("distortion",)).collect()
    assert [r["error"] for r in rows] == [None, None] and asked == [5, 2, 2]
