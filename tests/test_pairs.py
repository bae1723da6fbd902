"""What compares all pairs by groups, against brute force."""

import math

import numpy as np
import pytest

from starfield import catalog
from starfield.operators import cluster, embedding, knn, quality, spanning, topology

NEAREST = spanning.knn
POINTS = "id long, features array<double>, label int"


def cloud(spark, x):
    return spark.createDataFrame([(i * 3 + 1, [float(v) for v in row], 0) for i, row in enumerate(x)], POINTS)


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def prim(x):
    d, far, inside, now, out = distances(x), np.full(len(x), np.inf), np.zeros(len(x), bool), 0, []
    for _ in range(len(x) - 1):
        inside[now] = True
        far = np.where(inside, np.inf, np.minimum(far, d[now]))
        now = int(far.argmin())
        out.append(far[now])
    return sorted(out)


def far_groups():
    """Groups that no point's nearest neighbours lead out of, one far from the origin, and copies."""
    draw = np.random.default_rng(5)
    groups = [draw.normal(c, 0.1, (40, 3)) for c in (0, 3, 9, 1000)]
    return np.concatenate([*groups, groups[0][:10]])


def grid():
    """Nearly all lengths are equal."""
    return np.array([(a, b) for a in range(9) for b in range(7)], float)


@pytest.mark.parametrize("small", [10**6, 0])
@pytest.mark.parametrize("x", [far_groups(), grid()], ids=["groups", "grid"])
def test_spanning_lengths_equal_prim(spark, x, small):
    found = sorted(r["length"] for r in spanning.spanning_lengths(cloud(spark, x), 3, small).collect())
    assert np.allclose(found, prim(x), atol=1e-9)


def test_h0_bars_keep_no_table_of_pairs(spark, monkeypatch):
    """The search asks for a few neighbours of each point, not for all; points that are not finite stay alone."""
    asked = []
    monkeypatch.setattr(spanning, "knn", lambda p, k: asked.append(k) or NEAREST(p, k))
    x = np.concatenate([far_groups(), [[np.nan] * 3]])
    found = sorted(r["death"] for r in topology.h0_bars(cloud(spark, x)).collect())
    assert asked == [16] and found[-2:] == [math.inf] * 2 and np.allclose(found[:-2], prim(x[:-1]), atol=1e-9)


def test_islands_equal_those_of_prim_without_all_pairs(spark, sf_dir, monkeypatch):
    asked = []
    monkeypatch.setattr(spanning, "knn", lambda p, k: asked.append(k) or NEAREST(p, k))
    deaths = prim(np.array([r["features"] for r in catalog.vectors(spark, sf_dir).collect()], float))
    found = catalog.h0_islands(spark, sf_dir).first()
    assert asked == [16] and np.allclose([found["longest"], found["top_ratio"]], [deaths[-1], np.mean(deaths[-5:]) / np.median(deaths)], atol=1e-5)


@pytest.mark.parametrize("metric", [catalog.L1, "abs(x[0] - y[0]) + 2 * abs(x[1] - y[1])"])
def test_expressions_equal_brute_force(spark, metric, monkeypatch):
    """An expression that means a built-in metric is searched as that one; others keep a few rows of a task."""
    x = np.concatenate([np.random.default_rng(3).normal(1e4, 1, (60, 3)), grid()[:, [0, 1, 1]]])
    x = np.concatenate([x, x[:5]])
    exact, fewer, used = knn._exact, knn._fewer, []
    monkeypatch.setattr(knn, "_exact", lambda *a: used.append(a[2]) or exact(*a))
    monkeypatch.setattr(knn, "_fewer", lambda found, k: used.append("pairs") or fewer(found, k, most=500))
    d = np.abs(x[:, None] - x[None]) @ ([1, 1, 1] if metric == catalog.L1 else [1, 2, 0])
    np.fill_diagonal(d, np.inf)
    found = {(r["src"], r["rank"]): (r["dst"], r["dist"]) for r in knn.knn(cloud(spark, x), 4, metric, block=20).collect()}
    assert used == ["manhattan" if metric == catalog.L1 else "pairs"] and len(found) == 4 * len(x)
    for i, row in enumerate(d):
        for rank, j in enumerate(np.lexsort((np.arange(len(x)), row.round(9)))[:4], 1):
            assert math.isclose(found[3 * i + 1, rank][1], row[j], abs_tol=1e-9)


def test_silhouette_equals_brute_force(spark, monkeypatch):
    """Clusters that are whole, cut by groups, of one point, of copies, and points without one, in many groups."""
    monkeypatch.setattr(cluster, "groups_for", lambda *_: 4)
    x = np.concatenate([far_groups()[::4], np.zeros((4, 3))])
    of = [*(i % 3 for i in range(30)), 7, *[8] * (len(x) - 33), None, None]
    p = cloud(spark, x)
    rows = [(i * 3 + 1, c) for i, c in enumerate(of)]
    d, each = distances(x), []
    for i, c in enumerate(of):
        mean = {k: np.mean(own) for k in set(of) if (own := [d[i, j] for j in range(len(x)) if j != i and of[j] == k]) and k is not None}
        a, b = mean.get(c), min((v for k, v in mean.items() if k != c), default=None)
        each.append(0 if c is None or a is None or b is None or max(a, b) == 0 else (b - a) / max(a, b))
    found = cluster.silhouette(p, spark.createDataFrame(rows, "id long, cluster int")).first()[0]
    assert math.isclose(found, np.mean(each), abs_tol=1e-9)


def test_trustworthiness_equals_brute_force(spark, monkeypatch):
    """Ranks with ties and copies, in many groups, without a table of all pairs."""
    asked, k = [], 5
    monkeypatch.setattr(quality, "groups_for", lambda *_: 2)
    monkeypatch.setattr(quality, "knn", lambda p, k: asked.append(k) or NEAREST(p, k))
    high = np.concatenate([grid(), grid()[:9] * 1.0])
    low = np.random.default_rng(1).normal(0, 1, high.shape)
    n, order = len(high), lambda x, i: [j for j in sorted(range(len(x)), key=lambda j: (distances(x)[i, j], j)) if j != i]
    penalty = sum(max(order(high, i).index(j) + 1 - k, 0) for i in range(0, n) for j in order(low, i)[:k])
    layout = cloud(spark, low).withColumnRenamed("features", "coords")
    found = quality.trustworthiness(cloud(spark, high), layout, k)
    assert math.isclose(found, 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * penalty) and asked == [k]


@pytest.mark.parametrize("d, least", [(2, 4), (3, 3)])
def test_dbscan_equals_brute_force_and_stores_no_pairs(spark, d, least, monkeypatch):
    """Dense and sparse cells, cells in parts, borders between clusters, copies and noise."""
    draw = np.random.default_rng(d)
    x = np.concatenate([draw.normal(0, 0.35, (60, d)), draw.uniform(-2, 2, (90, d)), np.zeros((5, d)), np.arange(12)[:, None] * np.array([[0.25] + [0] * (d - 1)]) + 3])
    eps, ids = 0.25, draw.permutation(len(x))
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    root = np.where(core, ids, 10**6)
    for _ in range(len(x)):
        root = np.where(core, np.where(near & core[None], root[None], 10**6).min(1), 10**6)
    root = np.where(core, root, np.where(near & core[None], root[None], 10**6).min(1))
    names = {r: k for k, r in enumerate(sorted(set(root[core])))}
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, coords array<double>")
    found = {r["id"]: r["cluster"] for r in cluster.dbscan(rows, eps, least, block=7).collect()}
    assert found == {int(i): names.get(r, -1) for i, r in zip(ids, root, strict=True)} and not hasattr(cluster, "within")


def test_kernel_rounds_are_as_wide_as_close_eigenvalues_ask(spark):
    """Many values near the wanted ones make a round wide, a steep fall does not; a round equals the dense product."""
    assert embedding._width(np.r_[np.linspace(1, 0.9, 20), np.full(80, 1e-3)], 2) >= 20
    assert embedding._width(0.01 ** np.arange(100), 2) < 20
    draw = np.random.default_rng(7)
    x, r = draw.normal(0, 1, (90, 3)), draw.normal(0, 1, (90, 4))
    table = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, r, strict=True))], "id long, features array<double>, r array<double>")
    got = np.array([row["w"] for row in embedding._kernel_times(table, 0.3, 25).orderBy("id").collect()])
    assert np.allclose(got, np.exp(-0.3 * distances(x) ** 2) @ r, atol=1e-9)
