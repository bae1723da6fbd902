"""Hand-made cases, known shapes and invariants."""

import gzip
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starfield import catalog
from starfield.functions.vectors import metric_name
from starfield.operators import cluster, embedding, intrinsic, knn, points, quality, text, timeseries, topology
from starfield.operators.components import components, spanning_forest
from starfield.runner import ReducerRunner, plot_frame
from starfield.sources import files, generators
from starfield.streaming.bars import streaming_bars

POINTS = "id long, features array<double>, label int"


def cloud(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x], 0) for i, x in enumerate(rows)], POINTS)


def nearest(df):
    return {(r["src"], r["rank"]): r["dst"] for r in df.collect()}


def test_cosine_of_three_points(spark):
    found = nearest(knn.knn(cloud(spark, [(1, 0), (2, 0), (0, 1)]), 1, "cosine"))
    assert found[0, 1] == 1 and found[1, 1] == 0


def test_duplicates_leave_self_out_by_id(spark):
    found = nearest(knn.knn(cloud(spark, [(0, 0), (0, 0), (5, 5), (5, 5), (9, 0)]), 2))
    assert (found[0, 1], found[1, 1], found[2, 1], found[3, 1]) == (1, 0, 3, 2)
    assert all(src != dst for (src, _), dst in found.items())


def test_blocks_do_not_change_neighbours(spark):
    p = generators.gaussian(spark, 200, 5)
    rows = [sorted(map(tuple, knn.knn(p, 6, block=b).select("src", "rank", "dst").collect())) for b in (4096, 50, 33)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 1200


def test_fewer_neighbours_than_asked(spark):
    assert knn.knn(cloud(spark, [(0, 0), (1, 1)]), 5).count() == 2


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "inner_product", "cosine"])
def test_hundreds_of_copies_give_the_smallest_ids(metric):
    rng = np.random.default_rng(5)
    ids = rng.permutation(1200) + 7
    x = rng.standard_normal((1200, 6))
    x[100:600] = x[100]
    x[600:900] = x[600]
    src, dst, dist = knn.best(ids, x, ids, x, 5, metric)
    for i in range(len(x)):
        d = knn.exact_distances(x[i][None], x, metric)
        order = [j for j in np.lexsort((ids, d)) if j != i][:5]
        assert dst[src == ids[i]].tolist() == ids[order].tolist() and dist[src == ids[i]].tolist() == d[order].tolist()


def test_copies_give_the_same_neighbours_in_all_blocks(spark):
    rows = [(1.5, 2.5, -0.5) if i % 3 else (i, -i, 0.5) for i in range(400)]
    copies = [i for i in range(400) if i % 3]
    want = {(src, dst) for src in copies for dst in [i for i in copies if i != src][:4]}
    for block in (4096, 90):
        found = {(r["src"], r["dst"]) for r in knn.knn(cloud(spark, rows), 4, block=block).collect() if r["src"] % 3}
        assert found == want


def test_neighbours_far_from_the_origin():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((700, 4)) + 1e9
    x[0] = 0
    ids = np.arange(700)
    src, dst, _ = knn.best(ids, x, ids, x, 3, "euclidean")
    for i in range(700):
        d = knn.exact_distances(x[i][None], x, "euclidean")
        assert dst[src == i].tolist() == [j for j in np.lexsort((ids, d)) if j != i][:3]


def test_metric_names():
    assert [metric_name(m) for m in (None, " L2 ", "Euclidean", "cosine", "abs(x[0])")] == ["euclidean", "euclidean", "euclidean", "cosine", None]
    with pytest.raises(ValueError):
        metric_name(3)


def test_ivf_recall(spark):
    p = generators.blobs(spark, 600, 8, centers=6)
    r = knn.recall(knn.ivf_knn(p, 5, cells=8, probes=4, block=64), knn.knn(p, 5))
    assert r.agg(F.avg("recall")).first()[0] > 0.9
    noise = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.random.default_rng(3).normal(size=(900, 16)))], "id long, features array<double>")
    truth = knn.knn(noise, 5)
    assert knn.recall(knn.ivf_knn(noise, 5, cells=30, probes=1), truth).agg(F.avg("recall")).first()[0] < 0.6
    assert knn.recall(knn.ivf_knn(noise, 5, cells=30), truth).agg(F.avg("recall")).first()[0] > 0.9


def _cloud():
    """Far clusters, copies of one place, a tiny cluster, the origin, and one point very far away."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 5)) * 5
    return np.vstack([centres[rng.integers(0, 12, 400)] + rng.normal(size=(400, 5)) * 0.2, np.ones((60, 5)), rng.normal(size=(40, 5)) * 1e-9, np.zeros((3, 5)), np.full((1, 5), 1e12)])


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "cosine", "inner_product"])
@pytest.mark.parametrize("apart", [False, True])
def test_knn_of_cells_is_exact(spark, metric, apart):
    x = _cloud()
    odd = [(10_000, [float("nan")] * 5), (10_001, None), (10_002, [None] * 5), (10_003, [float("inf")] * 5)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "id long, features array<double>")
    queries = df.filter("id % 3 = 0") if apart else None
    got = defaultdict(list)
    for r in knn.knn(df, 7, metric, queries=queries, block=32).orderBy("src", "rank").collect():
        got[r.src].append((r.dst, r.dist))
    assert set(got) == {i for i in range(len(x)) if i % 3 == 0 or not apart}
    for i, found in got.items():
        d = knn.exact_distances(x[i][None], x, metric)
        want = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:7]
        assert [j for j, _ in found] == want and np.allclose([v for _, v in found], d[want], rtol=1e-12, atol=1e-300)


def test_knn_prunes_groups(spark, monkeypatch):
    """Of far clusters in small groups only few pairs of groups meet."""
    rng = np.random.default_rng(4)
    x = (np.repeat(np.arange(16), 64)[:, None] * 100 + rng.normal(size=(1024, 3))).tolist()
    df = spark.createDataFrame(list(enumerate(x)), "id long, features array<double>")
    monkeypatch.setattr(knn, "GROUP_BYTES", 1)
    seen = []
    monkeypatch.setattr(knn, "checkpoint", lambda d: seen.append(d.count()) or d)
    assert knn.knn(df, 4, block=64).count() == 4096
    # At least 16 cells' worth of blocks, so 256 pairs or more without bounds.
    assert 16 <= seen[-1] < 150


def test_kernel():
    a, b = embedding.kernel()
    assert abs(a - 1.8956) < 1e-3 and abs(b - 0.8006) < 1e-3
    a, b = embedding.kernel(spread=3.6)
    assert abs(a - 0.2519) < 1e-3 and abs(b - 0.7933) < 1e-3


@pytest.mark.parametrize("init", ["pca", "random"])
def test_layout_is_standardised_and_repeatable(spark, init):
    p = generators.blobs(spark, 100, 10)
    first, again = (embedding.create_reducer(init=init, max_iter=20, n_neighbors=10).fit_transform(p.repartition(n)) for n in (1, 5))
    assert quality.procrustes(first, again) < 1e-10
    x = np.array([r["coords"] for r in first.collect()])
    assert np.abs(x.mean(0)).max() < 1e-9 and np.abs(x.std(0, ddof=1) - 1).max() < 1e-9


def test_clusters_stay_apart(spark):
    p = generators.blobs(spark, 120, 10)
    layout = embedding.create_reducer(n_neighbors=10, max_iter=32).fit_transform(p)
    apart = cluster.separation(quality.as_points(layout).join(p.select("id", "label"), "id")).first()[0]
    assert apart > 0.5


def test_reducer_checks(spark):
    for bad in ({"n_components": 0}, {"n_neighbors": -1}, {"init": "diffusion"}, {"repulsion": "none"}):
        with pytest.raises(ValueError):
            embedding.create_reducer(**bad)
    with pytest.raises(ValueError):
        embedding.create_reducer("gpu")
    with pytest.raises(ValueError):
        embedding.create_reducer().fit(cloud(spark, []))
    with pytest.raises(ValueError):
        embedding.create_reducer().fit(cloud(spark, [(1, 2), (float("nan"), 0)]))
    with pytest.warns(UserWarning):
        assert embedding.create_reducer(n_neighbors=25, max_iter=2).fit(generators.blobs(spark, 20, 5)).n_neighbors == 19
    assert embedding.create_reducer().fit_transform(cloud(spark, [(3, 4)])).first()["coords"] == [0.0, 0.0]


def test_identical_points(spark):
    x = embedding.create_reducer(n_neighbors=3, max_iter=4).fit_transform(cloud(spark, [(1, 1)] * 10)).collect()
    assert all(math.isfinite(v) for r in x for v in r["coords"])


def test_samples(spark):
    p = generators.gaussian(spark, 300, 2)
    with pytest.raises(ValueError):
        points.bernoulli(p, 1.5)
    ids = {r["id"] for r in points.bernoulli(p, 0.3).collect()}
    assert ids == {r["id"] for r in points.bernoulli(p.repartition(7), 0.3).collect()} and 50 < len(ids) < 130
    assert [r["idx"] for r in points.numbered(p.repartition(5), "id").orderBy("id").collect()] == list(range(300))


def test_string_feature_is_an_error(spark):
    with pytest.raises(TypeError):
        points.assemble(spark.createDataFrame([(1, "a")], "id long, x string"), "id")


def test_components_and_forest(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (None, 9)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    p = generators.gaussian(spark, 7, 2)
    pairs = knn.knn(p, 6).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("dist").alias("length"))
    one, other = (sorted(map(tuple, spanning_forest(p, pairs, small=s).collect())) for s in (10**6, 0))
    assert one == other and len(one) == 6


def test_circle_has_one_loop(spark):
    p = generators.circle(spark, 100)
    assert topology.full_complex(p, 10, density=0.7) == (1, 1)
    bars = topology.rips_bars(generators.circle(spark, 40, noise=0.01))
    assert topology.significant(bars).count() == 1


def test_small_complexes(spark):
    assert tuple(topology.betti_curve(cloud(spark, [(0, 0), (9, 9)])).first())[:4] == (0, 0.0, 1, 0)
    two = topology.betti_curve(cloud(spark, [(k, 0) for k in range(6)] + [(100 + k, 0) for k in range(6)]), 2, n_steps=1)
    assert two.first()["beta_0"] == 2


def test_dtw():
    assert topology.dtw([1, 2, 3], [1, 2, 2, 3]) == 0
    assert topology.dtw([0], [3]) == 3


def test_dbscan(spark):
    layout = cloud(spark, [(0, 0), (0.1, 0), (0, 0.1), (5, 5), (5.1, 5), (5, 5.1), (20, 20)]).select("id", F.col("features").alias("coords"))
    assert [r["cluster"] for r in cluster.dbscan(layout, 0.3, 3).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, -1]


def test_dbscan_of_copies_equals_brute_force(spark):
    at = np.random.default_rng(5).integers(0, 9, (150, 2)) / 4.0
    at[40:90] = at[40]
    found = {r["id"]: r["cluster"] for r in cluster.dbscan(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(at)], "id long, coords array<double>"), 0.25, 9).collect()}
    near = ((at[:, None] - at[None]) ** 2).sum(2) <= 0.25**2
    core, root = near.sum(1) >= 9, np.arange(150)
    for _ in range(150):
        root = np.array([min(root[near[i] & core]) if core[i] else i for i in range(150)])
    roots = sorted(set(root[core]))
    want = {i: roots.index(min(root[near[i] & core])) if (near[i] & core).any() else -1 for i in range(150)}
    assert found == want and len(roots) > 1 and -1 in want.values()


def test_elbows():
    assert cluster.kneedle([1.0, 2.0]) == cluster.kneedle([1.0] * 5) == 1
    assert cluster.share_elbow([0.5, 0.96]) == 2 and cluster.share_elbow([0.1, 0.2]) == 2


def test_procrustes_differs(spark):
    a, b = (generators.gaussian(spark, 50, 2, seed=s).select("id", F.col("features").alias("coords")) for s in (1, 2))
    assert quality.procrustes(a, a) < 1e-12 and quality.procrustes(a, b) > 0.1


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("f,g,label\n1,2,x\n3,4,y\n")
    assert [(r["features"], r["label"]) for r in files.read_points(spark, str(tmp_path / "a.csv"), "label").orderBy("id").collect()] == [([1.0, 2.0], "x"), ([3.0, 4.0], "y")]
    np.save(tmp_path / "a.npy", np.arange(6).reshape(3, 2))
    assert files.read_points(spark, str(tmp_path / "a.npy")).count() == 3
    np.savez(tmp_path / "b.npz", X=np.ones((4, 2)), y=np.arange(4))
    assert {r["label"] for r in files.read_points(spark, str(tmp_path / "b.npz")).collect()} == {"0", "1", "2", "3"}
    (tmp_path / "a.arff").write_text("% note\n@relation r\n@attribute u numeric\n@attribute class {a,b}\n@attribute v real\n@data\n1,a,2\n{0 5, 1 b}\n")
    assert [(r["features"], r["label"]) for r in files.read_points(spark, str(tmp_path / "a.arff")).orderBy("id").collect()] == [([1.0, 2.0], "a"), ([5.0, 0.0], "b")]
    with gzip.open(tmp_path / "c.txt.gz", "wt") as f:
        f.write("m\tindividual\tlabel\n5\t1\t2.0\n10\t1\t\n")
    row = files.read_cytometry(spark, str(tmp_path / "c.txt.gz")).collect()
    assert len(row) == 1 and row[0]["label"] == 2 and abs(row[0]["features"][0] - math.asinh(1)) < 1e-12
    with pytest.raises(ValueError):
        files.read_points(spark, "a.xls")


def test_selectors():
    assert files.parse_selector("x.csv") == ("file", "x.csv")
    assert files.parse_selector("generate:blobs") == ("generate", "blobs")
    assert files.parse_selector("moons") == ("generate", "moons")


def test_generators(spark):
    for name in generators.GENERATORS:
        assert generators.generate(spark, name, n=5).filter(F.exists("features", lambda x: F.isnan(x))).count() == 0
    with pytest.raises(ValueError):
        generators.generate(spark, "nothing")
    lifted = generators.lifted(generators.circle(spark, 20), 10)
    norms = [np.linalg.norm(r["features"]) for r in lifted.collect()]
    assert len(lifted.first()["features"]) == 10 and np.allclose(norms, 1)


def test_runner(spark):
    run = ReducerRunner(reducer_options={"params": embedding.Parameters(n_neighbors=8, max_iter=16)}).run(spark, "generate:blobs", n=60, d=5)
    assert run.dataset_info == {"selector": "generate:blobs", "n_samples": 60, "n_features": 5} and run.fit_time_sec > 0
    assert plot_frame(run, 10).count() == 10


def test_empty_buckets_count(spark):
    rows = [(0, "2024-01-01 00:00:00", "a", 1.0, 1.0), (1, "2024-01-01 00:10:00", "a", 2.0, 1.0)]
    t = spark.createDataFrame(rows, "event_id long, ts string, key string, price double, size double").withColumn("ts", F.to_timestamp("ts"))
    assert timeseries.spine(t, 60).count() == 11
    assert timeseries.bucket_features(t, 60).count() == 0


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = streaming_bars(timeseries.from_events(stream), late="0 seconds").writeStream.outputMode("append").format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    batch = {(r["key"], r["ts"]): r["close"] for r in timeseries.bars(timeseries.from_events(events)).collect()}
    found = {(r["key"], r["ts"]): r["close"] for r in spark.table("bars").collect()}
    assert found and all(batch[k] == v for k, v in found.items()) and len(found) >= len(batch) - 5


def test_markdown(spark):
    df = spark.createDataFrame([("# T\n\n **b**  \n",)], "t string")
    assert df.select(text.plain(F.col("t")).alias("t")).first()["t"] == "T\nb"


def test_kernel_components(spark):
    """Exact with all points as landmarks: eigenvectors of the centred kernel matrix, up to sign; near with fewer."""
    p = generators.gaussian(spark, 80, 3)
    rows = p.orderBy("id").collect()
    x = np.array([r["features"] for r in rows])
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 3)
    centre = np.eye(80) - 1 / 80
    values, vectors = np.linalg.eigh(centre @ kernel @ centre)
    expected = (vectors * np.sqrt(np.maximum(values, 0)))[:, ::-1][:, :2]
    got = np.array([r["coords"] for r in embedding.kernel_pca(p, 2).orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(expected), atol=1e-6)
    near = np.array([r["coords"] for r in embedding.kernel_pca(p, 2, landmarks=60).orderBy("id").collect()])
    assert all(abs(np.corrcoef(near[:, k], expected[:, k])[0, 1]) > 0.98 for k in range(2))
    assert embedding.kernel_pca(p.limit(0), 2).count() == 0


def test_parameter_search(spark):
    p = generators.blobs(spark, 120, 4)
    space = {"n_neighbors": (5, 12), "spread": (1.0, 3.0), "init": ["pca", "random"]}
    one, again = (intrinsic.search(p, space, trials=2, base=embedding.Parameters(max_iter=8)).drop("seconds").collect() for _ in range(2))
    assert one == again and [r["trial"] for r in one] == [0, 1]
    assert all(0 <= r["score"] <= 1 and r["error"] >= 0 for r in one)
    with pytest.raises(ValueError, match="unknown parameters"):
        intrinsic.search(p, {"no_such": [1]})


def test_h0_bars_are_the_spanning_tree(spark, sf_dir):
    """The query over the whole table against Prim's algorithm."""
    x = np.array([r["features"] for r in catalog.vectors(spark, sf_dir).collect()], float)
    far, inside, deaths = np.full(len(x), np.inf), np.zeros(len(x), bool), []
    now = 0
    for _ in range(len(x) - 1):
        inside[now] = True
        far = np.where(inside, np.inf, np.minimum(far, np.sqrt(((x - x[now]) ** 2).sum(1))))
        now = int(far.argmin())
        deaths.append(far[now])
    found = sorted(r["death"] for r in catalog.h0_bars(spark, sf_dir).collect())
    assert found[-1] == math.inf and np.allclose(found[:-1], sorted(deaths), atol=1e-5)


def test_kernel_components_of_many_points_are_exact(spark):
    """More points than landmarks, in several blocks."""
    p = generators.gaussian(spark, 700, 5)
    x = np.array([r["features"] for r in p.orderBy("id").collect()])
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 5)
    centre = np.eye(700) - 1 / 700
    values, vectors = np.linalg.eigh(centre @ kernel @ centre)
    expected = (vectors * np.sqrt(np.maximum(values, 0)))[:, ::-1][:, :2]
    got = np.array([r["coords"] for r in embedding.kernel_pca(p, 2, block=300).orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(expected), atol=1e-5)


def test_axes_of_many_dimensions(spark):
    r = np.random.default_rng(1)
    base, turn = r.standard_normal((120, 3)) * [9, 5, 2], np.linalg.qr(r.standard_normal((3000, 3)))[0].T
    x = base @ turn + 0.01 * r.standard_normal((120, 3000)) + 7
    p = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "id long, features array<double>").repartition(4)
    mean, axes, values = embedding.principal_axes(p, 3)
    centred = x - x.mean(0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(mean, x.mean(0)) and np.allclose(values, s[:3] ** 2 / len(x), rtol=1e-8)
    assert np.allclose(np.abs((axes * v[:3]).sum(1)), 1, atol=1e-8)
    assert embedding.pca(p, 2).count() == 120


def test_subspace_axes_equal_the_covariance(spark):
    p = generators.blobs(spark, 300, 12)
    one, two = embedding.principal_axes(p, 2), embedding.subspace_axes(p, 2, rounds=30)
    assert np.allclose(one[0], two[0]) and np.allclose(one[2], two[2], rtol=1e-6)
    assert np.allclose(np.abs((one[1] * two[1]).sum(1)), 1, atol=1e-6)


def test_curve_methods(spark):
    p = generators.circle(spark, 40)
    atlas, rips = (topology.curve(p, method).orderBy("filtration").collect() for method in ("atlas", "rips"))
    assert max(r["beta_1"] for r in atlas) >= 1 and max(r["beta_1"] for r in rips) == 1
    with pytest.raises(ValueError, match="method"):
        topology.curve(p, "other")


def test_topology_error(spark):
    same = lambda points: points.select("id", F.col("features").alias("coords"))
    clouds = {"circle": (generators.circle(spark, 60), 1), "wrong": (generators.circle(spark, 60), 3)}
    found = {r["cloud"]: (r["found"], r["error"]) for r in topology.topology_error(same, clouds).collect()}
    assert found == {"circle": (1, 0), "wrong": (1, 2)}


def test_profiled(spark):
    from starfield.runner import profiled

    rows = profiled(generators.blobs(spark, 100, 4), embedding.Parameters(max_iter=4)).collect()
    assert [r["stage"] for r in rows] == ["points", "scale", "neighbours", "start", "layout", "standardise", "quality"]
    assert all(r["seconds"] >= 0 for r in rows) and rows[4]["rows"] == 100


def test_scores_of_no_accuracy():
    assert quality.folded_score(0.0, 0.5)[2] == -abs(quality.signed_score(0.0, 0.5)[2]) and np.isfinite(quality.signed_score(0.5, 0.0)[2])


def test_stream_of_buckets_equals_batch(spark, sf_dir, tmp_path):
    """However the stream is cut, each bucket is stored once, from all of its ticks."""
    from starfield.streaming.bars import stored_features, write_buckets

    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    for part in range(4):
        events.filter(F.pmod("event_id", F.lit(4)) == part).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = write_buckets(timeseries.from_events(stream), str(tmp_path / "out"), str(tmp_path / "c"), seconds=3600, late="3650 days")
    run.processAllAvailable()
    run.stop()
    assert spark.read.schema("key string").parquet(str(tmp_path / "out")).count() == 0  # nothing is final before its time
    run = write_buckets(timeseries.from_events(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out2"), str(tmp_path / "c2"), seconds=3600, late="0 seconds")
    run.processAllAvailable()
    run.stop()
    batch = timeseries.bucket_features(timeseries.from_events(events), 3600)
    last = events.agg(F.date_trunc("hour", F.max("ts"))).first()[0]
    want = {(r["key"], r["ts"]): r["ticks"] for r in batch.filter(F.col("ts") < last).collect()}
    got = {(r["key"], r["ts"]): r["ticks"] for r in stored_features(spark, str(tmp_path / "out2"), 3600).collect()}
    assert want and got == want


def test_windows_over_chunks_equal_windows_over_instruments(spark, sf_dir):
    t = timeseries.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    t = t.withColumn("key", F.when(F.col("event_id") % 3 > 0, F.lit("hot")).otherwise(F.col("key")))
    bars = timeseries.bars(t, 600)
    rounded = lambda df: sorted(map(repr, catalog.rounded(df).collect()))
    for small, whole in (
        (timeseries.tick_steps(t, chunk=4), timeseries.tick_steps(t)),
        (timeseries.bucket_features(t, 3600, chunk=4), timeseries.bucket_features(t, 3600)),
        (timeseries.rolling_features(bars, 5, chunk=5), timeseries.rolling_features(bars, 5)),
        (timeseries.rolling_features(bars, 5, chunk=2), timeseries.rolling_features(bars, 5)),
        (timeseries.tick_features(t, 3600, 5, chunk=8), timeseries.tick_features(t, 3600, 5)),
    ):
        found = rounded(small)
        assert found and found == rounded(whole)
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    plain = t.withColumn("before", F.lag("event_id").over(w)).filter("before IS NULL").count()
    assert timeseries.tick_steps(t, chunk=4).filter("time_diff IS NULL").count() == plain
    assert timeseries.tick_steps(t.limit(0)).count() == 0


def test_long_spines(spark):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 04:00:00"), ("b", "2024-01-01 00:00:07")]
    t = spark.createDataFrame(rows, "key string, ts string").withColumn("ts", F.to_timestamp("ts"))
    found = timeseries.spine(t, 1)
    assert found.count() == found.distinct().count() == 14402
