"""Order statistics by counting, and what is built on them: thresholds, equal samples, the front of trials."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfield.operators import cluster, points, topology
from starfield.operators.quantiles import order_statistics, quantiles


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "one", "tiny"])
def test_order_statistics(spark, kind):
    rng = np.random.default_rng(7)
    v = {
        "normal": rng.normal(size=3000), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.full(50, 2.5), "tiny": rng.random(2000) * 5e-324 + 5e-324,
        "wide": np.concatenate([10.0 ** rng.uniform(-300, 308, 1000) * rng.choice([-1, 1], 1000), [0.0, -0.0, 1.7e308, -1.7e308]]),
    }[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "x double").repartition(6)
    want, n = np.sort(v), len(v)
    places = sorted({0, 1, n // 3, n // 2, n - 2, n - 1})
    assert order_statistics(df, "x", places) == want[places].tolist()
    if kind != "wide":
        assert np.allclose(quantiles(df, "x", [0, 0.1, 0.5, 0.77, 1]), np.quantile(v, [0, 0.1, 0.5, 0.77, 1]))
    with pytest.raises(ValueError):
        order_statistics(df, "x", [n])
    assert quantiles(df.limit(0), "x", [0.5]) is None


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_thresholds_are_percentiles(spark):
    edges = spark.createDataFrame([(random.Random(k).random(),) for k in range(700)], "length double")
    got = [r.filtration for r in topology.thresholds(edges, 9).orderBy("step").collect()]
    want = edges.agg(F.percentile("length", F.array(*[F.lit(1 - s / 8) for s in range(9)]))).first()[0]
    assert np.allclose(got, want) and topology.thresholds(edges.limit(0), 9).collect() == []


def test_balanced_takes_the_least_hashes(spark):
    a = spark.createDataFrame([(k % 400, k) for k in range(500)], "id long, x int")
    b = spark.createDataFrame([(k, k) for k in range(123)], "id long, x int")
    one, other = points.balanced(a, b, 9)
    assert one.count() == other.count() == 123
    assert sorted(r.id for r in one.collect()) == sorted(r.id for r in points.fixed_sample(a, 123, 9).collect())
    assert [df.count() for df in points.balanced(a, b.limit(0))] == [0, 0]


def test_front_of_trials(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([rng.random(), 0.5, 0.9]), rng.choice([rng.random(), 0.1])) for k in range(400)] + [(400, None, 0.0), (401, 2.0, None)]
    beats = lambda p, q: p[1] >= q[1] and p[2] <= q[2] and (p[1] > q[1] or p[2] < q[2])
    whole = [r for r in rows if None not in r]
    want = {q[0] for q in whole if not any(beats(p, q) for p in whole)} | {400, 401}
    df = spark.createDataFrame(rows, "trial int, score double, error double").repartition(5)
    front = cluster.pareto(df)
    assert {r.trial for r in front.collect()} == want
    assert "NestedLoop" not in _plan(front) and "Cartesian" not in _plan(front)
