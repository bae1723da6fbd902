"""All registered queries of the point-cloud engine, with their DuckDB equivalents.

Numbers are rounded to six digits, as sums depend on the order of summation. Queries without an equivalent are
compared with known results in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfield.functions.vectors import key_name
from starfield.operators import cluster, descent, embedding, intrinsic, knn, points, quality, quantize, text, timeseries, topology, warping
from starfield.operators.components import components
from starfield.plans.materialize import checkpoint
from starfield.sources import generators

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _no_negative_zero(sql: str) -> str:
    """Adds 0.0 to every round(...): rounding leaves -0.0 in one engine and 0.0 in the other."""
    out, at = [], 0
    while (begin := sql.find("round(", at)) >= 0:
        end, depth = begin + 6, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:begin], "(", sql[begin:end], " + 0.0)"]
        at = end
    return "".join([*out, sql[at:]])


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = _no_negative_zero(oracle)
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.from_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points of four dimensions with a string label; the id is that of the row's key."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    t = t.withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return points.assemble(t.select("id", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"), "id", "l_returnflag")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each nation: mean and deviation of its customers' balances, of whole tables."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").cast("long").alias("id"))
    own = c.agg(F.array(F.avg("c_acctbal").cast("double"), F.coalesce(F.stddev_pop(F.col("c_acctbal").cast("double")), F.lit(0.0))).alias("features"))
    return own.withColumn("label", F.lit(0))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def flat(p: DataFrame) -> DataFrame:
    """A layout of the first two features."""
    return p.select("id", F.slice("features", 1, 2).alias("coords"))


def scalars(df: DataFrame, *names: str) -> DataFrame:
    """Array columns as numbered scalar columns."""
    out = [c for c in df.columns if c not in names]
    return df.select(*out, *[r6(F.col(n)[k]).alias(f"{n}_{k}") for n in names for k in range(2)])


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[(F.lit(v)).alias(k) for k, v in values.items()])


V = "p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f, label FROM embeddings)"
L = "l AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3, l_returnflag AS label FROM lineitem)"
LONG = "x AS (SELECT id, unnest([0, 1, 2, 3]) AS pos, unnest([f0, f1, f2, f3]) AS v FROM l)"
T = "t AS (SELECT event_id, ts, event_type AS key, value AS price, CAST(props ->> '$.k' AS DOUBLE) AS size FROM events)"
METRIC = {
    "euclidean": "list_distance(a.f, b.f)",
    "sqeuclidean": "list_distance(a.f, b.f) * list_distance(a.f, b.f)",
    "inner_product": "-list_inner_product(a.f, b.f)",
    "cosine": "1 - list_inner_product(a.f, b.f) / (sqrt(list_inner_product(a.f, a.f)) * sqrt(list_inner_product(b.f, b.f)) + 1e-8)",
}


def knn_sql(k: int, metric: str = METRIC["euclidean"], name: str = "g", table: str = "p", where: str = "TRUE") -> str:
    return f"""{name} AS (
  SELECT src, dst, rank, dist FROM (
    SELECT a.id AS src, b.id AS dst, {metric} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {metric}, b.id) AS rank
    FROM {table} a JOIN {table} b ON a.id <> b.id WHERE {where}) WHERE rank <= {k})"""


def hash_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12) AS BIGINT)"


def edges_out(g: DataFrame) -> DataFrame:
    return g.select("src", "dst", "rank", r6("dist").alias("dist"))


# Points


@query(f"WITH {L} SELECT id, f0, f1, f2, f3, label FROM l")
def points_assemble(spark, sf_dir):
    p = lineitems(spark, sf_dir)
    return p.select("id", *[F.col("features")[k].alias(f"f{k}") for k in range(4)], "label")


@query(f"WITH {L} SELECT id, label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM l")
def label_encode(spark, sf_dir):
    return points.label_codes(lineitems(spark, sf_dir)).select("id", "label", F.col("code").cast("long").alias("code"))


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def drop_unlabeled(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    return points.labelled_only(d, "quality").select("doc_id", "quality")


@query(f"WITH {L} SELECT id, round(asinh(f0 / 5), 6) AS f0, round(asinh(f1 / 5), 6) AS f1, round(asinh(f2 / 5), 6) AS f2, round(asinh(f3 / 5), 6) AS f3 FROM l")
def arcsinh_transform(spark, sf_dir):
    p = points.arcsinh(lineitems(spark, sf_dir), 5.0)
    return p.select("id", *[r6(F.col("features")[k]).alias(f"f{k}") for k in range(4)])


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 11 = 0 THEN CAST('inf' AS DOUBLE) WHEN event_id % 13 = 0 THEN NULL ELSE value END AS v FROM events) SELECT event_id, v FROM e WHERE v IS NOT NULL AND isfinite(v)")
def finite_filter(spark, sf_dir):
    e, m = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    bad = F.when(m % 7 == 0, F.lit(float("nan"))).when(m % 11 == 0, F.lit(float("inf"))).when(m % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    p = points.finite_only(e.select("event_id", F.array(bad).alias("features")))
    return p.select("event_id", F.col("features")[0].alias("v"))


@query(f"WITH {L}, {LONG}, c AS (SELECT id, pos, v - avg(v) OVER (PARTITION BY pos) AS v FROM x), m AS (SELECT max(abs(v)) AS m FROM c) SELECT id, pos, round(v / m, 6) AS v FROM c, m")
def normalize_points(spark, sf_dir):
    return points.centred(lineitems(spark, sf_dir)).select("id", F.posexplode("features").alias("pos", "v")).withColumn("v", r6("v"))


@query(f"WITH {L}, {LONG} SELECT id, pos, round((v - avg(v) OVER w) / coalesce(nullif(stddev_pop(v) OVER w, 0), 1), 6) AS v FROM x WINDOW w AS (PARTITION BY pos)")
def zscore_points(spark, sf_dir):
    return points.z_scores(lineitems(spark, sf_dir)).select("id", F.posexplode("features").alias("pos", "v")).withColumn("v", r6("v"))


@query(f"WITH {L}, {LONG} SELECT id, pos, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-8), 6) AS v FROM x WINDOW w AS (PARTITION BY pos)")
def zscore_epsilon(spark, sf_dir):
    return points.z_scores(lineitems(spark, sf_dir), 1e-8).select("id", F.posexplode("features").alias("pos", "v")).withColumn("v", r6("v"))


@query(f"WITH {L} SELECT id, round(f0 / 255 - 0.5, 6) AS f0, round(f1 / 255 - 0.5, 6) AS f1, round(f2 / 255 - 0.5, 6) AS f2, round(f3 / 255 - 0.5, 6) AS f3 FROM l")
def pixel_scale(spark, sf_dir):
    return points.pixels(lineitems(spark, sf_dir)).select("id", *[r6(F.col("features")[k]).alias(f"f{k}") for k in range(4)])


@query(f"WITH {L}, {LONG} SELECT pos, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(stddev_samp(v), 6) AS std_sample, min(v) AS least, max(v) AS most FROM x GROUP BY pos")
def dimension_stats(spark, sf_dir):
    s = points.dimension_stats(lineitems(spark, sf_dir))
    return s.select("pos", "n", *[r6(c).alias(c) for c in ("mean", "std", "std_sample")], "least", "most")


@query("SELECT count(v) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std FROM (SELECT CASE WHEN event_id % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS v FROM events) WHERE isfinite(v) AND abs(v) < 1e12")
def welford_stats(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    return points.running_moments(e, "v").select("n", r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"SELECT vec_id FROM embeddings WHERE {hash_sql('vec_id', '42')} / CAST(281474976710656 AS DOUBLE) < 0.5")
def bernoulli_subsample(spark, sf_dir):
    return points.bernoulli(vectors(spark, sf_dir), 0.5).select(F.col("id").alias("vec_id"))


@query(f"SELECT vec_id FROM embeddings ORDER BY {hash_sql('vec_id', '42')}, vec_id LIMIT 100")
def fixed_sample(spark, sf_dir):
    return points.fixed_sample(vectors(spark, sf_dir), 100).select(F.col("id").alias("vec_id"))


@query(f"WITH n AS (SELECT least((SELECT count(*) FROM embeddings WHERE label < 3), (SELECT count(*) FROM embeddings WHERE label >= 3)) AS n), r AS (SELECT vec_id, CASE WHEN label < 3 THEN 'a' ELSE 'b' END AS cloud, row_number() OVER (PARTITION BY label < 3 ORDER BY {hash_sql('vec_id', '42')}, vec_id) AS k FROM embeddings) SELECT cloud, vec_id FROM r, n WHERE k <= n")
def balanced_sample(spark, sf_dir):
    v = vectors(spark, sf_dir)
    a, b = points.balanced(v.filter("label < 3"), v.filter("label >= 3"))
    return a.select(F.lit("a").alias("cloud"), F.col("id").alias("vec_id")).union(b.select(F.lit("b"), "id"))


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, count(*) OVER () AS n FROM events) SELECT event_id, idx FROM r WHERE idx IN (SELECT CAST(floor(i * (n - 1) / 49.0) AS BIGINT) FROM range(50) s(i), (SELECT count(*) AS n FROM events))")
def even_sample(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    return points.evenly_spaced(e, 50, "ts", "event_id").select("event_id", "idx")


@query("WITH k AS (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 15) SELECT CASE WHEN source IN (SELECT source FROM k) THEN source ELSE 'other' END AS source, count(*) AS n FROM documents GROUP BY 1")
def top_categories(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source")
    return points.most_frequent(d, "source").groupBy("source").agg(F.count("*").alias("n"))


@query(f"SELECT id, label FROM (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY {hash_sql('vec_id', '42')}, vec_id) AS k, (SELECT 100 // count(DISTINCT label) FROM embeddings) AS per FROM embeddings) WHERE k <= per")
def stratified_sample(spark, sf_dir):
    return points.stratified(vectors(spark, sf_dir), "label", 100).select("id", "label")


@query("SELECT event_id, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 100) AS BIGINT) AS frame FROM events")
def animation_frames(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    return timeseries.frames(e, 100, "ts", "event_id").select("event_id", F.col("frame").cast("long").alias("frame"))


@query("SELECT DISTINCT c_name, regexp_replace(lower(trim(c_name)), '[^a-z0-9_]+', '_', 'g') AS key FROM customer")
def key_normalize(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name", key_name(F.col("c_name")).alias("key")).distinct()


# Neighbours


@query(f"WITH {V}, {knn_sql(16)} SELECT p.label, count(*) AS n_pairs, round(avg(CASE WHEN q.label = p.label THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM g JOIN p ON p.id = src JOIN p q ON q.id = dst GROUP BY p.label")
def knn_label_agreement(spark, sf_dir):
    v = vectors(spark, sf_dir)
    g = knn.knn(v, 16).join(v.select(F.col("id").alias("src"), "label"), "src").join(v.select(F.col("id").alias("dst"), F.col("label").alias("other")), "dst")
    return g.groupBy("label").agg(F.count("*").alias("n_pairs"), r6(F.avg((F.col("label") == F.col("other")).cast("double"))).alias("agreement"))


@query(f"WITH {V}, {knn_sql(16)} SELECT src, dst, rank, round(dist, 6) AS dist FROM g")
def knn_euclidean(spark, sf_dir):
    return edges_out(knn.knn(vectors(spark, sf_dir), 16))


@query(f"WITH {V}, {knn_sql(16, METRIC['sqeuclidean'])} SELECT src, dst, rank, round(dist, 6) AS dist FROM g")
def knn_sqeuclidean(spark, sf_dir):
    return edges_out(knn.knn(vectors(spark, sf_dir), 16, "sqeuclidean"))


@query(f"WITH {V}, {knn_sql(16, METRIC['inner_product'])} SELECT src, dst, rank, round(dist, 6) AS dist FROM g")
def knn_inner_product(spark, sf_dir):
    return edges_out(knn.knn(vectors(spark, sf_dir), 16, "inner_product"))


@query(f"WITH {V}, {knn_sql(16, METRIC['cosine'])} SELECT src, dst, rank, round(dist, 6) AS dist FROM g")
def knn_cosine(spark, sf_dir):
    return edges_out(knn.knn(vectors(spark, sf_dir), 16, "cosine"))


L1 = "aggregate(zip_with(x, y, (a, b) -> abs(a - b)), 0D, (s, v) -> s + v)"


@query(f"WITH {V}, {knn_sql(8, 'list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2])))')} SELECT src, dst, rank, round(dist, 6) AS dist FROM g")
def knn_l1_expr(spark, sf_dir):
    return edges_out(knn.knn(vectors(spark, sf_dir), 8, L1))


@query(f"WITH {V}, {knn_sql(8, where='a.id % 50 = 0')} SELECT src, dst, rank, round(dist, 6) AS dist FROM g")
def knn_queries(spark, sf_dir):
    v = vectors(spark, sf_dir)  # a stated set of queries asks all rows
    return edges_out(knn.knn(v, 8, queries=v.filter("id % 50 = 0")))


GRID = "p AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[])[1:3], lambda x: floor(x * 8)) AS f FROM embeddings)"
FAR = "p AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / 10 + 1000000) AS f FROM embeddings)"


@query(f"WITH {GRID}, {knn_sql(12)} SELECT src, dst, rank, round(dist, 6) AS dist FROM g")
def knn_ties(spark, sf_dir):
    v = vectors(spark, sf_dir)  # a small grid: most distances are shared, and ids decide
    return edges_out(knn.knn(v.withColumn("features", F.transform(F.slice("features", 1, 3), lambda x: F.floor(x * 8).cast("double"))), 12))


@query(f"WITH {FAR}, {knn_sql(16)} SELECT src, dst, rank, round(dist, 6) AS dist FROM g")
def knn_offset(spark, sf_dir):
    v = vectors(spark, sf_dir)  # far from the origin, near each other
    return edges_out(knn.knn(v.withColumn("features", F.transform("features", lambda x: x / 10 + 1_000_000)), 16))


@query()
def knn_ivf_recall(spark, sf_dir):
    v = vectors(spark, sf_dir)
    each = knn.recall(knn.ivf_knn(v, 10), knn.knn(v, 10))
    return each.agg(F.count("*").alias("n"), r6(F.avg("recall")).alias("recall"))


def recall_of(v, found):
    return knn.recall(found, knn.knn(v, 10)).agg(F.count("*").alias("n"), r6(F.avg("recall")).alias("recall"))


@query()
def knn_pq_recall(spark, sf_dir):
    v = checkpoint(vectors(spark, sf_dir))
    books = quantize.codebooks(v)
    index = quantize.coded(v, books)
    probes, refine, _ = quantize.tuned(v, 10, books, index)
    return recall_of(v, quantize.pq_knn(v, 10, books, probes, refine, index=index))


@query()
def knn_descent_recall(spark, sf_dir):
    v = checkpoint(vectors(spark, sf_dir))
    return recall_of(v, descent.descent_knn(v, 10))


SYM = "s AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g)"


@query(f"WITH {V}, {knn_sql(8)}, {SYM} SELECT src, dst FROM s")
def graph_symmetrize(spark, sf_dir):
    return knn.symmetric(knn.knn(vectors(spark, sf_dir), 8))


@query(f"WITH {V}, {knn_sql(8)}, {SYM} SELECT src, count(*) AS degree FROM s GROUP BY src")
def graph_degree(spark, sf_dir):
    return knn.degrees(knn.symmetric(knn.knn(vectors(spark, sf_dir), 8)))


@query(f"WITH {V}, {knn_sql(8)}, {SYM}, d AS (SELECT src, count(*) AS n FROM s GROUP BY src) SELECT s.src, s.dst, round(1 / sqrt(a.n * b.n), 6) AS val FROM s JOIN d a ON a.src = s.src JOIN d b ON b.src = s.dst")
def graph_normalized_adjacency(spark, sf_dir):
    a = knn.normalized_adjacency(checkpoint(knn.symmetric(knn.knn(vectors(spark, sf_dir), 8))))
    return a.select("src", "dst", r6("val").alias("val"))


@query(f"WITH {V}, {knn_sql(8)}, {SYM}, d AS (SELECT src, count(*) AS n FROM s GROUP BY src), a AS (SELECT s.src, s.dst, 1 / sqrt(a.n * b.n) AS val FROM s JOIN d a ON a.src = s.src JOIN d b ON b.src = s.dst) SELECT a.src AS id, d.pos, round(sum(val * f[d.pos + 1]), 6) AS v FROM a JOIN p ON p.id = a.dst, (SELECT unnest(range(64)) AS pos) d GROUP BY a.src, d.pos")
def graph_matvec(spark, sf_dir):
    v = vectors(spark, sf_dir)
    a = knn.normalized_adjacency(checkpoint(knn.symmetric(knn.knn(v, 8))))
    each = v.select("id", F.posexplode("features").alias("pos", "v"))
    return a.join(each.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "pos").agg(r6(F.sum(F.col("val") * F.col("v"))).alias("v"))


@query(f"WITH RECURSIVE {V}, {knn_sql(1)}, {SYM}, r AS (SELECT DISTINCT src AS node, src AS c FROM s UNION SELECT s.dst, r.c FROM r JOIN s ON s.src = r.node) SELECT node, min(c) AS component FROM r GROUP BY node")
def graph_components(spark, sf_dir):
    return components(knn.knn(vectors(spark, sf_dir), 1), "src", "dst")


# Layouts

A, B, CUT = 1.5769, 0.8951, 42.0
POS = "q AS (SELECT id, f[1] AS x, f[2] AS y, row_number() OVER (ORDER BY id) - 1 AS idx, count(*) OVER () AS n FROM p)"
PULL = f"""att AS (SELECT src, sum(w * dx) AS fx, sum(w * dy) AS fy FROM (
  SELECT src, dx, dy, pow(s, {B}) / (pow(s, {B}) + {A}) / sqrt(s) AS w FROM (
    SELECT src, b.x - a.x AS dx, b.y - a.y AS dy, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + 1e-10 AS s
    FROM g JOIN q a ON a.id = src JOIN q b ON b.id = dst)) GROUP BY src)"""
PUSH = f"""neg AS (SELECT a.id AS src, CAST({hash_sql('a.id', '0', 'slot', '42')} % a.n AS BIGINT) AS idx FROM q a, (SELECT unnest(range(8)) AS slot)),
rep AS (SELECT src, sum(w * dx) AS fx, sum(w * dy) AS fy FROM (
  SELECT src, dx, dy, -exp(-sqrt(s) / {CUT}) / (1 + {A} * pow(s, {B})) / sqrt(s) AS w FROM (
    SELECT src, b.x - a.x AS dx, b.y - a.y AS dy, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + 1e-10 AS s
    FROM neg JOIN q a ON a.id = src JOIN q b ON b.idx = neg.idx)) GROUP BY src)"""


def drawn(layout: DataFrame) -> DataFrame:
    return embedding.negatives(points.numbered(layout, "id"), layout.count(), 8, 0, 42)


@query(f"WITH {V}, {knn_sql(8)}, {POS}, {PULL} SELECT src, round(fx, 6) AS force_0, round(fy, 6) AS force_1 FROM att")
def attraction_step(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return scalars(embedding.attraction(knn.knn(v, 8), flat(v), A, B), "force")


@query(f"WITH {V}, {POS}, {PUSH} SELECT src, round(fx, 6) AS force_0, round(fy, 6) AS force_1 FROM rep")
def repulsion_step(spark, sf_dir):
    layout = flat(vectors(spark, sf_dir))
    return scalars(embedding.repulsion(drawn(layout), layout, A, B, CUT), "force")


@query(f"WITH {V}, {knn_sql(8)}, {POS}, {PULL}, {PUSH} SELECT src, round(greatest(least(att.fx + rep.fx, 0.5), -0.5), 6) AS force_0, round(greatest(least(att.fy + rep.fy, 0.5), -0.5), 6) AS force_1 FROM att JOIN rep USING (src)".replace("/ 42.0)", "/ 0.5)"))
def force_step_clamped(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return scalars(embedding.net_force(knn.knn(v, 8), drawn(flat(v)), flat(v), A, B, 0.5), "force")


@query(f"WITH {V}, {POS}, m AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM q) SELECT id, round((x - mx) / sx, 6) AS coords_0, round((y - my) / sy, 6) AS coords_1 FROM q, m")
def init_normalize(spark, sf_dir):
    return scalars(embedding.standardized(flat(vectors(spark, sf_dir))), "coords")


@query("SELECT k AS step, round(k * 3.0 / 299, 6) AS x, round(CASE WHEN k * 3.0 / 299 < 0.01 THEN 1.0 ELSE exp(-(k * 3.0 / 299 - 0.01)) END, 6) AS y FROM range(300) t(k)")
def kernel_target_curve(spark, sf_dir):
    x, y = embedding.kernel_target(0.01, 1.0)
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "step long, x double, y double").select("step", r6("x").alias("x"), r6("y").alias("y"))


@query("SELECT 'default' AS preset, 1.896 AS a, 0.801 AS b UNION ALL SELECT 'topology', 0.252, 0.793")
def kernel_ab_fit(spark, sf_dir):
    rows = [(name, *map(lambda v: round(v, 3), embedding.kernel(0.01, spread))) for name, spread in (("default", 1.0), ("topology", embedding.TOPOLOGY_TUNED["spread"]))]
    return spark.createDataFrame(rows, "preset string, a double, b double").select("preset", F.col("a").cast("decimal(4,3)").alias("a"), F.col("b").cast("decimal(4,3)").alias("b"))


@query(f"WITH {V}, x AS (SELECT id, unnest(f) AS v, generate_subscripts(f, 1) - 1 AS pos FROM p), c AS (SELECT id, pos, v - avg(v) OVER (PARTITION BY pos) AS v FROM x) SELECT a.pos AS i, b.pos AS j, round(sum(a.v * b.v) / count(*), 6) AS cov FROM c a JOIN c b ON a.id = b.id GROUP BY 1, 2")
def covariance_matrix(spark, sf_dir):
    cov = embedding.covariance(vectors(spark, sf_dir))[1]
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(cov)], "i long, j long, cov double").withColumn("cov", r6("cov"))


@query()
def pca_init(spark, sf_dir):
    return scalars(embedding.pca(vectors(spark, sf_dir), 2), "coords")


@query()
def random_init(spark, sf_dir):
    return scalars(embedding.projected(vectors(spark, sf_dir), embedding.random_axes(64, 2, 42)), "coords")


@query()
def spectral_init(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return scalars(embedding.spectral(v, knn.knn(v, 15), 2, rounds=24), "coords")


@query()
def embed_full(spark, sf_dir):
    return scalars(embedding.create_reducer().fit_transform(vectors(spark, sf_dir)), "coords")


@query()
def embed_distributed(spark, sf_dir):
    return scalars(embedding.create_reducer("distributed", max_iter=4, n_neighbors=8, neg_ratio=2.0).fit_transform(vectors(spark, sf_dir)), "coords")


@query(f"WITH {V}, s AS (SELECT id FROM p ORDER BY {hash_sql('id', '42')}, id LIMIT 100), d AS (SELECT a.id, b.id AS anchor, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) AS rank FROM p a, p b WHERE a.id NOT IN (SELECT id FROM s) AND b.id IN (SELECT id FROM s)), e AS (SELECT id, id AS anchor FROM s UNION ALL SELECT id, anchor FROM d WHERE rank = 1) SELECT e.id, round(p.f[1], 6) AS coords_0, round(p.f[2], 6) AS coords_1 FROM e JOIN p ON p.id = e.anchor")
def anchor_propagation(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return scalars(embedding.propagated(v, flat(embedding.anchors(v, 100)), noise=0.0), "coords")


@query()
def embed_hierarchical(spark, sf_dir):
    return scalars(embedding.hierarchical(vectors(spark, sf_dir), [100, 200], max_iter=32), "coords")


# Quality

LOW = "w AS (SELECT id, [f[1], f[2]] AS f FROM p)"


@query(f"WITH {V}, {knn_sql(16)}, {LOW}, e AS (SELECT abs(dist / greatest(list_distance(a.f, b.f), 1e-6) - 1) AS e FROM g JOIN w a ON a.id = src JOIN w b ON b.id = dst) SELECT round(stddev_pop(e) / avg(e), 6) AS stress FROM e")
def stress(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return quality.stress(knn.knn(v, 16), flat(v)).select(r6("stress").alias("stress"))


@query(f"WITH {V}, {knn_sql(16)}, {LOW}, {knn_sql(16, name='h', table='w')}, o AS (SELECT g.src, count(h.dst) / 16.0 AS s FROM g LEFT JOIN h ON h.src = g.src AND h.dst = g.dst GROUP BY g.src) SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std FROM o")
def neighbor_score(spark, sf_dir):
    v = vectors(spark, sf_dir)
    s = quality.neighbour_score(knn.knn(v, 16), knn.knn(quality.as_points(flat(v)), 16), 16)
    return s.select(r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"WITH {V}, m AS (SELECT *, {hash_sql('id', chr(39) + 'split' + chr(39), '42')} / CAST(281474976710656 AS DOUBLE) < 0.7 AS train FROM p), {knn_sql(16, table='m', where='NOT a.train AND b.train')}, v AS (SELECT src, label, count(*) AS n FROM g JOIN p ON p.id = dst GROUP BY src, label), b AS (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS k FROM v) SELECT round(avg(CASE WHEN b.label = p.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM b JOIN p ON p.id = src WHERE k = 1")
def knn_accuracy(spark, sf_dir):
    return quality.knn_accuracy(vectors(spark, sf_dir)).select(r6("accuracy").alias("accuracy"))


@query()
def svm_accuracy(spark, sf_dir):
    return one_row(spark, accuracy=float(quality.svm_accuracy(vectors(spark, sf_dir))))


@query()
def context_scores(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = quality.context_metrics(v, flat(v))
    return spark.createDataFrame([(k, *map(float, s)) for k, s in found.items()], "score string, high double, low double, log_ratio double")


@query(f"WITH {V} SELECT 0.0 AS disparity, count(*) AS n FROM p")
def procrustes(spark, sf_dir):
    layout = flat(vectors(spark, sf_dir))
    turned = layout.select("id", F.array(3 - 2 * F.col("coords")[1], 2 * F.col("coords")[0] + 1).alias("coords"))
    return one_row(spark, disparity=abs(round(quality.procrustes(layout, turned), 6)), n=layout.count())


@query(f"WITH {V}, {knn_sql(1000000)}, {LOW}, {knn_sql(16, name='h', table='w')}, n AS (SELECT count(*) AS n FROM p) SELECT round(1 - 2.0 / (n * 16 * (2 * n - 49)) * sum(greatest(g.rank - 16, 0)), 6) AS trustworthiness FROM h JOIN g ON g.src = h.src AND g.dst = h.dst, n GROUP BY n")
def trustworthiness(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return one_row(spark, trustworthiness=round(quality.trustworthiness(v, flat(v), 16), 6))


# Topology

ATLAS = f"""{V}, {knn_sql(8)}, lim AS (SELECT src AS i, quantile_cont(dist, 0.8) AS lim FROM g GROUP BY src),
wedge AS (SELECT a.src AS i, a.dst AS j, b.dst AS k FROM g a JOIN g b ON a.src = b.src AND a.dst < b.dst),
near AS (SELECT i, j, k, list_distance(x.f, y.f) AS d FROM wedge JOIN p x ON x.id = j JOIN p y ON y.id = k),
raw AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, src AS step, dist AS length FROM g
  UNION ALL SELECT j, k, near.i, d FROM near JOIN lim USING (i) WHERE d < lim),
edges AS (SELECT u, v, min(step) AS step, arg_min(length, step) AS length FROM raw GROUP BY u, v),
tri AS (SELECT DISTINCT list_sort([i, j, k]) AS t FROM wedge JOIN edges ON u = j AND v = k AND step <= i),
val AS (SELECT t[1] AS a, t[2] AS b, t[3] AS c, greatest(x.length, y.length, z.length) AS value FROM tri JOIN edges x ON x.u = t[1] AND x.v = t[2] JOIN edges y ON y.u = t[1] AND y.v = t[3] JOIN edges z ON z.u = t[2] AND z.v = t[3]),
th AS (SELECT s AS step, (SELECT quantile_cont(length, 1 - s / 9.0) FROM edges) AS filtration FROM range(10) t(s))"""
ATLAS = ATLAS.replace("th AS (SELECT s AS step, (SELECT quantile_cont(length, 1 - s / 9.0) FROM edges) AS filtration FROM range(10) t(s))", "th AS (" + " UNION ALL ".join(f"SELECT {s} AS step, quantile_cont(length, {1 - s / 9!r}) AS filtration FROM edges" for s in range(10)) + ")")


def complex_(spark, sf_dir):
    return topology.atlas(vectors(spark, sf_dir), 8)


@query(f"WITH {ATLAS} SELECT u, v, step, round(length, 6) AS length FROM edges")
def atlas_edges(spark, sf_dir):
    return complex_(spark, sf_dir)[0].select("u", "v", "step", r6("length").alias("length"))


@query(f"WITH {ATLAS} SELECT a, b, c, round(value, 6) AS value FROM val")
def atlas_triangles(spark, sf_dir):
    return topology.valued_triangles(*complex_(spark, sf_dir)).withColumn("value", r6("value"))


@query(f"WITH {ATLAS} SELECT 1 AS dim, u AS row, val, count(*) AS n FROM (SELECT u, -1 AS val FROM edges UNION ALL SELECT v, 1 FROM edges) GROUP BY u, val UNION ALL SELECT 2, u, val, count(*) FROM (SELECT a AS u, 1 AS val FROM val UNION ALL SELECT a, -1 FROM val UNION ALL SELECT b, 1 FROM val) GROUP BY u, val")
def boundary_operators(spark, sf_dir):
    edges, triangles = complex_(spark, sf_dir)
    triangles = topology.valued_triangles(edges, triangles)
    one = topology.boundary_1(edges).groupBy("row", "val").count().select(F.lit(1).alias("dim"), "row", "val", F.col("count").alias("n"))
    two = topology.boundary_2(triangles).groupBy(F.col("u").alias("row"), "val").count().select(F.lit(2).alias("dim"), "row", "val", F.col("count").alias("n"))
    return one.union(two)


@query(f"WITH {ATLAS} SELECT step, round(filtration, 6) AS filtration FROM th")
def filtration_values(spark, sf_dir):
    return topology.thresholds(complex_(spark, sf_dir)[0], 10).select("step", r6("filtration").alias("filtration"))


@query(f"WITH {ATLAS} SELECT step, round(filtration, 6) AS filtration, (SELECT count(*) FROM edges WHERE length <= filtration) AS n_edges, (SELECT count(*) FROM val WHERE value <= filtration) AS n_triangles FROM th")
def active_counts(spark, sf_dir):
    edges, triangles = complex_(spark, sf_dir)
    found = topology.active_counts(topology.thresholds(edges, 10), edges, topology.valued_triangles(edges, triangles))
    return found.withColumn("filtration", r6("filtration"))


@query()
def betti_curve(spark, sf_dir):
    return topology.betti_curve(vectors(spark, sf_dir), 8).withColumn("filtration", r6("filtration"))


@query()
def h0_bars(spark, sf_dir):
    return topology.h0_bars(vectors(spark, sf_dir)).withColumn("death", r6("death"))


@query()
def significant_bars(spark, sf_dir):
    bars = checkpoint(topology.rips_bars(nations(spark, sf_dir)))
    return topology.significant(bars, 0).unionByName(topology.significant(bars, 1)).select("dim", r6("birth").alias("birth"), r6("death").alias("death"), r6("persistence").alias("persistence"))


@query()
def rips_curve(spark, sf_dir):
    return topology.rips_curve(checkpoint(topology.rips_bars(nations(spark, sf_dir))), 20).withColumn("filtration", r6("filtration"))


@query()
def h0_islands(spark, sf_dir):
    return topology.islands(checkpoint(topology.h0_bars(vectors(spark, sf_dir)))).select(r6("longest").alias("longest"), r6("top_ratio").alias("top_ratio"))


def daily(spark, sf_dir):
    """Series of the mean value of each day: of every user, and as user -1 of all events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.explode(F.array("user_id", F.lit(-1).cast("long"))).alias("user_id"), F.to_date("ts").alias("day"), "value")
    return checkpoint(warping.series(e.groupBy("user_id", "day").agg(F.avg("value").alias("value")), "user_id", "day", "value"))


def to_all(users):
    return users.filter("key <> -1").select(F.col("key").alias("left"), F.lit(-1).cast("long").alias("right"))


DAILY = """e AS (SELECT user_id, ts, value FROM events UNION ALL SELECT -1, ts, value FROM events),
d AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS v FROM e WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL HAVING avg(value) IS NOT NULL),
s AS (SELECT user_id, list(v ORDER BY day) AS a FROM d GROUP BY user_id), m AS (SELECT a AS b FROM s WHERE user_id = -1),
w AS (SELECT user_id, 2 AS n, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i = 1 THEN abs(a[1] - b[1]) ELSE CAST('inf' AS DOUBLE) END) AS p, list_transform(a, lambda x: CAST('inf' AS DOUBLE)) AS q
FROM s, m WHERE user_id <> -1 UNION ALL SELECT w.user_id, n + 1, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN n + 1 - i BETWEEN 1 AND len(b) THEN abs(a[i] - b[n + 1 - i])
+ least(p[i], coalesce(p[i - 1], CAST('inf' AS DOUBLE)), coalesce(q[i - 1], CAST('inf' AS DOUBLE))) ELSE CAST('inf' AS DOUBLE) END), p FROM w JOIN s ON s.user_id = w.user_id, m WHERE n < len(a) + len(b))"""


@query(f"WITH RECURSIVE {DAILY} SELECT w.user_id, round(p[len(a)], 6) AS distance FROM w JOIN s ON s.user_id = w.user_id, m WHERE n = len(a) + len(b)")
def warped_exact(spark, sf_dir):
    users = daily(spark, sf_dir)
    return warping.warped(users, to_all(users), None).select(F.col("left").alias("user_id"), r6("distance").alias("distance"))


@query()
def warped_banded(spark, sf_dir):
    users = daily(spark, sf_dir)
    return warping.warped(users, to_all(users)).select(F.col("left").alias("user_id"), r6("distance").alias("distance"))


@query("SELECT round(sqrt(2.0) + 1, 6) AS distance")
def dtw_distance(spark, sf_dir):
    return one_row(spark, distance=round(topology.dtw([(0, 0), (1, 1), (2, 2)], [(0, 0), (2, 2), (2, 3)]), 6))


@query(f"WITH {ATLAS}, m AS (SELECT u AS row, v AS col FROM edges UNION SELECT v, u FROM edges UNION SELECT u, u FROM edges UNION SELECT v, v FROM edges), i AS (SELECT row AS id, row_number() OVER (ORDER BY row) - 1 AS k FROM (SELECT DISTINCT row FROM m)), n AS (SELECT a.k AS row, b.k AS col FROM m JOIN i a ON a.id = row JOIN i b ON b.id = col), r AS (SELECT row, max(col) - min(col) AS span, count(*) AS n, max(abs(row - col)) AS band FROM n GROUP BY row) SELECT count(*) AS n_rows, sum(n) AS nonzeros, round(sum(n) / (count(*) * count(*)), 6) AS density, max(band) AS bandwidth, round(avg(span), 6) AS mean_span, max(span) AS max_span FROM r")
def matrix_structure(spark, sf_dir):
    edges = complex_(spark, sf_dir)[0]
    found = topology.matrix_structure(topology.laplacian(topology.boundary_1(edges), ["row"], ["u", "v"]))
    return found.withColumns({"density": r6("density"), "mean_span": r6("mean_span")})


@query(f"WITH {ATLAS}, m AS (SELECT a AS t1, b AS t2, c AS t3, unnest([[a, b], [a, c], [b, c]]) AS e FROM val), i AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS k FROM (SELECT DISTINCT e FROM m)), n AS (SELECT DISTINCT x.k AS row, y.k AS col FROM m p1 JOIN m p2 USING (t1, t2, t3) JOIN i x ON x.e = p1.e JOIN i y ON y.e = p2.e), r AS (SELECT row, max(col) - min(col) AS span, count(*) AS n, max(abs(row - col)) AS band FROM n GROUP BY row) SELECT count(*) AS n_rows, sum(n) AS nonzeros, round(sum(n) / (count(*) * count(*)), 6) AS density, max(band) AS bandwidth, round(avg(span), 6) AS mean_span, max(span) AS max_span FROM r")
def matrix_structure_edges(spark, sf_dir):
    triangles = topology.valued_triangles(*complex_(spark, sf_dir))
    found = topology.matrix_structure(topology.laplacian(topology.boundary_2(triangles), ["u", "v"], ["a", "b", "c"]))
    return found.withColumns({"density": r6("density"), "mean_span": r6("mean_span")})


@query()
def topology_error(spark, sf_dir):
    clouds = {"figure_8": (generators.figure_8(spark, 200), 2), "torus": (generators.torus(spark, 200), 2)}
    return topology.topology_error(embedding.create_reducer(**embedding.TOPOLOGY_TUNED).fit_transform, clouds)


@query("SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1, 2")
def grouped_stats(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_quantity", F.col("l_quantity").cast("double"))
    return rounded(quality.grouped_stats(t, ["l_returnflag", "l_linestatus"], "l_quantity"))


LAYOUTS = {
    "pca": lambda v, near: embedding.standardized(embedding.pca(v, 2), sample=True),
    "random": lambda v, near: embedding.standardized(embedding.projected(v, embedding.random_axes(64, 2, 42)), sample=True),
    "spectral": lambda v, near: embedding.standardized(embedding.spectral(v, near.filter("rank <= 15"), 2), sample=True),
    "force": lambda v, near: embedding.create_reducer().fit_transform(v, near),
}


@query("SELECT unnest([" + ", ".join(f"'{k}'" for k in LAYOUTS) + "]) AS layout, (SELECT count(*) FROM embeddings) AS n_points, true AS finite, true AS centred, true AS scaled")
def layout_invariants(spark, sf_dir):
    """What every layout must have: a row for each point, finite, mean 0 and sample deviation 1 in both coordinates."""
    v, out = checkpoint(vectors(spark, sf_dir)), None
    near = checkpoint(knn.knn(v, 16))
    for name, lay in LAYOUTS.items():
        xy = [F.col("coords")[k] for k in range(2)]
        finite = F.bool_and(*[(F.abs(xy[0]) < 1e300) & (F.abs(xy[1]) < 1e300)])
        one = lay(v, near).groupBy(F.lit(name).alias("layout")).agg(F.count_distinct("id").alias("n_points"), finite.alias("finite"), (F.greatest(*[F.abs(F.avg(x)) for x in xy]) < 1e-6).alias("centred"), (F.greatest(*[F.abs(F.stddev_samp(x) - 1) for x in xy]) < 1e-6).alias("scaled"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def global_metrics(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = topology.global_metrics(v, flat(v), 8, 0.9, 8)
    return spark.createDataFrame([(k, float(x)) for k, x in found.items()], "metric string, value double")


# Time series

BAR = """bars AS (SELECT key, time_bucket(INTERVAL 60 SECONDS, ts) AS ts, arg_min(price, {'ts': ts, 'id': event_id}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {'ts': ts, 'id': event_id}) AS close, sum(size) AS volume, sum(price * size) / nullif(sum(size), 0) AS vwap, count(*) AS transactions FROM t GROUP BY 1, 2)"""


def minute_bars(spark, sf_dir):
    return timeseries.bars(trades(spark, sf_dir), 60)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(f"WITH {T}, {BAR} SELECT key, ts, {rounded_sql('open', 'high', 'low', 'close', 'volume', 'vwap')}, transactions FROM bars")
def ohlcv_bars(spark, sf_dir):
    return rounded(minute_bars(spark, sf_dir))


@query(f"WITH {T}, s AS (SELECT *, CASE WHEN price > 0 THEN ln(price) END AS lp, ln(size + 1) AS ls FROM t) SELECT event_id, round(lp, 6) AS log_price, round(ls, 6) AS log_size, round(lp - lag(lp) OVER w, 6) AS price_diff, round(ls - lag(ls) OVER w, 6) AS size_diff, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w, 6) AS time_diff FROM s WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)")
def tick_derivations(spark, sf_dir):
    t = timeseries.tick_steps(trades(spark, sf_dir))
    return rounded(t.select("event_id", "log_price", "log_size", "price_diff", "size_diff", "time_diff"))


@query("SELECT event_id, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, round(hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0, 6) AS time_of_day FROM events")
def time_parts(spark, sf_dir):
    t = timeseries.time_parts(trades(spark, sf_dir)).select("event_id", *[F.col(c).cast("long").alias(c) for c in ("hour", "minute", "second")], "time_of_day")
    return rounded(t)


BUCKET = "b AS (SELECT key, time_bucket(INTERVAL 600 SECONDS, ts) AS ts, arg_min(price, {'ts': ts, 'id': event_id}) AS p_first, arg_max(price, {'ts': ts, 'id': event_id}) AS p_last, min(price) AS p_min, max(price) AS p_max, avg(price) AS p_mean, stddev_samp(price) AS p_std, sum(size) AS s_sum, avg(size) AS s_mean, max(size) AS s_max, stddev_samp(size) AS s_std, count(*) AS n FROM t GROUP BY 1, 2)"
FEATURES = f"{T}, {BUCKET}, o AS (SELECT *, ln(p_last / p_first) AS ret FROM b WHERE p_std IS NOT NULL AND s_std IS NOT NULL AND p_first > 0 AND p_last > 0), f AS (SELECT key, ts, ret, p_std AS volatility, p_max - p_min AS range, (p_max + p_min) / 2 AS mid, ln(s_sum + 1) AS volume, s_mean AS mean_size, s_max AS max_size, CAST(n AS DOUBLE) AS ticks, s_std / (s_mean + 1e-8) AS dispersion, s_max / (s_sum + 1e-8) AS large_ratio, n / 600.0 AS intensity, n / (coalesce(lag(n) OVER (PARTITION BY key ORDER BY ts), 0) + 1) AS burst, abs(p_last - p_first) / (sqrt(s_sum) + 1e-8) AS kyle, abs(ret) / (p_mean * s_sum + 1e-8) AS amihud FROM o)"
NAMES = ("ret", "volatility", "range", "mid", "volume", "mean_size", "max_size", "ticks", "dispersion", "large_ratio", "intensity", "burst", "kyle", "amihud")


@query(f"WITH {FEATURES} SELECT key, ts, {rounded_sql(*NAMES)} FROM f")
def bucket_features(spark, sf_dir):
    return rounded(timeseries.bucket_features(trades(spark, sf_dir), 600))


ROLL = "r AS (SELECT *, row_number() OVER w AS n, close / nullif(lag(close) OVER w, 0) - 1 AS pct, lag(close, 20) OVER w AS c0, avg(volume) OVER h AS v, stddev_samp(volume) OVER h AS vs, avg(close) OVER h AS m, stddev_samp(close) OVER h AS s FROM bars WINDOW w AS (PARTITION BY key ORDER BY ts), h AS (PARTITION BY key ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), q AS (SELECT *, stddev_samp(pct) OVER i AS realised, avg(pct) OVER i * 100 AS mean_change FROM r WINDOW i AS (PARTITION BY key ORDER BY ts ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING))"


@query(f"WITH {T}, {BAR}, {ROLL} SELECT key, ts, round(CASE WHEN close / nullif(c0, 0) > 0 THEN ln(close / c0) END, 6) AS log_return, round((high - low) / nullif(close, 0), 6) AS range, round(close / nullif(open, 0) - 1, 6) AS period_return, round(ln(volume + 1), 6) AS log_volume, round(volume / (v + 1e-8), 6) AS relative_volume, round(vs / (v + 1e-8), 6) AS volume_dispersion, round(realised, 6) AS realised, round(mean_change, 6) AS mean_change, round((close - vwap) / nullif(vwap, 0), 6) AS vwap_deviation, round((close - m) / (s + 1e-8), 6) AS z_score, CAST(transactions AS DOUBLE) AS transactions FROM q WHERE n > 20")
def rolling_features(spark, sf_dir):
    return rounded(timeseries.rolling_features(minute_bars(spark, sf_dir)))


TICK = f"{T}, {BUCKET}, e AS (SELECT key, min(ts) AS a, max(ts) AS z FROM b GROUP BY key), sp AS (SELECT key, unnest(generate_series(a, z, INTERVAL 600 SECONDS)) AS ts FROM e), j AS (SELECT sp.key, sp.ts, b.* EXCLUDE (key, ts) FROM sp LEFT JOIN b ON b.key = sp.key AND b.ts = sp.ts), k AS (SELECT *, row_number() OVER w AS i, lag(p_last, 5) OVER w AS p0, avg(p_std) OVER h AS ps, avg(s_mean) OVER h AS sm, stddev_samp(s_mean) OVER h AS ss FROM j WINDOW w AS (PARTITION BY key ORDER BY ts), h AS (PARTITION BY key ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"


@query(f"WITH {TICK} SELECT key, ts, round(CASE WHEN p_last / nullif(p0, 0) > 0 THEN ln(p_last / p0) END, 6) AS log_return, round(p_max - p_min, 6) AS range, round(ps, 6) AS std, round(ln(s_sum + 1), 6) AS log_size, round(s_mean / (sm + 1e-8), 6) AS relative_size, round(ss / (sm + 1e-8), 6) AS dispersion, coalesce(n, 0) AS ticks, round(s_max / (s_sum + 1e-8), 6) AS large_ratio FROM k WHERE i > 5")
def tick_features(spark, sf_dir):
    return rounded(timeseries.tick_features(trades(spark, sf_dir), 600))


@query("WITH e AS (SELECT event_id, value AS x, CAST(props ->> '$.k' AS DOUBLE) AS y FROM events), c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM e), d AS (SELECT event_id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS distance FROM e, c) SELECT event_id, round(distance, 6) AS distance FROM d WHERE distance > (SELECT avg(distance) + 1.5 * stddev_samp(distance) FROM d)")
def anomalies(spark, sf_dir):
    t = trades(spark, sf_dir).select("event_id", F.col("price").alias("x"), F.col("size").alias("y"))
    return timeseries.anomalies(t, ["x", "y"], 1.5).select("event_id", r6("distance").alias("distance"))


@query(f"WITH {FEATURES}, g AS (SELECT *, CASE WHEN hour(ts) < 2 THEN -1 WHEN hour(ts) < 12 THEN 0 ELSE 1 END AS regime FROM f) SELECT regime, count(*) AS n, round(avg(ret), 6) AS mean_return, round(avg(volatility), 6) AS mean_volatility, round(avg(volume), 6) AS mean_volume, round(avg(intensity), 6) AS mean_intensity, strftime(min(ts), '%H:%M') AS first_time, strftime(max(ts), '%H:%M') AS last_time FROM g WHERE regime <> -1 GROUP BY regime")
def regime_stats(spark, sf_dir):
    f = timeseries.bucket_features(trades(spark, sf_dir), 600)
    h = F.hour("ts")
    return rounded(timeseries.regimes(f.withColumn("regime", F.when(h < 2, -1).when(h < 12, 0).otherwise(1))))


@query(f"WITH {T}, {BAR} SELECT key, arg_min(ts, {{'v': low - high, 'ts': ts}}) AS widest_at, arg_min(ts, {{'v': -volume, 'ts': ts}}) AS busiest_at FROM bars GROUP BY key")
def peak_times(spark, sf_dir):
    return timeseries.peaks(minute_bars(spark, sf_dir))


@query(f"WITH {T}, {BAR}, r AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY ts) AS i, close AS v FROM bars), k AS (SELECT min(key) AS a, max(key) AS b FROM bars) SELECT count(*) AS n, round(corr(x.v, y.v), 6) AS corr FROM r x JOIN r y USING (i), k WHERE x.key = k.a AND y.key = k.b")
def asset_correlation(spark, sf_dir):
    b = minute_bars(spark, sf_dir)
    ends = b.agg(F.min("key"), F.max("key")).first()
    return rounded(timeseries.aligned_correlation(b, ends[0], ends[1]))


# Clusters, curves and texts


@query()
def dbscan(spark, sf_dir):
    return cluster.dbscan(flat(vectors(spark, sf_dir)), 0.05, 5)


@query()
def kmeans_clusters(spark, sf_dir):
    v = vectors(spark, sf_dir)
    c = cluster.kmeans(v, 10).join(v.select("id", "label"), "id")
    return cluster.purity(c).join(cluster.adjusted_rand(c)).select(r6("purity").alias("purity"), r6("ari").alias("ari"))


def coarse(spark, sf_dir):
    """Clusters from the signs of two features, against the labels."""
    s = lambda k: (F.col("features")[k] > 0).cast("int")
    return vectors(spark, sf_dir).select("id", (s(0) * 2 + s(1)).alias("cluster"), "label")


COARSE = "c AS (SELECT id, CAST(f[1] > 0 AS INT) * 2 + CAST(f[2] > 0 AS INT) AS cluster, label FROM p), n AS (SELECT cluster, label, count(*) AS n FROM c GROUP BY 1, 2)"


@query(f"WITH {V}, {COARSE} SELECT round(sum(m) / sum(t), 6) AS purity FROM (SELECT max(n) AS m, sum(n) AS t FROM n GROUP BY cluster)")
def purity(spark, sf_dir):
    return rounded(cluster.purity(coarse(spark, sf_dir)))


@query(f"WITH {V}, {COARSE}, s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM n), a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM n GROUP BY cluster)), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM n GROUP BY label)) SELECT round((s - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS ari FROM s, a, b")
def adjusted_rand(spark, sf_dir):
    return rounded(cluster.adjusted_rand(coarse(spark, sf_dir)))


@query(f"WITH {V}, {COARSE}, d AS (SELECT a.id, x.cluster AS own, y.cluster, avg(list_distance(a.f, b.f)) AS d FROM p a JOIN p b ON a.id <> b.id JOIN c x ON x.id = a.id JOIN c y ON y.id = b.id GROUP BY 1, 2, 3), e AS (SELECT id, max(CASE WHEN cluster = own THEN d END) AS a, min(CASE WHEN cluster <> own THEN d END) AS b FROM d GROUP BY id) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM e")
def silhouette(spark, sf_dir):
    return rounded(cluster.silhouette(vectors(spark, sf_dir), coarse(spark, sf_dir)))


@query(f"WITH {V}, x AS (SELECT label, unnest(f) AS v, generate_subscripts(f, 1) AS pos FROM p), e AS (SELECT label, pos, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY 1, 2) SELECT round((SELECT avg(s) FROM (SELECT stddev_pop(m) AS s FROM e GROUP BY pos)) / (SELECT avg(s) FROM e), 6) AS separation")
def class_separation(spark, sf_dir):
    return rounded(cluster.separation(vectors(spark, sf_dir)))


@query("WITH o AS (SELECT s_suppkey AS trial, s_acctbal AS score, CAST(s_suppkey * 7919 % 1000 AS DOUBLE) AS error FROM supplier) SELECT trial, score, error FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.score >= a.score AND b.error <= a.error AND (b.score > a.score OR b.error < a.error))")
def pareto_front(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return cluster.pareto(s.select(F.col("s_suppkey").alias("trial"), F.col("s_acctbal").cast("double").alias("score"), (F.col("s_suppkey") * 7919 % 1000).cast("double").alias("error")))


@query("SELECT 'stress' AS curve, 3 AS dimension UNION ALL SELECT 'neighbor', 2 UNION ALL SELECT 'line', 2 UNION ALL SELECT 'share', 4")
def elbows(spark, sf_dir):
    rows = [("stress", cluster.kneedle([9.0, 5.0, 1.5, 1.2, 1.0], increasing=False)), ("neighbor", cluster.kneedle([0.1, 0.7, 0.8, 0.85, 0.9])), ("line", cluster.line_elbow([0.1, 0.7, 0.8, 0.85, 0.9])), ("share", cluster.share_elbow([0.5, 0.8, 0.9, 0.96, 1.0]))]
    return spark.createDataFrame(rows, "curve string, dimension int")


@query()
def intrinsic_sweep(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = intrinsic.sweep(v, range(1, 4), embedding.Parameters(max_iter=32))
    return found.select("dimension", r6("stress").alias("stress"), r6("neighbor").alias("neighbor"))


@query()
def parameter_search(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = intrinsic.search(v, {"n_neighbors": (8, 24), "spread": (1.0, 4.0), "init": ["pca", "random"]}, trials=4, base=embedding.Parameters(max_iter=32))
    return cluster.pareto(found).select("trial", "params", r6("score").alias("score"), r6("error").alias("error"))


@query()
def kernel_pca(spark, sf_dir):
    return embedding.kernel_pca(vectors(spark, sf_dir), 2).select("id", F.transform("coords", lambda x: F.round(x, 4)).alias("coords"))


@query()
def compare_reducers(spark, sf_dir):
    v = vectors(spark, sf_dir)
    methods = {k: f for k, f in intrinsic.reducers(max_iter=32).items() if k != "spectral"}
    return intrinsic.compare(spark, v, methods, metrics=("distortion",)).drop("seconds")


@query(r"WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents) SELECT id, place, trim(line) AS paragraph FROM l WHERE trim(line) <> '' AND len(regexp_split_to_array(trim(line), '\s+')) >= 20")
def split_paragraphs(spark, sf_dir):
    return text.paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").withColumn("place", F.col("place").cast("long"))


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(trim(x), '^#+\s*', ''), '\*+', '', 'g')), lambda x: trim(x) <> ''), chr(10)) AS text FROM documents")
def clean_markdown(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.plain(F.col("text")).alias("text"))
