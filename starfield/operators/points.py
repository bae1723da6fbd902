"""Point clouds: ``points(id, features ARRAY<DOUBLE>, label)``, their row transforms, statistics and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from starfield.functions.vectors import finite, keyed_hash, uniform
from starfield.operators.quantiles import order_statistics
from starfield.plans.materialize import checkpoint

NUMERIC = (T.NumericType, T.BooleanType)


def assemble(df: DataFrame, id_col: str, label: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Wide columns to one array. A label column that is missing is ignored; a column that is not numeric is an error."""
    label = label if label in df.columns else None
    columns = columns or [c for c in df.columns if c not in (id_col, label)]
    for c in columns:
        if not isinstance(df.schema[c].dataType, NUMERIC):
            raise TypeError(f"feature column {c} is {df.schema[c].dataType.simpleString()}, not numeric")
    features = F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("features")
    return df.select(F.col(id_col).alias("id"), features, (F.col(label) if label else F.lit(None).cast("int")).alias("label"))


def numeric_only(df: DataFrame, drop: list[str] = ()) -> DataFrame:
    """Without the named columns and those that are not numeric."""
    return df.select(*[f.name for f in df.schema if f.name not in drop and isinstance(f.dataType, NUMERIC)])


def from_vectors(df: DataFrame, id_col: str, vector: str, label: str | None = None) -> DataFrame:
    """An array column, of any numeric type or nested as in an image, to points."""
    x = F.col(vector)
    if isinstance(df.schema[vector].dataType.elementType, T.ArrayType):
        x = F.flatten(x)
    return df.select(F.col(id_col).alias("id"), x.cast("array<double>").alias("features"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"))


def label_codes(points: DataFrame, column: str = "label") -> DataFrame:
    """Adds ``code``: the labels' places, from 0, in their order; null has none.

    Ranks the distinct labels, not the rows, so the one-task window sees the classes only.
    """
    names = points.select(F.col(column).alias("_name")).filter("_name IS NOT NULL").distinct()
    codes = names.withColumn("code", F.dense_rank().over(Window.orderBy("_name")) - 1)
    return points.join(codes, F.col(column) == F.col("_name"), "left").drop("_name")


def labelled_only(points: DataFrame, column: str = "label") -> DataFrame:
    return points.filter(F.col(column).isNotNull())


def arcsinh(points: DataFrame, cofactor: float) -> DataFrame:
    return points.withColumn("features", F.transform("features", lambda x: F.asinh(x / cofactor))) if cofactor > 0 else points


def pixels(points: DataFrame) -> DataFrame:
    """Bytes of an image to -0.5 .. 0.5."""
    return points.withColumn("features", F.transform("features", lambda x: x / 255 - 0.5))


def finite_only(points: DataFrame) -> DataFrame:
    return points.filter(F.forall("features", finite))


def dimension_stats(points: DataFrame, nan_is_null: bool = False) -> DataFrame:
    """For each dimension: pos (from 0), n, mean, std (population), std_sample, least, most."""
    x = points.select(F.posexplode("features").alias("pos", "v"))
    if nan_is_null:
        x = x.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return x.groupBy("pos").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.stddev_samp("v").alias("std_sample"), F.min("v").alias("least"), F.max("v").alias("most"))


def _per_dimension(points: DataFrame, *names: str) -> list[list[float]]:
    """Statistics as lists in the order of dimensions; there are as many rows as dimensions."""
    rows = dimension_stats(points).orderBy("pos").select(*names).collect()
    return [[r[n] for r in rows] for n in names]


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def centred(points: DataFrame) -> DataFrame:
    """Less the mean of every dimension, then over the largest absolute value of all."""
    if not (means := _per_dimension(points, "mean")[0]):
        return points
    shifted = points.withColumn("features", F.zip_with("features", _array(means), lambda x, m: x - m))
    most = shifted.select(F.max(F.array_max(F.transform("features", F.abs)))).first()[0]
    return shifted if not most else shifted.withColumn("features", F.transform("features", lambda x: x / most))


def z_scores(points: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """By mean and population deviation. Without ``epsilon`` a constant dimension is divided by 1; with it NaN gives 0."""
    if not epsilon:
        means, stds = _per_dimension(points, "mean", "std")
        scale = [s or 1.0 for s in stds]
    else:
        rows = dimension_stats(points, nan_is_null=True).orderBy("pos").collect()
        means, scale = [r["mean"] or 0.0 for r in rows], [(r["std"] or 0.0) + epsilon for r in rows]
    z = F.zip_with(F.zip_with("features", _array(means), lambda x, m: x - m), _array(scale), lambda x, s: x / s)
    if epsilon:
        z = F.transform(z, lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    return points.withColumn("features", z)


def bernoulli(points: DataFrame, threshold: float, seed: int = 42) -> DataFrame:
    """Keeps each row with probability ``threshold``, by its id: the same rows of any table with these ids."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    return points.filter(uniform(F.col("id"), seed) < threshold)


def fixed_sample(points: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return points.orderBy(keyed_hash(F.col("id"), seed), "id").limit(n)


def balanced(a: DataFrame, b: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Both cut to the size of the smaller one, the rows of the least hashes (of equal ones, the smaller ids)."""
    counts = a.count(), b.count()
    n = min(counts)
    return tuple(df if count == n else _least_hashes(df, n, seed) for df, count in zip((a, b), counts, strict=True))


def _least_hashes(df: DataFrame, n: int, seed: int) -> DataFrame:
    """The ``n`` rows of ``fixed_sample`` for any ``n``: the hash that bounds them is found by counting, and only rows with
    this very hash are ordered."""
    if not n:
        return df.limit(0)
    rows = df.withColumn("_h", keyed_hash(F.col("id"), seed))
    bound = int(order_statistics(rows, "_h", [n - 1])[0])
    below = rows.filter(F.col("_h") < bound)
    return below.unionByName(rows.filter(F.col("_h") == bound).orderBy("id").limit(n - below.count())).drop("_h")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``idx``, dense from 0 in the given order, by ranges rather than in one task."""
    ranged = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn("idx", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def evenly_spaced(df: DataFrame, m: int, *order: str) -> DataFrame:
    """The rows at places 0 .. n - 1 in ``m`` even steps, rounded down, each once."""
    rows = numbered(df, *order)
    n = rows.count()
    place = F.floor(F.col("id") * F.lit(n - 1) / F.lit(max(m - 1, 1))).cast("long")
    wanted = df.sparkSession.range(m if n else 0).select(place.alias("idx")).distinct()
    return rows.join(wanted, "idx", "left_semi")


def most_frequent(df: DataFrame, column: str, n: int = 15, other: str = "other") -> DataFrame:
    """Replaces all but the ``n`` most frequent categories; ties go to the smaller name."""
    counts = df.groupBy(column).count().orderBy(F.desc("count"), column).limit(n).select(F.col(column).alias("_kept"))
    return df.join(counts, F.col(column).eqNullSafe(F.col("_kept")), "left").withColumn(column, F.coalesce("_kept", F.lit(other))).drop("_kept")


def stratified(points: DataFrame, column: str, total: int, seed: int = 42) -> DataFrame:
    """At most ``total // categories`` rows of each category."""
    per = total // max(points.select(column).distinct().count(), 1)
    order = Window.partitionBy(column).orderBy(keyed_hash(F.col("id"), seed), "id")
    return points.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per).drop("_n")


def running_moments(df: DataFrame, column: str) -> DataFrame:
    """n, mean and sample deviation (0 for a single value) of the finite values below 1e12."""
    ok = df.filter(finite(F.col(column)) & (F.abs(column) < 1e12))
    return ok.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("std"))
