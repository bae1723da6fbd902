"""Point clouds from files. All reading goes through Spark, so any store that Spark reads will do."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starfield.operators.points import arcsinh, assemble, numeric_only
from starfield.sources.arrays import read_arrays, read_labels

SUFFIXES = (".csv", ".parquet", ".npy", ".npz", ".arff", ".tsv", ".txt", ".fcs")
#: Rows of an array file in one batch.
ROWS = 4096


def parse_selector(selector: str) -> tuple[str, str]:
    """``scheme:name`` or ``scheme.name``; a path or known suffix is a file; a bare name is a generator."""
    if selector.lower().endswith(SUFFIXES) and not re.match(r"(file|generate|cytometry):", selector):
        return "file", selector
    if m := re.match(r"(file|generate|geometric|cytometry|openml)[:.](.+)$", selector):
        return m[1], m[2]
    if "/" in selector or "://" in selector:
        return "file", selector
    return "generate", selector


def with_ids(df: DataFrame) -> DataFrame:
    """Adds ``id``, dense from 0 in the order of reading: row numbers within input partitions and their offsets."""
    rows = df.withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn("id", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def read_csv(spark: SparkSession, path: str, label: str | None = None, sep: str = ",") -> DataFrame:
    return assemble(with_ids(spark.read.csv(path, header=True, inferSchema=True, sep=sep)), "id", label)


def read_parquet(spark: SparkSession, path: str, label: str | None = None, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return assemble(with_ids(df.select(*columns, *([label] if label and label not in columns else [])) if columns else df), "id", label)


def read_numpy(spark: SparkSession, path: str, labels_path: str | None = None) -> DataFrame:
    """``.npy`` (with an optional file of labels) or ``.npz`` with X and perhaps y, by ranges of rows (``read_arrays``)."""
    found = read_arrays(spark, path)
    if labels_path:
        found = found.drop("label").join(read_labels(spark, labels_path), "id", "left")
    return found


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Dense or sparse ARFF. A column named class, target or label is the label; other nominal ones are left out."""
    lines = with_ids(spark.read.text(path).withColumn("value", F.trim("value")).filter("value <> '' AND NOT value LIKE '\\%%'"))
    head = lines.filter(F.lower("value").startswith("@")).orderBy("id").collect()
    names, kinds, start = [], [], None
    for row in head:  # one row for each attribute
        if m := re.match(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.+)", row["value"], re.I):
            names.append(m[1].strip("'\""))
            kinds.append(m[2].strip().lower())
        elif row["value"].lower().startswith("@data"):
            start = row["id"]
    if start is None:
        raise ValueError(f"{path} has no @data")
    label = next((k for k, n in enumerate(names) if n.lower() in ("class", "target", "label")), None)
    used = [k for k, kind in enumerate(kinds) if k != label and kind.split()[0] in ("numeric", "real", "integer")]
    data = lines.filter(F.col("id") > start)
    sparse = F.col("value").startswith("{")
    entries = F.split(F.regexp_replace("value", r"[{}]", ""), r"\s*,\s*")
    pairs = F.filter(entries, lambda x: x != "")
    keyed = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.split(x, r"\s+")[0].cast("int").alias("k"), F.split(x, r"\s+")[1].alias("v"))))
    value = lambda k: F.when(sparse, F.coalesce(keyed[k], F.lit("0"))).otherwise(entries[k])
    features = F.array(*[F.nullif(value(k), F.lit("?")).cast("double") for k in used])
    name = F.regexp_replace(value(label), "^['\"]|['\"]$", "") if label is not None else F.lit(None).cast("string")
    return data.select((F.col("id") - start - 1).alias("id"), features.alias("features"), name.alias("label"))


def _fcs(content: bytes) -> tuple[list[str], np.ndarray]:
    """Channel names and events of a flow cytometry file with float data."""
    at = [int(content[a : a + 8]) for a in (10, 18, 26, 34)]
    text = content[at[0] : at[1] + 1].decode("latin-1")
    parts = text[1:].split(text[0])
    keys = {k.upper(): v for k, v in zip(parts[::2], parts[1::2], strict=False)}
    n, rows = int(keys["$PAR"]), int(keys["$TOT"])
    begin = at[2] or int(keys["$BEGINDATA"])
    order = "<" if keys["$BYTEORD"].startswith("1") else ">"
    kind = {"F": "f4", "D": "f8"}[keys["$DATATYPE"]]
    events = np.frombuffer(content, order + kind, n * rows, begin).reshape(rows, n)
    return [keys.get(f"$P{k + 1}S") or keys[f"$P{k + 1}N"] for k in range(n)], events.astype(float)


def read_fcs(spark: SparkSession, path: str) -> DataFrame:
    """Events as id, features and names (of the channels). A task holds a file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                names, x = _fcs(content)
                for at in range(0, len(x), ROWS):
                    part = x[at : at + ROWS]
                    yield pa.RecordBatch.from_pydict({"id": np.arange(at, at + len(part)), "features": list(part), "names": [names] * len(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "id long, features array<double>, names array<string>")


def read_cytometry(spark: SparkSession, path: str, label: str = "label", drop: list[str] = ("individual",), drop_unassigned: bool = True, cofactor: float = 5.0) -> DataFrame:
    """A table of markers, gzipped or not: numeric columns but the named ones, arcsinh, integer labels."""
    df = spark.read.csv(path, header=True, inferSchema=True, sep="," if re.search(r"\.csv(\.gz)?$", path) else "\t")
    if label in df.columns:
        df = df.filter(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))) if drop_unassigned else df
        df = df.withColumn(label, F.col(label).cast("int"))
    kept = numeric_only(df, list(drop))
    return arcsinh(assemble(with_ids(kept), "id", label), cofactor)


def read_points(spark: SparkSession, path: str, label: str | None = None, labels_path: str | None = None) -> DataFrame:
    """By the suffix."""
    suffix = next((s for s in SUFFIXES if path.lower().endswith(s)), None)
    if suffix == ".csv":
        return read_csv(spark, path, label)
    if suffix in (".tsv", ".txt"):
        return read_csv(spark, path, label, sep="\t")
    if suffix == ".parquet":
        return read_parquet(spark, path, label)
    if suffix in (".npy", ".npz"):
        return read_numpy(spark, path, labels_path)
    if suffix == ".arff":
        return read_arff(spark, path)
    if suffix == ".fcs":
        return read_fcs(spark, path)
    raise ValueError(f"unsupported file {path}")


def write_embedding(layout: DataFrame, path: str, form: str = "parquet") -> None:
    """id and x, y, z ... as Parquet, JSON or CSV."""
    wide(layout).write.mode("overwrite").format(form).save(path)


def wide(layout: DataFrame) -> DataFrame:
    """id and one column for each coordinate: x, y, z, c3, ..."""
    first = layout.select(F.size("coords")).first()
    names = [("x", "y", "z")[k] if k < 3 else f"c{k}" for k in range(first[0] if first else 2)]
    return layout.select("id", *[F.col("coords")[k].alias(n) for k, n in enumerate(names)])
