"""Bounded samples for fitting models. Everything else covers all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_hash(rows: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """The ``limit`` rows whose keys have the smallest hashes: a sample that does not depend on the layout."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit("sample")), key).limit(limit)


def labelled(docs: DataFrame, labels: DataFrame, target, limit: int) -> DataFrame:
    """At most ``limit`` documents with a label ``y``, the mean of ``target`` over the label rows of a doc_id."""
    own = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg(target.cast("int")).alias("y")).filter("y IS NOT NULL")
    chosen = by_hash(own.join(docs.select("doc_id"), "doc_id", "left_semi"), limit)
    return docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # ``limit`` rows
