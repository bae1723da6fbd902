"""Joins of rows with one small row for each key, where single keys may hold much of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than this part of all rows are hot.
PARTS = 4096


def joined(left: DataFrame, right: DataFrame, key: str, count: str, spread: list[str], parts: int = PARTS) -> DataFrame:
    """``left`` with the columns of ``right`` but ``count``, null where the key is not in ``right``.

    ``right`` has a row for each key, ``count`` being how many rows of ``left`` hold it. A key with more than one
    part in ``parts`` of those rows is hot: there are fewer than ``parts`` of them, so their rows of ``right`` are
    sent to all tasks, and the rows of ``left`` that hold them are spread by ``spread`` in the shuffle of the others.
    ``right`` is read three times, so it should be a stored table.
    """
    own = [c for c in right.columns if c not in (key, count)]
    n = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * parts > n
    sent = right.filter(hot).select(F.col(key).alias("_hot_key"), F.struct(*own).alias("_hot"))
    cold = right.filter(~hot).select(F.col(key).alias("_cold_key"), F.lit(0).alias("_cold_salt"), F.struct(*own).alias("_cold"))
    rows = left.join(F.broadcast(sent), left[key] == F.col("_hot_key"), "left")
    away = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    rows = rows.withColumn("_salt", F.when(away, F.xxhash64(*spread)).otherwise(0)).withColumn("_to", F.when(~away, F.col(key)))
    rows = rows.join(cold, (F.col("_to") == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    found = [F.when(F.col("_hot_key").isNotNull(), F.col(f"_hot.{c}")).otherwise(F.col(f"_cold.{c}")).alias(c) for c in own]
    return rows.select(*[F.col(f"`{c}`") for c in left.columns], *found)
