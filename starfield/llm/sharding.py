"""Sharding by a keyed permutation of global row numbers. DataFrame functions only.

Rows get dense numbers in the order of a key: a range shuffle of the key columns alone, row numbers inside each
partition, and the prefix sums of the partition sizes. A Feistel network over ``a * b`` points (``a * b`` is the
smallest such grid of nearly equal sides that holds all rows) permutes the numbers; points beyond the last row walk
along their cycle until they are inside. The place ``p`` of a row gives shard ``p % shards`` and slot ``p // shards``,
so any row's place, or the row of any place, follows from the seed and the row count alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starfield.plans.materialize import checkpoint

ROUNDS = 6


def grid(n: int) -> tuple[int, int]:
    """Sides a >= b of the grid with a * b >= n and fewer than a points to spare."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _round(seed: int, k: int, x: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(k), x)


def permuted(x: Column, n: int, seed: int) -> Column:
    """Where the permutation of 0 .. n - 1 puts ``x``."""
    a, b = grid(n)

    def once(x: Column) -> Column:
        left, right = F.floor(x / F.lit(b)).cast("long"), x % F.lit(b)
        if a * b > 1 << 52:
            left = (x - x % F.lit(b)).cast("decimal(20,0)") / F.lit(b)
            left = left.cast("long")
        for k in range(ROUNDS):
            if k % 2:
                right = F.pmod(right + F.pmod(_round(seed, k, left), F.lit(b)), F.lit(b))
            else:
                left = F.pmod(left + F.pmod(_round(seed, k, right), F.lit(a)), F.lit(a))
        return left * F.lit(b) + right

    y = once(x)
    if a * b == n:
        return y
    # A cycle leaves the rows for at most as many steps as there are points beyond them.
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), y, lambda p, _: F.when(p < n, p).otherwise(once(p)))
    return F.when(y < n, y).otherwise(walk)


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``row``, dense from 0 in the order of ``order`` (nulls first), and the row count.

    Rows that are equal in ``order`` are spread by a random number, so that no partition gets them all; to fix the
    places of rows that differ, let ``order`` tell them apart.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = df.withColumn("_spread", F.rand(11)).repartitionByRange(*keys, "_spread").sortWithinPartitions(*keys, "_spread")
    ranged = checkpoint(ranged.drop("_spread").withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row for each partition: as many as the shuffle has partitions, whatever the input.
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    n = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return ranged.join(F.broadcast(before), "_part").withColumn("row", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"), n


def sharded(docs: DataFrame, shards: int = 40, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard and slot: key, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shard sizes differ by one row at most. Groups of equal texts are spread like any rows.
    A null text counts as empty, a null key sorts first; rows with one key are ordered by their text's and then the
    whole row's hash, and fully equal rows change places freely. Other columns of ``docs`` are ignored but for that
    hash; an empty table gives none.
    """
    text_ = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text_) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text_, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text_).alias("_text"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_row"),
    )
    rows, n = numbered(rows, ["doc_id", "_text", "_row"])
    place = rows.withColumn("_place", permuted(F.col("row"), n, seed))
    return place.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
