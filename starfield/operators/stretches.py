"""Rounds over vectors of all points of a graph, in stretches of places: a point's place is its number by id.

A stretch holds its points' ids and edges, dealt once to the tasks and kept there. A round sends every stretch's vectors, a row
each, to the stretches' tasks, ``HELD`` points at a time, so what a task holds is bounded and what is shuffled are vectors
alone. The driver sees neither.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfield.operators.points import numbered
from starfield.plans.materialize import deleted, written
from starfield.plans.sums import added

#: Points of which a task holds the vectors at once, and points of a stretch, at most.
HELD, SIZE = 1 << 20, 1 << 14


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


class Stretches:
    """``start`` (id, coords) with the edges (src, dst, and val if there is one) of ``n`` points."""

    def __init__(self, start: DataFrame, edges: DataFrame, n: int, width: int, held: int = HELD, size: int | None = None):
        spark = start.sparkSession
        size = size or max(256, min(SIZE, -(-n // (2 * spark.sparkContext.defaultParallelism))))
        self.n, self.width, self.size, self.per = n, width, size, max(1, held // size)
        self.count = -(-n // size)
        placed = written(numbered(start, "id").select("id", "idx", "coords"), "places")
        value = F.col("val") if "val" in edges.columns else F.lit(None).cast("double")
        ends = edges.select("src", "dst", value.alias("val")).join(placed.select(F.col("id").alias("src"), F.col("idx").alias("_s")), "src").join(placed.select(F.col("id").alias("dst"), F.col("idx").alias("_d")), "dst")
        near = ends.select(F.floor(F.col("_s") / size).alias("e"), F.col("_s").alias("s"), F.col("_d").alias("d"), "val")

        def pack(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.sort_by("idx")
            first, ids = left["idx"][0].as_py(), np.asarray(left["id"], np.int64)
            src, dst, val = np.asarray(right["s"]), np.asarray(right["d"]), np.asarray(right["val"], float)
            order = np.lexsort((dst, src))
            begins = np.searchsorted(src[order], np.arange(first, first + len(ids) + 1))
            return pa.table({"stretch": [first // size], "ids": _bytes(ids), "begins": _bytes(begins.astype(np.int64)), "dst": _bytes(dst[order]), "val": _bytes(val[order])})

        def begin(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("idx")
            x = np.asarray(rows["coords"].combine_chunks().flatten(), float)
            return pa.table({"stretch": [rows["idx"][0].as_py() // size], "x": _bytes(x)})

        by = placed.withColumn("stretch", F.floor(F.col("idx") / size))
        tasks = min(self.count, 2 * spark.sparkContext.defaultParallelism)
        packed = written(by.select("stretch", "idx", "id").groupBy("stretch").cogroup(near.groupBy("e")).applyInArrow(pack, "stretch long, ids binary, begins binary, dst binary, val binary"), "stretches")
        # Kept where it is dealt to, so that a round shuffles vectors alone; read again from the shared folder where that is lost.
        self.held = packed.repartition(tasks, "stretch").persist()
        self.x, self.spark = written(by.groupBy("stretch").applyInArrow(begin, "stretch long, x binary"), "vectors"), spark

    def moved(self, move: Callable, step: Callable, turn: int = 0) -> None:
        """One round: ``move(own, first, (ids, begins, dst, val), others, lead, turn)`` is what the vectors ``others`` of the places from ``lead``
        on give to a stretch from place ``first`` on, ``step(own, sum, turn)`` its new vectors."""
        size, per, width = self.size, self.per, self.width
        parts = -(-self.count // per)
        of = lambda value: np.frombuffer(value.as_buffer(), float).reshape(-1, width)

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return pa.table({"stretch": pa.array([], pa.int64()), "x": pa.array([], pa.binary())})
            mine = np.asarray(right["mine"])
            own, rest = of(right.filter(mine)["x"][0]), right.filter(~mine).sort_by("of")
            stretch, lead = left["stretch"][0].as_py(), rest["of"][0].as_py() * size
            others = np.concatenate([of(v) for v in rest["x"]])
            held = tuple(np.frombuffer(left[name][0].as_buffer(), kind) for name, kind in (("ids", np.int64), ("begins", np.int64), ("dst", np.int64), ("val", float)))
            given = move(own, stretch * size, held, others, lead, turn)
            return pa.table({"stretch": [stretch], "x": _bytes(step(own, given, turn) if parts == 1 else given)})

        def total(left: pa.Table, right: pa.Table) -> pa.Table:
            own = of(left["x"][0])
            return pa.table({"stretch": [left["stretch"][0].as_py()], "x": _bytes(step(own, sum(of(v) for v in right["x"]), turn))})

        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        sent = self.x.select(every(self.count).alias("to"), F.col("stretch").alias("of"), "x", F.floor(F.col("stretch") / per).alias("p"), F.lit(False).alias("mine"))
        sent = sent.unionByName(self.x.select(F.col("stretch").alias("to"), F.col("stretch").alias("of"), "x", every(parts).alias("p"), F.lit(True).alias("mine")))
        schema = "stretch long, x binary"
        if parts == 1:
            self.put(self.held.groupBy("stretch").cogroup(sent.groupBy("to")).applyInArrow(meet, schema))
            return
        left = self.held.withColumn("_p", every(parts))
        given = left.groupBy("stretch", "_p").cogroup(sent.groupBy("to", "p")).applyInArrow(meet, schema)
        self.put(self.x.groupBy("stretch").cogroup(given.withColumnRenamed("stretch", "to").groupBy("to")).applyInArrow(total, schema))

    def gram(self) -> np.ndarray:
        """The vectors' products with each other, summed over the points."""
        width = self.width

        def product(batches):
            for batch in batches:
                for v in batch.column(0):
                    x = np.frombuffer(v.as_buffer(), float).reshape(-1, width)
                    yield pa.RecordBatch.from_pydict({"v": _bytes(x.T @ x)})

        return added(self.x.select("x").mapInArrow(product, "v binary")).reshape(width, width)

    def turned(self, by: np.ndarray) -> None:
        """The vectors times a small matrix."""
        width = self.width

        def turn(batches):
            for batch in batches:
                x = [np.ascontiguousarray(np.frombuffer(v.as_buffer(), float).reshape(-1, width) @ by).tobytes() for v in batch.column("x")]
                yield pa.RecordBatch.from_pydict({"stretch": batch.column("stretch"), "x": pa.array(x, pa.binary())})

        self.put(self.x.mapInArrow(turn, "stretch long, x binary"))

    def put(self, new: DataFrame) -> None:
        """Takes ``new`` (stretch, x) for the vectors; the earlier ones are deleted."""
        before = self.x.inputFiles()
        self.x = written(new, "vectors")
        deleted(self.spark, before[0].rsplit("/", 1)[0])

    def layout(self, name: str) -> DataFrame:
        """id and the vectors."""
        width = self.width

        def unpack(left: pa.Table, right: pa.Table) -> pa.Table:
            x = np.frombuffer(right["x"][0].as_buffer(), float)
            ids = np.frombuffer(left["ids"][0].as_buffer(), np.int64)
            return pa.table({"id": ids, name: pa.array(list(x.reshape(-1, width)), pa.list_(pa.float64()))})

        out = written(self.held.select("stretch", "ids").groupBy("stretch").cogroup(self.x.withColumnRenamed("stretch", "to").groupBy("to")).applyInArrow(unpack, f"id long, {name} array<double>"), "layout")
        self.held.unpersist()
        return out
