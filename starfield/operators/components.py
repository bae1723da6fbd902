"""Connected components and minimum spanning forests by joins and minima, with no graph in one task or on the driver."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfield.plans.materialize import checkpoint


#: A forest of at most so many edges is found in one task.
SMALL = 1_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) of every node that has an edge.

    Each round a node takes the smallest component of its neighbours, then that node's own component, so paths
    shorten by powers of two. Ends when a round changes nothing. Nulls link nothing; no edges, no rows.
    """
    both = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = checkpoint(both.union(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    state = checkpoint(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    while True:
        offered = both.join(state.select(F.col("node").alias("other"), F.col("component").alias("offer")), "other").groupBy("node").agg(F.min("offer").alias("offer"))
        nearer = state.join(offered, "node").select("node", F.least("component", "offer").alias("next"), F.col("component").alias("was"))
        roots = state.select(F.col("node").alias("next"), F.col("component").alias("root"))
        after = checkpoint(nearer.join(roots, "next", "left").select("node", F.least("next", F.coalesce("root", "next")).alias("component"), "was"))
        changed = not after.filter("component <> was").isEmpty()
        state = after.select("node", "component")
        if not changed:
            return state


def _kruskal(edges: pd.DataFrame) -> pd.DataFrame:
    above: dict = {}

    def root(x):
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    kept = []
    for u, v, length in edges.sort_values(["length", "u", "v"])[["u", "v", "length"]].itertuples(index=False):
        a, b = root(u), root(v)
        if a != b:
            above[b] = a
            kept.append((u, v, length))
    return pd.DataFrame(kept, columns=["u", "v", "length"]).astype({"u": "int64", "v": "int64", "length": float})


def spanning_forest(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """The edges (u, v, length) of the least spanning forest; equal lengths are ordered by u and v. ``nodes`` has id.

    Up to ``small`` edges go through one task. Beyond, rounds in which every component takes its shortest edge
    outwards join and aggregate the edges."""
    edges = checkpoint(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "length").groupBy("u", "v").agg(F.min("length").alias("length")))
    if edges.count() <= small:
        return checkpoint(edges.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(_kruskal, "u long, v long, length double"))
    state = nodes.select(F.col("id").alias("node"), F.col("id").alias("component"))
    chosen = []
    while True:
        of = lambda k: state.select(F.col("node").alias(k), F.col("component").alias(f"_{k}"))
        open_ = edges.join(of("u"), "u").join(of("v"), "v").filter("_u <> _v")
        ends = open_.select(F.explode(F.array("_u", "_v")).alias("_c"), F.struct("length", "u", "v").alias("e"))
        new = checkpoint(ends.groupBy("_c").agg(F.min("e").alias("e")).select("e.*").distinct())
        if new.isEmpty():
            break
        chosen.append(new)
        every = reduce(DataFrame.union, chosen)
        linked = components(every, "u", "v")
        state = checkpoint(nodes.select(F.col("id").alias("node")).join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    if not chosen:
        return edges.limit(0)
    return reduce(DataFrame.union, chosen).select("u", "v", "length")
