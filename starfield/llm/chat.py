"""Chat formatting: collapses logged snapshots of a conversation, then renders the rest. DataFrame functions only.

A log often holds a conversation many times, each time some turns longer. The hash of a turn prefix is the running
sum of hashes of (place, role, text), two of 64 bits each; a conversation is dropped where its whole hash is that of
a proper prefix of another one, or of an equal one with a smaller id.

The turns are sorted once, by ranges of (conv_id, turn, role, text), and written with the hashes of role and text; the
collapse reads the hashes alone, and only the rendering reads texts again. All sums run in two steps, within runs of at
most ``RUN`` rows of the sorted table and over the runs, so no task needs a whole conversation, also where its turn
numbers are null or repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starfield.plans.materialize import checkpoint, written

RUN = 256
PART = 1024
_PREFIX = ["n", "h1", "h2"]


def turns(conversations: DataFrame) -> DataFrame:
    """A written table of the distinct turns: _conv (a struct of conv_id, so that nulls join), _at (the place in the
    order of conv_id, turn, role and text, with gaps between partitions), _run, role, text, and two hashes of the
    latter, _one and _two."""
    key = ["conv_id", "turn", "role", "text"]
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id())
    one = F.xxhash64(F.lit(1), F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    two = F.xxhash64("text", F.col("text").isNull(), "role", F.col("role").isNull(), F.lit(2))
    run = (F.col("_at") - F.col("_at") % RUN).alias("_run")
    return written(rows.select(F.struct("conv_id").alias("_conv"), "_at", run, "role", "text", one.alias("_one"), two.alias("_two")), "turns")


def _over_runs(runs: DataFrame, sums: list[str]) -> DataFrame:
    """Turns each run's sums into those of the conversation's runs before it."""
    over = Window.partitionBy("_conv").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumns({c: F.coalesce(F.sum(c).over(over), F.lit(0)) for c in sums})


def places(rows: DataFrame) -> DataFrame:
    """For each run of each conversation: _before (turns before the run), _first (the run's first _at) and n_turns (of
    the whole conversation). Within a run places are consecutive."""
    runs = rows.groupBy("_conv", "_run").agg(F.count("*").alias("_before"), F.min("_at").alias("_first"))
    runs = runs.withColumn("n_turns", F.sum("_before").over(Window.partitionBy("_conv")))
    return _over_runs(runs, ["_before"])


def _place() -> Column:
    return F.col("_before") + F.col("_at") - F.col("_first") + 1


def prefixes(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Every turn's place ``n`` from 1, the hashes ``h1`` and ``h2`` of the turns up to it, and n_turns."""
    wide = lambda *c: F.xxhash64(*c).cast("decimal(20,0)")  # noqa: E731  sums of longs overflow
    df = rows.select("_conv", "_run", "_at", "_one", "_two").join(runs, ["_conv", "_run"]).withColumn("n", _place())
    within = Window.partitionBy("_conv", "_run").orderBy("_at")
    df = df.withColumns({"h1": F.sum(wide("n", "_one")).over(within), "h2": F.sum(wide("_two", "n")).over(within)})
    whole = df.groupBy("_conv", "_run").agg(F.max_by("h1", "_at").alias("_h1"), F.max_by("h2", "_at").alias("_h2"))
    df = df.join(_over_runs(whole, ["_h1", "_h2"]), ["_conv", "_run"])
    return df.select("_conv", "n", (F.col("h1") + F.col("_h1")).alias("h1"), (F.col("h2") + F.col("_h2")).alias("h2"), "n_turns")


def segment(role: Column, text: Column) -> Column:
    """A turn in the rendered form."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def _maximal(rows: DataFrame, runs: DataFrame) -> DataFrame:
    found = checkpoint(prefixes(rows, runs))
    one = found.filter("n = n_turns").groupBy(*_PREFIX).agg(F.min("_conv").alias("_conv"), F.count("*").alias("copies"))
    proper = found.filter("n < n_turns").select(*_PREFIX).distinct()
    return one.join(proper, _PREFIX, "left_anti").select("_conv", "n", "copies")


def maximal(conversations: DataFrame) -> DataFrame:
    """The conversations that no longer one begins with: conv_id, n (turns), copies (equal conversations, with itself).

    Of equal conversations the smallest conv_id stays; a null conv_id is a conversation of its own and counts as
    smaller. Rows that repeat wholly (conv_id, turn, role, text) are one turn. Rows that share a turn number are in
    the order of role, then text. Nulls come first, differ from empty strings and equal each other.
    """
    rows = turns(conversations)
    return _maximal(rows, places(rows)).select("_conv.conv_id", "n", "copies")


def formatted(conversations: DataFrame, part: int = PART) -> DataFrame:
    """Renders the maximal conversations: conv_id, part, n_turns, copies, text.

    A conversation of more than ``part`` turns is rendered in several parts, numbered from 0, whose texts follow
    each other, so that no row is unbounded. Null roles and texts render as empty. See ``maximal`` for the other
    cases; extra columns are ignored, an empty table gives none.
    """
    rows = turns(conversations)
    runs = checkpoint(places(rows))
    kept = runs.join(_maximal(rows, runs).select("_conv", "copies"), "_conv")
    out = rows.select("_conv", "_run", "_at", segment(F.col("role"), F.col("text")).alias("_segment")).join(kept, ["_conv", "_run"])
    out = out.withColumns({"n": _place(), "part": F.floor((_place() - 1) / part).cast("long")})
    packed = F.sort_array(F.collect_list(F.struct("n", "_segment")))
    out = out.groupBy("_conv", "part", "n_turns", "copies").agg(packed.alias("_all"))
    return out.select("_conv.conv_id", "part", "n_turns", "copies", F.concat_ws("", F.col("_all._segment")).alias("text"))
