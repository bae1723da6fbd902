"""Features of ordered ticks: buckets, trailing windows, anomalies, regimes.

``trades(ts, key, price, size)`` with ``event_id`` to order equal times; ``key`` is the instrument. Windows look a
few rows back, so they are partitioned by chunks of the instruments' rows (see ``led``), not by the instrument: one
that has most of the ticks is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from starfield.operators.points import numbered

EPSILON = 1e-8
#: Rows of a chunk, its lead not counted.
CHUNK = 1 << 16


def from_events(events: DataFrame) -> DataFrame:
    """The events table as trades: value as price, the props' k as size, the type as instrument."""
    size = F.get_json_object("props", "$.k").cast("double")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), F.col("value").alias("price"), size.alias("size"))


def led(df: DataFrame, rows: int, *order: str, chunk: int = CHUNK) -> tuple[DataFrame, WindowSpec]:
    """Deals the rows, sorted by key and ``order``, to chunks of equal size, each led by copies of the ``rows`` rows
    before it, and returns them with the window in which every row that is not a copy sees at least ``rows`` rows of
    its instrument before it, or all there are. ``_led`` marks the copies; callers drop them by ``unled``."""
    chunk = max(chunk, rows, 1)
    at = F.floor(F.col("idx") / chunk)
    place = lambda c, copy: F.struct(c.alias("_chunk"), F.lit(copy).alias("_led"))
    places = F.when(F.col("idx") % chunk >= chunk - rows, F.array(place(at, False), place(at + 1, True))).otherwise(F.array(place(at, False)))
    dealt = numbered(df, "key", *order).select(*df.columns, F.inline(places))
    return dealt, Window.partitionBy("_chunk", "key").orderBy(*order)


def unled(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_led")).drop("_led", "_chunk")


def tick_steps(trades: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """log_price, log_size (of size + 1), their changes, seconds since the last tick, and arrivals per second."""
    t, w = led(trades, 1, "ts", "event_id", chunk=chunk)
    t = t.withColumns({"log_price": F.log(F.when(F.col("price") > 0, F.col("price"))), "log_size": F.log1p("size")})
    seconds = F.unix_micros("ts") / 1e6
    t = t.withColumns({"price_diff": F.col("log_price") - F.lag("log_price").over(w), "size_diff": F.col("log_size") - F.lag("log_size").over(w), "time_diff": seconds - F.lag(seconds).over(w)})
    return unled(t.withColumn("arrival_rate", 1 / (F.col("time_diff") + 0.001)))


def time_parts(df: DataFrame, ts: str = "ts") -> DataFrame:
    h, m, s = F.hour(ts), F.minute(ts), F.second(ts)
    return df.withColumns({"hour": h, "minute": m, "second": s, "time_of_day": h + m / 60 + s / 3600})


def bars(trades: DataFrame, seconds: int = 60) -> DataFrame:
    """open, high, low, close, volume, vwap, transactions for each instrument and bucket. Works on streams too."""
    first, last = F.min_by("price", F.struct("ts", "event_id")), F.max_by("price", F.struct("ts", "event_id"))
    g = trades.groupBy("key", F.window("ts", f"{seconds} seconds").alias("w")).agg(first.alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), last.alias("close"), F.sum("size").alias("volume"), F.try_divide(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("vwap"), F.count("*").alias("transactions"))
    return g.select("key", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "vwap", "transactions")


def buckets(trades: DataFrame, seconds: int = 10) -> DataFrame:
    """Statistics of price and size for each instrument and bucket that has ticks."""
    first, last = F.min_by("price", F.struct("ts", "event_id")), F.max_by("price", F.struct("ts", "event_id"))
    g = trades.groupBy("key", F.window("ts", f"{seconds} seconds").alias("w")).agg(
        first.alias("p_first"), last.alias("p_last"), F.min("price").alias("p_min"), F.max("price").alias("p_max"), F.avg("price").alias("p_mean"), F.stddev_samp("price").alias("p_std"),
        F.sum("size").alias("s_sum"), F.avg("size").alias("s_mean"), F.max("size").alias("s_max"), F.stddev_samp("size").alias("s_std"), F.count("*").alias("n"),
    )
    return g.select("key", F.col("w.start").alias("ts"), *[c for c in g.columns if c not in ("key", "w")])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def bucket_features(trades: DataFrame, seconds: int = 10, chunk: int = CHUNK) -> DataFrame:
    """Fourteen features of each bucket of two ticks or more."""
    return features_of(buckets(trades, seconds), seconds, chunk)


def features_of(buckets_: DataFrame, seconds: int, chunk: int = CHUNK) -> DataFrame:
    """``bucket_features`` of what ``buckets`` gave."""
    c = F.col
    b = buckets_.filter("p_std IS NOT NULL AND s_std IS NOT NULL AND p_first > 0 AND p_last > 0")
    b, w = led(b, 1, "ts", chunk=chunk)
    b = unled(b.withColumns({"ret": F.log(c("p_last") / c("p_first")), "_n": F.lag("n").over(w)}))
    return b.select(
        "key", "ts", "ret", c("p_std").alias("volatility"), (c("p_max") - c("p_min")).alias("range"), ((c("p_max") + c("p_min")) / 2).alias("mid"), F.log1p("s_sum").alias("volume"), c("s_mean").alias("mean_size"), c("s_max").alias("max_size"),
        c("n").cast("double").alias("ticks"), (c("s_std") / (c("s_mean") + EPSILON)).alias("dispersion"), (c("s_max") / (c("s_sum") + EPSILON)).alias("large_ratio"), (c("n") / F.lit(float(seconds))).alias("intensity"),
        (c("n") / (F.coalesce("_n", F.lit(0)) + 1)).alias("burst"), (F.abs(c("p_last") - c("p_first")) / (F.sqrt("s_sum") + EPSILON)).alias("kyle"), (F.abs("ret") / (c("p_mean") * c("s_sum") + EPSILON)).alias("amihud"),
    )


def rolling_features(bars_: DataFrame, rows: int = 20, chunk: int = CHUNK) -> DataFrame:
    """Features over the ``rows`` bars before each bar, without itself; bars with a shorter history are left out."""
    c = F.col
    x, w = led(bars_, rows, "ts", chunk=chunk)
    before, inside = w.rowsBetween(-rows, -1), w.rowsBetween(-rows + 1, -1)
    x = x.withColumns({"_n": F.count(F.lit(1)).over(before), "_pct": _ratio(c("close"), F.lag("close").over(w)) - 1})
    x = x.withColumns({
        "_first": F.lag("close", rows).over(w), "_v": F.avg("volume").over(before), "_vs": F.stddev_samp("volume").over(before), "_m": F.avg("close").over(before), "_s": F.stddev_samp("close").over(before),
        "realised": F.stddev_samp("_pct").over(inside), "mean_change": F.avg("_pct").over(inside) * 100,
    })
    x = unled(x.filter(c("_n") == rows))
    positive = lambda a: F.when(a > 0, a)
    return x.select(
        "key", "ts", F.log(positive(_ratio(c("close"), c("_first")))).alias("log_return"), _ratio(c("high") - c("low"), c("close")).alias("range"), (_ratio(c("close"), c("open")) - 1).alias("period_return"), F.log1p("volume").alias("log_volume"),
        (c("volume") / (c("_v") + EPSILON)).alias("relative_volume"), (c("_vs") / (c("_v") + EPSILON)).alias("volume_dispersion"), "realised", "mean_change", _ratio(c("close") - c("vwap"), c("vwap")).alias("vwap_deviation"), ((c("close") - c("_m")) / (c("_s") + EPSILON)).alias("z_score"), c("transactions").cast("double").alias("transactions"),
    )


def spine(trades: DataFrame, seconds: int) -> DataFrame:
    """All buckets between each instrument's first and last tick, empty ones too: key, ts."""
    edge = F.window("ts", f"{seconds} seconds")["start"]
    ends = trades.groupBy("key").agg(F.min(edge).alias("a"), F.max(edge).alias("b"))
    step, wide = F.expr(f"interval {seconds} seconds"), F.expr(f"interval {seconds * 4096} seconds")
    ends = ends.select("key", "b", F.explode(F.sequence("a", "b", wide)).alias("a"))
    return ends.select("key", F.explode(F.sequence("a", F.least("b", F.col("a") + wide - step), step)).alias("ts"))


def tick_features(trades: DataFrame, seconds: int = 60, rows: int = 5, chunk: int = CHUNK) -> DataFrame:
    """Eight features over the ``rows`` buckets before each bucket, empty buckets included."""
    c = F.col
    b = spine(trades, seconds).join(buckets(trades, seconds), ["key", "ts"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    b, w = led(b, rows, "ts", chunk=chunk)
    before = w.rowsBetween(-rows, -1)
    b = b.withColumns({"_n": F.count(F.lit(1)).over(before), "_first": F.lag("p_last", rows).over(w), "_std": F.avg("p_std").over(before), "_mean": F.avg("s_mean").over(before), "_ms": F.stddev_samp("s_mean").over(before)})
    b = unled(b.filter(c("_n") == rows))
    positive = lambda a: F.when(a > 0, a)
    return b.select("key", "ts", F.log(positive(_ratio(c("p_last"), c("_first")))).alias("log_return"), (c("p_max") - c("p_min")).alias("range"), c("_std").alias("std"), F.log1p("s_sum").alias("log_size"), (c("s_mean") / (c("_mean") + EPSILON)).alias("relative_size"), (c("_ms") / (c("_mean") + EPSILON)).alias("dispersion"), c("n").alias("ticks"), (c("s_max") / (c("s_sum") + EPSILON)).alias("large_ratio"))


def anomalies(df: DataFrame, coords: list[str], deviations: float = 2.5) -> DataFrame:
    """Rows further from the centre than the mean distance and ``deviations`` sample deviations: adds distance."""
    centre = df.agg(*[F.avg(c).alias(f"_{c}") for c in coords])
    x = df.join(F.broadcast(centre)).withColumn("distance", F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in coords), F.lit(0.0)))).drop(*[f"_{c}" for c in coords])
    limit = x.agg((F.avg("distance") + deviations * F.stddev_samp("distance")).alias("_limit"))
    return x.join(F.broadcast(limit)).filter(F.col("distance") > F.col("_limit")).drop("_limit")


def regimes(features: DataFrame, regime: str = "regime") -> DataFrame:
    """For each cluster but noise (-1): periods, mean return, volatility, volume and intensity, first and last HH:mm."""
    g = features.filter(F.col(regime) != -1).groupBy(regime)
    return g.agg(F.count("*").alias("n"), F.avg("ret").alias("mean_return"), F.avg("volatility").alias("mean_volatility"), F.avg("volume").alias("mean_volume"), F.avg("intensity").alias("mean_intensity"), F.date_format(F.min("ts"), "HH:mm").alias("first_time"), F.date_format(F.max("ts"), "HH:mm").alias("last_time"))


def peaks(bars_: DataFrame) -> DataFrame:
    """For each instrument the times of its widest bar and of its largest volume; the earliest of equal ones."""
    at = lambda v: F.min_by("ts", F.struct(-v, F.col("ts")))
    return bars_.groupBy("key").agg(at(F.col("high") - F.col("low")).alias("widest_at"), at(F.col("volume")).alias("busiest_at"))


def aligned_correlation(bars_: DataFrame, a: str, b: str, column: str = "close") -> DataFrame:
    """Correlation of two instruments whose rows are paired in order, up to the shorter one: one row, n, corr."""
    rows = numbered(bars_.filter(F.col("key").isin(a, b)).select("key", "ts", F.col(column).alias("v")), "key", "ts")
    starts = rows.groupBy("key").agg(F.min("idx").alias("_start"))  # two rows at most
    rows = rows.join(F.broadcast(starts), "key").select("key", (F.col("idx") - F.col("_start")).alias("i"), "v")
    x, y = rows.filter(F.col("key") == a).select("i", F.col("v").alias("x")), rows.filter(F.col("key") == b).select("i", F.col("v").alias("y"))
    return x.join(y, "i").agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr"))


def frames(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """Adds ``frame``: the row's place over ``rows``, rounded down."""
    return numbered(df, *order).withColumn("frame", F.floor(F.col("idx") / rows))
