"""Importance resampling towards a target: documents whose hashed n-grams are like the target's are drawn first.

A partition's words become ids, and a suffix array over them, sorted to the depth of the longest n-gram, brings equal
n-grams together: places whose common prefix with the one before has n words or more are one run. Each run is hashed
once, and its bucket is scattered to all places of the run. The buckets of all places are stored; their counts over all
documents and all of the target give each bucket's gain, and a document's weight is the sum of its places' gains.

The draw adds noise of Gumbel's law to the weights and takes the highest. Ranks come from one sort by ranges and the
prefix sums of its partitions' sizes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starfield.llm.words import NOT_ALNUM, Words, blocks
from starfield.plans.materialize import written
from starfield.plans.sums import added

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10


def word_numbers(words: Words) -> tuple[np.ndarray, list[bytes]]:
    """Each word's id in the block, and the words by id."""
    n = words.ends - words.starts
    flat = np.arange(int(n.sum())) + np.repeat(words.starts - (np.cumsum(n) - n), n)
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    all_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words.data[flat]))])
    coded = all_.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def suffixes(ids: np.ndarray, last: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``ids``, ordered by the first ``depth`` words, and each suffix's common prefix with the one before
    it, up to ``depth``. A suffix ends with its document, whose last word is at ``last`` (given for each word)."""
    n, place = len(ids), np.arange(len(ids))
    rank, order = ids, np.argsort(ids, kind="stable")
    for k in range(1, depth):
        # Equal in the first k words: the next word decides, none being the least.
        further = np.zeros(n, np.int64)
        longer = place + k <= last
        further[longer] = ids[place[longer] + k] + 1
        order = np.lexsort((further, rank))
        new = np.zeros(n, bool)
        new[1:] = (np.diff(rank[order]) != 0) | (np.diff(further[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
    prefix = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    same = np.ones(max(0, n - 1), bool)
    for j in range(depth):
        same &= (a + j <= last[a]) & (b + j <= last[b])
        same[same] = ids[a[same] + j] == ids[b[same] + j]
        prefix[1:] += same
    return order, prefix


def buckets(words: Words, n_max: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of 1 to ``n_max`` words of a block, by document, and how many each document has."""
    ids, known = word_numbers(words)
    last = (np.repeat(words.first[1:], words.counts) - 1).astype(np.int64)
    order, prefix = suffixes(ids, last, n_max)
    document, out, of = words.document(), [], []
    for n in range(1, n_max + 1):
        # A suffix of fewer words shares fewer than n with the next one, so runs of n words break there by themselves.
        whole = order + n - 1 <= last[order]
        at, new = order[whole], prefix[whole] < n
        hashed = np.array([zlib.crc32(b" ".join([known[w] for w in ids[a : a + n]])) % size for a in at[new]], np.int64)
        found = np.full(len(ids), -1, np.int64)
        found[at] = hashed[np.cumsum(new) - 1]
        out.append(found[found >= 0])
        of.append(document[found >= 0])
    of = np.concatenate(of)
    by_document = np.argsort(of, kind="stable")
    return np.concatenate(out)[by_document], np.bincount(of, minlength=len(words.counts))


def placed(docs: DataFrame, n_max: int, size: int, key: str, text: str) -> DataFrame:
    """The first pass, written: doc_id, n_words, n_features, buckets (two or four bytes each)."""
    kind = docs.schema[key].dataType.simpleString()
    width = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets, NOT_ALNUM, lower=True)
            found, counts = buckets(words, n_max, size)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * width.itemsize
            stored = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(found.astype(width))])
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "n_words": words.counts.astype(np.int64), "n_features": counts.astype(np.int64), "buckets": stored.cast(pa.binary())})

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(hash_, f"doc_id {kind}, n_words long, n_features long, buckets binary"), "buckets", "zstd")


def _flat(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The buckets of all rows of a batch."""
    column = batch.column("buckets").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None and len(column) else b""
    return np.frombuffer(raw, "<u2" if size <= 1 << 16 else "<u4")


def counts(stored: DataFrame, size: int) -> np.ndarray:
    """How many places of all rows are in each bucket: vectors of ``size`` numbers, added as a tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += np.bincount(_flat(batch, size), minlength=size)
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    found = added(stored.select("buckets").mapInArrow(count, "v binary"))
    return np.zeros(size, np.int64) if found is None else found.astype(np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 * ln of the smoothed share in the target over that in the source)."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from a hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(docs: DataFrame, target: DataFrame, n_max: int = 1, size: int = BUCKETS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's doc_id, n_words, n_features, weight and score, the weight with noise; written.

    Null and empty texts have no features and weight 0. A very long text is a block of its own. Every row counts and is
    weighed by itself, so repeated rows, equal and null doc_ids each give a row; the noise of rows with one doc_id is
    equal. Without a target, or with an empty one, gains come from smoothing alone. Other columns are ignored.
    """
    stored = placed(docs, n_max, size, key, text)
    kind = stored.schema["doc_id"].dataType.simpleString()
    wanted = placed(target.withColumn("_none", F.lit(None).cast("long")), n_max, size, "_none", text)
    gain = gains(counts(stored, size), counts(wanted, size))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.concatenate([[0], np.cumsum(gain[_flat(batch, size)])])
            ends = np.concatenate([[0], np.cumsum(batch.column("n_features").to_numpy())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(sums[ends]))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = stored.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    return written(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")


def drawn(weights: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Ranks the ``percent`` (rounded down) of the documents of ``least_words`` words or more that have the highest scores:
    doc_id, n_features, weight, score, rank (from 1; null for the others). Ties go to the smaller doc_id, a null one being
    the greatest; rows equal in these are in any order. An empty table gives none."""
    able = F.col("n_words") >= least_words
    rows = weights.withColumn("_late", ~able)
    order = [F.col("_late"), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows.drop("n_words"), "ranks")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.sum((~F.col("_late")).cast("long")).alias("_able"))
    # One row for each partition of the sort, so small enough to be sent to all tasks.
    base = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"), F.sum("_able").over(Window.partitionBy()).alias("_able"))
    place = F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    rows = rows.join(F.broadcast(base), part == F.col("_part")).withColumn("_place", place)
    chosen = ~F.col("_late") & (F.col("_place") <= F.floor(F.col("_able") * percent / 100))
    return rows.select("doc_id", "n_features", "weight", "score", F.when(chosen, F.col("_place")).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, n_max: int = 1, size: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Weighs ``docs`` by their likeness to ``target`` and draws: see ``weighted`` and ``drawn``."""
    return drawn(weighted(docs, target, n_max, size, seed, key, text), percent, least_words)
