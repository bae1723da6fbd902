"""SimHash near-duplicates by pivot distance tables.

Each distinct fingerprint carries a table of its Hamming distances to many reference fingerprints. Two fingerprints
at distance 2 or less differ by 2 or less in every coordinate (the triangle inequality). The table decides which
pairs are made: the first ``CELLED`` coordinates, cut into cells of three, are join keys, so that only fingerprints of
the same or neighbouring cells meet; those whose largest coordinate difference is more than 2 are discarded
(``survivors``), and the rest are verified (``verified``). Since random references lie at much the same distance from
everything, cells alone are crowded; the other join key is two of four 16-bit blocks, which any pair at distance 2
shares.

Blocks that many distinct fingerprints share would pair up by the square. There the same links follow from bit
flips: fingerprints at distance 2 or less have a neighbour at distance 1 or less in common, so it is enough to group
each with its 64 one-bit neighbours and itself. Either way no link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfield.llm.skew import joined
from starfield.llm.words import Words, blocks
from starfield.operators.components import components
from starfield.plans.materialize import checkpoint

SHINGLE = 3
SEED = 42
RADIUS = 2
PIVOTS = 16
#: How many coordinates are join keys.
CELLED = 2
#: More distinct fingerprints than this in one block are linked by bit flips.
CROWD = 64


def pivot(k: int) -> int:
    """The k-th reference fingerprint, as a signed number."""
    return int(np.array([xxhash.xxh64_intdigest(f"pivot {k}", 0)], np.uint64).view(np.int64)[0])


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of every text of a block."""
    words = Words(data, offsets, lower=True)
    counts = words.counts
    lengths = words.ends - words.starts
    # The words of the block with one blank after each: a shingle is then one slice.
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    joined = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    keep = np.repeat(words.starts - begins, lengths) + _within(begins, lengths)
    joined[_within(begins, lengths)] = words.data[keep]
    text, ends = joined.tobytes(), begins + lengths
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.repeat(words.first[:-1], n) + _within(np.zeros_like(n), n)
    last = np.where(np.repeat(counts >= SHINGLE, n), first + SHINGLE - 1, np.repeat(words.first[1:], n) - 1)
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(counts), np.uint64)
    at, places = 0, np.cumsum(n)
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(places, (places[at - 1] if at else 0) + 200_000, "right")))
        a, b = (places[at - 1] if at else 0), places[to - 1]
        bits = np.zeros((to - at, 64), np.int64)
        for c in range(a, b, 1 << 18):  # a long text has many shingles
            d = min(b, c + (1 << 18))
            h = np.fromiter((digest(text[x:y], SEED) for x, y in zip(begins[first[c:d]].tolist(), ends[last[c:d]].tolist(), strict=True)), np.uint64, d - c)
            flat = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64)
            inside = np.searchsorted(places[at:to], np.arange(c, d), "right")
            rows, starts = np.unique(inside, return_index=True)
            bits[rows] += np.add.reduceat(flat, starts, axis=0, dtype=np.int64)
        major = (2 * bits > n[at:to, None]).astype(np.uint8)
        out[at:to] = np.packbits(major, axis=1).view(">u8").ravel()
        at = to
    return out


def _within(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begins[k], begins[k] + 1, ... for lengths[k] numbers, one k after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - lengths), lengths)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_id (the text's XXH64) and fp, the fingerprint as a signed long, of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "text_id": rows.column("text_id"), "fp": fingerprints_of(data, offsets).view(np.int64)})

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_id")).mapInArrow(hash_, f"doc_id {kind}, text_id long, fp long")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def tabled(distinct: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """The pivot table: fp, and ``d``, its distances to the references."""
    return distinct.select("fp", F.array(*[_distance(F.col("fp"), F.lit(pivot(k))).cast("byte") for k in range(pivots)]).alias("d"))


def _cell(k: int) -> Column:
    return F.floor(F.col("d")[k] / (RADIUS + 1)).cast("int")


def pairs(keyed: DataFrame, celled: int = CELLED) -> DataFrame:
    """Pairs of rows (which, bits, fp, d) with equal keys and neighbouring cells: a, b, da, db. a < b."""
    left = keyed.select("which", "bits", F.col("fp").alias("a"), F.col("d").alias("da"), *[_cell(k).alias(f"c{k}") for k in range(celled)])
    right = keyed.select("which", "bits", F.col("fp").alias("b"), F.col("d").alias("db"), *[_cell(k).alias(f"c{k}") for k in range(celled)])
    for k in range(celled):
        right = right.withColumn(f"c{k}", F.explode(F.array(*[F.col(f"c{k}") + n for n in (-1, 0, 1)])))
    return left.join(right, ["which", "bits", *[f"c{k}" for k in range(celled)]]).filter("a < b").select("a", "b", "da", "db")


def survivors(pairs: DataFrame) -> DataFrame:
    """Discards pairs whose largest coordinate difference is more than ``RADIUS``."""
    return pairs.filter(F.array_max(F.zip_with("da", "db", lambda x, y: F.abs(x - y))) <= RADIUS).select("a", "b")


def verified(survivors: DataFrame) -> DataFrame:
    return survivors.filter(_distance(F.col("a"), F.col("b")) <= RADIUS)


def blocked(distinct: DataFrame, crowd: int = CROWD, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Fingerprints by the blocks that others share: (which, bits, fp, d) where ``crowd`` at most share one, and fp
    of the others."""
    block = [F.shiftright("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = [F.struct(F.lit(n).alias("which"), (block[i] * 65536 + block[j]).alias("bits")) for n, (i, j) in enumerate(combinations(range(4), 2))]
    table = tabled(distinct, pivots).select("fp", "d", F.explode(F.array(*keys)).alias("key")).select("key.which", "key.bits", "fp", "d")
    sizes = checkpoint(table.groupBy("which", "bits").agg(F.count("*").alias("n")).filter("n > 1"))
    few = table.join(sizes.filter(F.col("n") <= crowd).select("which", "bits"), ["which", "bits"], "left_semi")
    many = table.drop("d").join(sizes.filter(F.col("n") > crowd).select("which", "bits"), ["which", "bits"], "left_semi")
    return few, many.select("fp").distinct()


def links(distinct: DataFrame, crowd: int = CROWD, pivots: int = PIVOTS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all pairs at ``RADIUS``."""
    few, crowded = blocked(distinct, crowd, pivots)
    close = verified(survivors(pairs(few)))
    flips = F.concat(F.array(F.col("fp")), *[F.array(F.col("fp").bitwiseXOR(F.lit(int(np.array([1 << k], np.uint64).view(np.int64)[0])))) for k in range(64)])
    flipped = crowded.select("fp", F.explode(flips).alias("near"))
    hubs = flipped.groupBy("near").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).filter("a < most").select("near", "a")
    star = flipped.join(hubs, "near").filter("a < fp").select("a", F.col("fp").alias("b"))
    return close.union(star).distinct()


def classed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id, text_id, fp and ``first``: doc_id, fp and text_id of the component's first row (the smallest
    doc_id, of those the smallest others; null doc_ids are last)."""
    rows = checkpoint(fingerprints(docs, key, text))
    own = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "text_id")).alias("own"), F.count("*").alias("_rows"))
    own = checkpoint(own)
    found = components(links(own.select("fp")), "a", "b")
    # Components are sums of distinct fingerprints here, not of rows.
    prints = checkpoint(own.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    first = checkpoint(prints.groupBy("component").agg(F.min("own").alias("first"), F.count("*").alias("_prints")))
    by_print = checkpoint(joined(prints, first, "component", "_prints", ["fp"]).select("fp", "first", "_rows"))
    return joined(rows, by_print, "fp", "_rows", ["doc_id", "text_id"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's class: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of its component).

    A fingerprint is the majority of the XXH64 values (seed 42) of the lower-cased text's 3-word shingles, repeats
    included; fewer words are one shingle, and no words (null or empty text) give zero, which links like any other.
    Very long texts are taken whole. Fingerprints link at two or fewer differing bits. Repeated rows stay, each with
    its class; a null doc_id is classed too but is no component_id unless all of the component's are null; other
    columns are ignored; an empty table gives none.
    """
    return classed(docs, key, text).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))
