"""Benchmark decontamination by a distributed positional inverted index.

1. Equal windows of the test items are one: each has a home, the first item and place that hold it.
2. The terms of the homes are counted over the whole corpus. The two rarest terms of a window are its seeds; the index
   stores the positions of all seed terms.
3. The rarest term's postings, each less the term's place in the item, give alignments (item, document, offset); the
   second one's postings, offset alike, are intersected with them, up to ``slop`` words apart.
4. For the documents that are left, the positions of all test terms are stored and intersected term by term; runs of
   places that all match, at least a window long, are the phrase matches: exact where all stand in their places,
   and proximity matches where each stands within ``slop`` words of its place.
5. Items that share the windows of a run are looked up by intervals of places.

Windows are never listed per document: a passage of n words costs n postings, not n windows of 13, and it does so once
however many items hold it. A bitmap says which words are stored; words that only share its bits with a term are
dropped by the joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starfield.llm.words import NOT_ALNUM, Words, blocks, gram_hashes, signed
from starfield.plans.materialize import checkpoint, written

WINDOW = 13
#: By how many words a term of a proximity match may be out of its place.
SLOP = 2
#: The bitmap of terms has 32 bits for each term, at least 2^20 and at most 2^28 (32 MB).
BITS = (20, 28)


class Marks:
    """The terms' low bits, packed. Its size follows the number of test terms, not the corpus."""

    def __init__(self, terms: DataFrame):
        found = terms.select("term").distinct().toArrow().column("term").to_numpy().view(np.uint64)
        bits = int(np.clip(int(32 * max(len(found), 1)).bit_length(), *BITS))
        self.low = np.uint64((1 << bits) - 1)
        marks = np.zeros(1 << bits, bool)
        marks[(found & self.low).astype(np.int64)] = True
        self.bits = np.packbits(marks, bitorder="little")

    def of(self, h: np.ndarray) -> np.ndarray:
        at = (h & self.low).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def item_terms(items: DataFrame) -> DataFrame:
    """All words of all items: item (its id and text), place, term (a hash), n_words."""
    kind = items.schema["item_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets, NOT_ALNUM, lower=True)
            doc = pa.array(words.document())
            yield pa.RecordBatch.from_pydict({"item_id": rows.column("item_id").take(doc), "item_text": rows.column("item_text").take(doc), "place": np.arange(len(words)) - words.first[doc], "term": signed(words.hashes()), "n_words": words.counts[doc].astype(np.int64)})

    rows = items.select("item_id", "text", F.xxhash64("text").alias("item_text")).distinct().mapInArrow(split, f"item_id {kind}, item_text long, place long, term long, n_words long")
    return rows.select(F.struct("item_id", "item_text").alias("item"), "place", "term", "n_words")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """All windows of all items: item, start, need (its words), home (the first item with such a window, and its place)."""
    kind = items.schema["item_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets, NOT_ALNUM, lower=True)
            need = np.minimum(words.counts, window)
            ones, twos = words.hashes(), words.hashes(1)
            for n in np.unique(need[need > 0]):
                at = words.starts_of_grams(int(n))
                doc = words.document()[at]
                at, doc = at[need[doc] == n], doc[need[doc] == n]
                of = pa.array(doc)
                yield pa.RecordBatch.from_pydict({"item_id": rows.column("item_id").take(of), "item_text": rows.column("item_text").take(of), "start": at - words.first[doc], "need": np.full(len(at), n, np.int64), "h1": signed(gram_hashes(ones, int(n))[at]), "h2": signed(gram_hashes(twos, int(n))[at])})

    rows = items.select("item_id", "text", F.xxhash64("text").alias("item_text")).distinct().mapInArrow(split, f"item_id {kind}, item_text long, start long, need long, h1 long, h2 long")
    rows = checkpoint(rows.select(F.struct("item_id", "item_text").alias("item"), "start", "need", "h1", "h2"))
    homes = rows.groupBy("need", "h1", "h2").agg(F.min(F.struct("item", "start")).alias("home"))
    return rows.join(homes, ["need", "h1", "h2"]).select("item", "start", "need", "home")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each term occurs in all documents: term, n."""
    marks = Marks(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in blocks(batches):
            h = Words(data, offsets, NOT_ALNUM, lower=True).hashes()
            found, n = np.unique(h[marks.of(h)], return_counts=True)
            yield pa.RecordBatch.from_pydict({"term": signed(found), "n": n})

    partial = docs.select("text").mapInArrow(count, "term long, n long")
    return partial.groupBy("term").agg(F.sum("n").alias("n")).join(terms.select("term").distinct(), "term", "left_semi")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for every document: doc (doc_id and the text's hash), n_words, postings (term, position) of the terms,
    and of a few other words that share the bitmap's bits."""
    marks = Marks(terms)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets, NOT_ALNUM, lower=True)
            h = words.hashes()
            at = np.flatnonzero(marks.of(h))
            bounds = np.searchsorted(at, words.first)
            doc = np.repeat(np.arange(len(words.counts)), np.diff(bounds))
            listed = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x)) for x in (signed(h[at]), (at - words.first[doc]))]
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "text_id": rows.column("text_id"), "n_words": words.counts.astype(np.int64), "terms": listed[0], "positions": listed[1]})

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_id")).mapInArrow(store, f"doc_id {kind}, text_id long, n_words long, terms array<long>, positions array<long>")
    return rows.select(F.struct("doc_id", "text_id").alias("doc"), "n_words", "terms", "positions")


def postings(indexed: DataFrame) -> DataFrame:
    """term, doc, position."""
    return indexed.select("doc", F.explode(F.arrays_zip("terms", "positions")).alias("p")).select("doc", F.col("p.terms").alias("term"), F.col("p.positions").alias("position"))


def seed_pairs(terms: DataFrame, windows: DataFrame, counts: DataFrame) -> DataFrame:
    """The two rarest terms of every window that the corpus may hold: item, need (its window's length), p1, t1, p2, t2,
    and the first and last place of the windows that have them. Only windows at home are listed."""
    own = windows.filter((F.col("home.item") == F.col("item")) & (F.col("home.start") == F.col("start"))).select("item", "need", "start")
    places = own.select("item", "need", "start", F.explode(F.sequence("start", F.col("start") + F.col("need") - 1)).alias("place"))
    # Counts meet each word of an item once, not once for each of its windows.
    counted = terms.select("item", "place", "term").join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    every = places.join(counted, ["item", "place"])
    # A group is a window: its length at most.
    rare = every.groupBy("item", "need", "start").agg(F.slice(F.sort_array(F.collect_set(F.struct("n", "place", "term"))), 1, 2).alias("r"))
    rare = rare.filter(F.col("r")[0]["n"] > 0)
    pick = lambda k, f: F.element_at("r", k)[f]
    pairs = rare.select("item", "need", "start", pick(1, "place").alias("p1"), pick(1, "term").alias("t1"), pick(-1, "place").alias("p2"), pick(-1, "term").alias("t2"))
    return pairs.groupBy("item", "need", "p1", "t1", "p2", "t2").agg(F.min("start").alias("low"), (F.max("start") + F.col("need") - 1).alias("high"))


def _cells(position: Column, slop: int, near: bool = False) -> Column:
    """Stretches of ``slop + 1`` words: what is ``slop`` words apart at most lies in one or in two that meet."""
    cell = F.floor(position / (slop + 1)).cast("long")
    return F.explode(F.array(*[cell + k for k in (-1, 0, 1)])) if near and slop else cell


def alignments(pairs: DataFrame, indexed: DataFrame, slop: int = 0) -> DataFrame:
    """Where a window's two rarest terms stand as in the item: doc, offset (of the item's first word), the pair, and
    ``off``, by how much the second one is out of place, which is ``slop`` at most."""
    all_ = postings(indexed)
    one = pairs.join(all_.select(F.col("term").alias("t1"), "doc", "position"), "t1").withColumn("offset", F.col("position") - F.col("p1")).drop("position")
    one = one.withColumn("_at", F.col("offset") + F.col("p2")).withColumn("_cell", _cells(F.col("_at"), slop, near=True))
    two = all_.select(F.col("doc").alias("_doc"), F.col("term").alias("_t"), F.col("position").alias("_p"), _cells(F.col("position"), slop).alias("_c"))
    both = one.join(two, (one["doc"] == two["_doc"]) & (one["t2"] == two["_t"]) & (one["_cell"] == two["_c"]))
    off = F.abs(F.col("_p") - F.col("_at"))
    return both.withColumn("off", off).filter(F.col("off") <= slop).drop("_doc", "_t", "_p", "_c", "_at", "_cell")


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """The index (a row for every document), and all matches: doc, item (at home), need, low, high (its places), offset
    (of the item's first word in the document), exact. They are at least ``window`` words or a whole shorter item long;
    exact ones are also listed as matches that are not, since each of their words is within ``slop`` of its place."""
    terms = checkpoint(item_terms(items))
    windows = checkpoint(item_windows(items, window))
    pairs = checkpoint(seed_pairs(terms, windows, term_counts(docs, terms)))
    seeds = pairs.select(F.explode(F.array("t1", "t2")).alias("term")).distinct()
    indexed = written(index(docs, seeds), "postings")
    found = checkpoint(alignments(pairs, indexed, slop).select("item", "need", "doc", "offset", "low", "high").distinct())
    candidates = found.select("doc").distinct()
    ids = candidates.select(F.col("doc.doc_id").alias("_id"), F.col("doc.text_id").alias("_text")).distinct()
    left = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]) & (F.xxhash64(docs["text"]) == ids["_text"]), "left_semi")
    full = postings(index(left, terms)).distinct().select("doc", "term", F.col("position").alias("_p"), _cells(F.col("position"), slop).alias("_cell"))
    places = found.select("item", "need", "doc", "offset", F.explode(F.sequence("low", "high")).alias("place")).distinct()
    expected = places.join(terms.select("item", "place", "term"), ["item", "place"]).withColumn("_at", F.col("offset") + F.col("place"))
    expected = expected.withColumn("_cell", _cells(F.col("_at"), slop, near=True))
    off = F.abs(F.col("_p") - F.col("_at"))
    matched = expected.join(full, ["doc", "term", "_cell"]).filter(off <= slop).groupBy("doc", "item", "need", "offset", "place").agg(F.min(off).alias("off"))
    # A partition is one alignment, so as long as the item.
    along = Window.partitionBy("doc", "item", "offset").orderBy("place")
    exactly = Window.partitionBy("doc", "item", "offset", "_exact").orderBy("place")
    matched = matched.withColumn("_exact", F.col("off") == 0)
    matched = matched.withColumns({"near": F.col("place") - F.row_number().over(along), "same": F.when(F.col("_exact"), F.col("place") - F.row_number().over(exactly))})
    both = matched.select("doc", "item", "need", "offset", "place", F.explode(F.array(F.struct(F.lit(False).alias("exact"), F.col("near").alias("run")), F.struct(F.lit(True).alias("exact"), F.col("same").alias("run")))).alias("_")).select("*", "_.*").filter("run IS NOT NULL")
    runs = both.groupBy("doc", "item", "need", "offset", "exact", "run").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    return indexed, runs.filter(F.col("high") - F.col("low") + 1 >= F.col("need")).drop("run").join(_shared(windows), ["item", "need"], "left")


def _shared(windows: DataFrame) -> DataFrame:
    """For each item at home and need: ``holders``, the intervals of starts whose windows other items (or itself) hold:
    array of item_id, from, to."""
    along = Window.partitionBy("home.item", "need", "item").orderBy("start_")
    rows = windows.select("home", "need", "item", F.col("home.start").alias("start_")).distinct().withColumn("_run", F.col("start_") - F.row_number().over(along))
    spans = rows.groupBy(F.col("home.item").alias("home"), "need", "item", "_run").agg(F.min("start_").alias("from"), F.max("start_").alias("to"))
    # One row for each item; its list is as long as its windows and the items that share them.
    return spans.groupBy(F.col("home").alias("item"), "need").agg(F.collect_list(F.struct(F.col("item.item_id").alias("item_id"), "from", "to")).alias("holders"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Every row's overlap with the items: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, text_id.

    Words are runs of ASCII letters, lower-cased, digits and all other characters beyond ASCII. A window is ``window``
    consecutive words of an item, or all of a shorter one; a word in any occurrence of a window is hit. A document is
    contaminated if at least a twentieth of its words are hit. ``n_near`` counts the items with a proximity match: a
    window all of whose words stand within ``slop`` words of their places, exact ones included. Null and empty texts
    have no words; very long texts are indexed whole; repeated rows get a row each; a null doc_id is scored like
    others; an item without an id hits words but is not listed; other columns are ignored; without items nothing is
    hit, without documents there are no rows. ``text_id`` is the text's XXH64 (seed 42, null: 42), which tells rows
    that share a doc_id apart.
    """
    indexed, matches = phrase_matches(docs, items, window, slop)
    matches = checkpoint(matches)
    held = matches.select("doc", "exact", F.explode("holders").alias("h"), "low", (F.col("high") - F.col("need") + 1).alias("last")).filter("h.from <= last AND h.to >= low")
    held = held.select("doc", "exact", F.col("h.item_id").cast("string").alias("item_id")).distinct().groupBy("doc")
    ids = held.agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("ids"), F.count_if(~F.col("exact") & F.col("item_id").isNotNull()).alias("n_near"))
    ids = ids.select("doc", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"), "n_near")
    spans = matches.filter("exact").select("doc", (F.col("offset") + F.col("low")).alias("low"), (F.col("offset") + F.col("high")).alias("high")).distinct()
    nothing = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))
    union = F.aggregate("runs", nothing, lambda s, r: F.struct(F.greatest(s["end"], r["high"]).alias("end"), (s["hit"] + F.greatest(F.lit(0), r["high"] - F.greatest(s["end"], r["low"] - 1))).alias("hit")))["hit"]
    hits = spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("runs")).select("doc", union.alias("n_hit"))
    rows = indexed.select("doc", "n_words").join(ids.join(hits, "doc", "left"), "doc", "left")
    n_hit, zero = F.coalesce("n_hit", F.lit(0)).cast("long"), F.lit(0).cast("long")
    return rows.select(
        "doc.doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", zero).alias("n_near"), "doc.text_id",
    )


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, position (of the match's first place, as the alignment has it), exact, of all matches; of each
    repeated row alike. Nulls, empty tables and other columns as in ``contamination``."""
    matches = phrase_matches(docs, items, window, slop)[1].select("*", F.explode("holders").alias("h")).filter("h.from <= high - need + 1 AND h.to >= low")
    rows = matches.groupBy("doc.doc_id", "h.item_id", F.greatest(F.col("offset") + F.col("low"), F.lit(0)).alias("position")).agg(F.max("exact").alias("exact"))
    return rows
