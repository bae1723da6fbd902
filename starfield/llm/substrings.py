"""Substring dedup: seed and extend on winnowed anchors.

1. Of every ``LENGTH`` consecutive words, winnowing selects one anchor of ``ANCHOR`` words by its content alone, so
   equal passages of that length hold equal anchors. Anchors that only one document has are dropped.
2. Holders of an anchor are joined with its first holder (the smallest doc_id), never with each other: a passage in a
   third of all documents costs its length, not its square. The seed of a holder is the anchor's span, the union of
   the windows that selected it, at the place where the first holder of the same span has it.
3. Where spans around an anchor differ, they are opened, and each window is joined with its own first holder.
4. Seeds are extended both ways: those of one source on one diagonal that overlap or meet are one repeat, until no
   neighbour on either side goes on. What results is at least ``LENGTH`` words long, with its source and place there.

Two 64-bit hashes, of the anchor and of the span or window, from independent word hashes, stand for the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfield.llm.words import Words, blocks, gram_hashes, mix, signed
from starfield.plans.materialize import written

LENGTH = 50
ANCHOR = 13
_LOW = np.uint64(0xFFFFFFFF)
#: Of the anchors' word hashes; the windows' have none.
_SALT = 7
REPEATS = "array<struct<low bigint,past bigint,source {0},source_low bigint>>"
#: Begins the names of columns that are joined to those of the caller.
_OWN = "_substrings_"


def selected(words: Words, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a block: document, anchor hash and span hash of every selected anchor, with the first and last window that
    selected it, as words of the block. Where a text goes on repeating itself, equal anchors with equal spans that
    follow each other are one."""
    starts, hashes = words.starts_of_grams(length), words.hashes()
    if not len(starts):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), starts, starts)
    grams, windows = gram_hashes(words.hashes(_SALT), anchor), gram_hashes(hashes, length)
    # The least hash of each window, the leftmost of equal ones: 32 bits of hash, then the place.
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    span, wide = 1, length - anchor + 1
    while span < wide:
        step = min(span, wide - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    chosen = (least[starts] & _LOW).astype(np.int64)
    change = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    low, high = starts[change], starts[np.concatenate([change[1:] - 1, [len(starts) - 1]])]
    spans = np.zeros(len(change), np.uint64)
    n = high - low + 1
    for k in range(int(n.max())):
        more = k < n
        spans[more] = mix(spans[more] * np.uint64(0x9FB21C651E98DF25) + windows[low[more] + k])
    doc, anchors = words.document()[low], grams[chosen[change]]
    same = (anchors[1:] == anchors[:-1]) & (spans[1:] == spans[:-1]) & (doc[1:] == doc[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    return doc[head], anchors[head], spans[head], low[head], high[np.concatenate([head[1:] - 1, [len(high) - 1]])]


def occurrences(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """All selected anchors: anchor, span, doc_id, text_id, low, high (windows by their first words, from 0)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets)
            doc, anchors, spans, low, high = selected(words, length, anchor)
            yield pa.RecordBatch.from_pydict({"anchor": signed(anchors), "span": signed(spans), "doc_id": rows.column("doc_id").take(pa.array(doc)), "text_id": rows.column("text_id").take(pa.array(doc)), "low": low - words.first[doc], "high": high - words.first[doc]})

    return with_text_id(docs.filter("doc_id IS NOT NULL")).mapInArrow(select, f"anchor long, span long, doc_id {kind}, text_id long, low long, high long")


def _windows(opened: DataFrame, length: int) -> DataFrame:
    """The windows of opened spans: anchor, window, doc_id, text_id, low, past. ``opened`` has text_id, text and spans.
    Equal windows that follow each other are one."""
    kind = opened.schema["doc_id"].dataType.simpleString()

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets)
            windows = gram_hashes(words.hashes(), length)
            listed = rows.column("spans")
            n = np.diff(np.asarray(listed.offsets))
            flat = listed.flatten()
            low, high, anchors = (np.asarray(flat.field(k)) for k in range(3))
            m = high - low + 1
            if not m.sum():
                continue
            doc = np.repeat(np.repeat(np.arange(len(n)), n), m)
            at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low, m)
            hashes, keys = signed(windows[words.first[doc] + at]), np.repeat(anchors, m)
            same = (hashes[1:] == hashes[:-1]) & (keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + 1)
            head = np.flatnonzero(np.concatenate([[len(at) > 0], ~same]))
            past = at[np.concatenate([head[1:], [len(at)]]) - 1] + length
            for a in range(0, len(head), 1 << 19):
                h, d = head[a : a + (1 << 19)], doc[head[a : a + (1 << 19)]]
                yield pa.RecordBatch.from_pydict({"anchor": keys[h], "window": hashes[h], "doc_id": rows.column("doc_id").take(pa.array(d)), "text_id": np.asarray(rows.column("text_id"))[d], "low": at[h], "past": past[a : a + (1 << 19)]})

    return opened.mapInArrow(open_, f"anchor long, window long, doc_id {kind}, text_id long, low long, past long")


def with_text_id(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_id, by which rows that share a doc_id are told apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_id"))


def repeated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """The texts that repeat earlier documents' passages of ``length`` words: one table of those texts (doc_id,
    text_id, text), a superset, and one of their seeds (doc_id, text_id, repeats: low, past, source, source_low)."""
    found = occurrences(docs, length, anchor)
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"), F.min("span").alias("_c"), F.max("span").alias("_d"))
    # Written before it is joined: right above an aggregation Spark does not split a hot key's join.
    shared = written(shared.filter("_a < _b").select("anchor", (F.col("_c") < F.col("_d")).alias("varied")), "shared-anchors")
    seeds = written(found.join(shared, "anchor"), "seeds")
    first = written(seeds.groupBy("anchor", "span").agg(F.min(F.struct("doc_id", "low")).alias("first")), "first-spans")
    seeds = written(seeds.join(first, ["anchor", "span"]).filter("first.doc_id < doc_id OR varied"), "extended")
    settled = seeds.filter("first.doc_id < doc_id").select("doc_id", "text_id", "low", (F.col("high") + length).alias("past"), "first")
    # Sets, because wholly equal rows of a document give equal spans and seeds: however many rows, they stay one.
    spans = F.sort_array(F.collect_set(F.when(F.col("first.doc_id") == F.col("doc_id"), F.struct("low", "high", "anchor"))))
    wanted = seeds.groupBy("doc_id", "text_id").agg(spans.alias("spans"))
    texts = with_text_id(docs).join(wanted, ["doc_id", "text_id"]).dropDuplicates(["doc_id", "text_id"])  # as the join has dealt them
    texts = written(texts.select("doc_id", "text_id", "text", "spans"), "repeating-texts")
    windows = written(_windows(texts.filter(F.size("spans") > 0), length), "windows")
    held = windows.groupBy("anchor", "window").agg(F.min(F.struct("doc_id", "low")).alias("first"), F.max("doc_id").alias("_b")).filter("first.doc_id < _b").drop("_b")
    held = written(held, "held-windows")
    again = windows.join(held, ["anchor", "window"]).filter("first.doc_id < doc_id").select("doc_id", "text_id", "low", "past", "first")
    seed = F.struct("low", "past", F.col("first.doc_id").alias("source"), F.col("first.low").alias("source_low"))
    return texts.select("doc_id", "text_id", "text"), settled.union(again).groupBy("doc_id", "text_id").agg(F.collect_set(seed).alias("repeats"))


def extended(low: np.ndarray, past: np.ndarray, source: np.ndarray, source_low: np.ndarray) -> list[tuple[int, int, object, int]]:
    """A document's maximal repeats from its seeds: those of one source and diagonal are merged as long as they overlap
    or meet. In the order of their places."""
    names = {s: k for k, s in enumerate(dict.fromkeys(source))}
    of = np.array([names[s] for s in source], np.int64)
    order = np.lexsort((low, source_low - low, of))
    key = np.stack([of, source_low - low])[:, order]
    low, past = low[order], past[order]
    fresh = np.ones(len(low), bool)
    fresh[1:] = (key[:, 1:] != key[:, :-1]).any(0)
    # The furthest end so far on the diagonal: ends of later diagonals are lifted beyond all earlier ones.
    lift = np.cumsum(fresh) * (int(past.max()) + 2)
    reach = np.maximum.accumulate(past + lift)
    fresh[1:] |= (low + lift)[1:] > reach[:-1]
    head = np.flatnonzero(fresh)
    tail = np.concatenate([head[1:], [len(low)]]) - 1
    return sorted((int(low[a]), int(reach[b] - lift[b]), source[order[a]], int(source_low[order[a]])) for a, b in zip(head, tail, strict=True))


def _removed(words: Words, listed: pa.ListArray) -> np.ndarray:
    """Which words of a block the repeats cover."""
    n = np.diff(np.asarray(listed.offsets))
    flat = listed.flatten()
    base = np.repeat(words.first[:-1], n)
    steps = np.bincount(base + np.asarray(flat.field(0)), minlength=len(words) + 1) - np.bincount(base + np.asarray(flat.field(1)), minlength=len(words) + 1)
    return np.cumsum(steps)[: len(words)] > 0


def _cut(texts: DataFrame, repeats: DataFrame, with_text: bool) -> DataFrame:
    """What is left of texts with repeats: doc_id, text_id, n_words, n_removed, kept_sha256, repeats (or the text)."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets)
            listed = rows.column("repeats")
            gone = _removed(words, listed)
            raw, digests, left, spans = data.tobytes(), [], [], []
            for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                kept = np.flatnonzero(~gone[a:b]) + a
                if with_text:  # runs of kept words as they stand in the text
                    edge = np.flatnonzero(np.diff(kept) > 1)
                    runs = zip(words.starts[kept[np.concatenate([[0], edge + 1])]].tolist(), words.ends[kept[np.concatenate([edge, [-1]])]].tolist(), strict=True) if len(kept) else ()
                    left.append(b" ".join(raw[x:y] for x, y in runs).decode())
                    continue
                digests.append(hashlib.sha256(b" ".join(raw[x:y] for x, y in zip(words.starts[kept].tolist(), words.ends[kept].tolist(), strict=True))).hexdigest())
                own = listed[k].values
                low, past, source_low = (np.asarray(own.field(c)) for c in (0, 1, 3))
                spans.append([dict(zip(("low", "past", "source", "source_low"), x, strict=True)) for x in extended(low, past, own.field(2).to_pylist(), source_low)])
            columns = {"doc_id": rows.column("doc_id"), "text_id": rows.column("text_id")}
            if with_text:
                yield pa.RecordBatch.from_pydict(columns | {"text": left, "whole": rows.column("text")})
            else:
                removed = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_pydict(columns | {"n_removed": removed[words.first[1:]] - removed[words.first[:-1]], "kept_sha256": digests, "repeats": pa.array(spans, listed.type)})

    columns = "text string, whole string" if with_text else "n_removed long, kept_sha256 string, repeats " + REPEATS.format(kind)
    return texts.join(repeats, ["doc_id", "text_id"]).mapInArrow(cut, f"doc_id {kind}, text_id long, {columns}")


def _whole(docs: DataFrame) -> DataFrame:
    """Digests of whole texts: doc_id, text_id, n_words, kept_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            raw, counts, digests = data.tobytes(), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                words = raw[a:b].split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "text_id": rows.column("text_id"), "n_words": counts, "kept_sha256": digests})

    return with_text_id(docs).mapInArrow(digest, f"doc_id {kind}, text_id long, n_words long, kept_sha256 string")


def substring_report(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Every row's repeats: doc_id, n_words, n_removed, kept_sha256 (of the kept words, one blank between), repeats (an
    array of low, past, source, source_low: maximal spans in words, the document that has them first, and where).

    A word goes if a window of ``length`` words covers it that also stands in a document with a smaller doc_id; the
    windows are those of the input. Null and empty texts have no words; very long texts are taken whole, one at a time
    in a task. Rows that share a doc_id are one document, which loses nothing to itself; a null doc_id neither gives
    nor loses passages. Other columns are ignored; an empty table gives none.
    """
    texts, repeats = repeated(docs, length, anchor)
    less = _cut(texts, repeats, False).select("doc_id", "text_id", "n_removed", F.col("kept_sha256").alias("_left"), "repeats")
    all_ = _whole(docs).join(less, ["doc_id", "text_id"], "left")
    none = F.array().cast(less.schema["repeats"].dataType)
    return all_.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("_left", "kept_sha256").alias("kept_sha256"), F.coalesce("repeats", none).alias("repeats"))


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with the repeats cut out of ``text``. Texts without a repeat stay as they are; rows of which nothing
    is left go."""
    texts, repeats = repeated(docs, length, anchor)
    less = _cut(texts, repeats, True).select(F.col("doc_id").alias(_OWN + "doc"), F.col("whole").alias(_OWN + "text"), F.col("text").alias(_OWN + "left"))
    changed = written(less, "cut-texts")
    cut = docs.join(changed, (F.col("doc_id") == F.col(_OWN + "doc")) & (F.col("text") == F.col(_OWN + "text")), "left")
    cut = cut.filter(F.col(_OWN + "left").isNull() | (F.col(_OWN + "left") != ""))
    cut = cut.withColumn("text", F.coalesce(_OWN + "left", "text"))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])
