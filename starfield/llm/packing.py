"""Packing: all documents' tokens one after another, cut into windows of fixed length.

The first pass encodes each document once and stores its ids with its partition, and the tokens before it there.
The prefix sums of the partition totals (one row for each partition) give each partition's global offset; the second
pass cuts every document at the window bounds. No text or id is shuffled. The order is that of the stored first pass,
so a lost executor changes nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starfield.llm.bpe import BLOCK, binaries, bounds, gathered, library, widths, word_ids
from starfield.llm.words import FORGET, blocks, release, thrifty
from starfield.plans.materialize import written

LENGTH = 1024
END = 0


class Encoder:
    """Encodes blocks of texts by their distinct words (see ``bpe``). Nothing is kept from block to block, since workers
    live on and each would hold its own words."""

    def __init__(self, path: str):
        self.path, self.tokenizer = path, library(path)
        self.kind = np.uint16 if len(widths(path)) <= 1 << 16 else np.uint32

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block, and how many each text has."""
        at = bounds(data, offsets)
        coded = binaries(data, at).dictionary_encode()
        first, at = np.searchsorted(at, offsets), None
        ids, lengths = word_ids(coded.dictionary, self.path)
        index = coded.indices.to_numpy()
        out = gathered(ids.astype(self.kind), np.cumsum(lengths, dtype=np.int64) - lengths, lengths, index)
        return out, np.diff(np.concatenate([[0], np.cumsum(lengths[index], dtype=np.int64)])[first])


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker: it outlives the tasks."""
    return Encoder(path)


FORGET["packing"] = encoder.cache_clear


def encoded(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first pass: part, before (tokens before the document in its part), doc_id, doc_tokens, ids (bytes)."""
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for rows, data, offsets in blocks(batches, own="bpe", size=BLOCK):
            ids, counts = encoder(tokenizer).encode(data, offsets)
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, END)
            ends += np.arange(1, len(ends) + 1)
            width = ids.itemsize
            stored = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]) * width), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_pydict({
                "part": np.full(len(ends), part, np.int64), "before": before + ends - counts - 1, "doc_id": rows.column("doc_id"),
                "doc_tokens": counts + 1, "width": np.full(len(ends), width, np.int32), "ids": stored.cast(pa.binary()),
            })
            before += int(ends[-1])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(thrifty(encode, "bpe"), f"part long, before long, doc_id {kind}, doc_tokens long, width int, ids binary")


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its ids, then id 0; all documents follow each other in storage order, so every sequence but the
    last is full. A null or empty text is the one id 0; a very long one is cut into as many windows as it needs.
    Repeated rows are packed each, a null doc_id stays null, other columns are ignored, an empty table gives none.
    """
    stored = written(encoded(docs, tokenizer, key, text), "token-ids")
    kind = stored.schema["doc_id"].dataType.simpleString()
    totals = stored.groupBy("part").agg(F.sum("doc_tokens").alias("_n"))
    # One row for each partition of the first pass, so small enough to be sent to all tasks.
    base = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    rows = stored.join(F.broadcast(base), "part").select("doc_id", "doc_tokens", (F.col("_base") + F.col("before")).alias("at"), "width", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            doc, begins, lengths, crcs, at, kept = [], [], [], [], [], []
            for k, (n, first, width) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_tokens", "at", "width")), strict=True)):
                ids = np.frombuffer(batch.column("ids")[k].as_buffer(), np.uint16 if width == 2 else np.uint32).astype("<u4")
                bounds = [0, *range(length - first % length, n, length), n]
                for a, b in zip(bounds, bounds[1:], strict=False):
                    doc.append(k)
                    begins.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(ids[a:b]))
                    at.append(first + a)
                    if with_ids:
                        kept.append(ids[a:b].astype(np.int32))
            place = np.array(at, np.int64)
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(doc, pa.int64())), "start": pa.array(begins, pa.int64()), "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
                "doc_tokens": batch.column("doc_tokens").take(pa.array(doc, pa.int64())), "sequence_id": place // length, "offset": place % length,
            }
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if with_ids else {}))

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(thrifty(cut), schema + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = END) -> DataFrame:
    """Joins pieces that have ids into rows for training: sequence_id, ids (of ``length``), boundaries (offset, doc_id).

    The last sequence is filled with ``pad``. A row is as long as its sequence, however many pieces it has; pieces of
    null texts and null ids are like others; no pieces, no rows.
    """
    all_ = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = pieces.groupBy("sequence_id").agg(all_.alias("_all"))
    ids = F.flatten(F.col("_all.ids"))
    ids = F.concat(ids, F.array_repeat(F.lit(pad), F.lit(length) - F.size(ids)))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("_all", lambda x: F.struct(x["offset"], x["doc_id"])).alias("boundaries"))
