"""BPE encoding and decoding of whole texts with a public tokenizer's file.

Encoding goes through the distinct words. The texts of a block are split into words, of which the documents become codes
into the block's word list. The lists of all blocks are dealt out by the words' hashes; each part is a table of distinct
words, of which each is encoded once. The ids return to all blocks that hold the word, where the documents take them by
position. So what is shuffled is a word for each block that holds it, not for each place, and the codes; a very frequent
word is there once a block.

Decoding joins each id with its piece and appends the pieces. The table of pieces is as long as the vocabulary, so it is
sent to all tasks, where ids find their pieces by place; nothing is shuffled.

A word begins at a blank that something visible follows: no piece of the tokenizer's first split reaches over such a
blank. Before bytes that may begin a Unicode blank, and before "<", with which a special token may begin, no cut is
made: a special token is looked for before the split, and blanks before it stay together. A mark such as "." between a
letter and a cut is a word by itself, so that a word at the end of a sentence is none of its own.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfield.llm.words import FORGET, blocks, hashes, release, thrifty

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 1 << 25
#: Bytes that may follow the blank at which a word begins.
OPEN = np.ones(256, bool)
OPEN[:0x21] = False
OPEN[[ord("<"), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: Marks that are words by themselves between a letter and a cut; no piece of the first split has a letter and a mark after it.
MARK, LETTER = np.isin(np.arange(256), list(b".,;:!?")), np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


@cache
def library(path: str):
    """The tokenizer, once for each Python worker, without its truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@cache
def widths(path: str) -> np.ndarray:
    """How many bytes each id's piece stands for, of ids that are not special: a letter each."""
    found = library(path)
    return np.array([len(found.id_to_token(k) or "") for k in range(found.get_vocab_size(with_added_tokens=True))], np.int64)


def _forget() -> None:
    library.cache_clear()
    widths.cache_clear()


FORGET["bpe"] = _forget


def bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of a block begin, and its end: at each document's beginning and at each cut within."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        cut[: len(data) - 1] = (data[:-1] == 0x20) & OPEN[data[1:]]
    cut[offsets] = True
    if len(data):
        cut[1:-1] |= LETTER[data[:-1]] & MARK[data[1:]] & cut[2:]
    return np.flatnonzero(cut)


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.LargeBinaryArray:
    """The slices of ``data`` between ``offsets``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def word_list(data: np.ndarray, at: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The distinct words of a block, the most frequent first, then in order of their bytes, and each word's code."""
    coded = binaries(data, at).dictionary_encode()
    index = coded.indices.to_numpy()
    count = np.bincount(index, minlength=len(coded.dictionary))
    by_word = np.asarray(pc.array_sort_indices(coded.dictionary))
    order = by_word[np.argsort(-count[by_word], kind="stable")]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[index]


def squeezed(codes: np.ndarray) -> bytes:
    """Codes of up to 32 bits as bytes of like weight, compressed: frequent words have small codes."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unsqueezed(stored: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(stored), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _raw(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, and where each begins, with the end of the last."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _stored(words: pa.LargeBinaryArray) -> tuple[bytes, bytes]:
    """Words as their lengths and their bytes, compressed."""
    data, at = _raw(words)
    return squeezed(np.diff(at)), zstandard.compress(data.tobytes(), 3)


def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch, np.ndarray, pa.LargeBinaryArray, np.ndarray]]:
    """The blocks of a task: number, mark (a hash of the bytes), rows, how many words each has, the distinct words, all codes."""
    block = TaskContext.get().partitionId() << 33
    for rows, data, offsets in blocks(batches, own="bpe", size=BLOCK):
        at = bounds(data, offsets)
        mark = xxhash.xxh3_64_intdigest(np.ascontiguousarray(data)) >> 1
        yield block, mark, rows, np.diff(np.searchsorted(at, offsets)), *word_list(data, at)
        block += 1


def coded(docs: DataFrame) -> DataFrame:
    """The documents of each block: block, mark, doc_ids, n_words, and codes of all their words in order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, mark, rows, n_words, _, codes in split(batches):
            yield pa.RecordBatch.from_pydict({"block": [block], "mark": [mark], "doc_ids": one(rows.column("doc_id")), "n_words": one(pa.array(n_words, pa.int64())), "codes": [squeezed(codes)]})

    return docs.mapInArrow(thrifty(code, "bpe"), f"block long, mark long, doc_ids array<{kind}>, n_words array<long>, codes binary")


def listed(docs: DataFrame, buckets: int) -> DataFrame:
    """The distinct words of each block, a row for each of ``buckets`` into which their hashes fall: _block, _mark, bucket,
    codes (their differences), lengths and words, compressed."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, mark, _, _, words, _ in split(batches):
            raw, at = _raw(words)
            to = (hashes(raw, at[:-1], at[1:]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            own, first = np.unique(to[order], return_index=True)
            cuts = np.append(first, len(order))
            parts = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            lengths, texts = zip(*(_stored(words.take(pa.array(p))) for p in parts), strict=True) if parts else ((), ())
            yield pa.RecordBatch.from_pydict({
                "_block": np.full(len(own), block, np.int64), "_mark": np.full(len(own), mark, np.int64), "bucket": own.astype(np.int32),
                "codes": pa.array([squeezed(np.diff(p, prepend=0)) for p in parts], pa.binary()),
                "lengths": pa.array(lengths, pa.binary()), "words": pa.array(texts, pa.binary()),
            })

    return docs.mapInArrow(thrifty(deal, "bpe"), "_block long, _mark long, bucket int, codes binary, lengths binary, words binary")


def word_ids(words: list[bytes] | pa.LargeBinaryArray, path: str, step: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, and how many each has. Words that begin at a cut are encoded ``step`` at a time as one text, in
    which each begins at a cut too, and the ids are dealt out by their bytes; others alone."""
    encode = lambda x: np.array(library(path).encode(x.tobytes().decode(), add_special_tokens=False).ids, "<u4")
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary())
    data, at = _raw(words)
    joined = np.diff(at) > 1
    first = at[:-1][joined]
    joined[joined] = (data[first] == 0x20) & OPEN[data[first + 1]]
    joined[np.searchsorted(at, np.flatnonzero(data == ord("<")), "right") - 1] = False
    together, alone = np.flatnonzero(joined), np.flatnonzero(~joined)
    lengths, found = np.zeros(len(words), np.int32), [np.zeros(0, "<u4")]
    text, ends = _raw(words.take(pa.array(together)))
    for k in range(0, len(together), step):
        cuts = ends[k : k + step + 1]
        found.append(encode(text[cuts[0] : cuts[-1]]))
        upto = np.searchsorted(np.cumsum(widths(path)[found[-1]]), cuts[1:] - cuts[0]) + 1
        lengths[together[k : k + step]] = np.diff(upto, prepend=0)
    for k in alone:
        found.append(encode(data[at[k] : at[k + 1]]))
        lengths[k] = len(found[-1])
    order = np.concatenate([together, alone])
    begins = np.zeros(len(words), np.int64)
    begins[order] = np.cumsum(lengths[order]) - lengths[order]
    return gathered(np.concatenate(found), begins, lengths), lengths


def gathered(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, of: np.ndarray | None = None, step: int = 1 << 18) -> np.ndarray:
    """The slices of ``flat`` one after another; or those with the numbers ``of``. Their places are held ``step`` slices at a time."""
    out = np.empty(int((lengths if of is None else lengths[of]).sum()), flat.dtype)
    at = 0
    for k in range(0, len(lengths if of is None else of), step):
        some = slice(k, k + step) if of is None else of[k : k + step]
        n = lengths[some]
        ends = np.cumsum(n, dtype=np.int64)
        out[at : at + ends[-1]] = flat[np.arange(ends[-1]) + np.repeat(begins[some] - (ends - n), n)]
        at += int(ends[-1])
    return out


def known_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """``listed`` words with their ids instead of bytes, each distinct word encoded once: _block, _mark, codes, lengths (ids
    of each), ids. A bucket has all blocks' entries of its words, so its word table is whole."""

    def encode(rows: pa.Table) -> pa.Table:
        release("bpe")
        lengths = [unsqueezed(x) for x in rows["lengths"].to_pylist()]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        data = b"".join(zstandard.decompress(x) for x in rows["words"].to_pylist())
        table = binaries(np.frombuffer(data, np.uint8), offsets).dictionary_encode()
        ids, n = word_ids(table.dictionary, tokenizer)
        begins, index = np.cumsum(n, dtype=np.int64) - n, table.indices.to_numpy()
        ends = np.cumsum([len(x) for x in lengths])
        own = [index[end - len(x) : end] for end, x in zip(ends, lengths, strict=True)]
        return pa.table({
            "_block": rows["_block"], "_mark": rows["_mark"], "codes": rows["codes"], "lengths": pa.array([squeezed(n[k]) for k in own], pa.binary()),
            "ids": pa.array([squeezed(gathered(ids, begins, n, k)) for k in own], pa.binary()),
        })

    return words.groupBy("bucket").applyInArrow(encode, "_block long, _mark long, codes binary, lengths binary, ids binary")


def encoded(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids: doc_id, n_tokens, ids (array), ids_sha256 (of ids as little-endian unsigned 32-bit integers).

    A null text is empty and has no ids. The strings of special tokens become their ids. A very long text is a block of
    its own, and a very long word is one word. Every row stands by itself, so repeated rows, equal and null doc_ids each
    give a row; other columns are ignored, an empty table gives none.

    The texts are split twice, once for the word lists and once for the codes, so that neither is stored; ``docs`` must
    give its rows in the same order again, as stored tables do. Marks of the blocks tell where it does not: an error.
    """
    def columns(ids: np.ndarray, ends: np.ndarray) -> dict[str, object]:
        return {"n_tokens": np.diff(ends), "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view("<i4"))), "ids_sha256": _digests(ids, ends)}

    return _placed(docs, tokenizer, key, text, columns, "n_tokens long, ids array<int>, ids_sha256 string")


def _digests(ids: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = memoryview(ids).cast("B") if len(ids) else b""
    return [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]


def _placed(docs: DataFrame, tokenizer: str, key: str, text: str, columns: Callable[[np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """doc_id and what ``columns`` makes of the ids of a block's documents (little-endian, unsigned, of 32 bits) and where
    each begins."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # About as many words in a bucket as in a block, whatever the input's size.
    buckets = max(32, 4 * docs.rdd.getNumPartitions())

    def place(rows: pa.Table, words: pa.Table) -> pa.Table:
        release("bpe")
        marks = {*rows["mark"].to_pylist(), *words["_mark"].to_pylist()}
        if len(rows) != 1 or len(marks) != 1:
            raise RuntimeError("the documents were not the same when they were read again: store them first")
        many = lambda c: [unsqueezed(x.as_py()) for x in words[c]]
        join = lambda arrays: np.concatenate([np.zeros(0, "<u4"), *arrays])
        code, n = join(np.cumsum(x, dtype="<u4") for x in many("codes")), join(many("lengths"))
        begins, lengths = np.zeros(len(code), np.int64), np.zeros(len(code), np.int32)
        begins[code], lengths[code] = np.cumsum(n, dtype=np.int64) - n, n
        codes = unsqueezed(rows["codes"][0].as_py())
        ids = gathered(join(many("ids")), begins, lengths, codes)
        n_words = rows["n_words"].combine_chunks().flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths[codes], dtype=np.int64)])[np.concatenate([[0], np.cumsum(n_words)])]
        return pa.table({"doc_id": rows["doc_ids"].combine_chunks().flatten()} | columns(ids, ends))

    known = known_words(listed(docs, buckets), tokenizer)
    return coded(docs).groupBy("block").cogroup(known.groupBy("_block")).applyInArrow(place, f"doc_id {kind}, {schema}")


def _bytes_of_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible ones of Latin-1 stand for themselves, the others
    follow from U+0100 on, in order."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    letters = {chr(b): b for b in shown}
    return letters | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}


def pieces(tokenizer: str) -> pa.BinaryArray:
    """The pieces (bytes) of a byte-level tokenizer by id, null where the vocabulary has none. A token with other letters,
    as special ones may have, is its own UTF-8 text."""
    letters = _bytes_of_letters()
    raw = lambda t: bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode()
    found = {k: raw(t) for t, k in library(tokenizer).get_vocab(with_added_tokens=True).items()}
    return pa.array([found.get(k) for k in range(max(found, default=-1) + 1)], pa.binary())


def _texts(piece: pa.BinaryArray, flat: pa.Array, ends: np.ndarray, size: int = 1 << 19) -> Iterator[str]:
    """The texts of the documents whose ids are between ``ends``: the pieces of ``size`` ids, or of one document, at a time."""
    first = 0
    while first < len(ends) - 1:
        to = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        ids = flat.slice(ends[first], ends[to] - ends[first])
        known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(piece)))
        raw, at = _raw(pc.fill_null(piece.take(pc.if_else(known, ids, None)), b"").cast(pa.large_binary()))
        at, raw = at[ends[first : to + 1] - ends[first]], memoryview(raw)
        for a, b in zip(at, at[1:], strict=False):
            yield str(raw[a:b], "utf-8", "replace")
        first = to


def decoded(rows: DataFrame, tokenizer: str, ids: str = "ids", digest: bool = False) -> DataFrame:
    """``rows`` with ``text`` in the place of ``ids``, an array of ids; or with decoded_sha256, the lowercase hex SHA-256 of
    the text in UTF-8.

    Ids that the vocabulary lacks are left out, and so are null ones; bytes that are no UTF-8 become U+FFFD. Null and
    empty arrays give an empty text. Special tokens are kept as their strings. A very long row is held by its task.
    Other columns are kept, repeated rows each; an empty table gives none.
    """
    name = "decoded_sha256" if digest else "text"
    kept = [c for c in rows.columns if c != ids]
    # As long as the vocabulary, whatever the input.
    table = rows.sparkSession.sparkContext.broadcast(pieces(tokenizer))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            texts = _texts(table.value, lists.flatten(), np.concatenate([[0], np.cumsum(n)]))  # without those of null lists
            done = [hashlib.sha256(t.encode()).hexdigest() for t in texts] if digest else list(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(done, pa.string())], names=[*kept, name])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != ids)
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`")).mapInArrow(join, f"{columns}, {name} string")


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes: doc_id, n_tokens, ids_sha256, decoded_sha256. Odd rows as in ``encoded``. A block's ids are decoded
    where they are placed, by the pieces as in ``decoded``."""
    table = docs.sparkSession.sparkContext.broadcast(pieces(tokenizer))

    def columns(ids: np.ndarray, ends: np.ndarray) -> dict[str, object]:
        texts = _texts(table.value, pa.array(ids), ends)
        return {"n_tokens": np.diff(ends), "ids_sha256": _digests(ids, ends), "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts]}

    return _placed(docs, tokenizer, key, text, columns, "n_tokens long, ids_sha256 string, decoded_sha256 string")
