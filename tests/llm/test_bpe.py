"""BPE through distinct words against the library, text by text, and on odd rows."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starfield.llm import bpe, queries
from starfield.llm.words import blocks, utf8

PATH = queries.tokenizer("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = ["a", "Word", " ", "  ", "\n", "\t", "'s", "'t", "12", ",", "!", "<", "<|endoftext|>", "<|endoftext", " ", " ", "　", "\u0085", "é", "日本", "🙂", "\x1f", "\x7f", "ﬁ", "नि"]


def brute(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    out = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()


def test_equals_the_library(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    want = [(i, *brute(t)) for i, t in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_distinct_words(spark, sf_dir).collect())) == sorted(want)


def test_odd_rows(spark):
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    texts = [None, "", " ", "x", "a  <|endoftext|> b", "a <|endoftext|>  b", "<|endoftext|><|endoftext|>", "  two  blanks \n\n ", long, "y" * 50_000, "tie", "tie"]
    rows = [(k if k else None, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("block", "codes", "words", "ids", "n_tokens", "_block", "word"):
        docs = docs.withColumn(c, F.lit("extra"))
    found = bpe.round_trip(docs, PATH)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(i, *brute(t)) for i, t in rows], key=repr)
    assert bpe.round_trip(docs.limit(0), PATH).collect() == []
    named = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("body"))
    assert {r.doc_id for r in bpe.encoded(named, PATH, "name", "body").collect()} == {None, *(f"d{k}" for k in range(1, 12))}


def test_small_blocks_and_batches(spark, monkeypatch):
    """Words that are in many blocks, and runs of a word that go on over the ends of batches."""
    texts = [" ".join(["the"] * (k % 7 + 1) + [f"n{k % 5}", "the"]) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r.doc_id, r.ids) for r in bpe.encoded(docs, PATH).collect())
        again = bpe.decoded(bpe.encoded(docs, PATH).select("doc_id", "ids"), PATH)
        assert sorted(map(tuple, again.collect())) == list(enumerate(texts))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(k, LIBRARY.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)]


def test_decoding_any_ids(spark):
    """Ids that no text gives: broken UTF-8, unknown ids, nulls."""
    rows = [[464, 50256, 0], [162], [162, 245, 98, 162], [], None, [50256, 60_000, -1, 11], [11, None, 11]]
    got = bpe.decoded(spark.createDataFrame(list(enumerate(rows)), "k int, ids array<int>"), PATH).collect()
    known = [[i for i in r or [] if i is not None and 0 <= i <= 50256] for r in rows]
    assert sorted((r.k, r.text) for r in got) == [(k, LIBRARY.decode(r, skip_special_tokens=False)) for k, r in enumerate(known)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_words_encode_as_whole_texts(text):
    for _, data, offsets in blocks([bpe.pa.RecordBatch.from_pydict({"text": [text]})], own="bpe"):
        at = bpe.bounds(data, offsets)
        words = [bytes(data[a:b]) for a, b in zip(at, at[1:], strict=False)]
        ids, lengths = bpe.word_ids(words, PATH)
        assert b"".join(words).decode() == text and int(lengths.sum()) == len(ids)
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_codes_return():
    codes = np.array([0, 5, 70_000, 1, 0, 3], np.int64)
    assert bpe.unsqueezed(bpe.squeezed(codes)).tolist() == codes.tolist()
    words, index = bpe.word_list(*utf8(bpe.pa.array(["b", "a", "c", "a"])))
    assert words.to_pylist() == [b"a", b"b", b"c"] and index.tolist() == [1, 0, 2, 0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_pieces(name):
    assert len(bpe.pieces(queries.tokenizer(name))) == 50_257


def test_marks_at_the_ends_of_words_are_words():
    """A word before a full stop is no distinct word of its own; other marks and places stay as they were."""
    data, offsets = utf8(bpe.pa.array(["end end. end, end", "an end.", "3. x.y .z a.<|endoftext|>. end.\n\nend é."]))
    words, codes = bpe.word_list(data, bpe.bounds(data, offsets))
    assert codes[1] == codes[3] == codes[5] == codes[7] and {b" end", b".", b",", b"3.", b" x.y", b" .z"} <= {*words.to_pylist()}
    ids, n = bpe.word_ids(words, PATH)
    assert bpe.gathered(ids, np.cumsum(n) - n, n, codes, step=3).tolist() == [i for a, b in zip(offsets, offsets[1:]) for i in LIBRARY.encode(data[a:b].tobytes().decode(), add_special_tokens=False).ids]


def test_round_trip_needs_one_worker_a_task(spark):
    """Workers that feed each other are held at the same time, with what each keeps."""
    docs = spark.createDataFrame([(1, "a b. c"), (2, None)], "doc_id long, text string")
    plan = bpe.round_trip(docs, PATH)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("FlatMapCoGroupsInArrow")]
    assert "MapInArrow" not in above


def test_decoding_in_slices():
    texts = ["a b", "", "c. d é", "x" * 50]
    ids = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    ends = np.cumsum([0, *map(len, ids)])
    assert [*bpe._texts(bpe.pieces(PATH), bpe.pa.array(sum(ids, [])), ends, size=2)] == texts
