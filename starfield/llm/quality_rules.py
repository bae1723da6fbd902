"""Quality rules by line labelling: a linear-chain conditional random field marks every line as content or
boilerplate, Viterbi decoding finds the most probable labels of a document, and the share of its words in content
lines decides.

The field is fitted on a bounded sample of labelled documents. Labels of documents become labels of lines by the lines'
own evidence (``line_labels``): in good documents a line is content unless it is boilerplate on its face (many
kinds of documents hold it, the document repeats it, or symbols and shouts fill it); in poor ones it is boilerplate unless it
reads as a sentence and is none of that. So good documents teach the field how boilerplate lines stand among content,
and poor ones the opposite. Without labels of both kinds the fixed weights of ``PRIOR`` hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfield.llm.samples import labelled
from starfield.llm.words import Words, blocks, gram_hashes, mix, signed
from starfield.plans.materialize import checkpoint

#: Chains of lines that are fitted on, at most, and the lines of each: longer documents are several chains.
SAMPLE, CHAIN = 3000, 100
#: A line is common if more kinds of documents than one for so many documents hold it, and ``LEAST_KINDS`` at least.
#: No more lines can be common than ``COMMON`` times the mean number of lines in a document.
COMMON, LEAST_KINDS = 1000, 4
CONTENT_SHARE = 0.5
GRAM = 8
_NEWLINE = np.arange(256) == 0x0A
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(0x41, 0x5B)))
_LOWERCASE = np.isin(np.arange(256), list(range(0x61, 0x7B)))
_DIGIT = np.isin(np.arange(256), list(range(0x30, 0x3A)))
_SHOUT = np.isin(np.arange(256), list(b"!?"))
_STOP = np.isin(np.arange(256), list(b".!?:;\""))
_BEGINS = (np.arange(256) & 0xC0) != 0x80
FEATURES = ["bias", "words", "word_length", "symbols", "upper", "digits", "shouts", "stop", "doubled", "known", "common", "first", "last"]
PRIOR = {"bias": 1.0, "symbols": -20.0, "upper": -3.0, "shouts": -20.0, "digits": -4.0, "doubled": -4.0, "known": -1.0, "common": -6.0, "words": 1.0}


def _sums(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[begins]


class Lines:
    """The lines with a word of a block: ``first`` (of each document, as in Words), ``words`` in each, features ``x``.
    ``common`` has the sorted hashes of the lines that many documents hold."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: Words, hashes: np.ndarray, common: np.ndarray):
        lines = Words(data, offsets, _NEWLINE)
        begin = np.searchsorted(words.starts, lines.starts)
        end = np.searchsorted(words.starts, lines.ends)
        full = end > begin
        document = lines.document()[full]
        self.starts, self.ends, begin, end = lines.starts[full], lines.ends[full], begin[full], end[full]
        self.first = np.searchsorted(document, np.arange(len(offsets)))
        self.counts = np.diff(self.first)
        self.words = end - begin
        # Of equal lines of a document all but the first repeat.
        own = lines.hashes()[full]
        found = np.searchsorted(common, own)
        self.common = common[np.minimum(found, len(common) - 1)] == own if len(common) else np.zeros(len(own), bool)
        key = mix(own + document.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.repeats = np.ones(len(key), bool)
        self.repeats[np.unique(key, return_index=True)[1]] = False
        share = lambda table: _sums(table[data], self.starts, self.ends) / np.maximum(size, 1)
        size = self.ends - self.starts
        letters = _sums(_UPPER[data] | _LOWERCASE[data], self.starts, self.ends)
        again = np.zeros(len(words), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        at = np.arange(len(key)) - np.repeat(self.first[:-1], self.counts)
        self.x = np.stack([
            np.ones(len(key)), np.log1p(self.words) / 4, _sums(_BEGINS[data], self.starts, self.ends) / np.maximum(self.words, 1) / 10, share(_SYMBOL),
            _sums(_UPPER[data], self.starts, self.ends) / np.maximum(letters, 1), share(_DIGIT), share(_SHOUT), _STOP[data[self.ends - 1]] if len(key) else np.zeros(0),
            _sums(again, begin, end) / np.maximum(self.words, 1), self.repeats, self.common, at == 0, at == np.repeat(self.counts, self.counts) - 1,
        ], axis=1).astype(float) if len(key) else np.zeros((0, len(FEATURES)))


def repeated_words(words: Words, hashes: np.ndarray, n: int = GRAM) -> np.ndarray:
    """For each document, the words in windows of ``n`` words that it holds twice or more."""
    starts = words.starts_of_grams(n)
    document = words.document()[starts]
    key = mix(gram_hashes(hashes, n)[starts] + document.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(starts) else np.zeros(0, np.uint64)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    steps = np.bincount(starts[twice], minlength=len(words) + 1) - np.bincount(starts[twice] + n, minlength=len(words) + 1)
    covered = np.cumsum(steps)[: len(words)] > 0
    return _sums(covered, words.first[:-1], words.first[1:])


def _padded(counts: np.ndarray) -> list[np.ndarray]:
    """For each step, the documents that have so many lines, when ``counts`` falls."""
    return [np.searchsorted(-counts, -step, "left") for step in range(int(counts.max()) if len(counts) else 0)]


def line_labels(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Each line's label (1: content) from its features and its document's label."""
    of = lambda name: x[:, FEATURES.index(name)]
    noise = (of("symbols") + of("shouts") > 0.05) | ((of("upper") > 0.5) & (of("words") > np.log1p(3) / 4))
    boilerplate = noise | (of("common") > 0) | (of("known") > 0) | (of("doubled") > 0.5)
    sentence = (of("stop") > 0) & (of("words") >= np.log1p(5) / 4)
    return np.where(good, ~boilerplate, sentence & ~boilerplate).astype(float)


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the content label and transition scores that maximise the labels' likelihood (Adam on the exact
    gradient). ``x``: all lines of all chains in turn, ``counts`` of each chain; ``y``: a label in 0 .. 1 for each line."""
    order = np.argsort(-counts, kind="stable")
    begins = (np.cumsum(counts) - counts)[order]
    counts = counts[order]
    active = _padded(counts)
    weights, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    gold = np.zeros((2, 2))  # the labels' own transitions
    for s, n in enumerate(active[1:], 1):
        was, now = y[begins[:n] + s - 1], y[begins[:n] + s]
        gold += np.array([[np.sum((1 - was) * (1 - now)), np.sum((1 - was) * now)], [np.sum(was * (1 - now)), np.sum(was * now)]])
    for t in range(1, rounds + 1):
        score = x @ weights
        alpha = []
        for s, n in enumerate(active):
            own = np.stack([np.zeros(n), score[begins[:n] + s]], 1)
            alpha.append(own if s == 0 else own + np.logaddexp(alpha[-1][:n, :1] + moves[0], alpha[-1][:n, 1:] + moves[1]))
        beta = np.zeros((len(counts), 2))
        p, pairs = np.zeros_like(score), np.zeros((2, 2))
        for s in range(len(active) - 1, -1, -1):
            n = active[s]
            both = alpha[s] + beta[:n]
            p[begins[:n] + s] = 1 / (1 + np.exp(both[:, 0] - both[:, 1]))
            if s:
                here = np.stack([np.zeros(n), score[begins[:n] + s]], 1) + beta[:n]
                joint = alpha[s - 1][:n, :, None] + moves[None] + here[:, None, :]
                joint = np.exp(joint - joint.max((1, 2), keepdims=True))
                joint /= joint.sum((1, 2), keepdims=True)
                pairs += joint.sum(0)
                beta[:n] = np.logaddexp(moves[:, 0] + here[:, :1], moves[:, 1] + here[:, 1:])
        g = np.concatenate([x.T @ (y - p), (gold - pairs).ravel()]) / max(len(x), 1) - ridge * np.concatenate([weights, moves.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weights, moves = weights + step[:-4], moves + step[-4:].reshape(2, 2)
    return weights, moves


def viterbi(score: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels of all lines; ``score`` is that of content over boilerplate. Ties go to content."""
    order = np.argsort(-counts, kind="stable")
    begins, active = (np.cumsum(counts) - counts)[order], _padded(counts[order])
    back = np.zeros((len(score), 2), bool)
    ends = np.zeros((len(counts), 2))
    for s, n in enumerate(active):
        own = np.stack([np.zeros(n), score[begins[:n] + s]], 1)
        if s == 0:
            ends[:n] = own
        else:
            from_0, from_1 = ends[:n, :1] + moves[0], ends[:n, 1:] + moves[1]
            back[begins[:n] + s] = from_1 >= from_0
            ends[:n] = own + np.maximum(from_0, from_1)
    labels = np.zeros(len(score), bool)
    now = ends[:, 1] >= ends[:, 0]
    for s in range(len(active) - 1, -1, -1):
        n = active[s]
        at = begins[:n] + s
        labels[at] = now[:n]
        now[:n] = back[at, now[:n].astype(int)]
    return labels


@dataclass
class Field:
    weights: np.ndarray
    moves: np.ndarray
    common: np.ndarray


def common_lines(docs: DataFrame, one_in: int = COMMON, least: int = LEAST_KINDS) -> np.ndarray:
    """The sorted hashes of the lines that many kinds of documents hold. A document's kind is the least hash of its
    three-word runs, so near copies are mostly of one kind; a line with fewer kinds than half its documents is not common,
    however many copies of them there are."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            found, words = Words(data, offsets, _NEWLINE), Words(data, offsets)
            at = words.starts_of_grams(3)
            kind = np.zeros(rows.num_rows, np.uint64)
            if len(at):
                begins = np.searchsorted(at, words.first)
                full = np.flatnonzero(begins[:-1] < begins[1:])
                kind[full] = np.minimum.reduceat(gram_hashes(words.hashes(), 3)[at], begins[full])
            document, own = np.unique(np.stack([found.document().astype(np.uint64), found.hashes()]), axis=1) if len(found) else np.zeros((2, 0), np.uint64)
            (line, kind), n = np.unique(np.stack([own, kind[document.astype(np.int64)]]), axis=1, return_counts=True) if len(own) else (np.zeros((2, 0), np.uint64), [])
            # The last row counts the block's documents.
            yield pa.RecordBatch.from_pydict({"line": pa.array([*signed(line), None], pa.int64()), "kind": pa.array([*signed(kind), None], pa.int64()), "n": pa.array([*n, rows.num_rows], pa.int64())})

    held = docs.select("text").mapInArrow(lines, "line long, kind long, n long").groupBy("line", "kind").agg(F.sum("n").alias("n"))
    counts = held.groupBy("line").agg(F.count("kind").alias("kinds"), F.sum("n").alias("n"))
    counts = checkpoint(counts.filter(F.col("line").isNull() | ((F.col("kinds") >= least) & (F.col("kinds") * 2 >= F.col("n")))))
    n = counts.filter("line IS NULL").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    found = counts.filter(F.col("line").isNotNull() & (F.col("kinds") * one_in > n)).select("line").toArrow().column("line").to_numpy()
    return np.sort(found.view(np.uint64))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """The field, fitted on at most ``sample`` chains of at most ``CHAIN`` lines, of at most ``sample`` documents."""
    common = common_lines(docs)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets)
            found = Lines(data, offsets, words, words.hashes(), common)
            for k, (key, y) in enumerate(zip(rows.column("doc_id").cast(pa.string()).to_pylist(), rows.column("y").to_pylist(), strict=True)):
                for n, a in enumerate(range(found.first[k], found.first[k + 1], CHAIN)):
                    b = min(a + CHAIN, found.first[k + 1])
                    yield pa.RecordBatch.from_pydict({"doc_id": [key], "chain": [n], "y": [y], "x": [found.x[a:b].ravel()]})

    chosen = labelled(docs.select("doc_id", "text"), labels, F.col("quality"), sample).select("doc_id", "text", "y")
    chains = chosen.mapInArrow(lines, "doc_id string, chain long, y double, x array<double>")
    chains = chains.orderBy(F.xxhash64("doc_id", "chain"), "doc_id", "chain").limit(sample).toArrow()
    good = chains.column("y").to_numpy() >= 0.5
    if len(set(good.tolist())) < 2:
        return Field(np.array([PRIOR.get(f, 0.0) for f in FEATURES]), np.array([[0.5, -0.5], [-0.5, 0.5]]), common)
    listed = chains.column("x").combine_chunks()
    counts = np.diff(np.asarray(listed.offsets)) // len(FEATURES)
    x = np.asarray(listed.flatten()).reshape(-1, len(FEATURES))
    return Field(*fit(x, counts, line_labels(x, np.repeat(good, counts))), common)


def judged(docs: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """Every row's verdict: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    content_words (in lines decoded as content), n_lines, n_content_lines.

    Null and empty texts have no words, so they fail the base rule (fewer than 20 words). Very long texts are decoded
    whole, however many lines they have; equally good labellings end in content. Repeated rows are judged each; a null
    doc_id stays null; other columns are ignored; an empty table gives none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets)
            hashes = words.hashes()
            lines = Lines(data, offsets, words, hashes, field.common)
            content = viterbi(lines.x @ field.weights, lines.counts, field.moves)
            n = words.counts.astype(np.int64)
            repeats = repeated_words(words, hashes)
            inside = _sums(lines.words * content, lines.first[:-1], lines.first[1:])
            visible = np.zeros(len(data), np.int8)
            visible[:] = _BEGINS[data]
            visible[np.isin(data, [0x20, 9, 10, 11, 12, 13])] = 0
            failed = (n < 20) | (100 * repeats > 30 * n)
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_id"), "n_words": n, "word_chars": _sums(visible, offsets[:-1], offsets[1:]), "n_symbols": _sums(_SYMBOL[data], offsets[:-1], offsets[1:]),
                "n_dup_lines": _sums(lines.repeats, lines.first[:-1], lines.first[1:]), "n_repeat_words": repeats, "base_failed": failed, "kept": ~failed & (inside >= share * n), "content_words": inside,
                "n_lines": lines.counts.astype(np.int64), "n_content_lines": _sums(content, lines.first[:-1], lines.first[1:]),
            })

    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long, n_lines long, n_content_lines long")


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fits the field on labelled documents, then judges all of them. See ``judged``."""
    return judged(docs, trained(docs, labels, sample))
