"""Quality classifier by co-training.

Two logistic classifiers see different views of a document: its text (shape of the writing and hashed words) and its
metadata (language, source, stated length and their crosses). They begin with a bounded sample of labelled documents. In
every round each view labels, of all unlabelled documents, the share it is surest are good and the share it is surest
are not, and the other view learns from them: a first pass over the corpus counts scores in narrow bins and so finds the
places of those shares, a second one adds up, in tasks, the gradient and a bound of the curvature of the other view's
loss on those documents. The driver holds weights, counts and sums but no unlabelled document, and fits the labelled
sample and that bound together. A label weighs what its teacher's probability is away from a half, after a slope that
held-out labelled documents give the teacher's scores, so a view that knows little teaches little, however sure it is.
Held-out labelled documents then calibrate and combine the two views, and all documents are scored.

A document is good if its quality label is 1 and it is not labelled toxic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfield.llm.quality_rules import _DIGIT, _LOWERCASE, _SHOUT, _SYMBOL, _UPPER, _sums
from starfield.llm.samples import labelled
from starfield.llm.words import NOT_ALNUM, Words, blocks
from starfield.plans.materialize import written
from starfield.plans.sums import added

#: Labelled documents at most for fitting.
LABELLED = 6000
ROUNDS = 3
#: The share of the unlabelled documents that a view labels good, and as large a one that it labels not good: its surest.
#: Documents that tie with the last one of a share are all in it.
SUREST = 0.1
#: Scores (log-odds) are counted in so many bins a unit, up to this score on either side.
BINS, SCORES = 128, 16
#: How much the other view's labels weigh, all together and if wholly sure, against the known ones.
GIVEN = 0.5
STEPS, MORE_STEPS, RIDGE = 150, 50, 1e-3
WORD_BITS, META_BITS = 15, 12
#: Share of the held-out good documents that the threshold keeps, and the least threshold; it is 0.5 at most.
KEPT_GOOD, LOWEST = 0.995, 0.2
#: Hashed words in fewer labelled documents have no weight.
LEAST_DOCUMENTS = 12
SHAPE = ["bias", "log_words", "short", "word_length", "symbols", "upper", "digits", "shouts", "doubled", "distinct"]
META = ["bias", "lang", "source", "length", "lang and length", "lang and source", "source and length"]
TEXT_SIZE, META_SIZE = len(SHAPE) + (1 << WORD_BITS), 1 << META_BITS
SIZES = {"text": TEXT_SIZE, "meta": META_SIZE}


@dataclass
class Rows:
    """Features of documents: ``shape`` (a row each), ``buckets`` of hashed words (those of one document after another,
    ``counts`` of each), ``meta`` (a row of columns each)."""

    shape: np.ndarray
    buckets: np.ndarray
    counts: np.ndarray
    meta: np.ndarray

    def __len__(self) -> int:
        return len(self.counts)

    def score(self, view: str, w: np.ndarray) -> np.ndarray:
        if view == "meta":
            return w[self.meta].sum(1)
        total = np.concatenate([[0.0], np.cumsum(w[len(SHAPE) + self.buckets])])
        ends = np.cumsum(self.counts)
        return self.shape @ w[: len(SHAPE)] + total[ends] - total[ends - self.counts]

    def gather(self, view: str, values: np.ndarray, absolute: bool = False) -> np.ndarray:
        """The sum over documents of their values times their features."""
        if view == "meta":
            return np.bincount(self.meta.ravel(), np.repeat(values, self.meta.shape[1]), META_SIZE)
        shape = np.abs(self.shape) if absolute else self.shape
        return np.concatenate([shape.T @ values, np.bincount(self.buckets, np.repeat(values, self.counts), 1 << WORD_BITS)])

    def width(self, view: str) -> np.ndarray:
        """The sum of each document's absolute features."""
        return np.full(len(self), float(self.meta.shape[1])) if view == "meta" else np.abs(self.shape).sum(1) + self.counts


def text_view(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a block: the shape of each text, the distinct buckets of its words one text after another, their counts."""
    words = Words(data, offsets, NOT_ALNUM, lower=True)
    h = words.hashes()
    n, size = words.counts, np.diff(offsets)
    document = words.document()
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (document[1:] == document[:-1])
    key = np.unique((document.astype(np.int64) << WORD_BITS) | (h & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64))
    per = np.bincount(key >> WORD_BITS, minlength=len(n))
    share = lambda table: _sums(table[data], offsets[:-1], offsets[1:]) / np.maximum(size, 1)
    letters = _sums(_UPPER[data] | _LOWERCASE[data], offsets[:-1], offsets[1:])
    shape = np.stack([
        np.ones(len(n)), np.log1p(n) / 8, n < 20, size / np.maximum(n, 1) / 10, np.sqrt(share(_SYMBOL)), _sums(_UPPER[data], offsets[:-1], offsets[1:]) / np.maximum(letters, 1),
        share(_DIGIT), np.sqrt(share(_SHOUT)), _sums(again, words.first[:-1], words.first[1:]) / np.maximum(n, 1), per / np.maximum(n, 1),
    ], axis=1).astype(np.float32)
    return shape, (key & ((1 << WORD_BITS) - 1)).astype(np.uint16), per


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """The columns of each document's metadata. Nulls are values of their own."""
    named: dict[str, int] = {}

    def place(name: str) -> int:
        if name not in named:
            named[name] = 1 + xxhash.xxh64_intdigest(name, 3) % (META_SIZE - 1)
        return named[name]

    length = ["none" if c is None else str(max(int(c), 0).bit_length()) for c in n_chars]
    columns = ([0, *map(place, (f"lang {a}", f"source {b}", f"length {c}", f"{a} {c}", f"lang {a} source {b}", f"source {b} length {c}"))] for a, b, c in zip(lang, source, length, strict=True))
    return np.array(list(columns), np.uint16).reshape(-1, len(META))


def _viewed(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Rows:
    known = {f.name: k for k, f in enumerate(rows.schema)}
    lang, source, n_chars = (rows.column(known[k]) for k in ("lang", "source", "n_chars"))
    return Rows(*text_view(data, offsets), meta_view(lang.cast(pa.string()).to_pylist(), source.cast(pa.string()).to_pylist(), n_chars.cast(pa.int64()).to_pylist()))


def features(docs: DataFrame) -> DataFrame:
    """Every row's features in bytes: doc_id, shape, buckets, meta. About a fifth of the texts' size."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            own = _viewed(rows, data, offsets)
            ends = np.cumsum(own.counts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_id"), "shape": [x.tobytes() for x in own.shape], "meta": [x.tobytes() for x in own.meta],
                "buckets": [own.buckets[a:b].tobytes() for a, b in zip(ends - own.counts, ends, strict=True)],
            })

    wanted = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    return wanted.mapInArrow(view, f"doc_id {kind}, shape binary, meta binary, buckets binary")


def _loaded(rows: pa.RecordBatch | pa.Table) -> Rows:
    """The features of stored rows."""

    def flat(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
        column = rows.column(rows.schema.get_field_index(name))
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
        return np.frombuffer(data.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize

    buckets, counts = flat("buckets", np.uint16)
    return Rows(flat("shape", np.float32)[0].reshape(-1, len(SHAPE)).astype(float), buckets.astype(np.int32), counts.astype(np.int64), flat("meta", np.uint16)[0].reshape(-1, len(META)).astype(np.int32))


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@dataclass
class Bound:
    """An upper bound of a loss around ``at``: its gradient and a diagonal that no curvature exceeds."""

    at: np.ndarray
    gradient: np.ndarray
    curvature: np.ndarray


def fitted(rows: Rows, view: str, y: np.ndarray, weight: np.ndarray, start: np.ndarray, steps: int, given: Bound | None = None, ridge: float = RIDGE, slice_: int = 1000) -> np.ndarray:
    """Weights of a logistic classifier by Adam, in steps that shrink to nothing, on the weighted mean loss, plus ``given``."""
    w = start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = max(weight.sum(), 1e-9)
    cuts = [slice(a, a + slice_) for a in range(0, len(rows), slice_)]
    ends = np.cumsum(rows.counts)
    begins = ends - rows.counts
    parts = [(Rows(rows.shape[c], rows.buckets[begins[c][0] : ends[c][-1]], rows.counts[c], rows.meta[c]), y[c], weight[c]) for c in cuts]
    for t in range(1, steps + 1):
        g = -ridge * w
        for part, own, each in parts:
            g += part.gather(view, each * (own - _probability(part.score(view, w)))) / total
        if given is not None:
            g -= given.gradient + given.curvature * (w - given.at)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.1 * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
    return w


def _bins(scores: np.ndarray) -> np.ndarray:
    return np.floor((np.clip(scores, -SCORES, SCORES) + SCORES) * BINS).astype(np.int64)


def surest(others: DataFrame, weights: dict[str, np.ndarray], share: float = SUREST) -> dict[str, tuple[int, int]]:
    """For each view, the highest bin of scores that it labels not good and the lowest one that it labels good: with all
    bins beyond, each holds at least ``share`` of the unlabelled documents (``features``), counted in one pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SIZES), 2 * SCORES * BINS + 1))
        for batch in batches:
            rows = _loaded(batch)
            for k, view in enumerate(SIZES):
                total[k] += np.bincount(_bins(rows.score(view, weights[view])), minlength=total.shape[1])
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    found = added(others.mapInArrow(count, "v binary"))
    counts = np.zeros((len(SIZES), 2 * SCORES * BINS + 1)) if found is None else found.reshape(len(SIZES), -1)
    places = {}
    for view, own in zip(SIZES, counts, strict=True):
        wanted = max(np.ceil(share * own.sum()), 1)
        places[view] = int(np.searchsorted(np.cumsum(own), wanted)), len(own) - 1 - int(np.searchsorted(np.cumsum(own[::-1]), wanted))
    return places


def pseudo_labels(rows: Rows, weights: dict[str, np.ndarray], places: dict[str, tuple[int, int]], slopes: dict[str, float]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each view, what the other one labels (nan where it does not) and how sure it is of that, from 0 to 1. A label
    is never on the other side of even odds."""
    out = {}
    for view, teacher in (("text", "meta"), ("meta", "text")):
        s = rows.score(teacher, weights[teacher])
        at, (low, high) = _bins(s), places[teacher]
        label = np.where((at >= high) & (s > 0), 1.0, np.where((at <= low) & (s < 0), 0.0, np.nan))
        out[view] = label, np.abs(2 * _probability(slopes[teacher] * s) - 1)
    return out


def exchanged(others: DataFrame, weights: dict[str, np.ndarray], slopes: dict[str, float], share: float = GIVEN) -> dict[str, Bound | None]:
    """Two passes over all unlabelled documents (``features``): each view's loss on what the other labels. Both classes
    weigh the same. None where there is not one of each class."""
    places = surest(others, weights)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(k, side): np.zeros(1 + 2 * n) for k, n in SIZES.items() for side in (0, 1)}
        for batch in batches:
            rows = _loaded(batch)
            for k, (label, sure) in pseudo_labels(rows, weights, places, slopes).items():
                p = _probability(rows.score(k, weights[k]))
                for side in (0, 1):
                    own = label == side
                    if own.any():
                        each = own * sure
                        total[k, side] += np.concatenate([[own.sum()], rows.gather(k, each * (p - side)), rows.gather(k, each * p * (1 - p) * rows.width(k), absolute=True)])
        yield pa.RecordBatch.from_pydict({"v": [np.concatenate(list(total.values())).tobytes()]})

    found = added(others.mapInArrow(sums, "v binary"))
    out: dict[str, Bound | None] = {}
    at = 0
    for k, n in SIZES.items():
        both = [(0.0, 0, 0) if found is None else (found[a], found[a + 1 : a + 1 + n], found[a + 1 + n : a + 1 + 2 * n]) for a in (at, at + 1 + 2 * n)]
        at += 2 * (1 + 2 * n)
        out[k] = Bound(weights[k], *(share / 2 * sum(x[j] / x[0] for x in both) for j in (1, 2))) if all(x[0] for x in both) else None
    return out


def slope(scores: np.ndarray, y: np.ndarray) -> float:
    """The factor, 0 or more and 1 where nothing speaks against it, that makes a view's scores log-odds where both classes
    weigh the same."""
    x = np.clip(scores, -SCORES, SCORES)
    weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
    b = 1.0
    for _ in range(50):
        p = _probability(b * x)
        step = ((weight * (y - p)) @ x - (b - 1)) / ((weight * p * (1 - p)) @ (x * x) + 1)
        b = max(b + float(np.clip(step, -0.5, 0.5)), 0.0)
    return b


def _calibrated(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (one for each view's score, and a constant) that make the combined score a log-odds."""
    x = np.column_stack([np.clip(scores, -15, 15), np.ones(len(y))])
    prior = np.array([1.0, 0.0, 0.0])
    w = prior
    for _ in range(50):
        p = _probability(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(3), x.T @ (y - p) - (w - prior))
        w = w + step / max(1, 2 * np.abs(step).max())
    return w


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    mix: np.ndarray
    threshold: float = 0.5

    def of(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both views' scores and the probability of every document."""
        text, meta = rows.score("text", self.text), rows.score("meta", self.meta)
        return text, meta, _probability(np.clip(text, -15, 15) * self.mix[0] + np.clip(meta, -15, 15) * self.mix[1] + self.mix[2])


def co_trained(own: Rows, y: np.ndarray, exchange: Callable[[dict[str, np.ndarray], dict[str, float]], dict[str, Bound | None]], rounds: int = ROUNDS) -> Model:
    """Co-trains on labelled rows; ``exchange`` gives each view's bound on what the other labels, from the views' weights
    and slopes. A quarter is held out."""
    common = np.bincount(own.buckets, minlength=1 << WORD_BITS) >= LEAST_DOCUMENTS
    use = common[own.buckets]
    kept = np.concatenate([[0], np.cumsum(use)])
    ends = np.cumsum(own.counts)
    own = Rows(own.shape, own.buckets[use], kept[ends] - kept[ends - own.counts], own.meta)
    held = np.arange(len(own)) % 4 == 0
    weight = (~held).astype(float)
    for side in (0, 1):  # both classes weigh the same
        weight[~held & (y == side)] *= 0.5 * (~held).sum() / max((~held & (y == side)).sum(), 1)
    allowed = {"text": np.concatenate([np.ones(len(SHAPE), bool), common]), "meta": np.ones(META_SIZE, bool)}
    weights = {k: fitted(own, k, y, weight, np.zeros(n), STEPS) for k, n in SIZES.items()}
    for _ in range(rounds):
        bounds = exchange(weights, {k: slope(own.score(k, w)[held], y[held]) for k, w in weights.items()})
        for k, bound in bounds.items():
            if bound is not None:
                bound.gradient = bound.gradient * allowed[k]
                weights[k] = fitted(own, k, y, weight, weights[k], MORE_STEPS, bound)
    scores = np.column_stack([own.score(k, weights[k])[held] for k in ("text", "meta")])
    truth = y[held]
    mix = _calibrated(scores, truth)
    found = Model(weights["text"], weights["meta"], mix)
    if truth.any():
        odds = np.clip(scores[truth == 1], -15, 15) @ mix[:2] + mix[2]
        found.threshold = float(np.clip(np.quantile(_probability(odds), 1 - KEPT_GOOD), LOWEST, 0.5))
    return found


def trained(viewed: DataFrame, labels: DataFrame, most: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """Co-trains on at most ``most`` labelled documents and all others, given by their ``features``: labelled ones beyond
    the sample count as unlabelled. Of rows that share a labelled doc_id one is fitted on. Without labels of both kinds
    the model accepts everything."""
    good = (F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    sample = labelled(viewed, labels, good, most).withColumn("id", F.col("doc_id").cast("string")).toArrow().sort_by("id")
    y = (sample.column("y").to_numpy() >= 0.5).astype(float)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(TEXT_SIZE), np.zeros(META_SIZE), np.array([0.0, 0.0, 1.0]))
    known = viewed.sparkSession.createDataFrame(sample.select(["doc_id"]))
    others = viewed.join(F.broadcast(known), "doc_id", "left_anti").select("shape", "meta", "buckets")  # ``most`` rows
    return co_trained(_loaded(sample), y, lambda weights, slopes: exchanged(others, weights, slopes), rounds)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model keeps, unchanged, in one pass without a shuffle. Rows are judged each, with
    nulls, empty and long texts and repeated rows as in ``scored``; an empty table stays empty."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            yield rows.filter(pa.array(model.of(_viewed(rows, data, offsets))[2] >= model.threshold))

    return docs.mapInArrow(keep, docs.schema)


def scored(viewed: DataFrame, model: Model) -> DataFrame:
    """Every row's probability of being good, from its ``features``: doc_id, text_score, meta_score, score, kept (a score
    of the model's threshold or more).

    A null or empty text has no words and is scored by its shape and metadata; a very long one is viewed whole; null
    metadata are values of their own; repeated rows are scored each, ties alike; a null doc_id stays null; other columns
    are ignored; an empty table gives none.
    """
    kind = viewed.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta, p = model.of(_loaded(batch))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "text_score": text, "meta_score": meta, "score": p, "kept": p >= model.threshold})

    return viewed.mapInArrow(score, f"doc_id {kind}, text_score double, meta_score double, score double, kept boolean")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Co-trains on all of ``docs``, then scores every row. See ``trained`` and ``scored``."""
    viewed = written(features(docs), "views")
    return scored(viewed, trained(viewed, labels))
