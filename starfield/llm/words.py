"""Words of whole texts as NumPy arrays, a block of documents at a time.

Everything works on the UTF-8 bytes. A block holds whole documents, so its size is bounded by ``BLOCK`` bytes or by
one document. Null texts count as empty ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK = 1 << 22
#: Words of more bytes are hashed one at a time.
LONG_WORD = 256

# The separators that the contracts name.
_WHITE = [0x20, *range(0x09, 0x0E)]
_NOT_ALNUM = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]

WHITE = np.isin(np.arange(256), _WHITE)
NOT_ALNUM = np.isin(np.arange(256), _NOT_ALNUM)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LOWER_BYTES = LOWER.tobytes()


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins, with the end of the last."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: What forgets the memory that an operator keeps in a worker between its tasks, by the operator's name.
FORGET: dict[str, Callable[[], None]] = {}


def release(own: str = "") -> None:
    """Gives back what earlier tasks of a worker have freed, and what other operators than ``own`` keep: workers live as
    long as their executor."""
    for name, forget in FORGET.items():
        if name != own:
            forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this allocator
        pass


def thrifty(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], own: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow, after which a worker gives back what its task has freed: it may wait long for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release(own)

    return run


def blocks(batches, text: str = "text", own: str = "", size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts Arrow batches into blocks of whole documents: their rows, bytes and offsets."""
    release(own)
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


class Words:
    """``starts`` and ``ends`` of every word of a block, and ``first``: the index of each document's first word,
    with the number of all words at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE, lower: bool = False):
        self.data = data = LOWER[data] if lower else data
        inside = ~separators[data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = offsets[:-1] < offsets[1:]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def document(self) -> np.ndarray:
        """The document, counted in the block, of every word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, salt: int = 0) -> np.ndarray:
        """64 bits for every word, as in ``hashes``."""
        return hashes(self.data, self.starts, self.ends, salt)

    def starts_of_grams(self, n: int) -> np.ndarray:
        """The first words of all runs of n words within one document."""
        at = np.arange(max(0, len(self) - n + 1))
        return at[at + n <= np.repeat(self.first[1:], self.counts)[: len(at)]]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 bits for every slice of ``data``, from all its bytes. Equal ones have equal hashes in every block; hashes of other
    salts are independent."""
    n = ends - starts
    h = mix(n.astype(np.uint64) * _LENGTH + np.uint64(salt))
    # The eight bytes from every place on, as numbers.
    lanes = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    left, k = np.flatnonzero(n <= LONG_WORD), 0
    while len(left):
        chunk = lanes[np.minimum(starts[left] + 8 * k, len(data) - 1)] & _FIRST[np.minimum(n[left] - 8 * k, 8)] if len(data) else np.uint64(0)
        h[left] = mix((h[left] ^ chunk) * _ODD + np.uint64(k + 1))
        k += 1
        left = left[n[left] > 8 * k]
    for k in np.flatnonzero(n > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), salt)
    return h


_LENGTH, _ODD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
#: Masks that leave a number's first 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _joined(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    return mix(left * np.uint64(0xC2B2AE3D27D4EB4F | 1) + mix(right + np.uint64(salt)))


def gram_hashes(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash for the n words from every word on, by doubling. Runs that cross a document's end are in it too."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    span, g = 1, h
    while span < n:
        step = min(span, n - span)
        g = _joined(g[: len(g) - step], g[step:], salt * 64 + step)
        span += step
    return g


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
