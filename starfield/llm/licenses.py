"""License scans: exact phrases on words, and short notices with a bounded number of edits.

Each notice is split into one part more than it may have edits, so a passage within that bound holds one part
unchanged. Those exact seeds locate candidates in the text's words, joined by blanks; the ``regex`` library then
matches the whole notice there with bounded errors and gives span and edits. Where matches of several notices
overlap, only those with the fewest edits count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfield.llm.words import LOWER_BYTES, NOT_ALNUM

# Phrases that the contract names.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Short notices of public licenses in their words, with labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the above copyright notice and this permission notice shall be included in all copies": "mit",
    "released under the mit license": "mit",
    "mit no attribution license": "mit-0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that": "isc",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is": "0bsd",
    "licensed under the apache license version 2 0": "apache-2",
    "apache software license version 1 1": "apache-1.1",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "gnu general public license as published by the free software foundation either version 2 of the license": "gpl-2",
    "gnu general public license as published by the free software foundation either version 3 of the license": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu lesser general public license as published by the free software foundation either version 2 1 of the license": "lgpl-2.1",
    "gnu lesser general public license as published by the free software foundation either version 3 of the license": "lgpl-3",
    "gnu affero general public license": "agpl",
    "gnu affero general public license as published by the free software foundation either version 3 of the license": "agpl-3",
    "subject to the terms of the mozilla public license": "mpl",
    "the contents of this file are subject to the mozilla public license version 1 1": "mpl-1.1",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "made available under the terms of the eclipse public license v1 0": "epl-1",
    "made available under the terms of the eclipse public license 2 0": "epl-2",
    "subject to the terms of the common development and distribution license": "cddl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-3",
    "licensed under the 2 clause bsd license": "bsd-2",
    "licensed under the 3 clause bsd license": "bsd-3",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely": "zlib",
    "distributed under the boost software license version 1 0": "bsl-1",
    "use of this software is governed by the business source license": "busl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution sharealike 3 0 unported": "cc-by-sa-3",
    "creative commons attribution sharealike 4 0 international": "cc-by-sa-4",
    "creative commons attribution 4 0 international": "cc-by",
    "creative commons zero v1 0 universal": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "licensed under the european union public licence": "eupl",
    "licensed under the artistic license 2 0": "artistic-2",
    "licensed under the sil open font license version 1 1": "ofl-1.1",
    "licensed under the academic free license version 3 0": "afl-3",
}
_SEPARATE = bytes(0x20 if NOT_ALNUM[b] and not 0x41 <= b <= 0x5A else LOWER_BYTES[b] for b in range(256))
MATCHES = "array<struct<label string, notice string, first_word long, last_word long, edits int>>"


def edits_allowed(notice: str) -> int:
    """One edit for every twenty characters, and one more."""
    return 1 + len(notice) // 20


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice in ``edits + 1`` parts of nearly equal length, with their offsets."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def _compiled(notices: tuple[tuple[str, str], ...]) -> tuple[list[tuple], ahocorasick.Automaton]:
    """The notices with their patterns, and an automaton that finds all seeds: for each its (notice, offset) places."""
    out, places = [], defaultdict(list)
    for n, (notice, label) in enumerate(notices):
        k = edits_allowed(notice)
        out.append((notice, label, k, regex.compile(rf"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}".encode())))
        for at, part in seeds(notice, k):
            places[part].append((n, at))
    found = ahocorasick.Automaton()
    for part, own in places.items():
        found.add_word(part, (len(part), own))
    found.make_automaton()
    return out, found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SEPARATE).split()


def blanks_of(joined: bytes) -> np.ndarray:
    """Where the blanks are; the k-th one is right before word k."""
    return np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)


def exact(joined: bytes, phrase: bytes, blanks: np.ndarray) -> list[int]:
    """The words at which the phrase's words begin; ``joined`` has a blank around every word."""
    found, at = [], joined.find(b" " + phrase + b" ")
    while at >= 0:
        found.append(at)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return np.searchsorted(blanks, found).tolist()


def fuzzy(joined: bytes, notices: tuple[tuple[str, str], ...], blanks: np.ndarray) -> list[tuple[str, str, int, int, int]]:
    """Matches with at most the allowed edits: label, notice, first and last word, edits."""
    known, automaton = _compiled(notices)
    found, seen = [], set()
    for last, (size, places) in automaton.iter(joined.decode("latin-1")):  # a character for each byte
        for n, offset in places:
            notice, label, k, pattern = known[n]
            at = last + 1 - size - offset
            if (m := pattern.search(joined, max(0, at - k), min(len(joined), at + len(notice) + k))) and (n, m.span()) not in seen:
                seen.add((n, m.span()))
                found.append((sum(m.fuzzy_counts), m.start(), m.end(), label, notice))
    found.sort(key=lambda m: (m[0], m[1] - m[2], *m[1:]))
    # Kept matches by stretches of the text no shorter than any match, so only three can hold one that overlaps.
    kept: dict[int, list[tuple]] = {}
    stretch = max((m[2] - m[1] for m in found), default=0) + 1
    for m in found:
        place = m[1] // stretch
        if all(m[2] <= x[1] or x[2] <= m[1] or ((x[0], x[2] - x[1]) == (m[0], m[2] - m[1]) and x[3] != m[3]) for k in (place - 1, place, place + 1) for x in kept.get(k, ())):
            kept.setdefault(place, []).append(m)
    out = []
    for edits, a, b, label, notice in (m for own in kept.values() for m in own):
        a += joined[a : a + 1] == b" "
        first, last = (int(np.searchsorted(blanks, x)) - 1 for x in (a + 1, max(b - 1, a + 1)))
        out.append((label, notice, max(first, 0), max(last, 0), edits))
    return sorted(out, key=lambda m: (m[2], m[3], m[0]))


def scanned(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's licenses: key, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    Phrases are exact sequences of words; their labels stay. Notices may have ``edits_allowed`` edits and add labels.
    Of overlapping matches the one with the fewest edits counts, of those the longest; where two labels tie, both do.
    ``score`` is 1 for a phrase, else the best match's share of unedited characters, else 0. Null and empty texts
    have no words; very long texts are scanned whole, one at a time; a null key stays null; repeated rows are scanned
    each; other columns are ignored; an empty table gives none.
    """
    kind = docs.schema[key].dataType.simpleString()
    known, wanted = tuple(notices.items()), [(p.encode(), label) for p, label in phrases.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                joined = b" " + b" ".join(words) + b" " if words else b" "
                blanks = blanks_of(joined)
                base = [(at, label) for p, label in wanted for at in exact(joined, p, blanks)]
                more = fuzzy(joined, known, blanks)
                own = sorted({label for _, label in base})
                score = 1.0 if base else max((round(1 - e / len(n), 6) for _, n, _, _, e in more), default=0.0)
                rows.append({
                    "n_words": len(words), "n_base": len(base), "first_word": min(base)[0] if base else None, "last_word": max(base)[0] if base else None,
                    "base_labels": ",".join(own), "labels": ",".join(sorted({*own, *(m[0] for m in more)})), "score": score,
                    "matches": [dict(zip(("label", "notice", "first_word", "last_word", "edits"), m, strict=True)) for m in more],
                })
            out = pa.RecordBatch.from_pylist(rows, _SCHEMA)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out.columns], ["doc_id", *out.schema.names])

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches {MATCHES}"
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, schema)


_SCHEMA = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])))])
