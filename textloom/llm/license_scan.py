"""Fuzzy short-notice search.

Text is read as words (A-Z lower-cased, ASCII letters and digits and all other
scripts' characters; every other ASCII character separates). A notice of k allowed
edits is split into k + 1 pieces; by the pigeonhole principle each match holds one
piece unchanged. One Aho-Corasick pass over the space-joined words finds the pieces;
around each hit the regex library's bounded-error matching ({e<=k}) verifies the
notice and gives its span, reported in code points of the text itself. Exact base phrases are counted beside it.

Edge cases. Null or empty text: 0 words, empty labels, null places, score 0.
Overlapping hits of one notice are verified once per window; matches are
leftmost and non-overlapping per notice. Words join across line breaks and marks,
so a notice broken over lines is found. Rows are scanned one by one: repeated rows
repeat results.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import as_bytes, map_arrow

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# notice: (label, allowed edits). Edits are characters inserted, dropped or replaced.
NOTICES = {
    "released under the mit license": ("mit", 2),
    "licensed under the mit license": ("mit", 2),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 5),
    "licensed under the apache license version 2 0": ("apache-2.0", 3),
    "gnu general public license": ("gpl", 2),
    "gnu lesser general public license": ("lgpl", 3),
    "gnu affero general public license": ("agpl", 3),
    "mozilla public license": ("mpl", 2),
    "licensed under cc by": ("cc-by", 1),
    "creative commons attribution": ("cc-by", 2),
    "all rights reserved": ("reserved", 1),
    "redistribution and use in source and binary forms": ("bsd", 4),
    "this is free and unencumbered software released into the public domain": ("unlicense", 5),
    "spdx license identifier": ("spdx", 1),
}

_ASCII_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
_TO_SPACE = bytes.maketrans(_ASCII_SEPARATORS, b" " * len(_ASCII_SEPARATORS))


def words_of(data: bytes) -> list[bytes]:
    return data.lower().translate(_TO_SPACE).split()


@dataclass(frozen=True)
class Match:
    label: str
    notice: str
    start: int  # code points; in the space-joined words as found, in the text as reported
    end: int
    edits: int


def seeds(notice: str, edits: int) -> list[tuple[str, int]]:
    """The notice cut into edits + 1 pieces, with their places."""
    n, k = len(notice), edits + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


class NoticeSearch:
    def __init__(self, notices: dict[str, tuple[str, int]]):
        import ahocorasick
        import regex

        self.notices = notices
        self.patterns = {t: regex.compile(rf"(?e)\b(?:{regex.escape(t, special_only=True)}){{e<={k}}}") for t, (_, k) in notices.items()}
        by_seed: dict[str, list[tuple[str, int]]] = {}
        for text, (_, k) in notices.items():
            for piece, at in seeds(text, k):
                by_seed.setdefault(piece, []).append((text, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by_seed.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, joined: str) -> list[Match]:
        windows: dict[str, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(joined):
            for text, at in where:
                k = self.notices[text][1]
                start = last + 1 - size - at
                low, high = max(0, start - k), min(len(joined), start + len(text) + k)
                spans = windows.setdefault(text, [])
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(high, spans[-1][1])
                    spans[-1][0] = min(low, spans[-1][0])
                else:
                    spans.append([low, high])
        found = set()
        for text, spans in windows.items():
            label = self.notices[text][0]
            for low, high in spans:
                # one character of context, so that \b sees where a word begins
                base = max(0, low - 1)
                for m in self.patterns[text].finditer(joined, base, high):
                    found.add(Match(label, text, m.start(), m.end(), sum(m.fuzzy_counts)))
        return sorted(found, key=lambda m: (m.start, m.end, m.notice))


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """(word place, label) of each base phrase; joined has a space at both ends."""
    out = []
    for phrase, label in BASE.items():
        needle = b" " + phrase.encode() + b" "
        at, word, counted = joined.find(needle), 0, 0
        while at >= 0:
            word, counted = word + joined.count(b" ", counted, at), at
            out.append((word, label))
            at = joined.find(needle, at + 1)
    return out


def in_text(data: bytes, joined: str, places: list[int]) -> list[int]:
    """Places in the space-joined words (ascending) as code points of the text."""
    plain = np.frombuffer(data.lower().translate(_TO_SPACE), np.uint8)
    words = plain != 32
    begins = np.flatnonzero(words & ~np.concatenate([[False], words[:-1]]))
    points = np.cumsum((plain & 0xC0) != 0x80) - 1  # code point of each byte
    out, word, counted, start = [], 0, 0, 0
    for at in places:
        if n := joined.count(" ", counted, at):
            word, start = word + n, joined.rindex(" ", counted, at) + 1
        counted = max(counted, at)
        out.append(int(points[begins[word]]) + at - start)
    return out


SPANS = "array<struct<label:string,notice:string,start:int,end:int,edits:int>>"
SCHEMA = f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPANS}"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))


def scan(data: bytes, search: NoticeSearch) -> tuple:
    words = words_of(data)
    joined = b" ".join(words)
    places = base_places(b" " + joined + b" ")
    text = joined.decode("utf-8", "replace")
    matches = search.find(text)
    base = {label for _, label in places}
    score = 1.0 if places else max((1 - m.edits / len(m.notice) for m in matches), default=0.0)
    starts = [p for p, _ in places]
    if matches:
        at = sorted({x for m in matches for x in (m.start, m.end - 1)})
        where = dict(zip(at, in_text(data, text, at), strict=True))
        matches = [replace(m, start=where[m.start], end=where[m.end - 1] + 1) for m in matches]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | {m.label for m in matches})), score,
        [{"label": m.label, "notice": m.notice, "start": m.start, "end": m.end, "edits": m.edits} for m in matches],
    )


def license_scan(docs: DataFrame, notices: dict[str, tuple[str, int]] = NOTICES) -> DataFrame:
    """One row per row of docs(doc_id, text); spans are code points of the text, end exclusive."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPAN]

    def run(batches):
        search = NoticeSearch(notices)
        for b in batches:
            out = [scan(d, search) for d in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], ["doc_id", *names])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {id_type}, {SCHEMA}")
