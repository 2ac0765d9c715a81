"""License scans by template-markup matching.

A template is wording with two kinds of markup: ``[ ... ]`` may be missing, and ``{a-b}`` stands for a to b
words of any kind (a holder's name, a version). It is compiled into a token automaton whose states are bits of
an integer; a place in a text is accepted where all mandatory wording follows word for word, and the longest
match counts. The first two words of a template are mandatory, and a vectorised search for their fingerprints
over the whole text finds the places where its automaton is run; what they find is compared as words.

Base phrases are counted at every place where their words stand one after the other.

Score: the share of a text's words that lie inside a match of a phrase or a template.

Defined results: null and empty texts have no words, no labels (empty strings) and score 0; repeated rows and
null ids give rows of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import texts
from tickerloom.llm.tables import map_arrow

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license notices, with markup; words are compared in lower case without punctuation.
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license [version] {0-1} [0] [the license]",
    "cc-by-nc-notice": "licensed under [a] [the] [creative commons] cc by nc {0-2}",
    "cc-notice": "licensed under a creative commons {1-6} license",
    "gpl-notice": "licensed under the gnu [lesser] [affero] general public license [version {1-2}] [or] [any] [later] [version]",
    "gpl-free-software": "free software you can redistribute it and or modify it under the terms of the gnu [lesser] [affero]"
    " general public license as published by the free software foundation [either] version {1-2} [of the license]"
    " [or at your option any later version]",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files [the software] to deal in the software without restriction including without limitation the"
    " rights to use copy modify merge publish distribute sublicense and or sell copies of the software {0-200}"
    " the above copyright notice and this permission notice [including the next paragraph] shall be included in all"
    " copies or substantial portions of the software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that"
    " the following conditions are met {0-12} redistributions of source code must retain the above copyright notice this"
    " list of conditions and the following disclaimer",
    "spdx-tag": "spdx license identifier {1-6}",
}


class Automaton(NamedTuple):
    """Bit i of a mask is state i. ``on`` maps a word to the states that it leaves by the edge to the next state."""

    label: str
    start: tuple[str, str]
    on: dict[str, int]
    anything: int
    jumps: tuple[tuple[int, int], ...]
    last: int
    longest: int


@lru_cache(maxsize=64)
def compile_template(label: str, wording: str) -> Automaton:
    """States are numbered along the wording; an optional region is a jump from its begin to its end."""
    on: dict[str, int] = {}
    anything, jumps, state, opened = 0, [], 0, []
    for token in re.findall(r"\[|\]|\{\d+-\d+\}|[^\s\[\]{}]+", wording):
        if token == "[":
            opened.append(state)
        elif token == "]":
            jumps.append((opened.pop(), state))
        elif token[0] == "{":
            least, most = map(int, token[1:-1].split("-"))
            for k in range(most):
                anything |= 1 << state
                if k >= least:
                    jumps.append((state, state + 1))
                state += 1
        else:
            on[token] = on.get(token, 0) | 1 << state
            state += 1
    if opened:
        raise ValueError(f"template {label}: a region is not closed")
    words = wording.split()
    if any(c in "[{" for w in words[:2] for c in w):
        raise ValueError(f"template {label}: the first two words must be mandatory")
    return Automaton(label, (words[0], words[1]), on, anything, tuple(sorted(jumps)), state, state)


def longest_match(automaton: Automaton, words: list[str]) -> int:
    """Number of words of the longest match that begins with the first word, or 0."""

    def closed(states: int) -> int:
        for begin, end in automaton.jumps:  # sorted by begin, so one pass follows chains of jumps
            if states >> begin & 1:
                states |= 1 << end
        return states

    states, best = closed(1), 0
    for k, word in enumerate(words, 1):
        states = closed((states & (automaton.on.get(word, 0) | automaton.anything)) << 1)
        if not states:
            break
        if states >> automaton.last & 1:
            best = k
    return best


@lru_cache(maxsize=4096)
def word_hash(word: str) -> np.uint64:
    return texts.words(pa.array([word]), "alnum").hash[0]


class _Reader:
    """Words of a column as lower-case text, by number."""

    def __init__(self, data: np.ndarray, found: texts.Words) -> None:
        self.data, self.found = data, found

    def __call__(self, first: int, stop: int) -> list[str]:
        table = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
        spans = zip(self.found.start[first:stop].tolist(), self.found.end[first:stop].tolist())
        return [self.data[a:b].tobytes().translate(table).decode("utf-8", "replace") for a, b in spans]


def _places(found: texts.Words, words: list[str]) -> np.ndarray:
    """Where the words stand one after the other in one text, by fingerprint."""
    n = len(found.hash) - len(words) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(found.hash[:n] == word_hash(words[0]))
    for k, word in enumerate(words[1:], 1):
        at = at[found.hash[at + k] == word_hash(word)]
    return at[found.row[at] == found.row[at + len(words) - 1]]


def scan_column(column: pa.Array, phrases: dict[str, str], templates: dict[str, str]) -> dict[str, list]:
    found = texts.words(column, "alnum")
    data, _ = texts.buffers(column)
    read, rows = _Reader(data, found), len(column)
    spans = texts.row_spans(found.row, rows)
    out = {
        "n_words": np.diff(spans), "n_base": np.zeros(rows, np.int64), "first_word": [None] * rows, "last_word": [None] * rows,
        "base_labels": [set() for _ in range(rows)], "labels": [set() for _ in range(rows)],
    }
    covered = np.zeros(len(found.hash) + 1, np.int64)
    for phrase, label in phrases.items():
        words = phrase.split()
        for at in _places(found, words).tolist():
            if read(at, at + len(words)) != words:
                continue
            r = int(found.row[at])
            place = at - int(spans[r])
            out["n_base"][r] += 1
            out["first_word"][r] = place if out["first_word"][r] is None else min(place, out["first_word"][r])
            out["last_word"][r] = place if out["last_word"][r] is None else max(place, out["last_word"][r])
            out["base_labels"][r].add(label)
            covered[at] += 1
            covered[at + len(words)] -= 1
    for label, wording in templates.items():
        automaton = compile_template(label, wording)
        for at in _places(found, list(automaton.start)).tolist():
            r = int(found.row[at])
            size = longest_match(automaton, read(at, min(int(spans[r + 1]), at + automaton.longest)))
            if size:
                out["labels"][r].add(label)
                covered[at] += 1
                covered[at + size] -= 1
    inside = np.r_[0, np.cumsum(np.cumsum(covered[:-1]) > 0)]
    share = (inside[spans[1:]] - inside[spans[:-1]]) / np.maximum(1, out["n_words"])
    out["labels"] = [",".join(sorted(a | b)) for a, b in zip(out["labels"], out["base_labels"])]
    out["base_labels"] = [",".join(sorted(a)) for a in out["base_labels"]]
    out["score"] = share
    return out


def scan(documents: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, word and phrase counts, places, labels and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch):
                found = scan_column(part.column(1), phrases, templates)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found.values(), TYPES)], ["doc_id", *found])

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), run, schema)


TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
