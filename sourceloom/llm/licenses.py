"""License scan by template markup.

A template is the wording of a license or notice with markup for the parts that may be left out
(``<<optional>> ... <<end>>``) or replaced (``<<var min max>>``: any words, as many as stated; ``<<one a|b>>``: one of
some words).  It is compiled to an automaton over words.  A template is found where a run of words takes its
automaton from the first to the last state, so all mandatory wording stands there exactly and in order; case,
punctuation and layout do not count, since words alone are compared.  Plain phrases give the base labels.

Texts are scanned whole: an automaton starts wherever its first mandatory words allow, and only in texts that
contain its rarest mandatory word.

Rows: null text is empty; no phrase gives null first and last word and empty labels; rows that repeat get
equal results; an empty table gives an empty result; extra columns do not matter.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import batches, text_of

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label -> template.
TEMPLATES = {
    "apache-2.0": 'Licensed under the Apache License, Version 2.0',
    "gpl-2.0": "licensed under <<optional>> the terms of <<end>> the GNU General Public License <<optional>> as published by "
               "the Free Software Foundation <<end>> <<optional>> either <<end>> version 2 <<optional>> of the License <<end>>",
    "gpl-3.0": "licensed under <<optional>> the terms of <<end>> the GNU General Public License <<optional>> as published by "
               "the Free Software Foundation <<end>> <<optional>> either <<end>> version 3 <<optional>> of the License <<end>>",
    "gpl-notice": "<<var 1 12>> is free software you can redistribute it and or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation either version <<one 2|3>> of the "
                  "License or at your option any later version",
    "lgpl": "GNU <<one lesser|library>> General Public License <<optional>> version <<one 2|2.1|3>> <<end>>",
    "mit-notice": "<<one released|licensed|distributed|available>> under the <<optional>> terms of the <<end>> MIT License",
    "mit-text": "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                "documentation files <<optional>> the Software <<end>> to deal in the Software without restriction including "
                "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
                "the Software and to permit persons to whom the Software is furnished to do so subject to the following "
                "conditions The above copyright notice and this permission notice <<optional>> including the next paragraph "
                "<<end>> shall be included in all copies or substantial portions of the Software",
    "isc": "Permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or "
           "without fee is hereby granted provided that the above copyright notice and this permission notice appear in all "
           "copies",
    "bsd": "Redistribution and use in source and binary forms with or without modification are permitted provided that the "
           "following conditions are met <<optional>> 1 <<end>> Redistributions of source code must retain the above "
           "copyright notice this list of conditions and the following disclaimer",
    "cc-by-4.0": "CC BY 4.0",
    "cc-by-sa-4.0": "CC BY SA 4.0",
    "cc-by-nc-4.0": "CC BY NC 4.0",
    "cc-by-nd-4.0": "CC BY ND 4.0",
    "cc-by-nc-sa-4.0": "CC BY NC SA 4.0",
    "cc-by-nc-nd-4.0": "CC BY NC ND 4.0",
    "cc0-1.0": "CC0 1.0 <<optional>> Universal <<end>>",
    "mpl-2.0": "subject to the terms of the Mozilla Public License v 2.0",
    "all-rights-reserved": "All rights reserved",
    "spdx": "SPDX License Identifier <<var 1 6>>",
}

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)) + _SEPARATORS, bytes(range(0x61, 0x7B)) + b" " * len(_SEPARATORS))


def words(text: str) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """States 0..n-1; a step is (from, word or None for any word, to); skips need no word."""

    def __init__(self, template: str):
        self.steps: list[dict[bytes, set[int]]] = [{}]
        self.any: list[set[int]] = [set()]
        self.skips: list[set[int]] = [set()]
        self.mandatory: list[bytes] = []
        opened: list[int] = []
        at, parts = 0, template.replace("<<", "\0<<").replace(">>", ">>\0").split("\0")
        for part in parts:
            if not part.startswith("<<"):
                for word in words(part):
                    if not opened:
                        self.mandatory.append(word)
                    at = self._word(at, [word])
                continue
            kind, *values = part[2:-2].split()
            if kind == "optional":
                opened.append(at)
            elif kind == "end":
                self.skips[opened.pop()].add(at)
            elif kind == "one":
                at = self._choice(at, [words(v) for v in values[0].split("|")])
            else:
                least, most = map(int, values)
                ends = []
                for n in range(most):
                    if n >= least:
                        ends.append(at)
                    new = self._state()
                    self.any[at].add(new)
                    at = new
                for end in ends:
                    self.skips[end].add(at)
        self.final = at
        self.pivot = max(self.mandatory, key=len)
        self.closures = [self._closure({s}) for s in range(len(self.steps))]

    def _state(self) -> int:
        self.steps.append({})
        self.any.append(set())
        self.skips.append(set())
        return len(self.steps) - 1

    def _word(self, at: int, choices: list[bytes]) -> int:
        new = self._state()
        for word in choices:
            self.steps[at].setdefault(word, set()).add(new)
        return new

    def _choice(self, at: int, choices: list[list[bytes]]) -> int:
        ends = []
        for own in choices:
            here = at
            for word in own:
                here = self._word(here, [word])
            ends.append(here)
        last = self._state()
        for end in ends:
            self.skips[end].add(last)
        return last

    def _closure(self, states: set[int]) -> frozenset[int]:
        found, left = set(states), list(states)
        while left:
            for new in self.skips[left.pop()] - found:
                found.add(new)
                left.append(new)
        return frozenset(found)

    def accepts_at(self, text: list[bytes], start: int) -> bool:
        """Do the words from ``start`` on contain the whole template?"""
        now = self.closures[0]
        for word in text[start:]:
            if self.final in now:
                return True
            new: set[int] = set()
            for state in now:
                for to in self.steps[state].get(word, ()):
                    new |= self.closures[to]
                for to in self.any[state]:
                    new |= self.closures[to]
            if not new:
                return False
            now = frozenset(new)
        return self.final in now

    def found_in(self, text: list[bytes]) -> bool:
        opening = self.closures[0]
        if any(self.any[s] for s in opening):
            starts = range(len(text))
        else:
            first = {w for s in opening for w in self.steps[s]}
            starts = (i for i, w in enumerate(text) if w in first)
        return any(self.accepts_at(text, i) for i in starts)


@functools.lru_cache(maxsize=8)
def compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, t in templates]


def scan(text: str, phrases: dict[str, str], templates: tuple[tuple[str, str], ...]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    own = words(text)
    joined = b" " + b" ".join(own) + b" "
    places, base, covered = [], set(), 0
    for phrase, label in phrases.items():
        wanted = b" " + b" ".join(words(phrase)) + b" "
        at = joined.find(wanted)
        seen, count = 0, 0
        while at >= 0:
            count += joined.count(b" ", seen, at)
            seen = at
            places.append(count)
            base.add(label)
            covered += wanted.count(b" ") - 1
            at = joined.find(wanted, at + 1)
    found = {label for label, automaton in compiled(templates)
             if b" " + automaton.pivot + b" " in joined and automaton.found_in(own)}
    score = 1.0 if found else min(1.0, 0.5 + covered / (2 * len(own))) if base else 0.0
    return (len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | found)), score)


_OUT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]


def licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    plain, marked = dict(phrases or PHRASES), tuple((templates or TEMPLATES).items())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            rows = [scan(t, plain, marked) for t in batch["text"].to_pylist()]
            columns = [batch["doc_id"], *map(list, zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _OUT, strict=True)], [n for n, _ in _OUT])
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                                "labels string, score double")
