"""License scans by template markup: optional and replaceable regions compiled into token automata.

A template is a text in which [[...]] marks a region that may be left out and <<name:most>> one
that stands for up to ``most`` words of any kind. All other words are mandatory. The templates
are compiled into one automaton over words; it starts anew at every word of a document, and
accepts where all mandatory words of a template stand in order, with nothing between them but
what its regions allow.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elutra.llm.shared import per_text

#: Words after lower-casing A-Z, in UTF-8: digits, letters, and all bytes beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Fixed values: (label, template). The wording is that of the licenses and of their usual notices.
TEMPLATES = [
    ("notice-mit", "[[this work is]] [[this software is]] released under the [[terms of the]] mit license"),
    ("notice-mit", "licensed under the [[terms of the]] mit license"),
    ("mit-text", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
     the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
     sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
     the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"""),
    ("notice-apache", "licensed under the apache license [[version]] [[2 0]] [[the license]]"),
    ("apache-text", """licensed under the apache license version 2 0 the license you may not use <<file:4>> except in compliance with the license you may obtain a
     copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under
     the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific
     language governing permissions and limitations under the license"""),
    ("notice-gpl", "licensed under the [[terms of the]] [[gnu]] [[lesser]] [[affero]] general public license [[version]] [[<<version:1>>]]"),
    ("gpl-text", """<<program:6>> is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as
     published by the free software foundation either version <<version:2>> of the license or [[at your option]] any later version"""),
    ("notice-bsd", "licensed under the [[<<clauses:2>>]] bsd [[2 clause]] [[3 clause]] license"),
    ("bsd-text", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
     [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
     [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or
     other materials provided with the distribution [[3 neither the name of <<owner:12>> nor the names of its contributors may be used to endorse or promote products
     derived from this software without specific prior written permission]]"""),
    ("isc-text", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
     copyright notice and this permission notice appear in all copies"""),
    ("notice-mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("notice-cc", "licensed under [[a]] [[the]] [[creative commons]] cc [[attribution]] by [[nc]] [[nd]] [[sa]] [[<<version:1>> 0]] [[license]]"),
    ("notice-cc", "licensed under [[a]] [[the]] creative commons attribution [[noncommercial]] [[non commercial]] [[noderivatives]] [[sharealike]] [[<<version:1>> 0]] [[international]] license"),
    ("unlicense-text", "this is free and unencumbered software released into the public domain"),
]

PART = re.compile(r"\[\[|\]\]|<<(\w+):(\d+)>>|([0-9a-z\x80-\U0010ffff]+)")


@dataclass
class Automaton:
    """States with one list of successors for each word; ``skip`` states can be passed without a word, ``any`` ones by every word."""

    words: list[dict[bytes, int]] = field(default_factory=list)
    any: list[int | None] = field(default_factory=list)
    skip: list[list[int]] = field(default_factory=list)
    accepts: dict[int, str] = field(default_factory=dict)
    starts: list[int] = field(default_factory=list)
    closed: dict[frozenset[int], frozenset[int]] = field(default_factory=dict)
    moved: dict[tuple[frozenset[int], bytes], frozenset[int]] = field(default_factory=dict)
    alphabet: set[bytes] = field(default_factory=set)

    def state(self) -> int:
        self.words.append({})
        self.any.append(None)
        self.skip.append([])
        return len(self.words) - 1

    def add(self, label: str, template: str) -> None:
        at, open_at = self.state(), []
        self.starts.append(at)
        for part in PART.finditer(template.lower()):
            if part[0] == "[[":
                open_at.append(at)
            elif part[0] == "]]":
                self.skip[open_at.pop()].append(at)
            elif part[1]:
                ends = [at]
                for _ in range(int(part[2])):
                    to = self.state()
                    self.any[at] = to
                    at = to
                    ends.append(at)
                end = self.state()
                for x in ends:
                    self.skip[x].append(end)
                at = end
            else:
                to, word = self.state(), part[3].encode()
                self.words[at][word] = to
                self.alphabet.add(word)
                at = to
        if open_at:
            raise ValueError(f"an optional region of {label} is not closed")
        self.accepts[at] = label

    def close(self, states: frozenset[int]) -> frozenset[int]:
        if states not in self.closed:
            found, todo = set(states), list(states)
            while todo:
                for x in self.skip[todo.pop()]:
                    if x not in found:
                        found.add(x)
                        todo.append(x)
            self.closed[states] = frozenset(found)
        return self.closed[states]

    def move(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        """The states after ``word``, closed. Words that no template has all move alike."""
        key = (states, word if word in self.alphabet else b"")
        if key not in self.moved:
            if len(self.moved) > 50_000:
                self.moved.clear()
            to = {self.words[s].get(key[1]) for s in states} | {self.any[s] for s in states}
            self.moved[key] = self.close(frozenset(x for x in to if x is not None))
        return self.moved[key]

    def find(self, words: list[bytes], starts: list[int]) -> list[tuple[int, int, str]]:
        """(first word, word after the last, label) of every accepted template, its longest form, from each of ``starts``."""
        begin, found = self.close(frozenset(self.starts)), []
        for start in starts:
            states, best = begin, {}
            for end in range(start, len(words)):
                states = self.move(states, words[end])
                if not states:
                    break
                for s in states:
                    if s in self.accepts:
                        best[self.accepts[s]] = end + 1
            found += [(start, end, label) for label, end in sorted(best.items())]
        return found


@lru_cache(maxsize=1)
def automaton() -> tuple[Automaton, frozenset[bytes]]:
    """All templates, and the words that an accepted place can begin with."""
    made = Automaton()
    for label, template in TEMPLATES:
        made.add(label, template)
    begin = made.close(frozenset(made.starts))
    return made, frozenset(w for s in begin for w in made.words[s])


def scan_text(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of one text."""
    data = text.encode("utf-8", "replace").lower()
    words = WORD.findall(data)
    places, base, spans = [], set(), []
    if b"license" in data:
        for at, word in enumerate(words):
            if word == b"license":
                for phrase, label in PHRASES.items():
                    own = phrase.encode().split()
                    if at + 1 >= len(own) and words[at + 1 - len(own) : at + 1] == own:
                        places.append(at + 1 - len(own))
                        base.add(label)
    if any(x in data for x in ANCHORS):
        made, first = automaton()
        spans = made.find(words, _starts(words, first))
    labels = base | {label for _, _, label in spans}
    full = any(label.endswith("-text") for label in labels)
    score = 1.0 if full else 0.8 if spans else 0.5 if base else 0.0
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


#: Every template has one of these; a text without them is not matched any further.
ANCHORS = (b"licens", b"permission", b"redistribut", b"unencumbered")


def _starts(words: list[bytes], first: frozenset[bytes]) -> list[int]:
    """Where a template can begin: at one of its first words. Templates that begin with a
    replaceable region are found from the word after it on, so the region itself may be empty."""
    return [i for i, w in enumerate(words) if w in first]


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,stop:long,label:string>>"


def scan(text: Column) -> Column:
    return per_text(lambda: scan_text, SCHEMA, COLUMNS)(text)


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id and what ``scan`` finds, for every row of ``docs`` (doc_id, text), in one narrow pass.

    score: 1 for a license text, 0.8 for a notice, 0.5 for a bare phrase, else 0. spans are the
    word ranges of accepted templates, overlapping ones included. Null and empty texts have no
    words and no labels. Repeated rows repeat; other columns are ignored.
    """
    return docs.select("doc_id", scan(F.col("text")).alias("x")).select("doc_id", *[f"x.{c}" for c in COLUMNS])
