"""License scan: templates with optional and replaceable regions as token automata.

A template is wording with markup: what stands between ``<<beginOptional>>`` and
``<<endOptional>>`` may be missing, and ``<<var;name="..";original="..";match="..">>`` is
replaceable by what ``match`` allows: ``.{m,n}`` any m to n words, ``.*`` and ``.+`` any words up
to ``MOST_ANY``, else one of the wordings between ``|``. All templates are compiled into one
automaton over words, which is determinised as texts need it. A passage is accepted if the
mandatory wording, and nothing else outside the regions, stands there word by word.

Base phrases are templates without regions, so one automaton finds both. Case and all ASCII
marks between words do not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventframe.llm.byte_words import ALPHANUMERIC, binaries, token_slabs
from eventframe.llm.texts import keyed, schema_of

MOST_ANY = 40
# Compiled states are dropped and compiled anew when there are more.
MOST_STATES = 50_000
OTHER = -1

# Phrases that name a licence, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# The licences' own words, which must stand as they are.
_GRANT = "<<var;name=\"verb\";original=\"licensed\";match=\"licensed|released|distributed|available|provided\">> under"
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY <<var;name=\"holders\";original=\"THE COPYRIGHT HOLDERS AND CONTRIBUTORS\";match=\".{1,20}\">> "
    "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
TEMPLATES = {
    "mit-grant": f"{_GRANT} the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of "
        "the Software. <<beginOptional>>THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "<<var;name=\"holders\";original=\"THE AUTHORS OR COPYRIGHT HOLDERS\";match=\".{1,20}\">> BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY<<endOptional>>"
    ),
    "apache-2.0": (
        f"{_GRANT} the <<beginOptional>>terms of the<<endOptional>> Apache License<<beginOptional>>, Version<<endOptional>> 2.0"
        "<<beginOptional>> (the \"License\"); you may not use this <<var;name=\"work\";original=\"file\";match=\".{1,4}\">> except in "
        "compliance with the License. You may obtain a copy of the License at<<endOptional>>"
    ),
    "gpl-2.0": (
        f"{_GRANT} the <<beginOptional>>terms of the<<endOptional>> GNU General Public License<<beginOptional>> as published by the "
        "Free Software Foundation<<endOptional>><<beginOptional>>; either<<endOptional>> version 2"
    ),
    "gpl-3.0": (
        f"{_GRANT} the <<beginOptional>>terms of the<<endOptional>> GNU General Public License<<beginOptional>> as published by the "
        "Free Software Foundation<<endOptional>><<beginOptional>>, either<<endOptional>> version 3"
    ),
    "gpl-or-later": (
        "GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>"
        "<<beginOptional>>, either<<endOptional>> version <<var;name=\"version\";original=\"3\";match=\"1|2|3\">> "
        "<<beginOptional>>of the License, <<endOptional>>or <<beginOptional>>(at your option) <<endOptional>>any later version"
    ),
    "cc-by-4.0": "CC BY 4.0<<beginOptional>> International<<endOptional>>",
    "cc-by-nc-4.0": "CC BY NC 4.0<<beginOptional>> International<<endOptional>>",
    "cc-by-sa-4.0": "CC BY SA 4.0<<beginOptional>> International<<endOptional>>",
    "cc-attribution": (
        f"{_GRANT} <<var;name=\"article\";original=\"a\";match=\"a|the\">> Creative Commons Attribution "
        "<<var;name=\"terms\";original=\"NonCommercial\";match=\".{0,4}\">> <<var;name=\"version\";original=\"4.0\";match=\"2.0|2.5|3.0|4.0\">> "
        "<<beginOptional>>International<<endOptional>> <<beginOptional>>Public<<endOptional>> License"
    ),
    "bsd-2-clause": _BSD + _AS_IS,
    "bsd-3-clause": (
        _BSD + "<<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=\"holder\";original=\"the copyright holder\";"
        "match=\".{1,20}\">> nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. " + _AS_IS
    ),
    "isc": (
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}

_MARKUP = re.compile(r"<<(beginOptional|endOptional|var)\b(.*?)>>", re.S)
_MATCH = re.compile(r'\bmatch="([^"]*)"')
_ANY = re.compile(r"\.(?:([*+])|\{(\d+),(\d+)\})")


def words_of(text: str) -> list[bytes]:
    return [w for part in token_slabs(text.encode(), ALPHANUMERIC) for w in part]


@dataclass
class Automaton:
    """Words to states: first as places with edges, then determinised while texts are read."""

    numbers: dict[bytes, int] = field(default_factory=dict)
    edges: list[dict[int, list[int]]] = field(default_factory=list)
    any_word: list[list[int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    ends: dict[int, int] = field(default_factory=dict)
    labels: list[tuple[str, bool]] = field(default_factory=list)

    def __post_init__(self):
        self.begin = self._place()

    # Places and edges of the templates.

    def _place(self) -> int:
        for table in (self.edges, self.any_word, self.free):
            table.append({} if table is self.edges else [])
        return len(self.edges) - 1

    def _wording(self, at: int, text: str) -> int:
        for word in words_of(text):
            after = self._place()
            self.edges[at].setdefault(self.numbers.setdefault(word, len(self.numbers)), []).append(after)
            at = after
        return at

    def _replaceable(self, at: int, match: str) -> int:
        free = _ANY.fullmatch(match.strip())
        end = self._place()
        if not free:
            for choice in match.split("|"):
                self.free[self._wording(at, choice)].append(end)
            return end
        least, most = (1 if free[1] == "+" else 0, MOST_ANY) if free[1] else (int(free[2]), int(free[3]))
        for number in range(most + 1):
            if number >= least:
                self.free[at].append(end)
            if number < most:
                after = self._place()
                self.any_word[at].append(after)
                at = after
        return end

    def add(self, label: str, template: str, base: bool) -> None:
        """Compile a template; ``base`` marks phrases whose places are counted."""
        opened: list[int] = []
        last = 0
        # A place of its own, so that no template's regions lead into another one.
        start = at = self._place()
        self.free[self.begin].append(start)
        for mark in _MARKUP.finditer(template):
            at = self._wording(at, template[last : mark.start()])
            last = mark.end()
            if mark[1] == "beginOptional":
                opened.append(at)
                inside = self._place()
                self.free[at].append(inside)
                at = inside
            elif mark[1] == "endOptional":
                if not opened:
                    raise ValueError(f"{label}: an optional region ends that did not begin")
                after = self._place()
                self.free[at].append(after)
                self.free[opened.pop()].append(after)
                at = after
            else:
                match = _MATCH.search(mark[2])
                if not match:
                    raise ValueError(f"{label}: a replaceable region without match")
                at = self._replaceable(at, match[1])
        at = self._wording(at, template[last:])
        if opened:
            raise ValueError(f"{label}: an optional region does not end")
        end = self._place()
        self.free[at].append(end)
        self.ends[end] = len(self.labels)
        self.labels.append((label, base))
        if len(self.labels) - 1 in self._closed([start])[1]:
            raise ValueError(f"{label}: no mandatory wording")
        if any(self.any_word[p] for p in self._closed([start])[0]):
            raise ValueError(f"{label}: begins with a region of any words")

    # Sets of places as states.

    def _closed(self, places: Sequence[int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """All places reached without a word, and the templates that end there."""
        seen, waiting = set(places), list(places)
        while waiting:
            for after in self.free[waiting.pop()]:
                if after not in seen:
                    seen.add(after)
                    waiting.append(after)
        return tuple(sorted(seen)), tuple(sorted(self.ends[p] for p in seen if p in self.ends))

    def compiled(self) -> "Automaton":
        """Ready to read texts; states are made from here on."""
        self.states: dict[tuple[int, ...], int] = {}
        self.sets: list[tuple[int, ...]] = []
        self.accepting: list[tuple[int, ...]] = []
        self.steps: list[dict[int, int]] = []
        self.first = self._state([self.begin])
        firsts = {w for p in self.sets[self.first] for w in self.edges[p]}
        # By word number, and False for words of no template (number -1, the last entry).
        self.leads = np.array([n in firsts for n in range(len(self.numbers))] + [False])
        return self

    def _state(self, places: Sequence[int]) -> int:
        closed, ends = self._closed(places)
        number = self.states.get(closed)
        if number is None:
            number = self.states[closed] = len(self.sets)
            self.sets.append(closed)
            self.accepting.append(ends)
            self.steps.append({})
        return number

    def _step(self, state: int, word: int) -> int:
        """The next state, or -1 for none."""
        after = [q for p in self.sets[state] for q in (*self.edges[p].get(word, ()), *self.any_word[p])]
        to = self._state(after) if after else -1
        self.steps[state][word] = to
        return to

    def longest(self, words: list[int], begin: int) -> dict[int, int]:
        """For each template that a passage from ``begin`` on matches: where its longest one ends."""
        if len(self.sets) > MOST_STATES:
            self.compiled()
        found: dict[int, int] = {}
        state = self.first
        for at in range(begin, len(words)):
            after = self.steps[state].get(words[at])
            state = self._step(state, words[at]) if after is None else after
            if state < 0:
                break
            for label in self.accepting[state]:
                found[label] = at + 1
        return found

    def accepts(self, text: str) -> list[str]:
        """Labels of the templates that the whole text matches."""
        words = [self.numbers.get(w, OTHER) for w in words_of(text)]
        found = self.longest(words, 0) if words else {}
        return sorted(self.labels[n][0] for n, end in found.items() if end == len(words))

    def passages(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """``(template, begin, end)`` of the longest passage of each template from each place on."""
        found = []
        begins = np.flatnonzero(self.leads[words])
        if not len(begins):
            return found
        as_list = words.tolist()
        for begin in begins.tolist():
            found.extend((n, begin, end) for n, end in self.longest(as_list, begin).items())
        return found


def compile_templates(templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> Automaton:
    out = Automaton()
    for phrase, label in phrases.items():
        out.add(label, phrase, True)
    for label, template in templates.items():
        out.add(label, template, False)
    return out.compiled()


def covered(passages: Sequence[tuple[int, int, int]]) -> int:
    """How many words lie in any of the passages."""
    total = reach = 0
    for _, begin, end in sorted(passages, key=lambda p: p[1:]):
        total += max(0, end - max(begin, reach))
        reach = max(reach, end)
    return total


def scan(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, n_words, n_covered, passages`` of every row; a passage is ``label, base, first, last`` (words from 0).

    From each place on a template's longest passage counts. Null and empty texts have no words,
    repeated rows are treated alike, columns beside id and text are not read, an empty table gives no rows.
    """
    given = keyed(docs, id_col, text_col)
    kind = "n_words bigint, n_covered bigint, passages array<struct<label: string, base: boolean, first: bigint, last: bigint>>"
    schema = schema_of(given, kind)
    passage = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64())])
    templates, phrases = dict(templates), dict(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compile_templates(templates, phrases)
        numbers = automaton.numbers
        for batch in batches:
            sizes, covers, lists = [], [], []
            for text in binaries(batch.column("text")):
                parts = [
                    np.fromiter((numbers.get(w, OTHER) for w in tokens), np.int32, len(tokens)) for tokens in token_slabs(text, ALPHANUMERIC)
                ]
                words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                found = automaton.passages(words)
                sizes.append(len(words))
                covers.append(covered(found))
                lists.append([
                    {"label": automaton.labels[n][0], "base": automaton.labels[n][1], "first": begin, "last": end - 1}
                    for n, begin, end in found
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(covers, pa.int64()), pa.array(lists, pa.list_(passage))],
                schema.names,
            )

    return given.mapInArrow(run, schema)


def digests(scanned: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is the share of a text's words that lie in accepted passages; 0 for a text without words.
    """
    base = F.filter("passages", lambda p: p["base"])

    def joined(passages: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(passages, lambda p: p["label"]))))

    starts = F.transform(base, lambda p: p["first"])
    return scanned.select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("passages")).alias("labels"),
        F.when(F.col("n_words") > 0, F.col("n_covered") / F.col("n_words")).otherwise(0.0).alias("score"),
    )
