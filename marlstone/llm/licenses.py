"""License scans: templates with optional and replaceable regions, compiled to one token automaton.

A template is the wording of a license in words, with markup: what stands between
``<<beginOptional>>`` and ``<<endOptional>>`` may be left out, and ``<<var;max=N>>``
stands for any 0 to N words. All other words are mandatory and must match exactly, one
after another. All templates become states of one automaton over words; sets of states
are made when first met and remembered. It starts at every word that can begin a
template and takes the longest text that each template accepts from there. Phrases are
templates without markup, whose every place counts.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import byte_list, table, tidy
from .words import PIECE_BYTES, TABLE, word_pieces

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Public license wording and notices, with what may vary marked.
TEMPLATES = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;max=12>>, to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>>
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
        ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
        AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("mit", "under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>open source<<endOptional>> MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
    ("bsd", "SPDX-License-Identifier: BSD <<var;max=1>> Clause"),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<var;max=4>> except in compliance with
        the License. You may obtain a copy of the License at <<var;max=8>> Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("apache-2", "licensed under the <<beginOptional>>terms of the<<endOptional>> Apache <<beginOptional>>Software<<endOptional>> License <<beginOptional>>Version<<endOptional>> 2.0"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    (
        "gpl-3",
        """free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or <<beginOptional>>(at your option)<<endOptional>> any later version""",
    ),
    (
        "gpl-3",
        """<<beginOptional>>this work is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License
        <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3""",
    ),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0"),
    (
        "gpl-2",
        """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License
        <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2""",
    ),
    ("gpl-2", "SPDX-License-Identifier: GPL-2.0"),
    ("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution NonCommercial <<beginOptional>>4.0<<endOptional>> <<beginOptional>>International<<endOptional>> License"),
    ("cc-by", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution <<beginOptional>>4.0<<endOptional>> <<beginOptional>>International<<endOptional>> License"),
)
#: Mandatory words at which the score is a half.
HALF_WORDS = 4
#: Sets of states that are remembered.
REMEMBERED = 1 << 16
MARKUP = re.compile(r"<<(.*?)>>", re.S)


@dataclass(frozen=True)
class Rule:
    label: str
    base: bool
    mandatory: int
    longest: int


@dataclass
class _Node:
    """A set of states: the rules it accepts, and the sets that known words (None: any other word) lead to."""

    states: frozenset
    accepts: tuple
    to: dict = field(default_factory=dict)


class Automaton:
    """All phrases and templates as one automaton over words."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates=TEMPLATES):
        self.by_word: list[dict[bytes, int]] = []  # of each state
        self.by_any: list[list[int]] = []
        self.free: list[list[int]] = []  # reached without a word
        self.accept: dict[int, int] = {}
        self.rules: list[Rule] = []
        starts = []
        for label, text, base in [(b, a, True) for a, b in phrases.items()] + [(a, b, False) for a, b in templates]:
            begin = at = self._state()
            at, mandatory, longest = self._parts(iter(MARKUP.split(text)), at)
            if not mandatory:
                raise ValueError(f"a template of {label} has no mandatory word")
            self.accept[at] = len(self.rules)
            self.rules.append(Rule(label, base, mandatory, longest))
            starts.append(begin)
        self.words = {w for d in self.by_word for w in d}
        self.longest = max((r.longest for r in self.rules), default=0)
        self.nodes: dict[frozenset, _Node] = {}
        self.root = self._node(self._closure(starts))
        self.first = {w for s in self.root.states for w in self.by_word[s]}
        self.open = any(self.by_any[s] for s in self.root.states)
        if self.open or self.root.accepts:
            raise ValueError("a template must begin with a word of its own")
        # each rule's rarest-looking mandatory word: a text without any of them matches nothing
        self.anchors = {max((w.encode() for w in _mandatory(t)), key=len) for t in [*phrases, *(t for _, t in templates)]}

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append([])
        self.free.append([])
        return len(self.by_word) - 1

    def _parts(self, parts, at: int, inside: bool = False) -> tuple[int, int, int]:
        """Adds words and markup from state ``at``: the last state, mandatory words, longest length."""
        mandatory = longest = 0
        for k, part in enumerate(parts):
            if k % 2 == 0:
                for w in part.encode().translate(TABLE).split():
                    to = self._state()
                    self.by_word[at][w] = to
                    at, mandatory, longest = to, mandatory + 1, longest + 1
            elif part == "beginOptional":
                # an own entry, so that leaving the region out doesn't merge with words inside it
                entry, after = self._state(), self._state()
                self.free[at].append(entry)
                last, _, n = self._parts(parts, entry, True)
                self.free[at].append(after)
                self.free[last].append(after)
                at, longest = after, longest + n
            elif part == "endOptional":
                if not inside:
                    raise ValueError("endOptional without beginOptional")
                return at, mandatory, longest
            elif m := re.fullmatch(r"var;max=(\d+)", part):
                after = self._state()
                for _ in range(int(m[1])):
                    to = self._state()
                    self.free[at].append(after)
                    self.by_any[at].append(to)
                    at = to
                self.free[at].append(after)
                at, longest = after, longest + int(m[1])
            else:
                raise ValueError(f"unknown markup {part}")
        if inside:
            raise ValueError("beginOptional without endOptional")
        return at, mandatory, longest

    def _closure(self, states) -> frozenset:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo.extend(self.free[s])
        return frozenset(seen)

    def _node(self, states: frozenset) -> _Node | None:
        if not states:
            return None
        if states not in self.nodes:
            if len(self.nodes) >= REMEMBERED:
                self.nodes = {}
            self.nodes[states] = _Node(states, tuple(sorted({self.accept[s] for s in states if s in self.accept})))
        return self.nodes[states]

    def step(self, node: _Node, word: bytes) -> _Node | None:
        key = word if word in self.words else None
        if key in node.to:
            return node.to[key]
        to = [t for s in node.states for t in self.by_any[s]] + [self.by_word[s][key] for s in node.states if key in self.by_word[s]]
        node.to[key] = out = self._node(self._closure(to))
        return out

    def at(self, words: list[bytes], begin: int) -> dict[int, int]:
        """For each rule that accepts words from ``begin``: where its longest match ends."""
        found, node = {}, self.root
        for i in range(begin, len(words)):
            node = self.step(node, words[i])
            if node is None:
                break
            for r in node.accepts:
                found[r] = i + 1
        return found

    def scan(self, text: bytes, limit: int = PIECE_BYTES):
        """Number of words and the matches ``(rule, begin, end)`` of all starts, in order."""
        n, found, tail = 0, [], []
        whole = len(text) <= limit
        low = text.translate(TABLE) if whole else b""
        if whole and not any(a in low for a in self.anchors):
            return len(low.split()), found
        for new in word_pieces(text, limit):
            words, before = tail + new, n - len(tail)
            n += len(new)
            sure = len(words) - self.longest + 1  # starts whose longest match ends within these words
            self._from(words, range(max(0, sure)), before, found)
            tail = words[max(0, sure) :]
        self._from(tail, range(len(tail)), n - len(tail), found)
        return n, found

    def _from(self, words, starts, before, found):
        for i in starts:
            if words[i] in self.first:
                for r, end in sorted(self.at(words, i).items()):
                    found.append((r, before + i, before + end))


def _mandatory(template: str) -> list[str]:
    """Words outside optional and replaceable regions."""
    depth, out = 0, []
    for k, part in enumerate(MARKUP.split(template)):
        if k % 2 == 0 and not depth:
            out += part.encode().translate(TABLE).decode().split()
        depth += (part == "beginOptional") - (part == "endOptional") if k % 2 else 0
    return out


@functools.cache
def _default() -> Automaton:
    return Automaton()


_SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
RESULT = T.StructType(
    [
        *(T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")),
        *(T.StructField(c, T.StringType()) for c in ("base_labels", "labels")),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(_SPAN)),
    ]
)
_ARROW = pa.struct([*((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])))])


def _row(automaton: Automaton, text: bytes) -> dict:
    n, found = automaton.scan(text)
    base, labels, places, spans, best, reached = set(), set(), [], [], 0, {}
    for r, begin, end in found:
        rule = automaton.rules[r]
        labels.add(rule.label)
        best = max(best, rule.mandatory)
        if rule.base:
            base.add(rule.label)
            places.append(begin)
        elif begin >= reached.get(rule.label, 0):
            spans.append({"label": rule.label, "begin": begin, "end": end})
            reached[rule.label] = end
    return {
        "n_words": n, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": best / (best + HALF_WORDS) if best else 0.0, "spans": spans,
    }


def license_scan(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] | None = None, templates=None, out: str = "license") -> DataFrame:
    """``docs`` and a struct ``out``: words, places of phrases, labels, score, and the spans of templates.

    Spans are of words, end excluded; of those of one label that overlap, the first
    counts, at its longest. The score is m / (m + 4) for the most mandatory words m of
    any phrase or template found, else 0. Null and empty texts have no words and no labels;
    texts of any length are read in pieces, matches across pieces included. Repeated rows
    get the same result; a column named ``out`` is replaced.
    """
    made = None if phrases is None and templates is None else (PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)

    @arrow_udf(RESULT)
    @tidy
    def run(texts: pa.Array) -> pa.Array:
        automaton = _default() if made is None else Automaton(*made)
        return pa.array([_row(automaton, t) for t in byte_list(texts)], _ARROW)

    return docs.select(*(c for c in docs.columns if c != out), run(F.col(text_col).cast("string")).alias(out))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and templates of licenses in every whole document.

    Null, empty and word-less texts have no places and empty labels; very long ones are
    read in pieces. Every row is judged by itself, so repeated rows and ids get equal
    results; an empty table gives no rows.
    """
    got = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *(F.col("license")[c].alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))


def _pattern(template: str) -> str:
    """The template as a regular expression over words that each follow a blank."""
    out = ""
    for k, part in enumerate(MARKUP.split(template)):
        if k % 2 == 0:
            out += "".join(f" {w}" for w in part.encode().translate(TABLE).decode().split())
        else:
            out += {"beginOptional": "(?:", "endOptional": ")?"}.get(part) or f"(?: [^ ]+){{0,{part.partition('=')[2]}}}"
    return out + " "


def _sql() -> str:
    phrase = [(a.split(), b) for a, b in PHRASES.items()]
    place = lambda ws: f"CASE WHEN contains(line, ' {' '.join(ws)} ') THEN list_filter(range(1, n_words + 1), lambda i: words[i:i + {len(ws) - 1}] = [{', '.join(repr(w) for w in ws)}]) ELSE [] END"
    hits = ",\n    ".join(f"CASE WHEN near THEN regexp_matches(line, '{_pattern(t)}') ELSE false END AS t{k}" for k, (_, t) in enumerate(TEMPLATES))
    labels = ", ".join([*(f"CASE WHEN len(p{k}) > 0 THEN '{b}' END" for k, (_, b) in enumerate(phrase)), *(f"CASE WHEN t{k} THEN '{b}' END" for k, (b, _) in enumerate(TEMPLATES))])
    most = ", ".join([*(f"CASE WHEN len(p{k}) > 0 THEN {len(ws)} ELSE 0 END" for k, (ws, _) in enumerate(phrase)), *(f"CASE WHEN t{k} THEN {len(_mandatory(t))} ELSE 0 END" for k, (_, t) in enumerate(TEMPLATES))])
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{b}' END" for k, (_, b) in enumerate(phrase))
    joined = lambda xs: f"array_to_string(list_sort(list_distinct(list_filter([{xs}], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
n AS (SELECT *, len(words)::BIGINT AS n_words, ' ' || array_to_string(words, ' ') || ' ' AS line FROM w),
l AS (SELECT *, regexp_matches(line, 'licens|permission|redistribution') AS near FROM n),
h AS (SELECT *, {", ".join(f"{place(ws)} AS p{k}" for k, (ws, _) in enumerate(phrase))},
    {hits} FROM l),
m AS (SELECT *, list_concat({", ".join(f"p{k}" for k in range(len(phrase)))}) AS places, greatest({most})::DOUBLE AS best FROM h)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT - 1 AS first_word, list_max(places)::BIGINT - 1 AS last_word,
    {joined(base)} AS base_labels, {joined(labels)} AS labels, best / (best + {HALF_WORDS}) AS score
FROM m
"""


QUERIES = {"op12_license_scan": op12_license_scan}
ORACLES = {"op12_license_scan": _sql()}
