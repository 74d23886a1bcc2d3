"""Operator 2, license scans: template-markup matching.

A template is license wording with regions in markup: ``<<beginOptional>>`` .. ``<<endOptional>>`` may be absent, and
``<<var;name="..";original="..";match="..">>`` may be replaced by what its ``match`` allows: alternatives ``a|b|c``, or ``.+`` / ``.*`` /
``.{m,n}`` for at least one, any number of, or m to n words. ``.+`` and ``.*`` have no upper bound: their state loops on any word. (At the very
start of a template they take their least number of words, as a longer run holds a shorter one.) A template is compiled into an automaton over words; a text is accepted when
some run of its words is read from the start state to the accepting one, so all mandatory wording must be
there, exactly and in order. Automata run only around places of a template's anchor, a long mandatory word near its start and before any loop.
An automaton with a loop passes over a text once, with the first start that leads to each state.

Words follow the contract: A-Z lower-cased, then runs of digits, letters and everything outside ASCII. They are found on UTF-8
bytes by table look-ups in numpy (every byte outside ASCII is a word byte), so most texts, which hold no
anchor word, are never split into Python strings. Rows are independent: no shuffle, constant broadcast (the templates).

Defined results: a null text counts as empty: no words, no labels, score 0; equal rows give equal results; an
empty table gives an empty result; only doc_id and text are read. ``score`` is 1 if a template accepts a run of the text, 0.5
if it only holds a base phrase, else 0; ``covered`` is the share of its words that lie in matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkv.llm.common import map_arrow, table

#: Base phrases and labels (fixed values of the contract).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Mandatory words from the start of a template among which its anchor is chosen.
FIRST_WORDS = 12

_OPT, _END = "<<beginOptional>>", "<<endOptional>>"


def _var(name: str, original: str, match: str) -> str:
    return f'<<var;name="{name}";original="{original}";match="{match}">>'


_AS_IS = f"""THE SOFTWARE IS PROVIDED {_var("asIs", '"AS IS"', "as is|as-is")}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND {_OPT}NON{_END}{_var("ni", "INFRINGEMENT", "noninfringement|infringement|non-infringement")}."""
_HOLDERS = _var("holders", "THE COPYRIGHT HOLDERS AND CONTRIBUTORS", ".+")
_BSD_HEAD = f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
{_OPT}1. {_END}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{_OPT}2. {_END}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""
_BSD_TAIL = f"""THIS SOFTWARE IS PROVIDED BY {_HOLDERS} {_var("asIs", '"AS IS"', "as is|as-is")} AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {_HOLDERS} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""


def _gnu(version: int) -> str:
    return f"""{_var("program", "This program", "this program|this file|.{1,4}")} is free software{_OPT}:{_END} you can redistribute it and/or modify it under the terms of the GNU
{_OPT}{_var("kind", "", "lesser|library|affero")} {_END}General Public License as published by the Free Software Foundation{_OPT}, {_END}{_OPT}either {_END}version {version} of the License{_OPT}, or (at your option) any
later version{_END}. {_var("program", "This program", "this program|this file|.{1,4}")} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


#: Label and template. The wording is that of the licenses' published texts and notices (fixed values): first short references, then whole texts.
TEMPLATES = [
    ("mit-reference", f'{_var("verb", "Released", "released|licensed|distributed|available|provided")} under the {_OPT}terms of the {_END}{_OPT}permissive {_END}MIT License'),
    ("apache-2.0", f'{_var("verb", "Licensed", "released|licensed|distributed|available")} under the {_OPT}terms of the {_END}Apache License{_OPT}, Version{_END} 2.0'),
    ("gpl-2.0", f"under the {_OPT}terms of the {_END}GNU General Public License{_OPT} as published by the Free Software Foundation{_END}{_OPT};{_END} {_OPT}either {_END}version 2"),
    ("gpl-3.0", f"under the {_OPT}terms of the {_END}GNU General Public License{_OPT} as published by the Free Software Foundation{_END}{_OPT};{_END} {_OPT}either {_END}version 3"),
    ("cc-by", f'{_var("verb", "licensed", "released|licensed|distributed|available")} under {_OPT}a {_END}{_OPT}the {_END}{_OPT}Creative Commons {_END}{_var("kind", "CC BY", "cc by|attribution|cc by sa|cc by nc|cc by nd|cc by nc sa|cc by nc nd")} {_var("version", "4.0", "1.0|2.0|2.5|3.0|4.0")}'),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mit-grant", f'Permission is hereby granted, free of charge, to any person obtaining a copy of {_var("what", "this software and associated documentation files", ".+")} (the "{_var("defined", "Software", ".{1,3}")}"), to deal in the {_var("defined", "Software", ".{1,3}")} without restriction'),
    ("isc-grant", f"Permission to use, copy, modify, {_OPT}and/or {_END}{_OPT}and {_END}distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-text", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of {_var("what", "this software and associated documentation files", ".+")} (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice {_OPT}(including the next paragraph) {_END}shall be included in all copies or substantial portions of the
Software. {_AS_IS} IN NO EVENT SHALL {_var("holders", "THE AUTHORS OR COPYRIGHT HOLDERS", ".+")} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd-2-text", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("bsd-3-text", f"""{_BSD_HEAD} {_OPT}3. {_END}Neither the name of {_var("organization", "the copyright holder", ".+")} nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission. {_BSD_TAIL}"""),
    ("isc-text", f"""Permission to use, copy, modify, {_OPT}and/or {_END}{_OPT}and {_END}distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED {_var("asIs", '"AS IS"', "as is|as-is")} AND {_var("author", "THE AUTHOR", ".+")} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL {_var("author", "THE AUTHOR", ".+")} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("apache-2.0-notice", f"""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
{_OPT}{_var("link", "http", "http|https")}://{_END}www.apache.org/licenses/LICENSE-2.0{_OPT}.{_var("suffix", "txt", "txt|html")}{_END} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-2.0-notice", _gnu(2)),
    ("gpl-3.0-notice", _gnu(3)),
]

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r'<<(beginOptional|endOptional|var)(?:;[^>]*?match="([^"]*)")?[^>]*>>')
_ANY = b""


def words_of(text: str) -> list[bytes]:
    """The words of ``text``, as UTF-8."""
    return _WORD.findall(_lower(text.encode()))


def _lower(data: bytes) -> bytes:
    return data.lower()  # bytes: A-Z only


class Automaton:
    """States 0 .. n; ``step[s]`` maps a word to next states (``_ANY``: any word), ``free[s]`` lists states reached without one."""

    def __init__(self, template: str) -> None:
        self.step: list[dict[bytes, list[int]]] = [{}]
        self.free: list[list[int]] = [[]]
        self.loops = False
        self.accept, at, opened, anchor, early, pos = 0, 0, [], None, 0, 0
        for m in [*_MARK.finditer(template), None]:
            for w in words_of(template[pos : m.start() if m else None]):
                early += not opened
                if not opened and early <= FIRST_WORDS and not self.loops and (anchor is None or len(w) > len(anchor)):
                    anchor = w
                at = self._chain(at, [w])
            if not m:
                break
            pos = m.end()
            if m[1] == "beginOptional":
                opened.append(at)
            elif m[1] == "endOptional":
                at = self._chain(at, None)
                self.free[opened.pop()].append(at)
            else:
                at = self._region(at, m[2] or ".+", not early and not opened)
        if opened or anchor is None:
            raise ValueError("a template needs closed regions and a mandatory word before any loop")
        self.accept, self.anchor = at, anchor
        self.lead = self._lead()

    def _new(self) -> int:
        self.step.append({})
        self.free.append([])
        return len(self.step) - 1

    def _chain(self, at: int, words: list[bytes] | None) -> int:
        """A path of ``words`` from ``at``, or a free step for None; its end."""
        for w in [None] if words is None else words:
            end = self._new()
            (self.free[at] if w is None else self.step[at].setdefault(w, [])).append(end)
            at = end
        return at

    def _region(self, at: int, match: str, first: bool) -> int:
        """``first``: nothing mandatory stands before."""
        m = re.fullmatch(r"\.(?:(\+)|(\*)|\{(\d+),(\d+)\})", match)
        end = self._new()
        if not m:
            for option in match.split("|"):
                span = re.fullmatch(r"\.\{(\d+),(\d+)\}", option)
                if span:
                    self._words(at, int(span[1]), int(span[2]), end)
                else:
                    self.free[self._chain(at, words_of(option))].append(end)
            return end
        least = 1 if m[1] else 0 if m[2] else int(m[3])
        if m[3]:
            self._words(at, least, int(m[4]), end)
            return end
        at = self._chain(self._chain(at, None), [_ANY] * least)
        if not first:
            self.loops = True
            self.step[at].setdefault(_ANY, []).append(at)
        self.free[at].append(end)
        return end

    def _words(self, at: int, least: int, most: int, end: int) -> None:
        """From ``least`` to ``most`` words between ``at`` and ``end``."""
        for k in range(most + 1):
            if k >= least:
                self.free[at].append(end)
            if k < most:
                at = self._chain(at, [_ANY])

    def _lead(self) -> int:
        """Most words that can precede the anchor's first place; no loop stands before it."""
        far, todo = {0: 0}, [0]
        while todo:
            s = todo.pop()
            for w, nxt in [*self.step[s].items(), (None, self.free[s])]:
                if w == self.anchor:
                    continue
                for t in nxt:
                    n = far[s] + (w is not None)
                    if n > far.get(t, -1):
                        far[t] = n
                        todo.append(t)
        return max(n for s, n in far.items() if self.anchor in self.step[s])

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run from ``start``, or -1."""
        states, end = self._closed({0}), -1
        for i in range(start, len(words) + 1):
            if self.accept in states:
                end = i
            if i == len(words) or not states:
                break
            states = self._closed({t for s in states for k in (words[i], _ANY) for t in self.step[s].get(k, ())})
        return end

    def passed(self, words: list[bytes], starts: list[int]) -> list[tuple[int, int]]:
        """The accepted runs from ``starts`` in one pass: for each first start, its longest; a run inside another of the same end is left out."""
        todo, at, found = iter(starts), {}, {}
        start = next(todo, None)
        for i in range(starts[0] if starts else 0, len(words) + 1):
            if start == i:
                at[0] = min(at.get(0, i), i)
                start = next(todo, None)
            stack = list(at)
            while stack:
                s = stack.pop()
                for t in self.free[s]:
                    if at[s] < at.get(t, len(words) + 1):
                        at[t] = at[s]
                        stack.append(t)
            if self.accept in at:
                found[at[self.accept]] = i
            if i == len(words):
                break
            after: dict[int, int] = {}
            for s, first in at.items():
                step = self.step[s]
                for k in (words[i], _ANY):
                    for t in step.get(k, ()):
                        after[t] = min(first, after.get(t, first))
            at = after
        return sorted(found.items())

    def runs(self, words: list[bytes], places: list[int]) -> list[tuple[int, int]]:
        """Accepted runs whose anchor stands at one of ``places``."""
        starts = sorted({s for p in places for s in range(max(0, p - self.lead), p + 1)})
        if self.loops:
            return [(s, e) for s, e in self.passed(words, starts) if e > s]
        return [(s, e) for s in starts if (e := self.longest(words, s)) > s]


_IS_WORD = np.zeros(256, np.int8)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, covered double, spans array<struct<label:string,first:long,last:long>>"


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """``SCHEMA``: the phrase places and template runs of every text; ``spans`` holds each match with its first and last word."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES

    def scan(data: bytes, base: list, automata: list, anchors: list[bytes]) -> tuple:
        data = _lower(data)
        flags = np.diff(_IS_WORD[np.frombuffer(data, np.uint8)], prepend=np.int8(0))
        n = int((flags == 1).sum())
        if not any(a in data for a in anchors):
            return n, 0, None, None, "", "", 0.0, 0.0, []
        words = _WORD.findall(data)
        at: dict[bytes, list[int]] = {}
        wanted = {p[0] for p, _ in base} | {a.anchor for _, a in automata}
        for i, w in enumerate(words):
            if w in wanted:
                at.setdefault(w, []).append(i)
        places = [(label, i, i + len(p) - 1) for p, label in base for i in at.get(p[0], ()) if words[i : i + len(p)] == p]
        runs = [(label, s, e - 1) for label, a in automata for s, e in a.runs(words, at.get(a.anchor, []))]
        covered = np.zeros(len(words) + 1, np.int64)
        for _, s, e in [*places, *runs]:
            covered[s] += 1
            covered[e + 1] -= 1
        share = float((np.cumsum(covered[:-1]) > 0).sum()) / max(1, len(words))
        starts = [i for _, i, _ in places]
        base_labels = {x[0] for x in places}
        return (
            n, len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {x[0] for x in runs})), 1.0 if runs else 0.5 if places else 0.0, share,
            [{"label": a, "first": s, "last": e} for a, s, e in sorted([*places, *runs], key=lambda x: (x[1], x[2], x[0]))],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [(label, Automaton(t)) for label, t in templates]
        base = [(words_of(p), label) for p, label in phrases.items()]
        anchors = sorted({max(p, key=len) for p, _ in base} | {a.anchor for _, a in automata})
        # An anchor word that holds another needs no search of its own.
        anchors = [a for a in anchors if not any(b != a and b in a for b in anchors)]
        spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), spans]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            if batch.num_rows:
                found = zip(*[scan(x.as_py(), base, automata, anchors) for x in batch.column(1)], strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(found, types, strict=True)]], names)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data")), run, SCHEMA)


def op2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' license phrases and templates."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("covered", "spans")


def _expression(template: str) -> str:
    """The template as a regular expression over words that are each followed by a space."""
    out, pos = "", 0
    for m in [*_MARK.finditer(template), None]:
        out += "".join(w.decode() + " " for w in words_of(template[pos : m.start() if m else None]))
        if m:
            pos = m.end()
            kind, match = m[1], m[2] or ".+"
            any_word = {".+": "(?:[^ ]+ )+", ".*": "(?:[^ ]+ )*"}
            option = lambda o: any_word.get(o) or (f"(?:[^ ]+ ){o[1:]}" if o.startswith(".{") else "".join(w.decode() + " " for w in words_of(o)))
            out += "(?:" if kind == "beginOptional" else ")?" if kind == "endOptional" else f"(?:{'|'.join(map(option, match.split('|')))})"
    return out


def _oracle() -> str:
    any_of = lambda pairs: "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{label}' END" for label, test in pairs) + "], lambda x: x IS NOT NULL)"
    base = [(label, f"contains(s, ' {p} ')") for p, label in PHRASES.items()]
    method = [(label, f"regexp_matches(s, ' {_expression(t)}')") for label, t in TEMPLATES]
    at = " OR ".join("(" + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p in PHRASES)
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), s AS (
  SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS s, CASE WHEN list_contains(w, 'license') THEN list_filter(range(1, len(w) + 1), lambda i: {at}) ELSE [] END AS places FROM w
), l AS (
  SELECT *, {any_of(base)} AS base, CASE WHEN contains(s, ' license ') OR contains(s, ' redistribution ') OR contains(s, ' permission ') OR contains(s, ' cc ') OR contains(s, ' attribution ') THEN {any_of(method)} ELSE [] END AS method FROM s
)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, method))), ',') AS labels, CASE WHEN len(method) > 0 THEN 1.0::DOUBLE WHEN len(places) > 0 THEN 0.5 ELSE 0 END AS score FROM l
"""


QUERIES = {"op2_templates": op2_templates}
ORACLES = {"op2_templates": _oracle()}
