"""License wording by template markup.

A template is license text with two kinds of regions: ``<<beginOptional>>`` ... ``<<endOptional>>`` may be missing, and
``<<var;name="n";least=0;most=3;word="[0-9]+">>`` stands for so many words of any wording, each like ``word`` where that is
given. A template compiles to an automaton over words, made deterministic as texts need it. A text is accepted where the
mandatory wording stands exactly, word for word, with nothing but these regions between; the longest wording from the
leftmost place counts, and places of one template do not overlap. Base phrases are plain words; all their places count.

Documents do not move and meet no other data. A text is read in windows that overlap by the longest wording any template
can accept, so texts of any length need the same memory.

Defined cases: null and empty texts have no words, no places, empty labels and score 0; rows that repeat are scanned again;
empty tables give no rows; ids of any type, null ones too, are passed on; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of licenses and of the notices that name them, with the regions that may differ.
TEMPLATES = {
    "mit-text": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files<<beginOptional>> (the "Software")<<endOptional>>, to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all
copies or substantial portions of the Software.<<beginOptional>> THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holders";least=1;most=8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE.<<endOptional>>""",
    "isc-text": """
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software <<beginOptional>>and its
documentation <<endOptional>>for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies.""",
    "bsd-text": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<var;name="bullet";least=0;most=1>> Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. <<var;name="bullet";least=0;most=1>> Redistributions in binary
form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.""",
    "mit-notice": """
<<var;name="verb";least=1;most=1;word="released|licensed|distributed|available">> under the <<beginOptional>>terms of the
<<endOptional>>MIT License""",
    "apache-2.0": """
Licensed under the <<beginOptional>>terms of the <<endOptional>>Apache License, Version
2.0<<beginOptional>> (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
of the License at http<<beginOptional>>s<<endOptional>>://www.apache.org/licenses/LICENSE-2.0<<beginOptional>> Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.<<endOptional>><<endOptional>>""",
    "gpl-notice": """
<<beginOptional>>This <<var;name="work";least=1;most=2>> is <<endOptional>>licensed under the <<beginOptional>>terms of the
<<endOptional>>GNU <<beginOptional>>Lesser <<endOptional>>General Public License<<beginOptional>> as published by the Free
Software Foundation<<endOptional>>, <<beginOptional>>either <<endOptional>>version <<var;name="version";least=1;most=2;word="[0-9]+">>
<<beginOptional>>of the License, <<endOptional>><<beginOptional>>or (at your option) any later version<<endOptional>>""",
    "cc-notice": """
Licensed under <<beginOptional>>a <<endOptional>>CC BY<<beginOptional>>-NC<<endOptional>><<beginOptional>>-<<var;name="kind";least=1;most=1;word="nd|sa">><<endOptional>>
<<var;name="version";least=2;most=2;word="[0-9]">>""",
    "mpl-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http<<beginOptional>>s<<endOptional>>://mozilla.org/MPL/2.0/""",
}

#: Words at which the score is one half.
HALF = 4
WINDOW = 4 << 20

#: Words are runs of digits, letters and everything beyond ASCII; A-Z become a-z.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_MARK = re.compile(r"<<(.*?)>>", re.DOTALL)
SCHEMA = "n_words long, base array<struct<label:string,first:long,words:int>>, found array<struct<label:string,first:long,words:int>>"


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


def parse(markup: str) -> list:
    """Regions in order: a word, ``("optional", regions)`` or ``("var", least, most, word pattern)``."""
    stack: list[list] = [[]]
    at = 0
    for mark in [*_MARK.finditer(markup), None]:
        stack[-1] += words_of(markup[at : mark.start() if mark else len(markup)].encode())
        if mark is None:
            break
        at, body = mark.end(), mark[1].strip()
        if body == "beginOptional":
            stack.append([])
        elif body == "endOptional":
            if len(stack) == 1:
                raise ValueError("an optional region ends that never began")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif body.startswith("var;"):
            given = dict(re.findall(r'(\w+)="?([^";]*)"?', body[4:]))
            least, most = int(given.get("least", 0)), int(given["most"])
            if not 0 <= least <= most:
                raise ValueError(f"no such number of words: {body}")
            stack[-1].append(("var", least, most, given.get("word")))
        else:
            raise ValueError(f"unknown mark {body!r}")
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    return stack[0]


class Automaton:
    """Accepts the wordings of a template, word by word."""

    def __init__(self, markup: str) -> None:
        regions = parse(markup)
        self._edges: list[list[tuple[bytes | re.Pattern | None, int]]] = [[]]
        self._free: list[set[int]] = [set()]
        self._end = self._chain(regions, 0)
        self._vocabulary = {w for edges in self._edges for w, _ in edges if isinstance(w, bytes)}
        self._states: dict[frozenset[int], int] = {}
        self._sets: list[frozenset[int]] = []
        self._steps: dict[tuple[int, bytes], int] = {}
        self._start = self._state({0})
        self.longest = _most_words(regions)
        self.needle = b" ".join(max(_plain_runs(regions), key=len, default=[]))
        if self._end in self._sets[self._start] or not self.needle:
            raise ValueError("a template needs mandatory words")

    def _new(self) -> int:
        self._edges.append([])
        self._free.append(set())
        return len(self._edges) - 1

    def _chain(self, regions: list, at: int) -> int:
        for region in regions:
            if isinstance(region, bytes):
                target = self._new()
                self._edges[at].append((region, target))
            elif region[0] == "optional":
                end, target = self._chain(region[1], at), self._new()
                self._free[at].add(target)
                self._free[end].add(target)
            else:
                _, least, most, word = region
                pattern, target = word and re.compile(word.encode()), self._new()
                for i in range(most + 1):
                    if i >= least:
                        self._free[at].add(target)
                    if i < most:
                        after = self._new()
                        self._edges[at].append((pattern, after))
                        at = after
            at = target
        return at

    def _state(self, places: set[int]) -> int:
        """Number of the state for these places and all that are reached from them without a word; -1 for none."""
        todo, reached = list(places), set(places)
        while todo:
            for target in self._free[todo.pop()] - reached:
                reached.add(target)
                todo.append(target)
        if not reached:
            return -1
        key = frozenset(reached)
        if key not in self._states:
            self._states[key] = len(self._sets)
            self._sets.append(key)
        return self._states[key]

    def step(self, state: int, word: bytes) -> int:
        known = self._steps.get((state, word))
        if known is not None:
            return known
        targets = {t for place in self._sets[state] for w, t in self._edges[place] if w is None or (w == word if isinstance(w, bytes) else w.fullmatch(word))}
        out = self._state(targets)
        if word in self._vocabulary:
            self._steps[state, word] = out
        return out

    def accepts(self, words: list[bytes], at: int) -> int:
        """Length of the longest wording that begins at ``at``; 0 for none."""
        state, best, i = self._start, 0, at
        while i < len(words):
            state = self.step(state, words[i])
            if state < 0:
                break
            i += 1
            if self._end in self._sets[state]:
                best = i - at
        return best

    def may_start(self, word: bytes) -> bool:
        return self.step(self._start, word) >= 0


def _most_words(regions: list) -> int:
    return sum(1 if isinstance(r, bytes) else _most_words(r[1]) if r[0] == "optional" else r[2] for r in regions)


def _plain_runs(regions: list) -> list[list[bytes]]:
    """Runs of mandatory words that always stand together."""
    runs: list[list[bytes]] = [[]]
    for region in regions:
        if isinstance(region, bytes):
            runs[-1].append(region)
        else:
            runs.append([])
    return [r for r in runs if r]


def _windows(data: bytes, window: int, longest: int) -> Iterator[tuple[int, list[bytes], int]]:
    """(number of the first word, words, how many of them may start a wording): every start is seen once, with all the
    words it can need."""
    data = data.translate(_TABLE)
    held: list[bytes] = []
    first, at = 0, 0
    while True:
        end = min(at + window, len(data))
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            end = cut + 1 if cut >= 0 else (data.find(b" ", end) + 1 or len(data))
        words, at = held + data[at:end].split(), end
        last = at >= len(data)
        starts = len(words) if last else max(0, len(words) - longest + 1)
        yield first, words, starts
        if last:
            return
        held, first = words[starts:], first + starts


def _scan_text(data: bytes, templates: list[tuple[str, Automaton]], phrases: list[tuple[list[bytes], str]], longest: int, window: int) -> dict:
    base, found, total = [], [], 0
    free = [0] * len(templates)  # where each template may be found again
    for first, words, starts in _windows(data, window, longest):
        total = first + len(words)
        line = b" " + b" ".join(words) + b" "
        for phrase, label in phrases:
            if b" " + b" ".join(phrase) + b" " in line:
                base += [{"label": label, "first": first + i, "words": len(phrase)} for i in range(starts) if words[i] == phrase[0] and words[i : i + len(phrase)] == phrase]
        for number, (label, automaton) in enumerate(templates):
            if b" " + automaton.needle + b" " not in line:
                continue
            opening = {w for w in set(words) if automaton.may_start(w)}
            for i in [i for i in range(starts) if words[i] in opening]:
                if first + i >= free[number] and (n := automaton.accepts(words, i)):
                    found.append({"label": label, "first": first + i, "words": n})
                    free[number] = first + i + n
    return {"n_words": total, "base": base, "found": found}


def _scan(batches: Iterator[pa.RecordBatch], templates: dict[str, str], phrases: dict[str, str], window: int) -> Iterator[pa.RecordBatch]:
    compiled = [(label, Automaton(markup)) for label, markup in templates.items()]
    plain = [(words_of(phrase.encode()), label) for phrase, label in phrases.items()]
    longest = max([a.longest for _, a in compiled] + [len(p) for p, _ in plain] + [1])
    place = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int32())]))
    for batch in batches:
        ids = batch.column("id")
        for a in range(0, batch.num_rows, 512):
            texts = batch.column("text").slice(a, 512).to_pylist()
            rows = [_scan_text(t or b"", compiled, plain, longest, window) for t in texts]
            columns = [ids.slice(a, 512), *[pa.array([r[c] for r in rows], t) for c, t in (("n_words", pa.int64()), ("base", place), ("found", place))]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "base", "found"])


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Places of base phrases and of template wordings: (``key``, n_words, base, found), a row per document.

    A place has the label, the number of its first word, from 0, and how many words it covers.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    work = partial(_scan, templates=TEMPLATES if templates is None else templates, phrases=PHRASES if phrases is None else phrases, window=window)
    return rows.mapInArrow(work, f"id {kind}, {SCHEMA}").withColumnRenamed("id", key)


def labelled(docs: DataFrame, **options) -> DataFrame:
    """Labels and evidence of each document.

    ``score`` is w / (w + 4) for the longest wording found, a base phrase or what a template accepted, of w words.
    """
    placed = scan(docs, **options)
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    longest = F.coalesce(F.array_max(F.concat("base.words", "found.words")), F.lit(0)).cast("double")
    return placed.select(
        options.get("key", "doc_id"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first").alias("first_word"),
        F.array_max("base.first").alias("last_word"), join(F.col("base.label")).alias("base_labels"),
        join(F.concat("base.label", "found.label")).alias("labels"), (longest / (longest + HALF)).alias("score"),
    )
