"""License scans by template-markup matching.

A template is license wording with markup: `<<optional>> ... <</optional>>` may be left out, `<<any:MIN-MAX>>` stands
for that many words of anything, `<<any:MIN-MAX:name>>` gives them a name. All other words are mandatory and must
match exactly, word for word, after case folding and without punctuation. Each template is compiled once into an
automaton over words: a state for each place in the template, an edge for each mandatory word, a jump over each
optional region and a bounded loop for each replaceable one. A text is accepted where the automaton reaches its end.
An automaton starts only where its anchor, a long run of mandatory words, stands; one search of the text finds these
places for each automaton. Templates are short notices and whole license bodies, which are accepted only to their end.
Long texts are read in blocks of words that overlap by the longest template.

Beside templates, plain phrases are found at every place where their words stand side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import ALNUM_LOWER_SPACES, slices

#: Phrase: label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The wording of notices and licenses.
_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and"
    " <<any:1-2>> in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from"
    " out of or in connection with the software or the use or other dealings in the software"
)
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished"
    " to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies"
    " or substantial portions of the software " + _AS_IS.replace("<<any:1-2>>", "noninfringement")
)
_BSD_OPENING = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<any:0-1>> redistributions of source code"
    " must retain the above copyright notice this list of conditions and the following disclaimer <<any:0-1>> redistributions in binary form must reproduce the above copyright notice this"
    " list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_NAMES = (
    " <<any:0-1>> neither the name of <<any:1-12:holder>> may be used to endorse or promote products derived from this software without specific prior written permission"
)
_BSD_END = (
    " this software is provided by <<any:1-12:holder>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a"
    " particular purpose are disclaimed in no event shall <<any:1-12:holder>> be liable for any direct indirect incidental special exemplary or consequential damages including but not"
    " limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict"
    " liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ISC_GRANT = "permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    " the software is provided as is and <<any:1-6:holder>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event"
    " shall <<any:1-6:holder>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of"
    " contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is"
    " granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<any:0-1>> the"
    " origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product"
    " documentation would be appreciated but is not required <<any:0-1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software"
    " <<any:0-1>> this notice may not be removed or altered from any source distribution"
)
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as"
    " a compiled binary for any purpose commercial or non commercial and by any means"
)
_APACHE_NOTICE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org"
    " licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of"
    " any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
)
_GNU_NOTICE = "you can redistribute it and or modify it under the terms of the gnu {kind} public license as published by the free software foundation {version}"
_LATER = "either version {n} of the license or at your option any later version"
_MPL = (
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<optional>>http<</optional>>"
    " <<optional>>https<</optional>> mozilla org mpl 2 0"
)


def _gnu() -> dict[str, str]:
    """Notices of the GNU licenses: each kind and version, with and without later versions."""
    out = {}
    for label, kind, versions in (("gpl", "general", "2 3"), ("lgpl", "lesser general", "2.1 3"), ("agpl", "affero general", "3")):
        for n in versions.split():
            out[f"{label}-{n}-or-later"] = _GNU_NOTICE.format(kind=kind, version=_LATER.format(n=n))
            out[f"{label}-{n}-only"] = _GNU_NOTICE.format(kind=kind, version=f"version {n} <<optional>>of the license<</optional>> only")
    return out


#: Label: template.
TEMPLATES = {
    "0bsd": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted" + _ISC_END,
    "apache-2.0": "licensed under the apache license <<optional>>version<</optional>> 2.0 <<optional>>the license<</optional>>",
    "apache-2.0-notice": _APACHE_NOTICE,
    "bsd-2-clause": _BSD_OPENING + _BSD_END,
    "bsd-3-clause": _BSD_OPENING + _BSD_NAMES + _BSD_END,
    "cc-by-nc": "<<optional>>this work is<</optional>> licensed under <<optional>>a<</optional>> <<optional>>creative commons<</optional>> cc by nc <<any:0-3:version>> <<optional>>license<</optional>>",
    "cc-by-sa": "licensed under <<optional>>a<</optional>> <<optional>>creative commons<</optional>> cc by sa <<any:0-3:version>> <<optional>>license<</optional>>",
    "copyright": "copyright <<optional>>c<</optional>> <<any:1-8:holder>> all rights reserved",
    "gpl-3.0": "<<optional>>this work is<</optional>> licensed under the <<optional>>gnu<</optional>> general public license <<optional>>version<</optional>> 3",
    "isc": _ISC_GRANT + " provided that the above copyright notice and this permission notice appear in all copies" + _ISC_END,
    "mit": "<<optional>>this <<any:1-2>> is<</optional>> released under the mit license",
    "mit-text": _MIT,
    "mpl-2.0": _MPL,
    "unlicense": _UNLICENSE,
    "zlib": _ZLIB,
} | _gnu()

#: Bytes of text whose words are held at once.
BLOCK_BYTES = 4 << 20
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_MARK = re.compile(r"<<(optional|/optional|any:(\d+)-(\d+)(?::\w+)?)>>")


def fold(text: bytes) -> list[bytes]:
    """A-Z in lower case, then the maximal runs of ASCII digits, letters and non-ASCII bytes."""
    return text.translate(ALNUM_LOWER_SPACES).split()


@dataclass
class Automaton:
    """States 0 .. n; words[s]: next state by word; skips[s]: states reached without a word; wild[s]: any word leads to s + 1."""

    label: str
    words: list[dict[bytes, int]]
    skips: list[list[int]]
    wild: list[bool]
    anchor: list[bytes]
    anchor_state: int
    mandatory: int

    @classmethod
    def compile(cls, label: str, template: str) -> Automaton:
        words: list[dict[bytes, int]] = [{}]
        skips: list[list[int]] = [[]]
        wild: list[bool] = [False]
        runs: list[tuple[int, list[bytes]]] = []
        depth, mandatory, opened = 0, 0, []

        def state() -> int:
            words.append({})
            skips.append([])
            wild.append(False)
            return len(words) - 1

        at = 0
        parts = _MARK.split(template)
        for k in range(0, len(parts), 4):
            fresh = fold(parts[k].encode())
            if fresh and not depth:
                runs.append((len(words) - 1, fresh))
                mandatory += len(fresh)
            for word in fresh:
                here = len(words) - 1
                words[here][word] = state()
            if k + 1 == len(parts):
                break
            mark, least, most = parts[k + 1 : k + 4]
            if mark == "optional":
                opened.append(len(words) - 1)
                depth += 1
            elif mark == "/optional":
                if not opened:
                    raise ValueError(f"{label}: an optional region ends that did not begin")
                depth -= 1
                skips[opened.pop()].append(len(words) - 1)
            else:
                for n in range(int(most)):
                    here = len(words) - 1
                    wild[here] = True
                    state()
                    if n >= int(least):
                        skips[here].append(-1 - (int(most) - n))  # to the end of the loop, made absolute below
        if depth or not runs:
            raise ValueError(f"{label}: an optional region does not end, or no word is mandatory")
        for here, jumps in enumerate(skips):
            skips[here] = [here - 1 - j if j < 0 else j for j in jumps]
        at, anchor = max(runs, key=lambda r: (min(len(r[1]), 4), -r[0]))
        return cls(label, words, skips, wild, anchor[:8], at, mandatory)

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, text: list[bytes], at: int, state: int | None = None) -> int | None:
        """End of the longest accepted stretch of words that starts at `at` in a state (the first), or None."""
        states, end, last = self._closed({0 if state is None else state}), None, len(self.words) - 1
        for k in range(at, len(text) + 1):
            if last in states:
                end = k
            if k == len(text) or not states:
                break
            word, after = text[k], set()
            for s in states:
                if word in self.words[s]:
                    after.add(self.words[s][word])
                if self.wild[s]:
                    after.add(s + 1)
            states = self._closed(after)
        return end

    def find(self, text: list[bytes], anchor_at: int) -> tuple[int, int] | None:
        """The accepted stretch of most words whose anchor stands at anchor_at."""
        if self.match(text, anchor_at, self.anchor_state) is None:
            return None
        for start in range(max(0, anchor_at - self.anchor_state), anchor_at + 1):
            end = self.match(text, start)
            if end is not None and end > anchor_at:
                return start, end
        return None


def places(joined: bytes, phrase: list[bytes]) -> list[int]:
    """Indexes of all words at which a phrase stands. joined: the words with a space before, between and after them."""
    needle, out, at, words = b" " + b" ".join(phrase) + b" ", [], 0, 0
    last = 0
    while (at := joined.find(needle, at)) >= 0:
        words += joined.count(b" ", last, at)
        last = at
        out.append(words)
        at += 1
    return out


class Scanner:
    """Scans texts block by block; a block's words come with `reach` words before and after it."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str], block: int = BLOCK_BYTES):
        self.phrases = [(fold(p.encode()), label) for p, label in phrases.items()]
        self.automata = [Automaton.compile(label, t) for label, t in templates.items()]
        self.mandatory = {a.label: a.mandatory for a in self.automata}
        self.reach = max([len(a.words) for a in self.automata] + [len(p) for p, _ in self.phrases], default=1)
        self.block = block

    def blocks(self, text: bytes) -> Iterator[tuple[list[bytes], int, int]]:
        """(words, first and end of those that are the block's own)."""
        at, lead = 0, []
        while True:
            end = min(at + self.block, len(text))
            while end < len(text) and end > at and ALNUM_LOWER_SPACES[text[end]] != 0x20:
                cut = _GAP.search(text, end)
                end = cut.start() if cut else len(text)
            own = fold(text[at:end])
            tail: list[bytes] = []
            room = 16 * self.reach
            while end < len(text) and len(tail) < self.reach:
                stop = min(end + room, len(text))
                tail = fold(text[end:stop])
                if stop == len(text):
                    break
                tail, room = tail[:-1], 2 * room  # the last word may go on
            yield lead + own + tail[: self.reach], len(lead), len(lead) + len(own)
            if end == len(text):
                return
            lead, at = (lead + own)[-self.reach :], end

    def __call__(self, text: bytes) -> tuple[int, list[int], set[str], list[tuple[str, int, int]], float]:
        found, labels, spans, base = [], set(), set(), 0
        for words, lo, hi in self.blocks(text):
            joined = b" " + b" ".join(words) + b" "
            for phrase, label in self.phrases:
                at = [base + k - lo for k in places(joined, phrase) if lo <= k < hi]
                found += at
                labels |= {label} if at else set()
            for a in self.automata:
                for at in places(joined, a.anchor):
                    if (span := a.find(words, at)) is not None and lo <= span[0] < hi:
                        spans.add((a.label, base + span[0] - lo, base + span[1] - lo))
            base += hi - lo
        surest = max((self.mandatory[label] for label, _, _ in spans), default=0)
        score = 1 - 0.5 ** (1 + surest / 4) if surest else 0.5 if found else 0.0
        return base, sorted(found), labels, sorted(spans, key=lambda s: (s[1], s[2], s[0])), score


def _scan(batches: Iterator[pa.RecordBatch], phrases: dict[str, str], templates: dict[str, str]) -> Iterator[pa.RecordBatch]:
    scan = Scanner(phrases, templates)
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in slices(batches):
        rows = [scan(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")]
        base = [",".join(sorted(r[2])) for r in rows]
        every = [",".join(sorted(r[2] | {s[0] for s in r[3]})) for r in rows]
        score = [r[4] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([min(r[1], default=None) for r in rows], pa.int64()),
                pa.array([max(r[1], default=None) for r in rows], pa.int64()),
                pa.array(base, pa.string()),
                pa.array(every, pa.string()),
                pa.array(score, pa.float64()),
                pa.array([[{"label": x, "start": s, "end": e} for x, s, e in r[3]] for r in rows], pa.list_(span)),
            ],
            names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first word, end).

    Base columns are about the phrases; labels and spans add the templates whose mandatory wording matches exactly.
    The score is 0.5 with phrases only and nears 1 with the mandatory words of the longest template found, else 0. Null and empty texts have no words: counts are 0,
    places null, labels empty. Every row gives one row, so repeated rows and null ids stay. Other columns don't
    matter; an empty table gives an empty result.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = docs.mapInArrow(lambda b: _scan(b, phrases, templates), f"id {dict(docs.dtypes)['id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)
