"""License wording in texts (method: template markup compiled to token automata)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import utf8

# The phrases of the contract, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Markup of the public license matching guidelines: optional and replaceable regions; a replaceable one takes ``words``.
TEMPLATES = {
    "mit-notice": "<<beginOptional>>this <<var;words=1-3>> is<<endOptional>> <<beginAlternative>>released<<or>>licensed"
                  "<<or>>distributed<<endAlternative>> under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
           "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
           "notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included "
           "in all copies or substantial portions of the Software.",
    "apache-2.0": "<<beginAlternative>>Licensed<<or>>Released<<or>>Distributed<<endAlternative>> under the "
                  "<<beginOptional>>terms of the<<endOptional>> Apache License, Version 2.0",
    "gpl-3.0": "<<beginOptional>>licensed under the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public License "
               "<<beginOptional>><<var;words=0-8>><<endOptional>> version 3",
    "gpl-2.0": "<<beginOptional>>licensed under the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public License "
               "<<beginOptional>><<var;words=0-8>><<endOptional>> version 2",
    "lgpl-3.0": "<<beginOptional>>licensed under the<<endOptional>> <<beginOptional>>GNU<<endOptional>> Lesser General Public License "
                "<<beginOptional>><<var;words=0-8>><<endOptional>> version 3",
    "lgpl-2.1": "<<beginOptional>>licensed under the<<endOptional>> <<beginOptional>>GNU<<endOptional>> Lesser General Public License "
                "<<beginOptional>><<var;words=0-8>><<endOptional>> version 2.1",
    "agpl-3.0": "<<beginOptional>>licensed under the<<endOptional>> <<beginOptional>>GNU<<endOptional>> Affero General Public License "
                "<<beginOptional>><<var;words=0-8>><<endOptional>> version 3",
    "cc-by-nc-4.0": "<<beginOptional>>licensed under<<endOptional>> CC BY-NC 4.0",
    "cc-by-4.0": "<<beginOptional>>licensed under<<endOptional>> CC BY 4.0",
    "cc-by-sa-4.0": "<<beginOptional>>licensed under<<endOptional>> CC BY-SA 4.0",
    "cc-by-nd-4.0": "<<beginOptional>>licensed under<<endOptional>> CC BY-ND 4.0",
    "cc-by-nc-sa-4.0": "<<beginOptional>>licensed under<<endOptional>> CC BY-NC-SA 4.0",
    "cc-by-nc-nd-4.0": "<<beginOptional>>licensed under<<endOptional>> CC BY-NC-ND 4.0",
    "mit-disclaimer": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the "
                      "warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the "
                      "authors or copyright holders be liable for any claim, damages or other liability, whether in an action of "
                      "contract, tort or otherwise, arising from, out of or in connection with the software or the use or other "
                      "dealings in the software.",
    "apache-2.0-terms": "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                        "<<beginOptional>><<beginAlternative>>http<<or>>https<<endAlternative>><<endOptional>> <<beginOptional>>www.<<endOptional>>apache.org/licenses/LICENSE-2.0"
                        "<<beginOptional>>.html<<endOptional>> Unless required by applicable law or agreed to in writing, software distributed under the "
                        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                    "conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, "
                    "this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must "
                    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
                    "other materials provided with the distribution.",
    "bsd-3-clause": "Neither the name of <<beginOptional>>the<<endOptional>> <<var;words=1-8>> nor the names of its contributors may be used to "
                    "endorse or promote products derived from this software without specific prior written permission.",
    "bsd-3-clause-notice": "<<beginOptional>>use of this source code is<<endOptional>> governed by a BSD-style license",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "copyright": "Copyright <<beginOptional>>(c)<<endOptional>> <<var;words=1-12>> all rights reserved",
}

#: A match right behind one of these words is part of another licence's name, or denied; one right before one of those is a narrower licence.
BEFORE = {"gpl-3.0": "lesser affero library", "gpl-2.0": "lesser affero library", "mit-notice": "not never", "apache-2.0": "not never"}
AFTER = {"cc-by-4.0": "nd nc sa", "cc-by-nc-4.0": "nd sa", "cc-by-sa-4.0": "nc nd"}

_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
                    for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lowered) and characters beyond ASCII."""
    return utf8(text or "").translate(_WORD_BYTES).split()


class Automaton(NamedTuple):
    """States are bits: ``step[word]`` and ``step_any`` list (from, to) bits, ``free[s]`` what s reaches without a word."""

    step: dict[bytes, list[tuple[int, int]]]
    step_any: list[tuple[int, int]]
    free: list[int]
    final: int
    first: frozenset[bytes]
    anchor: bytes


def compile_template(markup: str) -> Automaton:
    """Token automaton of a template. A template has to start with wording of its own, optional or not."""
    step: dict[bytes, list[tuple[int, int]]] = {}
    anys: list[tuple[int, int]] = []
    links: list[list[int]] = [[]]

    def state() -> int:
        links.append([])
        return len(links) - 1

    now, opened, mandatory = 0, [], []
    for mark, plain in re.findall(r"<<(.*?)>>|([^<]+)", markup):
        if mark == "beginOptional":
            opened.append((now, []))
        elif mark == "beginAlternative":
            opened.append((now, [None]))
        elif mark == "or":
            opened[-1][1].append(now)
            now = state()
            links[opened[-1][0]].append(now)
        elif mark == "endOptional":
            links[opened.pop()[0]].append(now)
        elif mark == "endAlternative":
            end = state()
            for s in [*opened.pop()[1][1:], now]:
                links[s].append(end)
            now = end
        elif mark.startswith("var"):
            low, high = map(int, re.search(r"words=(\d+)-(\d+)", mark).groups())
            begin = [now]
            for _ in range(high):
                anys.append((now, state()))
                now = anys[-1][1]
                begin.append(now)
            for s in begin[low:-1]:
                links[s].append(now)
        else:
            for word in tokens(plain):
                step.setdefault(word, []).append((now, state()))
                now = step[word][-1][1]
                if not opened:
                    mandatory.append(word)
    free = []
    for s in range(len(links)):
        reach, queue = {s}, [s]
        for r in queue:
            queue += [t for t in links[r] if t not in reach]
            reach.update(links[r])
        free.append(sum(1 << t for t in reach))
    first = frozenset(w for w, edges in step.items() if any(free[0] >> a & 1 for a, _ in edges))
    if any(free[0] >> a & 1 for a, _ in anys) or free[0] >> now & 1 or not mandatory:
        raise ValueError("a template starts with a word of its own and has mandatory wording")
    return Automaton(step, anys, free, now, first, max(mandatory, key=lambda w: (len(w), w)))


def longest_match(a: Automaton, words: list[bytes], at: int) -> int:
    """End of the longest accepted run of words that starts at ``at``; ``at`` if there is none."""
    live, end, i = a.free[0], at, at
    while live and i < len(words):
        after = 0
        for edges in (a.step.get(words[i], ()), a.step_any):
            for s, t in edges:
                if live >> s & 1:
                    after |= a.free[t]
        live, i = after, i + 1
        if live >> a.final & 1:
            end = i
    return end


@lru_cache(maxsize=8)
def _compiled(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]):
    return ([(label, compile_template(markup)) for label, markup in templates],
            [(label, tokens(phrase)) for phrase, label in phrases])


def guarded(label: str, words: list[bytes], start: int, end: int) -> bool:
    """Whether the words around a match make it something else."""
    before, after = (words[start - 1] if start else b""), (words[end] if end < len(words) else b"")
    return before in tokens(BEFORE.get(label)) or after in tokens(AFTER.get(label))


def scan_text(text: str | None, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]):
    """``(n_words, [(label, start, end)] of phrases, [(label, start, end)] of templates)`` in words from 0."""
    automata, bases = _compiled(templates, phrases)
    spaced = utf8(text or "").translate(_WORD_BYTES)
    words = spaced.split()
    places: dict[bytes, list[int]] = {}
    wanted = {b[1][-1] for b in bases if b[1][-1] in spaced}
    live = [(label, a) for label, a in automata if a.anchor in spaced]
    heads = wanted | {w for _, a in live for w in (*a.first, a.anchor)}
    if heads:
        for i, w in enumerate(words):
            if w in heads:
                places.setdefault(w, []).append(i)
    base = [(label, i - len(phrase) + 1, i + 1) for label, phrase in bases for i in places.get(phrase[-1], ())
            if i >= len(phrase) - 1 and words[i - len(phrase) + 1: i + 1] == phrase]
    found = []
    for label, a in live:
        if a.anchor in places:
            taken = 0
            for i in sorted(i for w in a.first for i in places.get(w, ())):
                if i >= taken and (end := longest_match(a, words, i)) > i:
                    taken = end
                    if not guarded(label, words, i, end):
                        found.append((label, i, end))
    return len(words), base, found


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                  phrases: dict[str, str] | None = None) -> DataFrame:
    """Licence wording of every row: ``(id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches)``.

    ``n_base`` counts every place of a phrase, overlapping ones too; ``matches`` lists the template matches as
    ``(label, start, end)`` in words; each template takes the leftmost longest match and goes on behind it, and
    a match whose neighbouring word makes it another licence's (``BEFORE``, ``AFTER``) is none. ``score`` is the share
    of the text's words inside a phrase or match, 0 for a text without words. A null or empty text has no words, empty
    labels and null positions. Repeated rows and null ids give a row each, an empty table none; other columns are not carried. No shuffle.
    """
    marks = tuple((TEMPLATES if templates is None else templates).items())
    bases = tuple((BASE if phrases is None else phrases).items())
    shape = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
             "score double, matches array<struct<label: string, start: bigint, end: bigint>>")

    @F.pandas_udf(shape)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch.tolist():
                n, base, found = scan_text(text, marks, bases)
                covered = {i for _, a, b in (*base, *found) for i in range(a, b)}
                starts = [a for _, a, _ in base]
                rows.append((n, len(base), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted({x[0] for x in base})), ",".join(sorted({x[0] for x in (*base, *found)})),
                             len(covered) / n if n else 0.0, [{"label": x, "start": a, "end": b} for x, a, b in found]))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    return docs.select(F.col(id_col), scanned(F.col(text_col)).alias("_s")).select(id_col, "_s.*")
