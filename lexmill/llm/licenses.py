"""License scan by template markup.

A template is ordinary licence wording with two kinds of markup::

    <<opt>> ... <<end>>        the region may be left out as a whole
    <<var:N>>                  at most N words of any kind stand here

Each template becomes a token automaton.  Every word of the mandatory wording must
match exactly and in order; only marked regions may differ.  The automaton runs from
each place where its first word stands, so a licence is found inside any text.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .arrow_map import Mapper, map_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes that no word contains become a space; bytes of a word stay.
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

#: Phrases of the base scan and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_WARRANTY = (
    'the software is provided "as is" without warranty of any kind express or implied including but not limited to '
    "the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the "
    "authors or copyright holders be liable for any claim damages or other liability whether in an action of contract "
    "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met <<var:1>> redistributions of source code must retain the above copyright notice this "
    "list of conditions and the following disclaimer <<var:1>> redistributions in binary form must reproduce the above "
    "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
    "provided with the distribution"
)
_CC = "creative commons attribution"
_CC_TAIL = "<<var:1>> <<var:1>> <<opt>>international<<end>> <<opt>>unported<<end>> license"

#: label, template.  The first item of a template is always a mandatory word.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "under <<opt>>the<<end>> <<opt>>terms of the<<end>> mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the rights "
     "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
     "whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
     "permission notice <<opt>>including the next paragraph<<end>> shall be included in all copies or substantial portions "
     "of the software " + _WARRANTY),
    ("isc", "permission to use copy modify and <<opt>>or<<end>> distribute this software for any purpose with or without fee is "
     "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-3-clause", _BSD_HEAD + " <<var:1>> neither the name of <<var:12>> nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-2-clause", _BSD_HEAD + " this software is provided by"),
    ("bsd", "under <<opt>>the<<end>> <<opt>>terms of the<<end>> <<var:2>> bsd license"),
    ("apache-2.0", "licensed under the apache license version 2.0 <<opt>>the license you may not use this file except in "
     "compliance with the license<<end>>"),
    ("apache-2.0", "under <<opt>>the<<end>> <<opt>>terms of the<<end>> apache license version 2.0"),
    ("gpl-3.0", "gnu general public license <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> "
     "version 3 <<opt>>of the license<<end>> <<opt>>or at your option any later version<<end>>"),
    ("gpl-2.0", "gnu general public license <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> "
     "version 2 <<opt>>of the license<<end>> <<opt>>or at your option any later version<<end>>"),
    ("lgpl", "gnu lesser general public license <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> "
     "version <<var:2>>"),
    ("agpl-3.0", "gnu affero general public license <<opt>>as published by the free software foundation<<end>> "
     "<<opt>>either<<end>> version 3"),
    ("mpl-2.0", "subject to the terms of the mozilla public license <<opt>>v<<end>> <<opt>>version<<end>> 2.0"),
    ("cc-by", f"{_CC} {_CC_TAIL}"),
    ("cc-by-sa", f"{_CC} sharealike {_CC_TAIL}"),
    ("cc-by-sa", f"{_CC} share alike {_CC_TAIL}"),
    ("cc-by-nc", f"{_CC} noncommercial {_CC_TAIL}"),
    ("cc-by-nc", f"{_CC} non commercial {_CC_TAIL}"),
    ("cc-by-nd", f"{_CC} noderivatives {_CC_TAIL}"),
    ("cc-by", "licensed under <<opt>>a<<end>> <<opt>>the<<end>> cc by <<var:2>> <<opt>>license<<end>>"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc0-1.0", "cc0 1.0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("bsl-1.0", "distributed under the boost software license version 1.0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held "
     "liable for any damages arising from the use of this software"),
    ("proprietary", "copyright <<var:8>> all rights reserved"),
)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(_ASCII_LOWER))


class TokenAutomaton:
    """Bit-parallel nondeterministic automaton over words.

    Bit i of the state set stands for "i items matched".  An optional region adds an
    epsilon edge over its items; a variable region is N optional wildcard items.
    """

    def __init__(self, label: str, template: str):
        self.label, self.step, self.any, self.skips = label, {}, 0, []
        n, opened, self.n_mandatory = 0, [], 0
        for part in re.findall(r"<<[^>]*>>|[^<]+", template):
            if part == "<<opt>>":
                opened.append(n)
            elif part == "<<end>>":
                self.skips.append((opened.pop(), n))
            elif m := re.fullmatch(r"<<var:(\d+)>>", part):
                for _ in range(int(m[1])):
                    self.any |= 1 << n
                    self.skips.append((n, n + 1))
                    n += 1
            else:
                for word in words_of(part):
                    self.step[word] = self.step.get(word, 0) | 1 << n
                    self.n_mandatory += not opened
                    n += 1
        if opened or self.any & 1 or not self.step or any(at == 0 for at, _ in self.skips):
            raise ValueError(f"template of {label} must close its regions and begin with a word")
        self.skips.sort()
        self.final = 1 << n
        self.first = next(w for w, mask in self.step.items() if mask & 1)
        self.rarest = {w for w, mask in self.step.items() if not any(mask >> i & 1 for a, b in self.skips for i in range(a, b))}

    def longest(self, words: list[str], at: int) -> int:
        """End of the longest match that starts at word ``at``; -1 if there is none."""
        state, end = 1, -1
        for i in range(at, len(words)):
            state = (state & (self.step.get(words[i], 0) | self.any)) << 1
            if not state:
                break
            for a, b in self.skips:
                if state >> a & 1:
                    state |= 1 << b
            if state & self.final:
                end = i + 1
        return end


AUTOMATA = tuple(TokenAutomaton(*t) for t in TEMPLATES)
_PHRASES = tuple((tuple(p.split()), label) for p, label in BASE_PHRASES)


@lru_cache(maxsize=16)
def _needed(automata: tuple[TokenAutomaton, ...]) -> re.Pattern:
    """Any text with a base phrase or a match of ``automata`` holds this: of each, its longest
    mandatory word, as a whole word."""
    words = {max(p, key=len) for p, _ in _PHRASES} | {max(a.rarest | {a.first}, key=lambda w: (len(w), w)) for a in automata}
    one = b"|".join(re.escape(w.encode("utf-8", "surrogatepass")) for w in sorted(words))
    return re.compile(rb"(?<![^ ])(?:" + one + rb")(?![^ ])")


def scan(text: str | None, automata: tuple[TokenAutomaton, ...] = AUTOMATA) -> dict:
    """All base places and template matches of one whole text (null counts as empty)."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    out = {"n_words": len(raw.split()), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": ""}
    if not _needed(tuple(automata)).search(raw):
        return out
    words = words_of(text)
    where: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        where.setdefault(w, []).append(i)
    base, starts = set(), []
    for phrase, label in _PHRASES:
        for at in where.get(phrase[0], ()):
            if tuple(words[at : at + len(phrase)]) == phrase:
                starts.append(at)
                base.add(label)
    found, score, spans = set(base), 0.5 * bool(base), set()
    for machine in automata:
        if not all(w in where for w in machine.rarest):
            continue
        for at in where.get(machine.first, ()):
            if (end := machine.longest(words, at)) >= 0:
                found.add(machine.label)
                spans.add((at, end, machine.label))
                score = max(score, 1 - 0.5 ** (1 + machine.n_mandatory / 4))
    out |= {"n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None)}
    return out | {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(found)), "score": score, "spans": ",".join(f"{label}:{a}:{b}" for a, b, label in sorted(spans))}


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, word count, base places, labels, score, template spans.

    A null text counts as empty.  Repeated rows give repeated results, an empty table an
    empty one; other columns are not read.  ``score`` is 0 without a finding, 0.5 for base
    phrases alone and nears 1 with the number of mandatory words that a template matched.
    """

    def setup() -> Mapper:
        def mapper(texts: list[str | None]) -> tuple[None, list]:
            found = [scan(t) for t in texts]
            return None, [[f[c.split()[0]] for f in found] for c in SCHEMA.split(", ")]

        return mapper

    return map_texts(df, id_col, text_col, setup, SCHEMA)
