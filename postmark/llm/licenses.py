"""License scan by template-markup matching.

A template is the mandatory wording of a notice with two kinds of markup: an optional
region ``<<beginOptional>>...<<endOptional>>`` (nestable) and a replaceable region
``<<var;match="a|b c">>``, one of several wordings, or ``<<var;any="lo,hi">>``, any lo to
hi words. Templates compile to one automaton over word tokens; a text has a template's
label where some run of its words is accepted, so mandatory words must match exactly, in
order, while punctuation, case of A-Z, line breaks and white space don't count.

Null and empty texts have no words, no labels and score 0. Repeated notices count once for
labels and each for ``n_base``. The score is 1 where a template is accepted, 0.5 where only a
base phrase stands, else 0.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .tables import read

#: Phrases that give a label by themselves.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices in template markup, among them the openings of license texts. Wording of public licenses, fixed values.
NOTICES = {
    "mit-notice": '<<var;match="released|licensed|distributed|available|provided">> under the <<beginOptional>>terms of the<<endOptional>> mit license',
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-2.0": '<<var;match="released|licensed|distributed|available">> under the <<beginOptional>>terms of the<<endOptional>> apache license <<beginOptional>>version<<endOptional>> 2.0',
    "gpl-2.0": 'gnu general public license <<beginOptional>>as published by the free software foundation <<beginOptional>>either<<endOptional>><<endOptional>> <<var;match="version|v">> 2',
    "gpl-3.0": 'gnu general public license <<beginOptional>>as published by the free software foundation <<beginOptional>>either<<endOptional>><<endOptional>> <<var;match="version|v">> 3',
    "gpl-or-later": 'gnu general public license <<var;any="0,9">> version <<var;match="2|3">> <<beginOptional>>of the license<<endOptional>> or <<beginOptional>>at your option<<endOptional>> any later version',
    "cc-by-4.0": 'licensed under <<beginOptional>>a<<endOptional>> <<var;match="cc by|creative commons attribution">> 4.0',
    "cc-by-nc-4.0": 'licensed under <<beginOptional>>a<<endOptional>> <<var;match="cc by-nc|creative commons attribution-noncommercial">> 4.0',
    "cc-by-sa-4.0": 'licensed under <<beginOptional>>a<<endOptional>> <<var;match="cc by-sa|creative commons attribution-sharealike">> 4.0',
    "bsd": 'redistribution and use in source and binary forms with or without modification are permitted <<beginOptional>>subject to the limitations in the disclaimer below<<endOptional>> provided that the following conditions are met',
    "isc": 'permission to use copy modify <<beginOptional>>and<<endOptional>> <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted',
    "mpl-2.0": 'this source code form is subject to the terms of the mozilla public license <<var;match="v|version">> <<beginOptional>>.<<endOptional>> 2.0',
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def _bsd(*clauses: str) -> str:
    said = (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        *clauses,
    )
    numbered = " ".join(f'<<beginOptional>><<var;match="{k + 1}|{"abcd"[k]}|{("i", "ii", "iii", "iv")[k]}">><<endOptional>> {c}' for k, c in enumerate(said))
    return (
        f"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {numbered} "
        'this software is provided by <<var;any="1,20">> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed '
        'in no event shall <<var;any="1,20">> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption '
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
    )


_ENDORSE = 'neither the name of <<var;any="1,20">> nor the names of <<var;match="its|their">> contributors may be used to endorse or promote products derived from this software without specific prior written permission'
_ADVERTISE = 'all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by <<var;any="1,20">>'
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_CLAIM = "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
#: The whole mandatory wording of license texts, with names as replaceable regions.
TEXTS = {
    "mit-whole": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to "
    "use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
    f"<<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software {_AS_IS} in no event shall <<var;any=\"1,20\">> {_CLAIM}",
    "bsd-2-clause": _bsd(),
    "bsd-3-clause": _bsd(_ENDORSE),
    "bsd-4-clause": _bsd(_ADVERTISE, _ENDORSE),
    "isc-whole": "permission to use copy modify <<beginOptional>>and<<endOptional>> <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
    'permission notice appear in all copies the software is provided as is and <<var;any="1,20">> <<var;match="disclaims|disclaim">> all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall '
    '<<var;any="1,20">> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in '
    "connection with the use or performance of this software",
    "unlicense-whole": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
    "commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the "
    "benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law "
    f"{_AS_IS} in no event shall the authors {_CLAIM}",
}
TEMPLATES = NOTICES | TEXTS
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def tokens(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOW))


def parse(template: str) -> list:
    """The template as a list of ("word", w), ("opt", list), ("alt", [list of words]) and ("any", lo, hi)."""
    stack: list[list] = [[]]
    for plain, mark in re.findall(r"([^<]+)|<<([^>]*)>>", template):
        if plain:
            stack[-1] += [("word", w) for w in tokens(plain)]
        elif mark == "beginOptional":
            stack.append([])
        elif mark == "endOptional":
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        elif (m := re.fullmatch(r'var;match="([^"]*)"', mark)) is not None:
            stack[-1].append(("alt", [tokens(x) for x in m[1].split("|")]))
        elif (m := re.fullmatch(r'var;any="(\d+),(\d+)"', mark)) is not None:
            stack[-1].append(("any", int(m[1]), int(m[2])))
        else:
            raise ValueError(f"unknown markup: {mark}")
    if len(stack) != 1:
        raise ValueError("a region isn't closed")
    return stack[0]


def pattern(template: str) -> str:
    """The same language as a regular expression over words that are each followed by one space."""

    def say(parts: list) -> str:
        out = ""
        for kind, *x in parts:
            if kind == "word":
                out += x[0] + " "
            elif kind == "opt":
                out += f"(?:{say(x[0])})?"
            elif kind == "alt":
                out += "(?:" + "|".join("".join(w + " " for w in ws) for ws in x[0]) + ")"
            else:
                out += f"(?:[^ ]+ ){{{x[0]},{x[1]}}}"
        return out

    return say(parse(template))


class Automaton:
    """All templates as one nondeterministic automaton over tokens; its state sets are made deterministic as they occur."""

    def __init__(self, templates: dict[str, str]):
        self.edges: list[dict[str | None, list[int]]] = []
        self.empty: list[list[int]] = []
        self.label: dict[int, str] = {}
        self.memo: dict = {}
        begin = self._state()
        for label, text in templates.items():
            first = self._state()
            self.empty[begin].append(first)
            self.label[self._chain(first, parse(text))] = label
        self.begin = self._closure([begin])
        self.firsts = {w for s in self.begin for w in self.edges[s] if w is not None}
        if any(None in self.edges[s] or s in self.label for s in self.begin):
            raise ValueError("a template must begin with mandatory or listed words")

    def _state(self) -> int:
        self.edges.append({})
        self.empty.append([])
        return len(self.edges) - 1

    def _word(self, at: int, word: str | None) -> int:
        to = self._state()
        self.edges[at].setdefault(word, []).append(to)
        return to

    def _chain(self, at: int, parts: list) -> int:
        for kind, *x in parts:
            if kind == "word":
                at = self._word(at, x[0])
            elif kind == "opt":
                end = self._state()
                self.empty[self._chain(at, x[0])].append(end)
                self.empty[at].append(end)
                at = end
            elif kind == "alt":
                end = self._state()
                for ws in x[0]:
                    self.empty[self._chain(at, [("word", w) for w in ws])].append(end)
                at = end
            else:
                for _ in range(x[0]):
                    at = self._word(at, None)
                end = self._state()
                self.empty[at].append(end)
                for _ in range(x[1] - x[0]):
                    at = self._word(at, None)
                    self.empty[at].append(end)
                at = end
        return at

    def _closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _next(self, states: frozenset[int], word: str) -> tuple[frozenset[int], frozenset[str]]:
        known = word if any(word in self.edges[s] for s in states) else None
        got = self.memo.get((states, known))
        if got is None:
            to = self._closure([t for s in states for w in {known, None} for t in self.edges[s].get(w, ())])
            got = self.memo[states, known] = (to, frozenset(self.label[s] for s in to if s in self.label))
        return got

    def run(self, words: list[str], at: int) -> set[str]:
        """Labels of the templates that accept some words beginning at ``at``."""
        states, found = self.begin, set()
        while states and at < len(words):
            states, more = self._next(states, words[at])
            found |= more
            at += 1
        return found


@lru_cache(4)
def _compiled(templates: tuple) -> Automaton:
    return Automaton(dict(templates))


def _hash(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return K.hashes(data, np.concatenate(([0], ends[:-1])).astype(np.int64), ends.astype(np.int64))


def scan(data: np.ndarray, offsets: np.ndarray, templates: dict[str, str], base: dict[str, str]) -> dict[str, list]:
    """Columns of the report for each text of a slice."""
    n = len(offsets) - 1
    auto = _compiled(tuple(templates.items()))
    start, end, row = K.words(data, offsets)
    h = K.hashes(data, start, end)
    first = np.searchsorted(row, np.arange(n + 1))
    n_base, least, most = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    base_labels: list[set[str]] = [set() for _ in range(n)]
    for phrase, label in base.items():
        ws = _hash(phrase.split(" "))
        if len(h) < len(ws):
            continue
        hit = row[: len(h) - len(ws) + 1] == row[len(ws) - 1 :]
        for k, w in enumerate(ws):
            hit &= h[k : len(h) - len(ws) + 1 + k] == w
        at = np.flatnonzero(hit)
        rows, place = row[at], at - first[row[at]]
        np.add.at(n_base, rows, 1)
        np.minimum.at(least, rows, place)
        np.maximum.at(most, rows, place)
        for r in np.unique(rows):
            base_labels[r].add(label)
    labels = [set(x) for x in base_labels]
    accepted = np.zeros(n, bool)
    anchors = np.flatnonzero(np.isin(h, _hash(sorted(auto.firsts)))) if len(h) else np.zeros(0, np.int64)
    for r in np.unique(row[anchors]):
        text = bytes(data[offsets[r] : offsets[r + 1]]).decode()
        ws = tokens(text)
        for a in anchors[np.searchsorted(anchors, first[r]) : np.searchsorted(anchors, first[r + 1])] - first[r]:
            if found := auto.run(ws, int(a)):
                labels[r] |= found
                accepted[r] = True
    none = most < 0
    return {
        "n_words": np.diff(first).astype(np.int64),
        "n_base": n_base,
        "first_word": pa.array(np.where(none, 0, least), mask=none),
        "last_word": pa.array(np.where(none, 0, most), mask=none),
        "base_labels": [",".join(sorted(x)) for x in base_labels],
        "labels": [",".join(sorted(x)) for x in labels],
        "score": np.where(accepted, 1.0, np.where(none, 0.0, 0.5)),
    }


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """One row a document: doc_id, word and phrase counts, base labels, all labels and the score."""
    templates, base = templates or TEMPLATES, base or BASE

    def run(batches):
        for b in K.slices(batches):
            got = scan(*K.utf8(b.column("text")), templates, base)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(x if isinstance(x, pa.Array) else pa.array(x) for x in got.values())], names=["doc_id", *got])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the license report of every document."""
    return scan_licenses(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))


def _oracle() -> str:
    """The given SQL: notices only, without ``TEXTS``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base = ", ".join(
        f"list_transform(list_filter(range(0, len(w) - {len(ws) - 1}), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(ws)) + f"), lambda i: {{'at': i, 'label': '{label}'}})"
        for phrase, label in BASE.items() for ws in [phrase.split(" ")]
    )
    method = ", ".join(f"CASE WHEN regexp_matches(joined, ' {pattern(t)}') THEN '{label}' END" for label, t in NOTICES.items())
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
u AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined, flatten([{base}]) AS hits FROM t),
v AS (SELECT doc_id, len(w) AS n_words, hits, list_sort(list_distinct(list_transform(hits, lambda x: x.label))) AS b,
  list_filter([{method}], lambda x: x IS NOT NULL) AS m FROM u)
SELECT doc_id, n_words::BIGINT AS n_words, len(hits)::BIGINT AS n_base, list_min(list_transform(hits, lambda x: x.at))::BIGINT AS first_word,
  list_max(list_transform(hits, lambda x: x.at))::BIGINT AS last_word, array_to_string(b, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(b, m))), ',') AS labels,
  CASE WHEN len(m) > 0 THEN 1.0 WHEN len(hits) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM v"""


ORACLE_SQL = _oracle()
