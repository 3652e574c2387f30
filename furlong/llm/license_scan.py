"""License scans: base phrases, and templates with optional and replaceable regions as token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrase and label of the base scan.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Templates: label and wording. ``[[...]]`` is optional, ``{{n}}`` stands for up to n words of any
#: kind, ``{{a|b c}}`` for one of the listed wordings; all else is mandatory.
TEMPLATES = (
    ("gpl-notice", "this {{work|program|library|software|file}} is licensed under the gnu [[lesser|affero]] general public license [[version {{1|2|2 0|2 1|3|3 0}} [[or any later version]]]]"),
    ("gpl-3.0", "licensed under the gnu general public license version {{3|3 0}}"),
    ("gpl-2.0", "licensed under the gnu general public license version {{2|2 0}}"),
    ("gpl-header", "free software you can redistribute it and or modify it under the terms of the gnu [[lesser|affero]] general public license as published by the free software foundation [[either version {{2}} of the license or at your option any later version]]"),
    ("apache-2.0", "licensed under the apache license version 2 [[0]]"),
    ("apache-2.0-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{12}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("cc-by-nc-4.0", "licensed under [[a|the]] [[creative commons]] cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a|the]] [[creative commons]] cc by sa 4 0"),
    ("cc-by-4.0", "licensed under [[a|the]] [[creative commons]] cc by 4 0"),
    ("mit-notice", "{{released|licensed|distributed|available}} under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3]] [[neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]]"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
_MARK = re.compile(r"\[\[|\]\]|\{\{(.*?)\}\}|\||[^\s\[\]{}|]+")


class Automaton:
    """Token automaton of one template.

    ``moves[state]`` maps a word to next states, ``any_[state]`` holds states reached by any
    word, ``free[state]`` those reached by none. State 0 starts, ``end`` accepts.
    """

    def __init__(self, template: str) -> None:
        self.moves: list[dict[str, list[int]]] = [{}]
        self.any_: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        marks = [(m.group(0), m.group(1)) for m in _MARK.finditer(template)]
        self.end, rest = self._sequence(0, marks, 0)
        assert rest == len(marks), template
        self.starts = {w for s in self.closure({0}) for w in self.moves[s]}

    def _state(self) -> int:
        self.moves.append({})
        self.any_.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _word(self, a: int, word: str) -> int:
        b = self._state()
        self.moves[a].setdefault(word, []).append(b)
        return b

    def _sequence(self, at: int, marks: list, i: int) -> tuple[int, int]:
        while i < len(marks) and marks[i][0] not in ("]]", "|"):
            mark, inner = marks[i]
            if mark == "[[":
                out = self._state()
                self.free[at].append(out)
                while True:
                    last, i = self._sequence(at, marks, i + 1)
                    self.free[last].append(out)
                    if marks[i][0] == "]]":
                        break
                at = out
            elif inner is not None and inner.isdigit() and "|" not in inner and int(inner) > 1:
                out = self._state()
                for _ in range(int(inner)):
                    self.free[at].append(out)
                    nxt = self._state()
                    self.any_[at].append(nxt)
                    at = nxt
                self.free[at].append(out)
                at = out
            elif inner is not None:
                out = self._state()
                for wording in inner.split("|"):
                    b = at
                    for w in wording.split():
                        b = self._word(b, w)
                    self.free[b].append(out)
                at = out
            else:
                at = self._word(at, mark)
            i += 1
        return at, i

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def match(self, words: list[str], at: int) -> int | None:
        """Where the longest match from word ``at`` ends, or None."""
        states, best = self.closure({0}), None
        for i in range(at, len(words) + 1):
            if self.end in states:
                best = i
            if i == len(words):
                break
            w = words[i]
            states = self.closure({t for s in states for t in (*self.moves[s].get(w, ()), *self.any_[s])})
            if not states:
                break
        return best


@cache
def automata() -> tuple[tuple[str, Automaton], ...]:
    return tuple((label, Automaton(t)) for label, t in TEMPLATES)


@cache
def _by_start() -> dict[str, list[tuple[str, Automaton]]]:
    out: dict[str, list[tuple[str, Automaton]]] = {}
    for label, a in automata():
        for w in a.starts:
            out.setdefault(w, []).append((label, a))
    return out


#: A text without any of these holds no phrase and no template.
_HINT = re.compile("license|cc[^0-9a-z\x80-\U0010ffff]+by|permission|redistribution")


def scan_text(text: str) -> dict:
    """All that the scan tells of one text; see ``scan_licenses``."""
    low = text.translate(_LOWER) if not text.isascii() else text.lower()
    words = WORD.findall(low)
    out = {"n_words": len(words), "places": [], "base": set(), "labels": set(), "covered": 0}
    if not _HINT.search(low):
        return out
    phrases = [(p.split(), label) for p, label in PHRASES]
    starts = _by_start()
    upto = 0
    for i, w in enumerate(words):
        for p, label in phrases:
            if w == p[0] and words[i : i + len(p)] == p:
                out["places"].append(i)
                out["base"].add(label)
        for label, a in starts.get(w, ()):
            end = a.match(words, i)
            if end is not None:
                out["labels"].add(label)
                out["covered"] += max(0, end - max(i, upto))
                upto = max(upto, end)
    return out


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The base scan finds places where a phrase's words follow each other. The templates are
    token automata: a text gets a template's label where its mandatory wording stands word for word,
    whatever fills its replaceable regions and whether or not its optional ones are there.
    score is 1 where a template matches, 0.5 where only a base phrase does, else 0.

    Null and empty texts have no words and no labels. Repeated rows are scanned one by one.
    Extra columns are ignored. An empty table gives an empty result.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [scan_text(t or "") for t in batch.column(1).to_pylist()]
            places = [f["places"] for f in found]
            columns = [
                batch.column(0),
                pa.array([f["n_words"] for f in found], pa.int64()),
                pa.array([len(p) for p in places], pa.int64()),
                pa.array([min(p) if p else None for p in places], pa.int64()),
                pa.array([max(p) if p else None for p in places], pa.int64()),
                pa.array([",".join(sorted(f["base"])) for f in found], pa.string()),
                pa.array([",".join(sorted(f["base"] | f["labels"])) for f in found], pa.string()),
                pa.array([1.0 if f["labels"] else 0.5 if f["base"] else 0.0 for f in found], pa.float64()),
                pa.array([f["covered"] for f in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "template_words"]
            )

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        run,
        f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, template_words long",
    )
