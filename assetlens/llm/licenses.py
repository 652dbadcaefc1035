"""License scans: template markup compiled into token automata.

A template is wording with two kinds of regions:

    <<beginOptional>> words <<endOptional>>      may be left out
    <<var;name="holder";min="1";max="12">>       replaceable by that many words

It becomes an automaton over words: states with edges for one word or for any
word, optional regions as shortcuts. A text carries the license if somewhere in
it the automaton runs through, that is, if all mandatory words stand there
exactly, in order, with nothing between them but the marked regions.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased,
so case, punctuation and line breaks don't matter. Automata start only at words
that begin a template; a pass over a text is linear but for those places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table, texts_of

#: Fixed phrases and the labels they give wherever their words stand together.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Templates and the labels they give.
TEMPLATES = (
    ("mit", "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> <<beginOptional>>distributed<<endOptional>> under the MIT License"),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="what";min="1";max="8">> '
        'and associated documentation files <<beginOptional>>(the <<var;name="defined";min="1";max="3">>)<<endOptional>>, to deal in the',
    ),
    ("apache-2", "<<beginOptional>>licensed under the<<endOptional>> Apache License, Version 2<<beginOptional>>.0<<endOptional>>"),
    ("cc-by-nc", '<<beginOptional>>licensed under<<endOptional>> CC BY-NC <<beginOptional>><<var;name="major";min="1";max="1">>.0<<endOptional>>'),
    (
        "gpl-3",
        "<<beginOptional>>this work is<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> "
        "GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> "
        "version 3 <<beginOptional>>of the License<<endOptional>> <<beginOptional>>or (at your option) any later version<<endOptional>>",
    ),
    (
        "bsd",
        'Redistribution and use in source and binary forms, with or without modification, are permitted <<beginOptional>>provided that the following '
        "conditions are met<<endOptional>>",
    ),
    (
        "isc",
        'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted',
    ),
)

_SPACES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


def words_of(text: str) -> list[bytes]:
    """The words of a text as lower-cased UTF-8."""
    return text.encode("utf-8").lower().translate(_SPACES).split()


class Automaton(NamedTuple):
    """edges[state] is [(word or None for any, next state)]; a run ends when it reaches ``accept``."""

    label: str
    start: frozenset[int]
    edges: tuple[tuple[tuple[bytes | None, int], ...], ...]
    free: tuple[frozenset[int], ...]  # states reached without a word, the state itself included
    accept: int

    def first_words(self) -> set[bytes]:
        """Words a run can begin with."""
        return {w for s in self.start for w, _ in self.edges[s]}

    def longest_end(self, words: list[bytes], at: int) -> int | None:
        """Where the longest run from word ``at`` ends; None if there is none."""
        states, end, i, n = self.start, None, at, len(words)
        while states and i < n:
            word = words[i]
            i += 1
            states = frozenset(f for s in states for w, t in self.edges[s] if w is None or w == word for f in self.free[t])
            if self.accept in states:
                end = i
        return end


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template. A template must not begin with a replaceable region, nor be optional as a whole."""
    edges: list[list[tuple[bytes | None, int]]] = [[]]
    jumps: dict[int, set[int]] = {}
    open_at: list[int] = []

    def step(word: bytes | None) -> None:
        edges[-1].append((word, len(edges)))
        edges.append([])

    for i, piece in enumerate(_MARKUP.split(template)):
        last = len(edges) - 1
        if i % 2 == 0:
            for word in words_of(piece):
                step(word)
        elif piece == "beginOptional":
            open_at.append(last)
        elif piece == "endOptional":
            jumps.setdefault(open_at.pop(), set()).add(last)
        else:
            least, most = (int(re.search(rf'{k}="(\d+)"', piece)[1]) for k in ("min", "max"))
            for n in range(most):
                if n >= least:
                    jumps.setdefault(len(edges) - 1, set()).add(last + most)
                step(None)
    if open_at:
        raise ValueError(f"an optional region of {label} isn't closed")
    free = []
    for state in range(len(edges)):
        seen, todo = {state}, [state]
        while todo:
            for t in jumps.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        free.append(frozenset(seen))
    found = Automaton(label, free[0], tuple(map(tuple, edges)), tuple(free), len(edges) - 1)
    if found.accept in found.start or None in found.first_words():
        raise ValueError(f"the template of {label} has no word to begin with")
    return found


class Scanner:
    """All phrases and automata, by the words they begin with."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in phrases:
            words = words_of(phrase)
            self.phrases.setdefault(words[0], []).append((words, label))
        self.automata: dict[bytes, list[Automaton]] = {}
        for label, template in templates:
            automaton = compiled(label, template)
            for word in automaton.first_words():
                self.automata.setdefault(word, []).append(automaton)
        self.begins = frozenset(self.phrases) | frozenset(self.automata)

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
        """The columns of ``scan_licenses`` after the id."""
        words = words_of(text)
        base_at, base, labels, covered, reach = [], set(), set(), 0, 0
        begins = self.begins
        for at in [i for i, w in enumerate(words) if w in begins]:
            for phrase, label in self.phrases.get(words[at], ()):
                if words[at : at + len(phrase)] == phrase:
                    base_at.append(at)
                    base.add(label)
            for automaton in self.automata.get(words[at], ()):
                end = automaton.longest_end(words, at)
                if end is not None:
                    labels.add(automaton.label)
                    covered += max(0, end - max(at, reach))
                    reach = max(reach, end)
        first, last = (base_at[0], base_at[-1]) if base_at else (None, None)
        score = covered / len(words) if words else 0.0
        return len(words), len(base_at), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Phrases and licenses of every row of ``docs``.

    n_base, first_word, last_word and base_labels are the places and labels of
    the phrases; labels are theirs and those of the accepted templates, distinct,
    sorted and comma-joined; score is the share of the text's words that lie in
    accepted wording. A null text counts as empty: no words, no labels, score 0.
    Null ids and repeated rows are kept; an empty table gives no rows.
    """
    scanner = Scanner(templates, phrases)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.scan(t) for t in texts_of(batch)]
            columns = zip(*found, strict=True) if found else [[]] * len(kinds)
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, run, SCHEMA)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op10_licenses": op10_licenses}
ORACLES: dict[str, str] = {}  # automata are not SQL; tests compare with regular expressions and brute force
