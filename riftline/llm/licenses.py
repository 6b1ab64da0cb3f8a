"""Licence scan: an exact containment join between blocks of text and licence templates.

A template is the wording of a notice, or one paragraph of a licence.  A block is a window of words, over line ends and
whatever else stands between words, a quarter longer than the template.  So words that are scattered over a text or a
long line don't add up, and a notice is found however its lines are broken.  A text has a template's label if one of its blocks
  * holds at least ``CONTAINMENT`` of the template's distinct words, among them those that name the licence (``NAMING``), and
  * holds no word that makes the licence another one (``EXCLUDED``).
The first block with the highest share is given too, as label:first word:end (exclusive, within the text).

Words are ordered by how many documents of the whole table have them, rarest first, and then by themselves.  With
that order a block that meets the threshold
  * has at least as many distinct words as it has to share (length filter),
  * has one of the template's first ``size - needed + 1`` words (prefix filter), since at most size - needed
    are missing, and
  * has enough words left, in itself and in the template, from its first shared word on (positional filter).
The first two are asked of the stretch of words around each place of a prefix word, the third of the words met
there; stretches that pass are searched block by block, so no match is lost.  The template list is fixed and small, so it
goes to every task; only counts of its own words are gathered from the corpus.

Besides, the base phrases are found wherever their words stand one after the other.

Edge cases: a null text is empty: no words, no labels, score 0; a document without base phrases has null
first and last words; texts of any length are read whole; repeated rows each give a row; a null id stays null and
leaves the others as they are; an empty table gives an empty result; only id and text are read, so other columns may have
any name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named_texts, with_results

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Templates by label, the usual wording of licence notices and paragraphs of licences.
TEMPLATES = (
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    ("mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "All rights reserved."),
)
#: Share of a template's distinct words that a block has to hold.
CONTAINMENT = 0.8
# Words by label that name the licence; those that a template has must be in the block.
NAMING = {
    "cc-by": frozenset({"cc", "by", "creative", "commons", "attribution"}), "cc-by-nc": frozenset({"cc", "by", "nc"}), "cc-by-sa": frozenset({"cc", "by", "sa"}), "cc0": frozenset({"waived"}),
    "gpl": frozenset({"gnu", "general", "public"}), "apache": frozenset({"apache"}), "mit": frozenset({"mit"}), "mozilla": frozenset({"mozilla"}), "reserved": frozenset({"rights", "reserved"}),
}
# Words by label that mean another licence when they stand in a block.
EXCLUDED = {"cc-by": frozenset({"nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "noderivs"}), "gpl": frozenset({"lesser", "affero"})}
SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, blocks string"

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Lower-cases A-Z and blanks what isn't part of a word.
_FOLD = bytes(c if (c := (b | 32 if 65 <= b <= 90 else b)) in _KEPT else 32 for b in range(256))
#: The same in Spark's expressions: what stands between words.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  #: distinct, rarest first
    needed: int
    span: int  #: words of a block
    excluded: frozenset[bytes]
    naming: frozenset[bytes]

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.words[: len(self.words) - self.needed + 1]


def ordered(templates: tuple[tuple[str, str], ...], frequency: dict[bytes, int], containment: float) -> list[Template]:
    out = []
    for label, text in templates:
        all_ = words_of(text)
        words = sorted(set(all_), key=lambda w: (frequency.get(w, 0), w))
        excluded = frozenset(w.encode() for w in EXCLUDED.get(label, ())) - set(words)
        naming = frozenset(w.encode() for w in NAMING.get(label, ())) & set(words)
        out.append(Template(label, tuple(words), ceil(containment * len(words) - 1e-9), len(all_) + len(all_) // 4, excluded, naming))
    return out


def best_block(words: list[bytes], first: int, last: int, t: Template) -> tuple[float, int]:
    """The highest share of a template's words in a block that holds a word from number ``first`` to ``last``, and the first such block's start; 0 if none has enough."""
    wanted, low = set(t.words), max(0, first - t.span + 1)
    held: dict[bytes, int] = defaultdict(int)
    own, wrong, named, best, start = 0, 0, 0, 0, 0
    for at in range(low, last + t.span):  # blocks may reach over the text's end
        if at - t.span >= low and (w := words[at - t.span]) in held:
            held[w] -= 1
            own -= w in wanted and not held[w]
            named -= w in t.naming and not held[w]
            wrong -= w in t.excluded
        if at < len(words) and ((w := words[at]) in wanted or w in t.excluded):
            held[w] += 1
            own += w in wanted and held[w] == 1
            named += w in t.naming and held[w] == 1
            wrong += w in t.excluded
        if at >= first and not wrong and named == len(t.naming) and own > best:
            best, start = own, max(0, at - t.span + 1)
    return (best / len(t.words), start) if best >= t.needed else (0.0, 0)


class Join:
    """The templates indexed by their prefix words."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.index: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(templates):
            for position, w in enumerate(t.prefix):
                self.index[w].append((k, position))

    def matches(self, words: list[bytes]) -> dict[int, tuple[float, int]]:
        """Numbers of the templates that some block of the words holds, with the highest share of their words and the block's start."""
        own = self.index.keys() & set(words)
        by_template: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if own:
            for at, w in enumerate(words):
                if w in own:
                    for k, position in self.index[w]:
                        by_template[k].append((at, position))
        out = {}
        for k, starts in by_template.items():
            t, best, n = self.templates[k], (0.0, 0), 0
            while n < len(starts):  # places whose blocks touch are searched as one
                first = last = starts[n][0]
                rarest = starts[n][1]
                n += 1
                while n < len(starts) and starts[n][0] - last < 2 * t.span:
                    last, rarest = starts[n][0], min(rarest, starts[n][1])
                    n += 1
                around = set(words[max(0, first - t.span + 1) : last + t.span])
                if len(around) >= t.needed and len(around.intersection(t.words[rarest:])) >= t.needed:
                    best = max(best, best_block(words, first, last, t), key=lambda b: (b[0], -b[1]))
            if best[0]:
                out[k] = best
        return out


def word_frequencies(texts: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """Number of documents, over the whole table, that have each of some words."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = F.array(*[F.lit(w.decode()) for w in sorted(words)])
    found = texts.select(F.explode(F.array_intersect(known, F.split(lower, _BETWEEN))).alias("word"))
    return {r["word"].encode(): r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def base_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(start word, label) of every place of every phrase."""
    joined, found, starts = b" " + b" ".join(words) + b" ", [], None
    for phrase, label in phrases.items():
        sought = b" " + phrase.encode() + b" "
        at = joined.find(sought)
        while at >= 0:
            if starts is None:  # where each word begins: the blank before it
                starts, reached = [], 0
                for w in words:
                    starts.append(reached)
                    reached += len(w) + 1
            found.append((bisect_left(starts, at), label))
            at = joined.find(sought, at + 1)
    return sorted(found)


def scan_text(text: str, join: Join, phrases: dict[str, str]) -> tuple:
    words = words_of(text)
    places = base_places(words, phrases)
    base = {label for _, label in places}
    found = join.matches(words)
    labels = base | {join.templates[k].label for k in found}
    score = max(float(bool(base)), *(share for share, _ in found.values()), 0.0)
    blocks = sorted({(start, min(len(words), start + join.templates[k].span), join.templates[k].label) for k, (_, start) in found.items()})
    base_columns = (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)))
    return *base_columns, ",".join(sorted(labels)), score, ",".join(f"{label}:{a}:{b}" for a, b, label in blocks)


def scan_licenses(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    containment: float = CONTAINMENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: words, places of base phrases, labels and highest share of a template in a block."""
    texts = named_texts(docs, id_column, text_column)
    frequency = word_frequencies(texts, {w for _, t in templates for w in words_of(t)})
    shared = docs.sparkSession.sparkContext.broadcast(Join(ordered(templates, frequency, containment)))

    def scanned(batch: list[str | None]) -> dict[str, Sequence]:
        rows = [scan_text(t or "", shared.value, phrases) for t in batch]
        return {c.split()[0]: [r[k] for r in rows] for k, c in enumerate(SCHEMA.split(", "))}

    return with_results(texts, SCHEMA, scanned)
