"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is any run of as many successive words as a template has, over line ends too, so hard-wrapped notices and those behind
comment marks count like others. It matches if it holds at least ``percent`` of the template's different words. The join is exact and
needs no comparison of all with all: a template's words are put in one global order, rarest in the corpus first, and of a
template with n words that needs m of them, any block that matches holds one of its first n - m + 1. Texts are probed with
those prefix words only; around a hit, places with too few words of the template (length and position filter) go at once,
and in the rest each block is counted as it slides by.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import FOLD, LETTERED, U64, Words, hashes, pieces, words

# The phrases of the base and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Public notices by which licenses are named or granted, with the label of each.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (
        "mit",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    ("gpl", "Licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it"),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def _hashed(text: str) -> np.ndarray:
    return hashes(words(pa.array([text]), LETTERED, FOLD))


class Template(NamedTuple):
    label: str
    width: int  # words, repeated ones too
    words: np.ndarray  # different ones, ascending
    prefix: np.ndarray  # ascending
    need: int


def index(templates: list[tuple[str, str]], counts: dict[int, int], percent: int) -> list[Template]:
    made = []
    for label, text in templates:
        whole = _hashed(text)
        own = np.unique(whole)
        ranked = sorted(own.tolist(), key=lambda w: (counts.get(w, 0), w))
        need = -(-percent * len(own) // 100)
        made.append(Template(label, len(whole), own, np.sort(np.array(ranked[: len(own) - need + 1], U64)), need))
    return made


def _among(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each hash its place in own, which ascends, or -1."""
    at = np.minimum(np.searchsorted(own, h), len(own) - 1)
    return np.where(own[at] == h, at, -1)


def match(one: Template, h: np.ndarray, text_of: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans (start, end, common) of words where blocks match, those that overlap joined and common the most in one block.
    hits are the places in h of the template's words, or of more; text_of is each word's text, ascending."""
    place = _among(h[hits], one.words)
    hits, place = hits[place >= 0], place[place >= 0]
    probes = np.flatnonzero(_among(one.words[place], one.prefix) >= 0)
    if not len(probes):
        return []
    # hits that a block around a probe can reach, and their number: too few can't match
    low = np.searchsorted(hits, np.maximum(hits[probes] - one.width + 1, np.searchsorted(text_of, text_of[hits[probes]], "left")), "left")
    high = np.searchsorted(hits, np.minimum(hits[probes] + one.width, np.searchsorted(text_of, text_of[hits[probes]], "right")), "left")
    fine = high - low >= one.need
    hit_text = text_of[hits]
    out: list[list[int]] = []
    done = 0
    for a, b in zip(low[fine].tolist(), high[fine].tolist(), strict=True):
        a = max(a, done)
        if a >= b:
            continue
        # what stands before a in reach was slid over already, but its words may still be in a block
        begin = max(int(np.searchsorted(hits, hits[a] - one.width + 1, "left")), int(np.searchsorted(hit_text, hit_text[a], "left")))
        held: dict[int, int] = {}
        at, words_at = hits[begin:b].tolist(), place[begin:b].tolist()
        left = 0
        for i, (p, w) in enumerate(zip(at, words_at, strict=True)):
            held[w] = held.get(w, 0) + 1
            while at[left] <= p - one.width:
                held[words_at[left]] -= 1
                if not held[words_at[left]]:
                    del held[words_at[left]]
                left += 1
            if len(held) >= one.need:
                if out and at[left] < out[-1][1]:
                    out[-1][1:] = [max(out[-1][1], p + 1), max(out[-1][2], len(held))]
                else:
                    out.append([at[left], p + 1, len(held)])
        done = b
    return [tuple(x) for x in out]


def word_counts(docs: DataFrame, vocabulary: np.ndarray, text: str) -> dict[int, int]:
    """How often each word of the templates stands in all texts. Each task sends one row for each such word at most."""
    known = np.sort(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in pieces(batches, text):
            h = hashes(words(batch.column(text), LETTERED, FOLD))
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            total += np.bincount(at[known[at] == h], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], ["word", "n"])

    rows = docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in rows.collect()}


def scan(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    percent: int = 80,
) -> DataFrame:
    """A row per row of docs: id, n_words, phrases (array<struct<label, start>>, word places from 0, in order), blocks
    (array<struct<start, end, label, common, size>>: for each template the stretches of words that its matching blocks cover, the most
    words in common with one block and the template's number of different words), by start, end and template.

    Words are runs of digits, letters and anything beyond ASCII, after folding A-Z. Phrases are found wherever their words stand in
    succession, over line ends too. Null and empty texts have no words and neither. Rows are scanned one by one: ties, repeats
    and null ids don't matter, other columns are not read; ids that are no whole numbers raise. The templates are the operator's
    own and few; the texts are read twice, once to count the templates' words.
    """
    listed = list(templates)
    vocabulary = np.unique(np.concatenate([_hashed(t) for _, t in listed]))
    made = index(listed, word_counts(docs, vocabulary, text), percent)
    phrases = [(label, _hashed(p)) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            found: Words = words(batch.column(text), LETTERED, FOLD)
            h, first = hashes(found), found.first
            n = batch.num_rows
            phrased: list[list] = [[] for _ in range(n)]
            text_of = np.repeat(np.arange(n), np.diff(first))
            for label, phrase in phrases:
                ok = np.flatnonzero(h == phrase[0])
                ok = ok[ok + len(phrase) <= len(h)]
                for j in range(1, len(phrase)):
                    ok = ok[(h[ok + j] == phrase[j]) & (text_of[ok + j] == text_of[ok])]
                for w in ok.tolist():
                    t = int(text_of[w])
                    phrased[t].append((w - int(first[t]), label))
            hits = np.flatnonzero(_among(h, vocabulary) >= 0)
            blocks: list[list] = [[] for _ in range(n)]
            for k, one in enumerate(made):
                for a, b, common in match(one, h, text_of, hits):
                    t = int(text_of[a])
                    blocks[t].append((a - int(first[t]), b - int(first[t]), k, common))
            told = [[{"label": label, "start": w} for w, label in sorted(x)] for x in phrased]
            seen = [
                [{"start": a, "end": b, "label": made[k].label, "common": c, "size": len(made[k].words)} for a, b, k, c in sorted(x)]
                for x in blocks
            ]
            block = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("common", pa.int64()), ("size", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id).cast(pa.int64()),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(told, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
                    pa.array(seen, pa.list_(block)),
                ],
                ["id", "n_words", "phrases", "blocks"],
            )

    schema = (
        "id long, n_words long, phrases array<struct<label: string, start: bigint>>, "
        "blocks array<struct<start: bigint, end: bigint, label: string, common: bigint, size: bigint>>"
    )
    return docs.select(id, text).mapInArrow(run, schema).withColumnRenamed("id", id)
