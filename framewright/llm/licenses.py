"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are the lines of each whole text, for whole notices (``NOTICES``) its paragraphs as well (runs of
lines between blank ones), and for each template all windows of as many words as it has, over line
breaks, so that a wrapped notice is met too. Tokens have one global order: those of no template first,
then by how many documents of the whole corpus hold them, rarest first. A block that holds at least
``need`` of a template's tokens must hold one of its first ``len - need + 1`` (prefix filter) and have
``need`` tokens at least (length filter). Where the tokens of both are read in the order, each shared one
bounds the overlap still possible by what is left on either side, and a pair that falls short is left
(positional filter). Survivors are counted exactly. The three base phrases are found at every place.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.textkernel import PUNCT, SPACE, Tokens, hash_words, text_slices, tokenize

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Template sentences of common licenses, as words; labels are the method's.
TEMPLATES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-release": "released under the mit license",
    "apache-2-notice": "licensed under the apache license version 2 0",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "licensed under the gnu lesser general public license version 2 1",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights-reserved": "copyright all rights reserved no part of this publication may be reproduced",
}
#: Whole notices, met by paragraphs as well as by lines and windows.
NOTICES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
    "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
    "furnished to do so subject to the following conditions",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must "
    "retain the above copyright notice this list of conditions and the following disclaimer",
    "apache-2-text": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-text": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
    "see the gnu general public license for more details",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
    "notice appear in all copies",
}
THRESHOLD = 0.8


@dataclass
class _Template:
    label: str
    tokens: list[int]
    words: int
    need: int
    prefix: list[int]
    notice: bool


def ordered_templates(templates: dict[str, str], threshold: float, frequency: dict[int, int], notices: dict[str, str] | None = None) -> list[_Template]:
    """Templates and whole notices with their tokens rarest first; ties by hash."""
    out = []
    for label, text in [*templates.items(), *(notices or {}).items()]:
        tokens = sorted({int(h) for h in hash_words(text.split())}, key=lambda t: (frequency.get(t, 0), t))
        need = math.ceil(threshold * len(tokens) - 1e-9)
        out.append(_Template(label, tokens, len(text.split()), need, tokens[: len(tokens) - need + 1], label in (notices or {})))
    return out


def token_frequency(docs: DataFrame, templates: dict[str, str]) -> dict[int, int]:
    """In how many documents each template token occurs, over all documents (a few hundred counts)."""
    wanted = np.unique(np.concatenate([hash_words(t.split()) for t in templates.values()]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                tokens = tokenize(data, offsets, PUNCT)
                at = np.minimum(np.searchsorted(wanted, tokens.hashes), len(wanted) - 1)
                hit = np.flatnonzero(wanted[at] == tokens.hashes)
                doc = np.searchsorted(tokens.offsets, hit, "right") - 1
                seen = np.unique(doc * len(wanted) + at[hit])
                total += np.bincount(seen % len(wanted), minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(wanted)), pa.int32()), pa.array(total)], names=["token", "n"])

    sums = docs.select("text").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {int(wanted[r["token"]]): r["n"] for r in sums}


class Scanner:
    """Finds template matches in blocks of tokens, and base phrases in documents.

    ``filters`` names those in use; without one of them there are more candidates and the same matches.
    ``candidates`` counts the pairs of a block and a template whose tokens were compared to the end."""

    def __init__(self, templates: list[_Template], frequency: dict[int, int] | None = None, filters: tuple[str, ...] = ("prefix", "length", "position")):
        self.templates, self.filters, self.candidates = templates, filters, 0
        every = sorted({t for x in templates for t in x.tokens}, key=lambda t: ((frequency or {}).get(t, 0), t))
        self.rank = {t: k for k, t in enumerate(every)}
        self.places = [{t: k for k, t in enumerate(x.tokens)} for x in templates]
        self.index: dict[int, list[int]] = defaultdict(list)
        for i, t in enumerate(templates):
            for token in t.prefix if "prefix" in filters else t.tokens:
                self.index[token].append(i)
        self.prefix = np.array(sorted(self.index), np.uint64)
        self.notice = np.array([any(templates[i].notice for i in self.index[int(token)]) for token in self.prefix], bool)
        self.sets = [set(t.tokens) for t in templates]
        self.wanted = np.array(sorted(set().union(*self.sets)), np.uint64)
        self.member = [np.append(np.isin(self.wanted, np.array(t.tokens, np.uint64)), False) for t in templates]
        self.rare = [np.append(np.isin(self.wanted, np.array(t.prefix, np.uint64)), False) for t in templates]
        self.phrases = [(hash_words(p.split()), label) for p, label in BASE.items()]

    def block(self, tokens: list[int], notices: bool = False) -> dict[int, int]:
        """Template index and shared tokens of every template that the block meets; only whole notices
        with ``notices``."""
        block = set(tokens)
        ordered = sorted(block & self.rank.keys(), key=self.rank.__getitem__)  # tokens of no template stand before these
        out = {}
        for i in {i for token in block & self.index.keys() for i in self.index[token] if self.templates[i].notice or not notices}:
            t = self.templates[i]
            if "length" in self.filters and len(block) < t.need:
                continue
            shared, place = 0, self.places[i]
            for at, token in enumerate(ordered):
                if (k := place.get(token)) is not None:
                    if "position" in self.filters and shared + min(len(t.tokens) - k, len(ordered) - at) < t.need:
                        break
                    shared += 1
            else:
                self.candidates += 1
                if shared >= t.need:
                    out[i] = shared
        return out

    def windows(self, h: np.ndarray, off: np.ndarray, lines: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, template, shared tokens) of windows over line breaks that meet a template."""
        at = np.minimum(np.searchsorted(self.wanted, h), len(self.wanted) - 1)
        at = np.where(self.wanted[at] == h, at, len(self.wanted))
        ends = np.repeat(off[1:], np.diff(off))
        for i, t in enumerate(self.templates):
            end = np.minimum(np.arange(len(h)) + t.words, ends)
            held = np.concatenate([[0], np.cumsum(self.member[i][at])])
            rare = np.concatenate([[0], np.cumsum(self.rare[i][at])])
            starts = np.flatnonzero((held[end] - held[:-1] >= t.need) & (rare[end] > rare[:-1]) & (lines[end - 1] > lines))
            docs = np.searchsorted(off, starts, "right") - 1
            for a, d in zip(starts.tolist(), docs.tolist()):
                shared = len(self.sets[i].intersection(h[a : end[a]].tolist()))
                if shared >= t.need:
                    yield d, i, shared

    def paragraphs(self, data: np.ndarray, tokens: Tokens, hits: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, first token, end token) of the paragraphs that hold a token of a whole notice's prefix."""
        hits = hits[self.notice[np.searchsorted(self.prefix, tokens.hashes[hits])]]
        if not len(hits):
            return
        breaks = np.flatnonzero(data == 0x0A)
        solid = np.concatenate([[0], np.cumsum(~SPACE[data])])  # bytes other than white space before each place
        blank = breaks[1:][solid[breaks[1:]] == solid[breaks[:-1] + 1]]  # line breaks that end a blank line
        ends = np.unique(np.concatenate([np.searchsorted(tokens.starts, blank), tokens.offsets]))
        for k in np.unique(np.searchsorted(ends, hits, "right")).tolist():
            a, b = int(ends[k - 1]), int(ends[k])
            yield int(np.searchsorted(tokens.offsets, a, "right")) - 1, a, b

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list, dict]]:
        """(document, words, [(label, first word, words)], {template: containment}) for each document."""
        tokens = tokenize(data, offsets, PUNCT)
        h, off = tokens.hashes, tokens.offsets
        found: dict[int, list] = defaultdict(list)
        for phrase, label in self.phrases:
            n = len(phrase)
            if len(h) >= n:
                places = np.flatnonzero(h[: len(h) - n + 1] == phrase[0])
                for k in range(1, n):
                    places = places[h[places + k] == phrase[k]]
                docs = np.searchsorted(off, places, "right") - 1
                for p, d in zip(places[places + n <= off[docs + 1]], docs[places + n <= off[docs + 1]]):
                    found[int(d)].append((label, int(p - off[d]), n))
        met: dict[int, dict] = defaultdict(dict)
        if len(self.prefix):
            at = np.minimum(np.searchsorted(self.prefix, h), len(self.prefix) - 1)
            hits = np.flatnonzero(self.prefix[at] == h)
            if len(hits):
                breaks = np.flatnonzero(data == 0x0A)
                every = np.searchsorted(breaks, tokens.starts)
                lines = every[hits]
                docs = np.searchsorted(off, hits, "right") - 1
                for line, doc in sorted({(int(a), int(b)) for a, b in zip(lines, docs)}):
                    begin = max(int(breaks[line - 1]) if line else 0, int(offsets[doc]))
                    end = min(int(breaks[line]) if line < len(breaks) else len(data), int(offsets[doc + 1]))
                    a, b = np.searchsorted(tokens.starts, [begin, end])
                    for i, shared in self.block(h[a:b].tolist()).items():
                        met[doc][i] = max(met[doc].get(i, 0.0), shared / len(self.templates[i].tokens))
                for doc, a, b in self.paragraphs(data, tokens, hits):
                    for i, shared in self.block(h[a:b].tolist(), notices=True).items():
                        met[doc][i] = max(met[doc].get(i, 0.0), shared / len(self.templates[i].tokens))
                for doc, i, shared in self.windows(h, off, every):
                    met[doc][i] = max(met[doc].get(i, 0.0), shared / len(self.templates[i].tokens))
        for d in range(len(off) - 1):
            yield d, int(off[d + 1] - off[d]), sorted(found.get(d, ()), key=lambda x: x[1]), met.get(d, {})


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per document: base phrases with their places, labels of met templates, best score.

    ``spans`` lists base places as label@word. Score is 1 where a base phrase stands, else the
    best containment met, else 0. Null and empty texts have no words and no labels; null ids are
    carried, repeated rows stay rows, extra columns are not read, a very long text is read whole
    (its paragraphs at once, as sets of words), and an empty table gives none.
    """
    templates = TEMPLATES if templates is None else templates
    notices = NOTICES if notices is None else notices
    frequency = token_frequency(docs, {**templates, **notices})
    scanner = Scanner(ordered_templates(templates, threshold, frequency, notices), frequency)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string()]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = []
            for first, _, data, offsets in text_slices(batch.column(1)):
                for d, n, base, met in scanner.scan(data, offsets):
                    starts = [x[1] for x in base]
                    base_labels = {x[0] for x in base}
                    labels = base_labels | {scanner.templates[i].label for i in met}
                    score = 1.0 if base else max(met.values(), default=0.0)
                    spans = ",".join(f"{x[0]}@{x[1]}" for x in base)
                    out.append((ids[first + d], n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(stream, SCHEMA)
