"""License scans: phrases, and text blocks that contain most of a license template.

Template tokens are ordered by how often the whole corpus has them, the rarest first. A block is a window of the
document's words, across line breaks, as long as the template with 1 - THRESHOLD of the window for other words; for
TEMPLATES a whole line, however long, is a block too. A document can have a block that contains a template to THRESHOLD
only if it has one of the template's first tokens (prefix filter), enough different words (length filter), and enough
template tokens left behind the first one it has (position filter); what remains is verified by counting in a window
that slides over the places of the template's tokens. Templates are a fixed list, so they are sent to every task.

In a short grant one token tells the license, so its key words must all be in the block, whatever else is changed.

Defined results: a null text is the empty text: no words, places or labels, score 0; repeated rows are scanned each;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the query: phrase and label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Sentences of well-known licenses and notices: label and words.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
]
#: Short grants and notices: label, words, and the key words that a block must have.
GRANTS = [
    ("all-rights-reserved", "All rights reserved", "all rights reserved"),
    ("apache", "Licensed under the Apache License, Version 2.0", "apache"),
    ("apache", "Released under the Apache License", "apache"),
    ("bsd", "Licensed under the BSD License", "bsd"),
    ("bsd", "Released under the BSD License", "bsd"),
    ("cc-by", "Licensed under CC BY 4.0", "cc by"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu"),
    ("gpl", "Licensed under the GNU General Public License, version 3", "gnu"),
    ("gpl", "Released under the GNU General Public License", "gnu"),
    ("isc", "Licensed under the ISC License", "isc"),
    ("isc", "Released under the ISC License", "isc"),
    ("mit", "Licensed under the MIT License", "mit"),
    ("mit", "Released under the MIT License", "mit"),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0", "mozilla"),
    ("mpl", "Released under the Mozilla Public License", "mozilla"),
]
THRESHOLD = 0.8


class Scanner:
    def __init__(self, templates, frequency: dict[bytes, int], threshold: float, phrases: dict[str, str], grants=()):
        self.templates, self.by_token = [], {}
        for k, (label, text, key) in enumerate([*((label, text, "") for label, text in templates), *grants]):
            ws = common.words(text)
            tokens = sorted(set(ws), key=lambda t: (frequency.get(t, 0), t))
            need = max(1, math.ceil(threshold * len(tokens)))
            self.templates.append((label, tokens, need, math.ceil(len(ws) / threshold), set(common.words(key))))
            for t in tokens[: len(tokens) - need + 1]:
                self.by_token.setdefault(t, []).append(k)
        self.phrases = [(b" " + b" ".join(common.words(p)) + b" ", label) for p, label in phrases.items()]
        self.first_tokens, self.tokens = set(self.by_token), {t for _, tokens, *_ in self.templates for t in tokens}

    @staticmethod
    def shared(have, tokens: list[bytes], need: int) -> int:
        """How many of the tokens are there, 0 if fewer than needed."""
        n = 0
        for place, t in enumerate(tokens):
            if n + len(tokens) - place < need:
                return 0
            n += t in have
        return n if n >= need else 0

    @staticmethod
    def window(places: dict[bytes, list[int]], tokens: list[bytes], need: int, width: int, key: set[bytes]) -> int:
        """The most tokens in a window of so many words with all key words, 0 if fewer than needed."""
        best, inside, n = 0, deque(), Counter()
        for at, t in sorted((p, t) for t in tokens for p in places.get(t, ())):
            inside.append((at, t))
            n[t] += 1
            while inside[0][0] <= at - width:
                _, old = inside.popleft()
                n[old] -= 1
                if not n[old]:
                    del n[old]
            if len(n) > best and len(n) >= need and key <= n.keys():
                best = len(n)
        return best

    def blocks(self, text: str, ws: list[bytes]):
        """(label, containment) of each template that a block of the text meets the threshold of."""
        places, lines = {}, None
        for at, w in enumerate(ws):
            if w in self.tokens:
                places.setdefault(w, []).append(at)
        for k in {k for t in places.keys() & self.first_tokens for k in self.by_token[t]}:
            label, tokens, need, width, key = self.templates[k]
            if not key <= places.keys() or not self.shared(places, tokens, need):
                continue
            best = self.window(places, tokens, need, width, key)
            if not key and best < len(tokens):
                if lines is None:
                    lines = [set(common.words(line)) for line in text.split("\n")]
                best = max([best, *(self.shared(have, tokens, need) for have in lines if len(have) >= need)])
            if best:
                yield label, best / len(tokens)

    def phrase_places(self, joined: bytes):
        for phrase, label in self.phrases:
            at, word, last = joined.find(phrase), -1, 0
            while at >= 0:
                word += joined.count(b" ", last, at + 1)
                yield word, label
                last = at + 1
                at = joined.find(phrase, last)

    def scan(self, text: str) -> tuple:
        ws = common.words(text)
        places = list(self.phrase_places(b" " + b" ".join(ws) + b" "))
        base, found = {label for _, label in places}, {}
        if not self.first_tokens.isdisjoint(ws):
            for label, score in self.blocks(text, ws):
                found[label] = max(score, found.get(label, 0))
        starts = [p for p, _ in places]
        return len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), 1.0 if base else max(found.values(), default=0.0)


def token_frequencies(docs: DataFrame, tokens: set[bytes]) -> dict[bytes, int]:
    """Documents of the whole corpus that have each template token; as many rows reach the driver as there are tokens."""

    def run(batches):
        n = Counter()
        for batch in batches:
            for text in common.texts(common.column(batch, "text")):
                n.update(tokens.intersection(common.words(text)))
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    rows = docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"].encode(): r["n"] for r in rows}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES, grants=GRANTS) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest containment; 1 with a phrase)."""
    docs = common.clean_columns(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanner = Scanner(templates, token_frequencies(docs, {w for _, t, *_ in [*templates, *grants] for w in common.words(t)}), threshold, phrases, grants)
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches):
        for batch in batches:
            rows = [scanner.scan(t) for t in common.texts(common.column(batch, "text"))]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=["doc_id", *names])

    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(common.read(spark, sf_dir, "documents"))
