"""Operator 3: license scans by an exact set-similarity join with templates.

A text's words fall into blocks that overlap by half: of BLOCK words, or of twice the longest template's where that is more,
so that every template lies whole in some block wherever it begins.  A template is found in a block that holds at
least CONTAINED of its distinct words.  Template words are ordered by the number of documents they are in, over all
documents, rarest first.  A template's prefix is its first |T| - need + 1 words: a block without any of them cannot
reach the need.  Blocks shorter than the need are skipped (length filter), and at the first shared word at places i
and j of the two ordered sets no more than 1 + min(|T| - i - 1, |B| - j - 1) words can be shared (positional filter).
What passes is compared exactly.  Templates are few and fixed, so they go to every task; documents are never shuffled.

Base phrases are counted where their words stand consecutively.  Null and empty texts have no words and no labels.  Rows
keep ids and repeats; other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common

BLOCK, CONTAINED = 96, 0.8
BLOCK_BYTES = 4 << 20

# The base phrases, and notices of common licenses with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Bytes outside words become spaces; a word's bytes are digits, lower-case letters and all of non-ASCII characters.
_WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def dense(raw: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased."""
    return raw.lower().translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    label: str
    ordered: tuple[bytes, ...]
    need: int

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.ordered[: len(self.ordered) - self.need + 1]


class Index:
    """Templates behind their prefixes."""

    def __init__(self, frequency: dict[bytes, int], templates=TEMPLATES, contained: float = CONTAINED):
        vocabulary = {w for _, t in templates for w in dense(t.encode())}
        self.order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates = []
        for label, t in templates:
            own = tuple(sorted(set(dense(t.encode())), key=self.order.__getitem__))
            self.templates.append(Template(label, own, math.ceil(contained * len(own) - 1e-9)))
        #: Words from one block to the next; a block is twice as long.
        self.stride = max(BLOCK // 2, *(len(dense(t.encode())) for _, t in templates), 0)
        self.by_word: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            for i, w in enumerate(t.prefix):
                self.by_word.setdefault(w, []).append((k, i))

    def blocks(self, words: list[bytes]) -> Iterator[tuple[int, int, float]]:
        """(template, block's first word, containment) of every block and template that reach the threshold."""
        if self.by_word.keys().isdisjoint(words):
            return
        step = self.stride
        # the last block is the first that reaches the end
        hit = {b for i, w in enumerate(words) if w in self.by_word for b in (i // step - 1, i // step) if b == 0 or 0 < b and (b + 1) * step < len(words)}
        for b in sorted(hit):
            block = set(words[b * step : (b + 2) * step])
            ordered = sorted((w for w in block if w in self.order), key=self.order.__getitem__)
            seen: set[int] = set()
            for j, w in enumerate(ordered):
                for k, i in self.by_word.get(w, ()):
                    t = self.templates[k]
                    if k in seen:
                        continue
                    seen.add(k)
                    if len(block) < t.need or 1 + min(len(t.ordered) - i - 1, len(ordered) - j - 1) < t.need:
                        continue
                    shared = sum(x in block for x in t.ordered)
                    if shared >= t.need:
                        yield k, b * step, shared / len(t.ordered)

    def find(self, words: list[bytes]) -> dict[int, float]:
        """Template -> greatest containment, of those that reach the threshold in some block."""
        found: dict[int, float] = {}
        for k, _, share in self.blocks(words):
            found[k] = max(found.get(k, 0.0), share)
        return found


def places(words: list[bytes], phrases=PHRASES) -> list[tuple[int, str]]:
    """(start, label) of every place of a phrase, by start."""
    found = []
    for phrase, label in phrases:
        p = dense(phrase.encode())
        if p[0] not in words:
            continue
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i] == p[0] and words[i : i + len(p)] == p]
    return sorted(found)


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """Documents that hold each template word, over all documents; as many rows as templates have words."""
    vocabulary = frozenset(w for _, t in templates for w in dense(t.encode()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for whole in batches:
            for raw in common.text_bytes(whole.column(0)):
                c.update(vocabulary.intersection(dense(raw)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_text(raw: bytes, index: Index) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
    words = dense(raw)
    base = places(words)
    found = index.find(words)
    own = sorted({x for _, x in base})
    every = sorted({*own, *(index.templates[k].label for k in found)})
    score = 1.0 if base else max(found.values(), default=0.0)
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(own), ",".join(every), score)


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """RESULT of every document."""
    common.bound_batches(docs.sparkSession)
    index = Index(frequencies(docs, templates), templates)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("license_scan", lambda: None)
        for whole in batches:
            for b in common.blocks(whole, 1, BLOCK_BYTES):
                rows = [scan_text(raw, index) for raw in common.text_bytes(b.column(1))]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


BLOCKS = "doc_id long, label string, template int, first_word long, n_words long, containment double"


def scan_blocks(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """BLOCKS: every block of every document with each template that it holds, by the template's number and the block's place."""
    common.bound_batches(docs.sparkSession)
    index = Index(frequencies(docs, templates), templates)
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.blocks(whole, 1, BLOCK_BYTES):
                rows = []
                for doc_id, raw in zip(b.column(0).to_pylist(), common.text_bytes(b.column(1)), strict=True):
                    words = dense(raw)
                    rows += [(doc_id, index.templates[k].label, k, start, min(2 * index.stride, len(words) - start), share) for k, start, share in index.blocks(words)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
