"""License scan: exact set-similarity join of text blocks with license templates.

A text is lower-cased (A-Z only) and cut into words.  Templates are sets of words; those of
one size class (their word count rounded up to a power of two, L) are compared with the
blocks of 2 L words that start at every L-th word, so any passage of L words lies whole in a block.  A block
meets a template when it holds at least the share ``threshold`` of the template's
different words, that is ``need`` of them.  The join finds every such pair:

* token order: Spark counts in how many blocks every template word occurs, over all texts;
  words are ordered from rare to frequent, ties by the word;
* length filter: a block with fewer than ``need`` template words is no candidate;
* prefix filter: a pair shares one of the first ``size - need + 1`` words
  of the template and one of the first ``length - need + 1`` of the block;
* positional filter: a shared word at place p of the template and q of the block leaves at
  most min(size - p, length - q) shared words from there on;
* the pairs left are compared whole.

Words of no template cannot be shared and are left out before the order is applied.  The
templates are part of the program (at most ``MAX_TEMPLATES``, else an error), so what tasks
carry of them is bounded; texts are never shuffled, a document is one task's work.

Beside the join stand the base phrases: places where their words follow each
other directly.

Defined cases: a NULL text is an empty one (no words, no labels, score 0); rows are scored one by
one, so repeated ids and texts give repeated rows; a NULL id stays NULL; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

THRESHOLD = 0.9
MAX_TEMPLATES = 1000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Usual wordings of license notices, as (label, text).  ``cc`` stands for all Creative
# Commons licenses, the longer labels for their conditions.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance "
               "with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
            "fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc", "Licensed under CC BY 4.0"),
    ("cc", "Licensed under CC BY-SA 4.0"),
    ("cc-nc", "Licensed under CC BY-NC 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("proprietary", "All rights reserved"),
]


def words(text: str | bytes) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.lower`` changes A-Z only."""
    return WORD.findall((text.encode() if isinstance(text, str) else text).lower())


class Template:
    def __init__(self, label: str, text: str, threshold: float):
        self.label, self.words = label, frozenset(words(text))
        self.size = len(self.words)
        self.length = 1 << (max(len(words(text)), 1) - 1).bit_length()
        # the least count whose share reaches the threshold, the division as it is reported
        self.need = next(k for k in range(max(1, ceil(threshold * self.size) - 1), self.size + 1)
                         if k / self.size >= threshold)


def prepare(templates: list[tuple[str, str]], threshold: float) -> dict[int, list[Template]]:
    """Templates by size class; a template without words is an error."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    classes: dict[int, list[Template]] = {}
    for label, text in templates:
        if not words(text):
            raise ValueError(f"template without words: {label}")
        t = Template(label, text, threshold)
        classes.setdefault(t.length, []).append(t)
    return classes


def text_blocks(known: list[tuple[int, bytes]], length: int) -> dict[int, set[bytes]]:
    """The different template words of every block, from (position, word);
    block b covers the words from b * length on, 2 * length of them."""
    out: dict[int, set[bytes]] = {}
    for i, w in known:
        b = i // length
        out.setdefault(b, set()).add(w)
        if b:
            out.setdefault(b - 1, set()).add(w)
    return out


def token_order(docs: DataFrame, classes: dict[int, list[Template]]) -> dict[bytes, int]:
    """Rank of every template word, rare ones first: blocks that hold it, of all
    texts and size classes (a count for each template word comes back)."""
    vocabulary = frozenset(w for ts in classes.values() for t in ts for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for _, texts in text_slices(batches, "text"):
            for text in texts:
                known = [(i, w) for i, w in enumerate(words(text)) if w in vocabulary]
                for length in classes:
                    for block in text_blocks(known, length).values():
                        seen.update(block)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                         ["word", "blocks"])

    rows = docs.select("text").mapInArrow(count, "word binary, blocks long").groupBy("word").agg(F.sum("blocks").alias("n"))
    n = {bytes(r["word"]): r["n"] for r in rows.collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}


class Join:
    """Prefix index of one size class: rank -> (template, place)."""

    def __init__(self, templates: list[Template], rank: dict[bytes, int]):
        self.templates, self.rank = templates, rank
        self.least = min(t.need for t in templates)
        self.index: dict[int, list[tuple[int, int]]] = {}
        self.own: list[frozenset[int]] = []
        for k, t in enumerate(templates):
            order = sorted(rank[w] for w in t.words)
            self.own.append(frozenset(order))
            for p, r in enumerate(order[:t.size - t.need + 1]):
                self.index.setdefault(r, []).append((k, p))

    def matches(self, block: set[bytes]) -> Iterator[tuple[Template, int]]:
        """Templates that the block meets, with the number of shared words."""
        length = len(block)
        if length < self.least:
            return
        order = sorted(self.rank[w] for w in block)
        shared: dict[int, int] = {}
        for q, r in enumerate(order[:length - self.least + 1]):
            for k, p in self.index.get(r, ()):
                t = self.templates[k]
                if length < t.need or q > length - t.need or shared.get(k, 0) < 0:
                    continue
                have = shared.get(k, 0)
                # a pair once ruled out stays so: later places leave less
                shared[k] = have + 1 if have + min(t.size - p, length - q) >= t.need else -1
        found = frozenset(order)
        for k, n in shared.items():
            if n > 0:
                both = len(self.own[k] & found)
                if both >= self.templates[k].need:
                    yield self.templates[k], both


def phrase_places(ws: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    by_last: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for p, label in phrases:
        by_last.setdefault(p[-1], []).append((p, label))
    out = []
    for i, w in enumerate(ws):
        for p, label in by_last.get(w, ()):
            start = i - len(p) + 1
            if start >= 0 and ws[start:i + 1] == p:
                out.append((start, label))
    return out


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
          "matches array<struct<label:string,start:long,words:int,shared:int,size:int>>")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
         threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): its words, the base places, and every (block,
    template) pair at or above ``threshold`` as ``matches`` (start and words of
    the block, shared and all different words of the template)."""
    classes = prepare(templates, threshold)
    rank = token_order(docs, classes)
    vocabulary = frozenset(rank)
    joins = {length: Join(ts, rank) for length, ts in classes.items()}
    listed = [(words(p), label) for p, label in phrases.items()]
    match = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int32()), ("shared", pa.int32()),
                       ("size", pa.int32())])

    def one(text: bytes) -> tuple:
        ws = words(text)
        places = phrase_places(ws, listed)
        known = [(i, w) for i, w in enumerate(ws) if w in vocabulary]
        found = []
        for length, join in joins.items():
            for b, block in sorted(text_blocks(known, length).items()):
                found += [{"label": t.label, "start": b * length, "words": min(2 * length, len(ws) - b * length),
                           "shared": n, "size": t.size} for t, n in join.matches(block)]
        starts = [s for s, _ in places]
        return (len(ws), len(places), min(starts, default=None), max(starts, default=None),
                sorted({label for _, label in places}), found)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            cols = list(zip(*[one(t) for t in texts]))
            types = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(match)]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "matches"]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")), *[pa.array(c, t) for c, t in zip(cols, types)]],
                ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(rows, SCHEMA)


def score():
    """1 for a base place, else the largest share of a template that a block holds, 0 without a match."""
    share = F.transform("matches", lambda m: m["shared"] / m["size"])
    return F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(share), F.lit(0.0)))


def sql(templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
        threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of the query's columns: every block against every template."""
    values = ", ".join(f"({k}, '{t.label}', {t.length}, {t.size}, {t.need}, [{', '.join(repr(w.decode()) for w in sorted(t.words))}])"
                       for k, t in enumerate(t for ts in prepare(templates, threshold).values() for t in ts))
    places = " UNION ALL ".join(
        "SELECT r, i, '{}' AS label FROM nxt WHERE {}".format(
            label, " AND ".join(f"w{k} = '{w.decode()}'" for k, w in enumerate(words(p)))) for p, label in phrases.items())
    depth = max(len(words(p)) for p in phrases)
    lead = ", ".join(f"lead(w, {k}) OVER (PARTITION BY r ORDER BY i) AS w{k}" for k in range(1, depth))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
t(k, label, len, size, need, ws) AS (VALUES {values}),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
nxt AS (SELECT r, i, w AS w0, {lead} FROM w),
base AS ({places}),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
tw AS (SELECT k, label, len, size, need, unnest(ws) AS w FROM t),
hit AS (SELECT w.r, tw.k, tw.label, tw.size, tw.need, w.i // tw.len AS b, tw.len, w.w FROM w JOIN tw USING (w)),
both_blocks AS (SELECT r, k, label, size, need, b, w FROM hit UNION SELECT r, k, label, size, need, b - 1, w FROM hit WHERE b > 0),
met AS (SELECT r, label, count(DISTINCT w) / size AS share FROM both_blocks GROUP BY r, k, label, size, need, b
        HAVING count(DISTINCT w) >= need),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM
        (SELECT r, label FROM met UNION SELECT r, label FROM base) GROUP BY r),
s AS (SELECT r, max(share) AS share FROM met GROUP BY r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)"""
