"""Licence scans: an exact set-similarity join of text blocks with licence templates.

A block is a line, a window of a long line, or a window of the whole text, which runs
across line ends, so that a text wrapped at any column is met whole. A template is found in a block if at least
``THRESHOLD`` of its distinct words stand in it. Words are ordered by how many documents hold
them, counted over the whole corpus, rarest first. A block that reaches the threshold
holds one of a template's first k - ceil(t k) + 1 words, so only these are looked
up; the length filter needs as many distinct words in a block as must be shared; the positional filter
needs enough words after the first one found. What is left is verified exactly. Templates that
differ in a word or two also need one of their ``MARKS``, words that stand consecutively in the block:
a share of the words alone can't tell them apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .textbatch import Block, Words, blocks, hash_word, words

THRESHOLD, WINDOW = 0.8, 64
#: A label for each place where these words stand consecutively.
PHRASES = {"apache": "apache license", "gpl": "general public license", "mit": "mit license"}
#: Licence templates; a label may have several.
TEMPLATES = (
    ("mit", "released under the MIT license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the GNU general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the GNU general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under CC BY NC 4 0"),
    ("cc-by-sa", "licensed under CC BY SA 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
)
_GPL = ("general public", "gnu general", "gnu public", "gnu gpl", "the gpl")
#: Templates, by text, whose words other licences nearly hold too: one of these runs of words must stand in the block.
MARKS = {
    "released under the MIT license": ("under the mit", "under mit", "mit license", "mit licence"),
    "licensed under the apache license version 2 0": ("under the apache", "under apache", "apache license", "apache licence", "apache 2"),
    "this work is licensed under the GNU general public license version 3": _GPL,
    "this program is free software you can redistribute it and or modify it under the terms of the GNU general public license": _GPL,
    "this source code form is subject to the terms of the mozilla public license": ("mozilla",),
    "licensed under CC BY NC 4 0": ("by nc",),
    "licensed under CC BY SA 4 0": ("by sa", "nc sa"),
    "this work is licensed under a creative commons attribution 4 0 international license": ("attribution",),
}
#: A mark counts only where none of these words follows it: they make it another licence.
NOT_AFTER = {"attribution": ("noncommercial", "sharealike", "noderivatives", "noderivs", "non", "share", "no")}


def word_set(text: str) -> set[str]:
    found = words(one := _one(text))
    return {bytes(one.data[a:b]).lower().decode() for a, b in zip(found.starts, found.ends, strict=True)}


def _one(text: str) -> Block:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return Block(0, data, np.array([0, len(data)]))


class Templates:
    """Templates as arrays of word hashes, rarest first, with what each must share."""

    def __init__(self, templates: tuple[tuple[str, str], ...], often: dict[int, int], threshold: float):
        self.labels = [label for label, _ in templates]
        self.orders, self.needed, self.prefix = [], [], {}
        for k, (_, text) in enumerate(templates):
            order = sorted((often.get(hash_word(w), 0), hash_word(w)) for w in word_set(text))
            self.orders.append([h for _, h in order])
            self.needed.append(math.ceil(threshold * len(order) - 1e-9))
            for h in self.orders[k][: len(order) - self.needed[k] + 1]:
                self.prefix.setdefault(h, []).append(k)
        run = lambda phrase: [hash_word(w) for w in phrase.split()]
        self.marks = [[(run(m), {hash_word(w) for w in NOT_AFTER.get(m, ())}) for m in MARKS.get(text, ())] for _, text in templates]
        self.lookup = np.array(sorted(self.prefix), dtype=np.uint64)

    def scan(self, block: Block, found: Words, window: int) -> dict[int, dict[str, float]]:
        """For each row with a licence: its labels and the best share of each."""
        out: dict[int, dict[str, float]] = {}
        at = _members(found.hashes, self.lookup)
        if not len(at):
            return out
        rows = np.searchsorted(found.offsets, at, side="right") - 1
        breaks = np.unique(np.concatenate([np.flatnonzero(block.data == 10), block.offsets]))
        line = np.searchsorted(breaks, found.starts, side="right")
        lines = line[at]
        by_line = np.searchsorted(line, lines, side="left"), np.searchsorted(line, lines, side="right")
        by_text = found.offsets[rows], found.offsets[rows + 1]
        held: dict[tuple[int, int], set[int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for begin, end in (by_line, by_text):
            for word, row, first, last in zip(at.tolist(), rows.tolist(), begin.tolist(), end.tolist(), strict=True):
                for start in _windows(word - first, last - first, window):
                    key = first + start, min(first + start + window, last)
                    if key not in held:
                        held[key] = set(found.hashes[slice(*key)].tolist())
                    for k in self.prefix[int(found.hashes[word])]:
                        if (*key, k) in tried:
                            continue
                        tried.add((*key, k))
                        share = self._share(k, held[key])
                        if share and self._marked(k, found.hashes[slice(*key)].tolist()):
                            labels = out.setdefault(row, {})
                            labels[self.labels[k]] = max(labels.get(self.labels[k], 0.0), share)
        return out

    def _share(self, k: int, held: set[int]) -> float:
        """The template's share in a block's words, or 0 if it is below the threshold."""
        order, needed = self.orders[k], self.needed[k]
        if len(held) < needed:
            return 0.0
        first = next((i for i, h in enumerate(order) if h in held), len(order))
        if len(order) - first < needed:
            return 0.0
        shared = sum(h in held for h in order)
        return shared / len(order) if shared >= needed else 0.0

    def _marked(self, k: int, run: list[int]) -> bool:
        """Whether one of the template's marks stands in a block's words; a template without marks needs none."""
        return not self.marks[k] or any(
            run[i : i + len(mark)] == mark and refused.isdisjoint(run[i + len(mark) : i + len(mark) + 1])
            for mark, refused in self.marks[k]
            for i in range(len(run) - len(mark) + 1)
        )


def _windows(at: int, n: int, window: int) -> list[int]:
    """Starts of the windows that hold word ``at`` of ``n`` words: every half window, the last reaching the end."""
    half = max(window // 2, 1)
    first = max(0, (at - window) // half + 1) * half
    return [s for s in range(first, min(at + 1, max(n - half, 1)), half) if s <= at < s + window]


def _members(hashes: np.ndarray, lookup: np.ndarray) -> np.ndarray:
    """Where ``hashes`` are in the sorted ``lookup``."""
    if not len(lookup):
        return np.zeros(0, dtype=np.int64)
    top = np.zeros(1 << 16, dtype=bool)
    top[(lookup >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(top[(hashes >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(lookup, hashes[maybe]), len(lookup) - 1)
    return maybe[lookup[place] == hashes[maybe]]


def document_counts(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, text_col: str = "text") -> dict[int, int]:
    """In how many documents of the whole corpus each word of the templates stands. As many rows reach the driver as templates have words."""
    lookup = np.array(sorted({hash_word(w) for _, text in templates for w in word_set(text)}), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(lookup), dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                found = words(block)
                at = _members(found.hashes, lookup)
                pairs = np.unique(found.row[at] * len(lookup) + np.searchsorted(lookup, found.hashes[at]))
                counts += np.bincount(pairs % len(lookup), minlength=len(lookup))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lookup))), pa.array(counts)], names=["k", "n"])

    sums = map_batches(docs.select(F.col(text_col).alias("text")), run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return {int(lookup[r["k"]]): r["n"] for r in sums.collect()}


def _phrase_places(found: Words) -> list[tuple[str, np.ndarray]]:
    """Word positions, in the block, where each phrase begins within one row."""
    out = []
    for label, phrase in PHRASES.items():
        parts = [np.uint64(hash_word(w)) for w in phrase.split()]
        last = np.flatnonzero(found.hashes == parts[-1])
        at = last - (len(parts) - 1)
        row_begin = found.offsets[np.searchsorted(found.offsets, last, side="right") - 1]
        at = at[at >= row_begin]
        for k, h in enumerate(parts):
            at = at[found.hashes[at + k] == h]
        out.append((label, at))
    return out


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
    window: int = WINDOW,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of ``docs``.

    Null text is empty: 0 words, no labels, score 0. score is the best containment, 1 where a base phrase stands.
    """
    often = document_counts(docs, templates, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Templates(templates, often, threshold)
        for batch in batches:
            for block in blocks(batch.column(1)):
                n = len(block)
                found = words(block)
                n_base = np.zeros(n, dtype=np.int64)
                low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, dtype=np.int64)
                base: dict[int, set[str]] = {}
                for label, at in _phrase_places(found):
                    row = np.searchsorted(found.offsets, at, side="right") - 1
                    n_base += np.bincount(row, minlength=n)
                    np.minimum.at(low, row, at - found.offsets[row])
                    np.maximum.at(high, row, at - found.offsets[row])
                    for r in np.unique(row).tolist():
                        base.setdefault(r, set()).add(label)
                shares = joined.scan(block, found, window)
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, n),
                        pa.array(found.counts.astype(np.int64)),
                        pa.array(n_base),
                        pa.array(low, mask=none),
                        pa.array(high, mask=none),
                        pa.array([",".join(sorted(base.get(r, ()))) for r in range(n)]),
                        pa.array([",".join(sorted(base.get(r, set()) | shares.get(r, {}).keys())) for r in range(n)]),
                        pa.array([1.0 if r in base else max(shares.get(r, {"": 0.0}).values()) for r in range(n)]),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_batches(rows, run, schema)


def _marks_sql(text: str) -> str:
    """Whether one of the template's marks stands in the words ``b`` of a block, which ``j`` holds joined."""
    found = []
    for mark in MARKS[text]:
        if mark in NOT_AFTER:
            run = mark.split()
            here = " AND ".join(f"b[i + {k + 1}] = '{word}'" for k, word in enumerate(run))
            refused = ", ".join(f"'{word}'" for word in NOT_AFTER[mark])
            found.append(f"len(list_filter(range(len(b)), lambda i: {here} AND coalesce(b[i + {len(run) + 1}] NOT IN ({refused}), true))) > 0")
        else:
            found.append(f"contains(j, ' {mark} ')")
    return " OR ".join(found)


def oracle_sql(threshold: float = THRESHOLD, window: int = WINDOW) -> str:
    """The query ``op2`` in DuckDB's SQL: phrases by position, templates by plain containment in every line, window of a line and window of the whole text, and marks."""
    half = window // 2
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cut = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    kinds = ", ".join("({}, '{}', [{}])".format(k, label, ", ".join(f"'{w}'" for w in sorted(word_set(text)))) for k, (label, text) in enumerate(TEMPLATES))
    marked = " ".join(f"WHEN {k} THEN {_marks_sql(text)}" for k, (_, text) in enumerate(TEMPLATES) if text in MARKS)
    places = " UNION ALL ".join(
        "SELECT doc_id, unnest(list_filter(range(len(w)), lambda i: {})) AS place, '{}' AS label FROM base".format(
            " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split())), label
        )
        for label, phrase in PHRASES.items()
    )
    return f"""WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
    base AS (SELECT doc_id, t, regexp_extract_all(t, '{cut}') AS w FROM low),
    places AS ({places}),
    found AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, list(DISTINCT label) AS kinds FROM places GROUP BY doc_id),
    kinds AS (SELECT * FROM (VALUES {kinds}) k(k, label, need)),
    lines AS (SELECT doc_id, regexp_extract_all(unnest(string_split(t, chr(10))), '{cut}') AS w FROM low UNION ALL SELECT doc_id, w FROM base),
    windows AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {half}, 1), {half})) AS s FROM lines),
    sets AS (SELECT doc_id, w[s + 1:s + {window}] AS b, list_distinct(b) AS held, ' ' || array_to_string(b, ' ') || ' ' AS j FROM windows),
    shares AS (SELECT doc_id, label, max(len(list_intersect(held, need)) / len(need)) AS share FROM sets, kinds
        WHERE len(list_intersect(held, need)) >= ceil({threshold} * len(need) - 1e-9) AND CASE k {marked} ELSE true END GROUP BY doc_id, label),
    best AS (SELECT doc_id, max(share) AS share, list(label) AS kinds FROM shares GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(labels, '') AS base_labels,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(found.kinds, []), coalesce(best.kinds, [])))), ',') AS labels,
        CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best.share, 0.0) END::DOUBLE AS score
    FROM base LEFT JOIN found USING (doc_id) LEFT JOIN best USING (doc_id)"""
