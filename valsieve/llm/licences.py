"""Licence scan: passages compared with licence templates by Dice over word bigrams.

Texts are normalised: lower case, words between white space, punctuation at their
ends removed.  A passage is any run of words.  Its likeness to a template is twice
the number of shared distinct bigrams over the sum of both numbers of distinct
bigrams.  A likeness of t needs sizes within t / (2 - t) and (2 - t) / t of the
template's, so templates that a text is too short for are passed over, windows have
a largest length, and only windows that hold enough template bigrams are compared.
The best passage begins and ends with a shared bigram, so only those are tried: the
result is the best over all passages of the whole text.

One row per document: its best licence (ties: the template named first), likeness
and passage, and all licences that reach the similarity.  Null texts count as
empty; a document without a licence has nulls and zero.  Repeated rows each give a
row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from valsieve.llm.common import pieces, ship, starts_of, texts_of, words_of

SIMILARITY = 0.8
PUNCTUATION = "\"'“”‘’«»()[]{}<>.,;:!?*#%&$|`=_/\\-"
#: Public licence notices; a licence may have several.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met:"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("reserved", "All rights reserved."),
)


def plain_words(text: str) -> list[str]:
    words = (w.strip(PUNCTUATION) for w in text.lower().split())
    return [w for w in words if w]


class Templates:
    """Bigrams of all templates, by number."""

    def __init__(self, templates=TEMPLATES, similarity: float = SIMILARITY):
        self.names = [name for name, _ in templates]
        self.similarity = similarity
        words = [plain_words(text) for _, text in templates]
        self.words = sorted({w for ws in words for w in ws})
        number = {w: i for i, w in enumerate(self.words)}
        sets = [{number[a] * len(self.words) + number[b] for a, b in zip(ws, ws[1:], strict=False)} for ws in words]
        self.keys = np.array(sorted(set().union(*sets)), dtype=np.int64)
        self.sizes = [len(s) for s in sets]
        self.holds = np.array([[int(k) in s for k in self.keys] for s in sets], dtype=bool)
        t = similarity
        #: Bigrams that a passage must share with a template at least, and hold at most.
        self.least = [max(1, math.ceil(m * t / (2 - t) - 1e-9)) for m in self.sizes]
        self.most = [math.floor(m * (2 - t) / t + 1e-9) for m in self.sizes]


def best_passage(spots, marks, pairs, size: int, least: int, most: int, similarity: float):
    """Best (likeness, start, end) among passages from one of ``spots`` to another, or None.

    ``spots``: places of shared bigrams in one text, ascending; ``marks``: which ones;
    ``pairs``: the bigram at every place of the text.  Repetitions make a passage
    longer than its distinct bigrams, so length isn't limited where they occur.
    """
    best = None
    for i in range(len(spots)):
        shared, seen, place = set(), set(), spots[i]
        for j in range(i, len(spots)):
            seen.update(pairs[place:spots[j] + 1])
            place = spots[j] + 1
            shared.add(marks[j])
            if len(seen) > most:
                break
            if len(shared) >= least:
                value = 2 * len(shared) / (size + len(seen))
                if value >= similarity - 1e-12 and (best is None or value > best[0] + 1e-12):
                    best = (value, spots[i], spots[j] + 1)
        if best and best[0] == 1:
            break
    return best


def scan_batches(batches, templates: Templates):
    """Arrow task: the licences of each text."""
    vocabulary = pa.array(templates.words, pa.large_string())
    width = len(templates.words)
    for batch in pieces(batches, "text"):
        rows, codes, distinct = words_of(pc.utf8_lower(texts_of(batch)), lower=False)
        bare = pc.utf8_trim(distinct, PUNCTUATION)
        bare_codes = bare.dictionary_encode()
        same = bare_codes.indices.to_numpy(zero_copy_only=False)
        filled = pc.greater(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
        known = pc.fill_null(pc.index_in(bare, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        keep = filled[codes] if len(codes) else np.empty(0, bool)
        rows, codes = rows[keep], codes[keep]
        starts = starts_of(rows, batch.num_rows)
        found: list[dict] = [{} for _ in range(batch.num_rows)]
        if len(codes) > 1:
            word, number = same[codes].astype(np.int64), known[codes]
            pair = word[:-1] * (int(same.max()) + 1) + word[1:]
            key = np.where((number[:-1] >= 0) & (number[1:] >= 0) & (rows[:-1] == rows[1:]), number[:-1] * width + number[1:], -1)
            at = np.minimum(np.searchsorted(templates.keys, key), len(templates.keys) - 1)
            hit = templates.keys[at] == key
            places, marks = np.flatnonzero(hit), at[hit]
            for k, name in enumerate(templates.names):
                own = templates.holds[k][marks]
                where, which = places[own], marks[own]
                edges = np.searchsorted(rows[where], np.arange(batch.num_rows + 1))
                for row in np.flatnonzero(np.diff(edges) >= templates.least[k]).tolist():
                    a, b = edges[row], edges[row + 1]
                    # Spots far from all others can't be in a passage with enough of them.
                    spots, kinds = where[a:b], which[a:b]
                    if len(np.unique(kinds)) < templates.least[k]:
                        continue
                    first, stop = int(starts[row]), int(starts[row + 1])
                    got = best_passage((spots - first).tolist(), kinds.tolist(), pair[first:stop - 1].tolist(), templates.sizes[k],
                                       templates.least[k], templates.most[k], templates.similarity)
                    if got and got[0] > found[row].get(name, (0.0,))[0] + 1e-12:
                        found[row][name] = got
        best = [max(f.items(), key=lambda item: item[1][0], default=(None, (0.0, None, None))) for f in found]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "licence": pa.array([b[0] for b in best], pa.string()),
            "dice": pa.array([float(b[1][0]) for b in best]), "first_word": pa.array([b[1][1] for b in best], pa.int64()),
            "last_word": pa.array([b[1][2] for b in best], pa.int64()), "n_licences": pa.array([len(f) for f in found], pa.int64()),
            "licences": pa.array([",".join(sorted(f)) for f in found], pa.string())})


def scan(docs: DataFrame, templates=TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, licence, dice, first_word, last_word, n_licences, licences.

    ``first_word`` and ``last_word`` count the normalised words of the text from 0.
    """
    ship(docs.sparkSession)
    known = Templates(templates, similarity)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, licence string, dice double, first_word bigint, last_word bigint, n_licences bigint, licences string"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: scan_batches(batches, known), schema)
