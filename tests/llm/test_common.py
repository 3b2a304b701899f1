"""Words and pieces of Arrow batches against plain Python."""

import re

import pyarrow as pa

from valsieve.llm import common

TEXTS = ["Éa  B\tc", None, "", "ÀÉ ab\x0bC d", " x ", "\x85y\xa0z", "漢 字" * 50] * 40


def test_words_of_slices():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(TEXTS)})
    seen = []
    for piece in common.pieces([batch.slice(3, 200)], "text", 300):
        rows, codes, distinct = common.words_of(common.texts_of(piece))
        distinct.validate(full=True)
        starts = common.starts_of(rows, piece.num_rows)
        words = distinct.to_pylist()
        seen += [[words[c] for c in codes[a:b]] for a, b in zip(starts[:-1], starts[1:])]
    lowered = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in TEXTS[3:203]]
    assert seen == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in lowered]


def test_pieces_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(TEXTS)})
    for limit in (1, 100, 1 << 20):
        assert [t for p in common.pieces([batch], "text", limit) for t in p.column("text").to_pylist()] == TEXTS
