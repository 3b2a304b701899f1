"""Fingerprints, edited texts and near pairs against brute force."""

import hashlib

import pyarrow as pa
import pytest

from valsieve.llm import spotsigs

ANCHORS = pa.array(spotsigs.ANCHORS, pa.large_string())


def plain_signatures(text):
    """The chains of one text, as tuples of words."""
    words = [w for w in (x.strip(spotsigs.PUNCTUATION) for x in text.lower().split()) if w]
    common = set(spotsigs.ANCHORS)
    anchors = [i for i, w in enumerate(words) if w in common] or list(range(len(words)))
    out = set()
    for i in anchors:
        chain = [w for w in words[i + 1:] if w not in common][:spotsigs.CHAIN]
        out.add((words[i], *chain))
    return out


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def same_as_brute(spark, docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[:len(text) - half] + after[:half]
        sets = [plain_signatures(t) for t in (text, changed, after)]
        want.append((str(doc_id), len(text), hashlib.sha256(changed.encode()).hexdigest(), round(jaccard(sets[0], sets[1]), 6), round(jaccard(sets[0], sets[2]), 6)))
    got = spotsigs.fingerprints(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 6), round(r.near_next, 6)) for r in got) == sorted(want)
    by_text = {}
    for r, (doc_id, text) in zip(sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), rows, strict=True):
        if [x for x, _ in rows].count(doc_id) == 1:
            assert by_text.setdefault(text, r.fingerprint) == r.fingerprint


@pytest.mark.parametrize("size", [30_000, 1 << 30])
def test_documents(spark, monkeypatch, size):
    monkeypatch.setattr(spotsigs, "RANGE_BYTES", size)
    same_as_brute(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


@pytest.mark.parametrize("size", [10, 1 << 30])
def test_edge_cases(spark, monkeypatch, size):
    monkeypatch.setattr(spotsigs, "RANGE_BYTES", size)
    rows = [(5, None), (3, ""), (3, ""), (None, "the quick"), (9, "the"), (7, "no anchors é 漢字 \U0001f642"), (8, "word " * 20_000), (8, "other"), (-4, "The end. is a")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, part string")
    same_as_brute(spark, docs)
    same_as_brute(spark, docs.where("doc_id = 9"))
    assert spotsigs.fingerprints(docs.limit(0)).count() == 0


def test_near_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    membership, pairs = spotsigs.near_pairs(docs, 0.5)
    sets = {r.doc_id: frozenset(plain_signatures(r.text)) for r in docs.collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert {r.doc_id: r.class_id for r in membership.collect()} == {i: first[s] for i, s in sets.items()}
    classes = sorted(first.values())
    want = {(a, b): round(jaccard(sets[a], sets[b]), 6) for a in classes for b in classes if a < b and sets[a] and jaccard(sets[a], sets[b]) >= 0.5}
    assert {(r.a, r.b): round(r.likeness, 6) for r in pairs.collect()} == want
    assert want
