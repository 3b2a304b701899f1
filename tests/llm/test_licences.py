"""Licence scan against all windows of small texts."""

import random

import pytest

from valsieve.llm import licences


def brute(text):
    """Best likeness of each licence over all windows."""
    words = licences.plain_words(text)
    best = {}
    for name, template in licences.TEMPLATES:
        own = licences.plain_words(template)
        target = set(zip(own, own[1:]))
        for a in range(len(words)):
            for b in range(a + 2, len(words) + 1):
                window = set(zip(words[a:b], words[a + 1:b]))
                value = 2 * len(window & target) / (len(window) + len(target))
                if value >= licences.SIMILARITY - 1e-12 and value > best.get(name, 0) + 1e-12:
                    best[name] = value
    return best


def texts():
    random.seed(3)
    templates = [t for _, t in licences.TEMPLATES]
    out = [None, "", "word", "all rights", "All rights reserved. All rights reserved.", *templates]
    for _ in range(40):
        words = random.choice(templates).split()
        for _ in range(random.randint(0, 3)):
            words[random.randrange(len(words))] = random.choice(["x", "the", "license", "of"])
        out.append(" ".join(["some words before it"] * random.randint(0, 2) + words + random.choice(templates).split()[:random.randint(0, 9)]))
    return out


def test_best_passages(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, licence string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    for i, text in rows:
        want, r = brute(text or ""), got[i]
        assert r.licences == ",".join(sorted(want)) and r.n_licences == len(want)
        assert r.dice == pytest.approx(max(want.values(), default=0.0))
        assert (r.licence is None) == (not want)
        if want:
            passage = licences.plain_words(text)[r.first_word:r.last_word + 1]
            assert brute(" ".join(passage))[r.licence] == pytest.approx(r.dice)


def test_documents_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    texts_ = {r.doc_id: r.text for r in docs.collect()}
    for r in licences.scan(docs).collect():
        assert all(name in r.licences.split(",") for line, name in lines.items() if line in texts_[r.doc_id])
    long = spark.createDataFrame([(None, "All rights reserved " * 20_000), (1, "w " * 100_000)], "doc_id bigint, text string")
    assert sorted(str(r.licence) for r in licences.scan(long).collect()) == ["None", "reserved"]
    assert licences.scan(docs.limit(0)).count() == 0
