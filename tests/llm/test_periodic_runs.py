"""Runs against brute force: random words, periodic texts, edge cases, and the whole documents of sf0.001."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from valsieve.llm import periodic_runs
from valsieve.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def brute(words, least=24, times=3):
    """Start, length and smallest period of every run, by start and period."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def expected(doc_id, text, marked=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if marked and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    gone = set()
    for s, length, q in runs:
        gone.update(range(s + q, s + length))
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def test_random_words_match_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        docs = []
        for _ in range(rng.randint(1, 8)):
            n, k = rng.randint(0, 160), rng.choice([1, 2, 3, 8, 50])
            words = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
                words = words[:a] + [words[min(n - 1, a + i % p)] for i in range(n - a)]
            docs.append(words)
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        found = periodic_runs.runs_of(np.array(sum(docs, []), dtype=np.int32), starts)
        got = [[] for _ in docs]
        for text, *run in zip(*[x.tolist() for x in found], strict=True):
            got[text].append(tuple(run))
        assert got == [brute(d) for d in docs]


def test_extensions_by_grammar_are_exact():
    rng = np.random.default_rng(3)
    words = np.concatenate([np.tile(rng.integers(0, 3, 7), 30), rng.integers(0, 2, 300), np.zeros(100, int)]).astype(np.int32)
    levels = periodic_runs.grammar(words, np.array([0]))
    assert len(levels[-1].symbols) < 8
    left = rng.integers(0, len(words) - 1, 400)
    right = np.array([rng.integers(x + 1, len(words)) for x in left])
    plain = [next((i for i in range(len(words) - b) if words[a + i] != words[b + i]), len(words) - b) for a, b in zip(left, right, strict=True)]
    got = periodic_runs.extensions(levels, left, right, np.full(400, len(words)))
    assert got.tolist() == plain


def test_grid_bounds_do_not_change_the_runs(monkeypatch):
    words = np.tile(np.arange(9), 40).astype(np.int32)
    whole = [x.tolist() for x in periodic_runs.runs_of(words, np.array([0, 360]))]
    monkeypatch.setattr(periodic_runs, "POINTS", 50)
    assert [x.tolist() for x in periodic_runs.runs_of(words, np.array([0, 360]))] == whole == [[0], [0], [360], [9]]


TEXTS = [None, "", " \n\t", "one", "a " * 23, "a " * 24, "a b " * 12, "é x y\x0bz " * 9, "漢字 " * 3000, "x" * 100_000,
         " ".join(f"w{i % 1000}" for i in range(3000)), " ".join(f"w{i % 1001}" for i in range(3000)), "a b " * 12]


@pytest.mark.parametrize("clash", [False, True])
def test_edge_cases(spark, clash):
    ids = [*range(len(TEXTS) - 2), None, 3]  # a missing and a repeated id
    rows = [(i, t, "x", "y", 1) for i, t in zip(ids, TEXTS, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mark string, runs string, n_runs int")
    docs = docs if clash else docs.select("doc_id", "text")
    got = sorted((tuple(r) for r in periodic_runs.marked_runs(docs).collect()), key=repr)
    assert got == sorted(((i, *expected(i, t)) for i, t in zip(ids, TEXTS, strict=True)), key=repr)


def test_runs_and_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "b " + "a b c " * 9 + "d"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in periodic_runs.find_runs(docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 27, 3)] and got[1].collapsed == "b a b c d"
    assert got[2].runs == [] and got[2].collapsed == "" and got[2].start is None


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert periodic_runs.find_runs(docs).count() == 0 and periodic_runs.marked_runs(docs).count() == 0


def test_query_matches_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    short = [d for d in docs if len((d.text or "").split()) <= 800 or zlib.crc32(str(d.doc_id).encode()) % 10 == 0]
    assert {d.doc_id: got[d.doc_id] for d in short} == {d.doc_id: expected(d.doc_id, d.text) for d in short}
    assert sum(got[d.doc_id][0] > 0 for d in docs) > 5


def test_mark_column_is_read_as_unsigned(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b c d " * 10).alias("text"))
    assert all(tuple(r)[1:] == expected(r.doc_id, "a b c d " * 10) for r in periodic_runs.marked_runs(docs).collect())
