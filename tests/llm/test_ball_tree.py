"""Ranked search against plain Python over all documents, with pruning checked on blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from valsieve.llm import ball_tree
from valsieve.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=10):
    """Sorted (item_id, rank, doc_id, score)."""
    counts = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    held = [c for c in counts if c[1]]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        wanted = Counter(terms(text))
        ranked = []
        for doc_id, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // total
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, k in wanted.items() if t in c)
            if score > 0:
                ranked.append((-score, doc_id is None, doc_id))
        ranked.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item_id, k + 1, doc_id, -s) for k, (s, _, doc_id) in enumerate(ranked[:top])]
    return sorted(out, key=repr)


def found(spark, docs, items, columns=(), top=10):
    extra = "".join(f", {c} string" for c in columns)
    left = spark.createDataFrame([(*d, *["x"] * len(columns)) for d in docs], "doc_id bigint, text string" + extra)
    right = spark.createDataFrame([(*i, *["x"] * len(columns)) for i in items], "item_id bigint, text string" + extra)
    return sorted((tuple(r) for r in ball_tree.search(left, right, top).collect()), key=repr)


def some_docs(rng, count, words):
    return [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(rng.randrange(1, 60)))) for i in range(count)]


def test_blocks_leaves_and_groups_do_not_change_the_rows(spark, monkeypatch):
    rng = random.Random(3)
    docs = some_docs(rng, 600, 300)
    items = [(k, docs[rng.randrange(600)][1] + " w1 w1") for k in range(30)]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    for name, value in (("BLOCK_TERMS", 500), ("LEAF", 3), ("GROUP", 7), ("ITEM_BYTES", 3000)):
        monkeypatch.setattr(ball_tree, name, value)
    assert found(spark, docs, items) == want


def test_bounds_hold_and_prune():
    rng = random.Random(7)
    sizes = [rng.randrange(1, 30) for _ in range(800)]
    codes = np.concatenate([np.sort(rng.sample(range(400), n)) for n in sizes]).astype(np.int32)
    scores = np.array([rng.randrange(1, 10**6) for _ in codes])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    near = np.arange(790, 800)  # the rows that the item comes from
    for row in near:
        scores[starts[row]:starts[row + 1]] = 900_000
    weights = np.array([rng.randrange(100, 9000) for _ in range(400)])
    own = np.unique(codes[starts[790]:starts[791]])
    items = ball_tree.Items(np.array([0]), None, np.array([0, len(own)]), own, np.ones(len(own), np.int64))
    tree = ball_tree.BallTree(starts, codes, scores * np.sqrt(weights)[codes], 400)
    spots = np.full(400, -1)
    spots[own] = np.arange(len(own))
    bounds = tree.bounds(spots, np.sqrt(weights[own])[None, :])[:, 0]
    dense = np.zeros(400, np.int64)
    dense[own] = weights[own]
    exact = np.add.reduceat(scores * dense[codes], starts[:-1])
    for node, rows in enumerate(tree.members):
        assert bounds[node] >= exact[rows].max()
    search = ball_tree.Search(items, weights, 1)
    search.add(np.arange(800), starts, codes, scores)
    assert search.best[0] == [(-exact.max(), int(np.argmax(exact)))]
    assert search.scored < 800


TEXTS = [None, "", " -- ", "Alpha beta", "ALPHA, beta!", "alpha\x00beta", "élan É alpha", "漢字 alpha-漢字", "beta " * 20_000, "gamma9 9", "alpha beta alpha", "zeta"]


@pytest.mark.parametrize("columns", [(), ("score", "rank", "n", "codes", "item_row")])
def test_edge_cases(spark, columns):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "alpha beta"), (3, "Alpha beta"), (3, "gamma9 9"), (None, None)]
    items = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, "--"), (None, "Beta É 漢字 漢字"), (4, "unknown"), (5, "9 gamma9"), (6, "beta " * 5000)]
    assert found(spark, docs, items, columns) == brute(docs, items)
    assert found(spark, docs, items, columns, top=2) == brute(docs, items, 2)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []


def test_query_matches_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(key, "text").collect()]
                   for name, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = sorted((tuple(r) for r in QUERIES["op11_ball_tree"](spark, folder).collect()), key=repr)
    assert got == brute(docs, items)
