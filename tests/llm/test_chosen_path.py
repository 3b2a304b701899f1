"""The chosen-path join against brute force over all pairs: small fixtures, hot groups and the whole documents of sf0.001 and sf0.01."""

import random
import re
from collections import defaultdict

import pytest

from valsieve.llm import chosen_path
from valsieve.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """Sorted (doc_id, n_shingles, component_id, kept) by all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    posts = defaultdict(list)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in posts[x]:
                common[j] += 1
            posts[x].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        key = (doc_id is None, doc_id or 0)
        least[root(i)] = min(least.get(root(i), key), key)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        missing, value = least[root(i)]
        component = None if missing else value
        out.append((doc_id, len(sets[i]), component if sets[i] else doc_id, doc_id == (component if sets[i] else doc_id)))
    return sorted(out, key=repr)


def found(spark, rows, columns=()):
    schema = "doc_id bigint, text string" + "".join(f", {c} string" for c in columns)
    docs = spark.createDataFrame([(*r, *["x"] * len(columns)) for r in rows], schema)
    return sorted((tuple(r) for r in chosen_path.near_duplicates(docs).collect()), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_trees_reach_the_recall():
    assert chosen_path.survival(0.8, 1) == pytest.approx(0.75 * 0.8 + 0.25 * 0.96)
    chance = chosen_path.survival(0.8, chosen_path.DEPTH)
    trees = chosen_path.choose_trees(0.8)
    assert 1 - (1 - chance) ** trees >= chosen_path.RECALL > 1 - (1 - chance) ** (trees - 1)
    with pytest.raises(ValueError):
        chosen_path.choose_trees(0.4)


def test_edge_cases(spark):
    long = " ".join(f"w{i % 4001}" for i in range(30_000))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "one two"), (6, "two one"), (7, "one two one two"), (None, "ONE two"),
            (None, "lonely row"), (9, long), (8, long + " end"), (9, long), (10, "a b c d e f"), (11, "a b c d e f g"), (12, "漢 字 é"), (12, "other")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, ("node", "digest", "component_id", "size", "row")) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_threshold_is_exact(spark):
    base = [f"w{i}" for i in range(46)]  # 45 shingles; a new last word each: 44 of 46 ... down to 40 of 50
    rows = [(k, " ".join(base[:46 - k] + [f"x{k}_{i}" for i in range(k)])) for k in range(12)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("small, block", [(512, 768), (4, 12)])
def test_near_copies_in_large_groups(spark, monkeypatch, small, block):
    monkeypatch.setattr(chosen_path, "SMALL", small)
    monkeypatch.setattr(chosen_path, "BLOCK_MEMBERS", block)
    rng = random.Random(8)
    rows = []
    for family in range(4):
        words = [f"f{family}w{rng.randrange(90)}" for _ in range(120)]
        for _ in range(60):
            rows.append((len(rows), edited(rng, words, rng.randrange(9))))
        rows += [(len(rows) + i, " ".join(words)) for i in range(20)]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_all_pairs(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_chosen_path"](spark, folder).collect()), key=repr)
    assert got == brute(docs)
    assert sum(not r[3] for r in got) > 3
