"""Exact and near dedup against brute force on small fixtures and on the documents of sf0.001."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from valsieve.llm import exact_dedup, jaccard_join

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, row_hash string, kept int"


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "x", 7) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def prose(n, seed):
    return " ".join(f"w{(i * seed) % 997}" for i in range(n))


TEXTS = [
    "a  b", "a b", "a\tb", " a b", None, "", " ", "\n", "é\x0bx", "é x", "漢字" * 3000, "漢字" * 3000,
    "漢字" * 2999 + "漢", prose(4000, 31), prose(4000, 31), prose(4000, 31).replace(" ", "\n\n"), prose(4000, 31) + " end", "x" * 50_000,
]


@pytest.mark.parametrize("clash", [False, True])
def test_exact_groups_match_brute_force(spark, clash):
    identifier = (lambda c: F.pmod(F.xxhash64(c), F.lit(3))) if clash else exact_dedup.hash_of
    got = {r.doc_id: r for r in exact_dedup.exact_groups(frame(spark, TEXTS), identifier).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[normal(t)].append(i)
    for text, members in groups.items():
        for i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (members[0], len(members), i == members[0])
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup_of_repeated_rows_missing_ids_and_no_rows(spark):
    docs = frame(spark, ["a", "a", "a", "b", "b", "c c"], [None, 3, 3, None, None, 3])
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()) == [(3, "a"), (3, "c c")]
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["b"]
    assert exact_dedup.keep_first(docs.limit(0)).count() == 0
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def shingles(text, n=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def brute(rows):
    """{id: (rep, class, links)} by all pairs of distinct n-gram sets."""
    sets = defaultdict(list)
    for i, t in rows:
        sets[shingles(t)].append(i)
    keys = [k for k in sets]
    owner = defaultdict(set)
    for k, s in enumerate(keys):
        for g in s:
            owner[g].add(k)
    links = defaultdict(set)
    for k, s in enumerate(keys):
        for other in {o for g in s for o in owner[g]}:
            if other > k and len(s & keys[other]) >= 0.8 * len(s | keys[other]) - 1e-9:
                links[k].add(other)
                links[other].add(k)
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in links:
        for o in links[k]:
            root[find(k)] = find(o)
    first = defaultdict(list)
    for k, s in enumerate(keys):
        first[find(k)] += sets[s]
    return {i: (min(sets[s]), min(first[find(k)]), len(links[k])) for k, s in enumerate(keys) for i in sets[s]}


def same_as_brute(spark, docs):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.rep_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == want
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[1] for w in want.values()})


def test_near_duplicates_of_the_documents(spark):
    same_as_brute(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_near_duplicates_of_edge_cases(spark):
    base = prose(200, 7).split()
    texts = [None, "", " ", "one", "ONE", "one two three", "one two three four five", prose(30_000, 11), prose(30_000, 11) + " end"]
    texts += [" ".join(base), " ".join(base).upper(), " ".join(base[:190] + ["x"]), " ".join(base[8:]), "a a a a a a a"]
    same_as_brute(spark, frame(spark, texts))


def test_a_large_bucket_is_a_grid_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 5)
    base = prose(120, 7).split()
    texts = [" ".join(base[:i] + [f"z{i}"] + base[i + 1:] + ["tail"] * (i % 3)) for i in range(0, 120, 3)]
    same_as_brute(spark, frame(spark, texts + ["other words than those of the group"]))


def test_near_duplicates_of_repeated_rows_and_no_rows(spark):
    docs = frame(spark, ["a b c d e f"] * 4 + ["a b c d e f g"], [None, 3, 3, 5, None])
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(docs).collect()]
    assert sorted(kept, key=str) == [(3, "a b c d e f"), (None, "a b c d e f g")]
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


def test_near_duplicates_without_ids_are_linked(spark):
    base = prose(200, 7).split()
    texts = [" ".join(base), " ".join(base[:198] + ["x", "y"]), " ".join(base[3:]), "other words of no group at all"]
    docs = frame(spark, texts, [None, None, 8, None])
    got = jaccard_join.near_duplicates(docs).collect()
    assert sorted(r.n_links for r in got) == [0, 2, 2, 2]
    assert {r.class_id for r in got if r.n_links} == {8}
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(docs).collect()]
    assert sorted(kept, key=str) == [(8, texts[2]), (None, texts[3])]


def test_bands_reach_the_recall():
    bands, rows = jaccard_join.choose_bands(0.8, 0.99, 128)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.99
    assert 1 - (1 - 0.8 ** (rows + 1)) ** (128 // (rows + 1)) < 0.99
