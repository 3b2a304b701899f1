"""Own merges against the installed library."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from valsieve.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TREE = bpe.load_tree(PATH)
TEXTS = [
    "", "   ", None, "Hello, wörld!! don't I'LL 1234", "ΣΑΣ ς İstanbul é ﬁ ½", "a<|endoftext|>b <|startoftext|><|endoftext|> <|endof",
    "a\x85b\xa0c d​e\x1cf", "漢字かな 🙂🙂", "ab" * 4000, "a" * 3000 + "!" * 70, "Hello, wörld!! don't I'LL 1234",
]


def wanted(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_whole_table_matches_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").union(extra).collect()}
    got = bpe.encode(docs.select("doc_id", "text").union(extra), PATH).cache()
    for r in got.collect():
        ids, said = wanted(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()
    back = {r.doc_id: r.decoded for r in bpe.decode(got, PATH).collect()}
    assert all(back[i] == wanted(t)[1] for i, t in texts.items())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aábcdetinABΣσς'.,!1٢漢🙂\t\n\x85\xa0 ́<|>\x1c", max_size=60))
def test_any_text(text):
    assert list(TREE.encode_pieces([text])[0]) == wanted(text)[0]


@pytest.mark.parametrize("width", [2, 4, 64])
def test_merges_equal_the_plain_loop(width):
    rng = np.random.default_rng(width)
    words = ["".join(rng.choice(list("thanerio"), rng.integers(1, width + 1))) for _ in range(200)]
    ranks = {k: i for i, k in zip(TREE.order.tolist(), TREE.keys.tolist(), strict=True)}
    for word, got in zip(words, TREE.encode_tokens([w.encode() for w in words]), strict=True):
        symbols = [int(TREE.inner[ord(c)]) for c in word[:-1]] + [int(TREE.last[ord(word[-1])])]
        while True:
            found = [(ranks[k], i) for i in range(len(symbols) - 1) if (k := symbols[i] * TREE.base + symbols[i + 1]) in ranks]
            if not found:
                break
            rank, i = min(found)
            symbols[i:i + 2] = [int(TREE.made[rank])]
        assert got.tolist() == symbols


def test_empty_table_and_missing_id(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, ids string")
    assert bpe.encode(none, PATH).count() == 0
    row = bpe.encode(spark.createDataFrame([(None, None, "x")], none.schema), PATH).first()
    assert row.doc_id is None and row.n_tokens == 0 and row.decoded_sha256 == hashlib.sha256(b"").hexdigest()


def batch_of(texts):
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abÀÉéßÿ×÷ªΣς'.,!?;:1 \n\x85́<|>İǅ", max_size=30), max_size=6))
def test_batches_equal_the_library(texts):
    texts = [*texts, "a<|endoftext|>b", None]
    got = [r for b in bpe.encode_batches([batch_of(texts)], PATH, True) for r in b.to_pylist()]
    for row, text in zip(got, texts, strict=True):
        ids, said = wanted(text)
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["decoded_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_a_full_store_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_TOKENS", 50)
    store = bpe.TokenStore(TREE)
    rng = np.random.default_rng(4)
    for _ in range(12):
        words = sorted({"".join(rng.choice(list("thanerio"), rng.integers(1, 7))) for _ in range(40)})
        ids, counts = store.pieces(pa.array([w + "!" * int(rng.integers(3)) for w in words], pa.large_string()))
        named = pa.array(words, pa.large_string())
        at = store.places(named)
        assert [store.ids[s:s + c].tolist() for s, c in zip(store.starts[at].tolist(), store.counts[at].tolist(), strict=True)] == [wanted(w)[0] for w in words]
        assert len(store.tokens) <= 50 + 80 and counts.sum() == len(ids)


def test_repeated_rows_and_long_texts(spark):
    texts = ["word " * 50_000, "word " * 50_000, "x" * 70_000, "a.b,c", "a.b,c"]
    rows = bpe.encode(spark.createDataFrame([(7, t) for t in texts], "doc_id bigint, text string"), PATH, with_ids=False).collect()
    assert sorted((r.n_tokens, r.ids_sha256) for r in rows) == sorted(
        (len(wanted(t)[0]), hashlib.sha256(np.array(wanted(t)[0], "<u4").tobytes()).hexdigest()) for t in texts)
