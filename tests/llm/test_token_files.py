"""Separator scans against plain loops over whole files."""

import numpy as np
import public_tokenizers
import pytest

from valsieve.llm import token_files

END = 50256
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain(tokens, end):
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == end:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(tokens):
        out.append((len(out), start, len(tokens) - start, False))
    return out


@pytest.mark.parametrize("size", [2, 4])
@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_scan_of_files(spark, tmp_path, monkeypatch, size, block):
    monkeypatch.setattr(token_files, "GROUP_BLOCKS", 3)
    rng = np.random.default_rng(block)
    files = {
        "random": rng.integers(0, 6, 200), "no-end": np.arange(1, 40), "only-ends": np.zeros(20, int), "empty": np.empty(0, int),
        "long": np.concatenate([np.ones(150, int), [0], np.ones(149, int), [0, 0], np.ones(3, int)]),
    }
    for name, tokens in files.items():
        (tmp_path / name).write_bytes(tokens.astype(token_files.KINDS[size]).tobytes())
    found = token_files.count_tokens(spark, [f"file://{tmp_path}/{n}" for n in files], 0, size, block).collect()
    got = sorted((r.file.rpartition("/")[2], r.ordinal, r.start, r.n_tokens, r.closed) for r in found)
    assert got == sorted((n, *row) for n, tokens in files.items() for row in plain(tokens.tolist(), 0))


def test_broken_file_is_refused(spark, tmp_path):
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole tokens"):
        token_files.count_tokens(spark, [f"{tmp_path}/odd"], 0).collect()


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 1000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(1001, None), (1002, ""), (1002, ""), (None, "a<|endoftext|>b"), (1003, "é漢" * 5000)], docs.schema)
    docs = docs.union(extra)
    encoding = token_files.load_encoding(PATH, PATTERN)
    want = sorted((str(r.doc_id), len(encoding.encode_ordinary(r.text or ""))) for r in docs.collect())
    got = token_files.document_tokens(docs, PATH, PATTERN, END).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    assert token_files.document_tokens(docs.limit(0), PATH, PATTERN, END).count() == 0
