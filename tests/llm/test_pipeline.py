"""The corpus pipeline, stage by stage, against plain Python on a small table."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from valsieve.llm import mixing, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, kept string, row_hash int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def small_corpus():
    rng = random.Random(6)
    plain = [" ".join(rng.choice(["river", "stone", "cloud", "forest", "market", "letter", "window", "garden"]) + str(rng.randrange(90)) for _ in range(60)) for _ in range(30)]
    texts = list(plain)
    texts += [t.replace(" ", "  \n", 3) for t in plain[:5]]  # equal but for white space
    texts += [" ".join([*t.split()[:-1], "changed"]) for t in plain[5:10]]  # near copies
    texts += [f"you {w} and 1d10t {plain[i][:80]}" for i, w in enumerate(["idiot", "moron", "stupid"] * 8)]
    texts += [None, "", "one", plain[0]]
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}", None if t is None else len(t), "x", i) for i, t in enumerate(texts)]
    labels = [(i, 1, int(30 + 10 <= i < 30 + 10 + 24)) for i in range(len(texts) - 4)]
    return [*rows, rows[20], (None, plain[12] + " tail", None, None, 1, None, None)], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = small_corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_each_stage_matches_plain_python(spark, folder):
    docs = corpus_pipeline.table(spark, folder, "documents")
    stages, kept = dict(corpus_pipeline.STAGES), {}
    assert list(stages) == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "bpe"]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, folder), f"test-{name}")
        assert docs.columns == corpus_pipeline.table(spark, folder, "documents").columns
        kept[name] = listed(docs)
    whole = listed(corpus_pipeline.table(spark, folder, "documents"))
    # toxicity: rows below the threshold, each as often as it came
    scores = toxicity.toxicity(corpus_pipeline.table(spark, folder, "documents"), corpus_pipeline.table(spark, folder, "labels")).collect()
    gone = {r.doc_id for r in scores if r.predicted}
    assert kept["toxicity"] == [r for r in whole if r[0] not in gone] and len(gone) > 10
    # exact dedup: the first of equal texts
    firsts = {}
    for row in kept["toxicity"]:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", row[1] or "")
        order = (row[0] is None, row[0] or 0)
        firsts[key] = min(firsts.get(key, (order, row)), (order, row), key=lambda x: x[0])
    assert kept["exact_dedup"] == sorted((row for _, row in firsts.values()), key=repr)
    # near copies: the first of each component
    rows = kept["exact_dedup"]
    sets = [frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in (words(r[1]) for r in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    groups = {}
    for i, row in enumerate(rows):
        order = (row[0] is None, row[0] or 0)
        key = root[i] if sets[i] else "empty"
        groups[key] = min(groups.get(key, (order, row)), (order, row), key=lambda x: x[0])
    assert kept["jaccard_join"] == sorted((row for _, row in groups.values()), key=repr)
    assert len(kept["jaccard_join"]) < len(rows)
    # mixing: a part of the rows, each as it was
    assert set(kept["mixing"]) <= set(kept["jaccard_join"]) and len(set(kept["mixing"])) == len(kept["mixing"])
    before = corpus_pipeline.table(spark, folder, "documents").limit(0).union(spark.createDataFrame(kept["jaccard_join"], SCHEMA))
    assert kept["mixing"] == listed(mixing.sample(before))
    # tokens of all that is left, by the library, and the same from the whole run
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for row in kept["mixing"]:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert listed(corpus_pipeline.run(spark, folder)) == sorted(want, key=repr)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
