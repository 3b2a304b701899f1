"""Restored words, held-out accuracy and edge cases of the toxicity scores."""

import numpy as np
import pyarrow as pa
import pytest

from valsieve.llm import toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return toxicity.train(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


def test_disguised_words_are_restored(trained):
    decoder = toxicity.Decoder(trained["letters"])
    disguised = {
        "1d10t": "idiot", "m0r0n": "moron", "l0s3r": "loser", "iiidiooot": "idiot", "tr@sh": "trash", "st.u.p.i.d": "stupid",
        "i-d-i-o-t": "idiot", "$tup!d": "stupid", "sc*m": "scum", "worthless###": "worthless", "dis*gust*ing": "disgusting"}
    assert {w for w, plain in disguised.items() if plain not in decoder.readings(w)} == set()
    assert decoder.readings("idiot") == ["idiot"] and decoder.readings("2024") == [] and decoder.readings("") == []


def test_viterbi_finds_the_best_path(trained):
    decoder = toxicity.Decoder(trained["letters"])
    model = decoder.model

    def brute(choices, a, b, score, read):
        if not choices:
            return [(score + (model[a][b][0] if b else 0.0), " ".join(read.split()))]
        out = []
        for letter, code, cost in choices[0]:
            if code < 0:
                out += brute(choices[1:], a, b, score - cost, read)
            elif code == 0:
                out += brute(choices[1:], 0, 0, score - cost + (model[a][b][0] if b else 0.0), read + " ")
            else:
                out += brute(choices[1:], b, code, score - cost + model[a][b][code], read + letter)
        return out

    for text in ("1d1", "a$$", "th1ng", "2*b", "m0..n", "ee3e"):
        best = max(brute(decoder.choices(text), 0, 0, 0.0, ""))
        assert decoder.restore(text) == best[1]


def test_held_out_rows(spark, trained):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.score(docs.select("doc_id", "text"), trained).where("crc32(cast(doc_id as string)) % 3 = 1").join(labels, "doc_id").toPandas()
    flagged = scored.score >= toxicity.THRESHOLD
    assert flagged[scored.toxic == 1].mean() > 0.85 and flagged[scored.toxic == 0].mean() < 0.01
    plain = toxicity.score(spark.createDataFrame([(1, "the 1d10t and m0r0n is s t u p i d")], "doc_id int, text string"), trained).first()
    assert plain.score > toxicity.THRESHOLD


def test_edge_cases(spark, trained):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "x" * 100_000, 3), (3, "a b c d e " * 5000, 4), (4, "\U0001f642 漢字 1 $", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and sorted(r.score for r in kept.collect()) == [1, 2, 2, 3, 4, 5]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    only = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (None, 0, 0)], labels.schema)
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, only).collect())


def test_fit_separates():
    rows, columns = np.array([0, 1, 2, 3]), np.array([0, 0, 1, 1])
    weights = toxicity.fit_weights(rows, columns, np.array([1, 1, 0, 0, 0, 0]), 2)
    assert weights[0] + weights[2] > 1 and weights[1] + weights[2] < -1


def toy_decoder(words):
    uses = np.zeros((toxicity.LETTERS,) * 3)
    for word in words:
        codes = [0, 0, *(ord(c) - 96 for c in word), 0]
        for triple in zip(codes, codes[1:], codes[2:]):
            uses[triple] += 10
    return toxicity.Decoder(np.log((uses + 0.01) / (uses.sum(axis=2, keepdims=True) + 0.01 * toxicity.LETTERS)))


def test_no_word_is_lost_in_long_pieces():
    decoder = toy_decoder(["that", "word", "idiot"])
    for n in range(8, 30):
        piece = ".".join(["that"] * n + ["1d10t"] + ["w0rd"] * n)
        assert decoder.restore(piece).split() == ["that"] * n + ["idiot"] + ["word"] * n
        assert "idiot" in decoder.readings(piece)
    for n in range(4, 12):  # letters set apart
        text = " ".join("that" * n + "idiot" + "that" * 5)
        _, found = toxicity.row_features(pa.RecordBatch.from_pydict({"text": [text]}), decoder, {})
        assert "=idiot" in found
    long = ".".join(["that", "1d10t"] * 20_000)
    assert decoder.restore(long).split() == ["that", "idiot"] * 20_000


def test_repetitions_edges_and_digits_are_read(trained):
    decoder = toxicity.Decoder(trained["letters"])
    disguised = {"stuupid": "stupid", "mmoron": "moron", "*diot": "idiot", "(lown": "clown", "455": "ass", "scuum": "scum", "(l0wn": "clown"}
    assert {w for w, plain in disguised.items() if plain not in decoder.readings(w)} == set()
    for number in ("2024", "1999", "5000", "12", "500", "(879)"):
        assert decoder.readings(number) == []


def test_k_best_readings_are_the_best_paths(trained):
    decoder = toxicity.Decoder(trained["letters"])
    model = decoder.model

    def brute(choices, a, b, score, read):
        if not choices:
            return [(score + (model[a][b][0] if b else 0.0), " ".join(read.split()))]
        out = []
        for letter, code, cost in choices[0]:
            if code < 0:
                out += brute(choices[1:], a, b, score - cost, read)
            elif code == 0:
                out += brute(choices[1:], 0, 0, score - cost + (model[a][b][0] if b else 0.0), read + " ")
            else:
                out += brute(choices[1:], b, code, score - cost + model[a][b][code], read + letter)
        return out

    for text in ("1d1", "sc*m", "2*b", "ee3e", "4$$"):
        best = {}
        for score, read in brute(decoder.choices(text), 0, 0, 0.0, ""):
            best[read] = max(score, best.get(read, score))
        got = decoder.ranked(text, 2)
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s in sorted(best.values(), reverse=True)[:2]]
        assert all(best[read] == pytest.approx(score) for score, read in got)


def test_quick_tests_change_no_feature(trained):
    """Scoring skips words that can't have a wanted feature; the rows must be those of the plain way."""
    words = ["stuupid", "mmoron.", "(lown", "*diot!", "idiot", "idiots,", "Idiots!!!", "still", "ééidiott", "m0r0n", "s t u p i d", "asss", "\u00e9\u00e9", "x(idiot)", "trash...!!", "zzz", "漢漢字", "((stupid))", ""]
    batch = pa.RecordBatch.from_pydict({"text": [*words, " ".join(words), None]})
    names = ["=idiot", "=stupid", "^stup", "^mor", "=moron", "^moro", "=ass", "=clown", "^idio", "=trash", "^漢字", "=zz"]
    wanted = toxicity.Wanted({f: i for i, f in enumerate(names)})
    decoder = toxicity.Decoder(trained["letters"])
    slow = {(r, f) for r, f in zip(*toxicity.row_features(batch, decoder, {}), strict=True) if f in names}
    fast = {(r, names[k]) for r, k in zip(*toxicity.row_features(batch, decoder, {}, wanted), strict=True)}
    assert fast == slow and len(fast) > 20
