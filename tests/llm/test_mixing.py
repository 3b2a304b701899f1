"""Raking against a plain loop, and the sample it leads to."""

from collections import defaultdict

import pytest

from valsieve.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, m_words string, probability string, sampled string, held int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "m", "p", "s", 1) for r in rows], SCHEMA)


def rows_of(n):
    forms = ["plain words here", "a | b | c", "loud!! words!! x", "junk### words*** here", "Licensed under x", "", None]
    return [(i, " ".join([forms[i % 7] or ""] * (i % 5 + 1)) if forms[i % 7] is not None else None,
             [None, "en", "de"][i % 3], "hot" if i // 3 % 3 else f"s{i // 9 % 4}") for i in range(n)]


def raked(rows, flatten, rounds):
    import re

    cells = defaultdict(float)
    for _, text, lang, source in rows:
        text = text or ""
        topic = next((t for t, p in mixing.TOPICS if re.search(p, text)), mixing.REST)
        cells[source or mixing.NO_VALUE, lang or mixing.NO_VALUE, topic] += len(re.findall(r"[^\x20\x09-\x0D]+", text))
    total = sum(cells.values())
    weight = {k: v / total for k, v in cells.items()}
    share = []
    for m in range(3):
        sums = defaultdict(float)
        for k, v in cells.items():
            sums[k[m]] += v
        raw = {k: v ** flatten if v else 0 for k, v in sums.items()}
        share.append({k: v / sum(raw.values()) for k, v in raw.items()})
    for _ in range(rounds):
        for m in range(3):
            held = defaultdict(float)
            for k, v in weight.items():
                held[k[m]] += v
            weight = {k: v * share[m][k[m]] / held[k[m]] if held[k[m]] else 0.0 for k, v in weight.items()}
    factor = {k: weight[k] / cells[k] for k in cells if cells[k]}
    return {k: factor[k] / max(factor.values()) if k in factor else 1.0 for k in cells}, weight, share


def test_probabilities_match_a_loop_and_margins_hold(spark):
    rows = rows_of(400)
    want, weight, share = raked(rows, mixing.FLATTEN, mixing.ROUNDS)
    got = {(r.m_source, r.m_lang, r.m_topic): r for r in mixing.probabilities(frame(spark, rows)).collect()}
    assert set(got) == set(want)
    assert all(got[k].probability == pytest.approx(want[k], abs=1e-9) for k in want)
    for m in range(3):
        sums = defaultdict(float)
        for k, r in got.items():
            sums[k[m]] += r.weight
        assert all(sums[v] == pytest.approx(share[m][v], abs=1e-6) for v in sums)


def test_given_targets_and_sample(spark):
    docs = frame(spark, rows_of(600))
    kept = mixing.sample(docs, {"source": {"hot": 0.2, "s0": 0.5, "nowhere": 0.3}})
    assert kept.columns == docs.columns
    assert 0 < kept.count() < 600 and {r.m_words for r in kept.collect()} == {"m"}
    again = mixing.sample(docs.orderBy("text"), {"source": {"hot": 0.2, "s0": 0.5, "nowhere": 0.3}})
    assert sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in kept.collect())


def test_no_rows_no_words_and_repeated_rows(spark):
    docs = frame(spark, [(1, "", "en", "a"), (1, "", "en", "a"), (None, None, None, None)])
    assert mixing.sample(docs.limit(0)).count() == 0
    assert mixing.sample(docs).count() == 3


def expected(docs, **options):
    cells = mixing.probabilities(docs, **options).collect()
    return cells, sum(r.tokens * r.probability for r in cells), sum(r.tokens for r in cells)


def test_one_tiny_cell_does_not_thin_the_sample(spark):
    rows = rows_of(600)
    tiny = [(9999, "some twenty words " * 3, "xx", "new")]
    before, kept, tokens = expected(frame(spark, rows), share=0.6)
    after, kept_too, tokens_too = expected(frame(spark, rows + tiny), share=0.6)
    assert kept == pytest.approx(0.6 * tokens, rel=1e-9) and kept_too == pytest.approx(0.6 * tokens_too, rel=1e-9)
    plain = {(r.m_source, r.m_lang, r.m_topic): r.probability for r in before}
    assert all(abs(plain.get((r.m_source, r.m_lang, r.m_topic), r.probability) - r.probability) < 0.02 for r in after)
    assert [r.probability > 0.98 for r in after if r.m_source == "new"] == [True]
    # The pipeline's stage has the share by itself: in sum over many rows the draw is near it.
    counted = {r.doc_id: len((r.text or "").split()) for r in mixing.sample(frame(spark, rows + tiny)).collect()}
    assert 9999 in counted and sum(counted.values()) == pytest.approx(mixing.SAMPLE_SHARE * tokens_too, rel=0.1)


def test_margins_hold_beside_whole_cells(spark):
    docs = frame(spark, rows_of(600))
    targets = {"source": {"hot": 0.4, "s0": 0.3, "s1": 0.1, "s2": 0.1, "s3": 0.1}}
    cells, kept, tokens = expected(docs, targets=targets, share=0.5)
    assert all(0 <= r.probability <= 1 for r in cells)  # s0 has fewer tokens than its target
    assert kept == pytest.approx(0.5 * tokens, rel=1e-9)
    sums = defaultdict(float)
    for r in cells:
        sums[r.m_source] += r.weight
    has = {v: sum(r.tokens for r in cells if r.m_source == v) for v in sums}
    assert sums["s0"] == pytest.approx(has["s0"], rel=0.02)
    rest = {v: sums[v] / targets["source"][v] for v in ("hot", "s1", "s2", "s3") if sums[v] < has[v] * 0.999}
    assert len(rest) >= 2 and max(rest.values()) == pytest.approx(min(rest.values()), rel=0.02)


def test_share_of_everything_and_of_emptied_values(spark):
    docs = frame(spark, rows_of(300))
    assert all(r.probability == pytest.approx(1) for r in expected(docs, share=1.0)[0])
    cells, kept, _ = expected(docs, targets={"source": {"hot": 0.0}}, share=0.9)
    assert all(r.probability == (0 if r.m_source == "hot" else pytest.approx(1)) for r in cells if r.tokens)
    with pytest.raises(ValueError):
        mixing.sample(docs, share=0.0)
