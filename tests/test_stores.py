"""Quotes read page by page, and verification rows in buckets of their keys."""

import pytest
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.errors import VerificationError
from valsieve.sources import writers
from valsieve.sources.quote_pages import FilteringPageReader, read_quote_pages, write_quote_pages


@pytest.fixture
def pages(spark, tmp_path):
    rows = [(r, s, f"{r}{s[0]}{i}", 1.5 * i, 10 * i, i) for r in ("us", "de", "jp") for s in ("Energy", "Real Estate") for i in range(25)]
    rows.append(("us", "Energy", None, None, None, None))
    quotes = spark.createDataFrame(rows, "region string, sector string, ticker string, price double, mcap_c bigint, volume bigint")
    write_quote_pages(quotes.coalesce(1), str(tmp_path / "pages"), 10)
    return str(tmp_path / "pages"), rows


def test_filters_choose_the_pages(spark, pages):
    path, rows = pages
    table = read_quote_pages(spark, path)
    assert sorted(map(tuple, table.collect()), key=repr) == sorted(rows, key=repr)
    assert table.rdd.getNumPartitions() == 18
    some = table.where(F.col("region").isin("us", "jp") & (F.col("sector") == "Real Estate") & (F.col("volume") > 20))
    assert some.rdd.getNumPartitions() == 6 and some.count() == 8
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:  # all pages are read, and Spark filters
        plain = read_quote_pages(spark, path).where(F.col("region") == "us")
        assert plain.count() == 51 and plain.rdd.getNumPartitions() == 18
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    none = table.where(F.col("region") == "fr")
    assert none.count() == 0 and none.rdd.getNumPartitions() <= 1


def test_filters_on_other_columns_stay_with_spark():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = FilteringPageReader("x")
    other = GreaterThan(("volume",), 5)
    assert list(reader.pushFilters([EqualTo(("region",), "us"), other, EqualTo(("region",), "de")])) == [other]
    assert reader.wanted == {"region": set()}


def verified(spark, rows):
    values = [tuple({"snapshot_id": "snap_1", "ticker": t, "proveedor_secundario": "s", "metrica": m, "estado": e, "verificado_en_utc": when}.get(c)
                    for c in S.VERIFICATION_COLUMNS) for t, m, e, when in rows]
    kinds = ", ".join(f"{c} {'double' if c.startswith(('valor', 'diferencia')) else 'string'}" for c in S.VERIFICATION_COLUMNS)
    return spark.createDataFrame(values, kinds)


def test_replay_adds_nothing_and_stored_rows_stay_in_place(spark, tmp_path):
    path = str(tmp_path / "verification")
    first = verified(spark, [("A", "ebit", "x", "1"), ("A", "ebit", "y", "2"), ("B", "ebit", "x", "1")])
    for _ in range(2):
        stored = writers.append_verification_bucketed(first, path, 4)
    assert sorted((r.ticker, r.estado) for r in stored.collect()) == [("A", "y"), ("B", "x")]
    more = verified(spark, [("B", "ebit", "z", "3"), ("C", "cash", "x", "1")])
    assert writers.append_verification_bucketed(more, path, 4).count() == 3
    with pytest.raises(VerificationError):
        writers.append_verification_bucketed(more.drop("estado"), path, 4)
    from valsieve.operators.verification import pending

    name, before = writers.verification_table(spark, path, 4), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pending(more, spark.table(name))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    stored_side = plan[:plan.index("FileScan parquet")].rsplit("Join", 1)[1]
    assert "Bucketed: true" in plan and plan.count("Exchange") <= 2
    assert "Exchange" not in stored_side[stored_side.rindex("Sort"):]


def test_new_verification_rows_are_sorted_behind_the_shuffle_only(spark):
    from valsieve.operators.verification import pending

    new = verified(spark, [("A", "ebit", "x", "1"), ("A", "ebit", "z", "1"), ("A", "ebit", None, "1"), ("A", "ebit", "zz", "0"), ("B", "cash", "x", "1")])
    kept = pending(new, new.where(F.col("ticker") == "B"))
    assert [(r.ticker, r.estado) for r in kept.collect()] == [("A", "z")]
    plan = pending(new, new.limit(0))._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("row_number()"):]
    assert "Sort [" not in window[window.index("Exchange hashpartitioning(snapshot_id"):].split("\n:- ")[0].split("Exchange", 2)[1]


def test_many_pages_share_partitions(spark, pages, monkeypatch):
    from valsieve.sources import quote_pages

    path, rows = pages
    monkeypatch.setattr(quote_pages, "PARTITIONS", 4)
    reader = quote_pages.PageReader(path)
    runs = reader.partitions()
    assert len(runs) == 4 and sum(len(run.pages) for run in runs) == 18
    got = [tuple(r.values()) for run in runs for batch in reader.read(run) for r in batch.to_pylist()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
