"""reason_text shows the numbers of its sentences, and its SQL renders decimal ties as Spark does."""

import re

import __spark_entry__ as entry
import duckdb
import pytest
from pyspark.sql import functions as F

from valsieve.catalog.output_queries import half_up


def test_sentences_hold_their_numbers(spark):
    assert "'#'" not in entry.oracle_sql()["reason_text"]
    rows = entry.queries()["reason_text"](spark, "/root/testdata/sf0.001").collect()
    texts = [r.motivos_descarte for r in rows]
    assert not any("#" in text for text in texts)
    assert any(re.search(r" -?\d+\.\d%? (<=|>=|<) -?\d", text) for text in texts)


@pytest.mark.parametrize("digits", [1, 2])
def test_ties_are_rendered_alike(spark, digits):
    values = [0.05, 0.15, 0.25, 0.35, 1.005, 2.675, -0.04, -0.05, -0.0, 0.0, 12.349999999999998, 123456.05, 2.5e-7, 1e21, 99.95]
    shown = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(
        F.format_string(f"%.{digits}f%%", "v")).collect()
    con = duckdb.connect()
    got = [con.execute(f"SELECT {half_up('v', digits, '%')} FROM (SELECT CAST(? AS DOUBLE) AS v)", [v]).fetchall()[0][0] for v in values]
    assert got == [r[0] for r in shown]
