import math

import pytest
from pyspark.sql import functions as F

from valsieve.functions import cleaning, dates, text
from valsieve.functions import ratios as R

NAN, INF = float("nan"), float("inf")


def lit(v):
    return F.lit(None).cast("double") if v is None else F.lit(float(v))


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


CASES = [
    (lambda: R.pe(lit(1000), lit(100)), 10), (lambda: R.pe(lit(1000), lit(0)), None),
    (lambda: R.pe(lit(1000), lit(-5)), None), (lambda: R.pe(lit(1000), lit(NAN)), None),
    (lambda: R.enterprise_value(lit(1000), lit(300), lit(100)), 1200),
    (lambda: R.enterprise_value(lit(1000), lit(None), lit(100)), None),
    (lambda: R.ev_ebit(lit(1000), lit(300), lit(100), lit(150)), 8),
    (lambda: R.ev_ebit(lit(100), lit(0), lit(500), lit(100)), -4),
    (lambda: R.invested_capital(lit(300), lit(500)), 800), (lambda: R.invested_capital(lit(300), lit(-500)), None),
    (lambda: R.roic(lit(200), lit(300), lit(500), lit(0.25), lit(None), lit(None)), 150 / 800),
    (lambda: R.roic(lit(200), lit(300), lit(500), lit(0.25), lit(200), lit(400)), 150 / 700),
    (lambda: R.roic(lit(200), lit(300), lit(500), lit(0.25), lit(200), lit(-400)), 150 / 800),
    (lambda: R.roic(lit(200), lit(300), lit(500), lit(0.9), lit(None), lit(None)), 100 / 800),
    (lambda: R.roic(lit(200), lit(300), lit(500), lit(None), lit(None), lit(None)), 150 / 800),
    (lambda: R.net_debt_ebitda(lit(100), lit(500), lit(50)), 0), (lambda: R.net_debt_ebitda(lit(500), lit(100), lit(200)), 2),
    (lambda: R.net_debt_ebitda(lit(500), lit(None), lit(200)), None), (lambda: R.net_debt_ebitda(lit(5), lit(1), lit(0)), None),
    (lambda: R.interest_coverage(lit(200), lit(0)), INF), (lambda: R.interest_coverage(lit(200), lit(-20)), 10),
    (lambda: R.interest_coverage(lit(-200), lit(0)), INF), (lambda: R.interest_coverage(lit(None), lit(0)), None),
    (lambda: R.revenue_cagr(lit(100), lit(121), lit(2)), 0.10), (lambda: R.revenue_cagr(lit(100), lit(-1), lit(2)), -1),
    (lambda: R.revenue_cagr(lit(0), lit(121), lit(2)), None), (lambda: R.earnings_yield(lit(0)), None),
    (lambda: R.effective_tax_rate(lit(30), lit(100)), 0.3), (lambda: R.effective_tax_rate(lit(80), lit(100)), 0.25),
    (lambda: R.effective_tax_rate(lit(None), lit(100)), 0.25), (lambda: cleaning.safe_div(lit(INF), lit(2)), None),
    (lambda: R.net_cash_share(lit(5), lit(1), lit(8)), 0.5), (lambda: R.convert_to_eur(lit(5), lit(None)), None),
]


def test_scalar_goldens(spark):
    row = spark.range(1).select(*[build().alias(f"c{i}") for i, (build, _) in enumerate(CASES)]).first()
    for i, (_, want) in enumerate(CASES):
        got = row[f"c{i}"]
        assert (got is None) == (want is None), i
        if want is not None:
            assert got == want or math.isclose(got, want, rel_tol=1e-12), i


@pytest.mark.parametrize("country, region", [
    ("United States", "Norteamerica"), ("Japan", "Japon"), (" Spain ", "Europa"), ("Brazil", "Otros"), (None, "Otros")])
def test_region(spark, country, region):
    assert one(spark, R.comparable_region(F.lit(country).cast("string"))) == region


def test_flags_and_text(spark):
    assert one(spark, R.roic_reliable(lit(1.0))) is True
    assert one(spark, R.roic_reliable(lit(4.0))) is False
    assert one(spark, R.roic_reliable(lit(NAN))) is False
    assert one(spark, text.company_key(F.lit("Autotrader Group plc"))) == "AUTOTRADER"
    assert one(spark, text.company_key(F.lit("Banco Santander S.A."))) == "BANCO NTANDER"
    assert one(spark, text.venue_symbol(F.lit(" itx.mc "))) == "BME:ITX"
    assert one(spark, text.venue_symbol(F.lit("BHP.AX"))) == "BHP.AX"
    assert one(spark, text.venue_symbol(F.lit("A B"))) is None
    assert one(spark, text.percent_text(lit(0.171))) == "17.1%"
    assert one(spark, text.number_text(lit(None))) == "N/D"
    assert one(spark, cleaning.text_bool(F.lit(" Sí "))) is True
    assert one(spark, cleaning.text_bool(F.lit(None).cast("string"))) is False


def test_audit_instants(spark):
    ts = F.lit("2026-08-24T07:00:00Z").cast("timestamp")
    assert one(spark, dates.snapshot_id(ts)) == "snap_20260824T070000000000Z"
    assert one(spark, dates.iso_week(ts)) == "2026-W35"
    assert one(spark, dates.iso_week(F.lit("2027-01-01").cast("timestamp"))) == "2026-W53"
