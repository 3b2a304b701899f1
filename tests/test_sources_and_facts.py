import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.errors import VerificationError
from valsieve.operators import facts, statements, verification
from valsieve.sources import readers, writers


def statement_table(spark, rows):
    return spark.createDataFrame([(t, s, b, c, dt.date.fromisoformat(d), v) for t, s, b, c, d, v in rows],
                                 "ticker string, statement string, basis string, concept string, period_end date, value double")


def test_period_and_series_rules(spark):
    rows = [
        ("A", "resultados", "TTM", "Total Revenue", "2026-06-30", 1100.0), ("A", "resultados", "ANUAL", "Total Revenue", "2025-12-31", 1000.0),
        ("A", "resultados", "ANUAL", "Total Revenue", "2024-12-31", 900.0), ("A", "flujo_caja", "TTM", "Free Cash Flow", "2026-06-30", 55.0),
        ("A", "flujo_caja", "ANUAL", "Free Cash Flow", "2025-12-31", 50.0), ("A", "balance", "ANUAL", "Total Debt", "2025-12-31", None),
        ("A", "balance", "ANUAL", "Total Debt", "2024-12-31", 7.0), ("A", "balance", "ANUAL", "Total Debt", "2023-12-31", 6.0),
        ("A", "balance", "ANUAL", "Cash", "2025-12-31", 3.0), ("A", "balance", "ANUAL", "Cash And Cash Equivalents", "2024-12-31", 4.0),
        # No TTM cash flow: both fall back to annual.
        ("B", "resultados", "TTM", "Total Revenue", "2026-06-30", 1100.0), ("B", "resultados", "ANUAL", "Operating Revenue", "2025-12-31", 1000.0),
        ("B", "resultados", "ANUAL", "Total Revenue", "2025-12-31", None), ("B", "flujo_caja", "ANUAL", "Free Cash Flow", "2025-12-31", 50.0),
        ("B", "resultados", "ANUAL", "Tax Provision", "2025-12-31", 30.0), ("B", "resultados", "ANUAL", "Pretax Income", "2025-12-31", 100.0),
        ("C", "resultados", "ANUAL", "Total Revenue", "2025-12-31", None), ("C", "balance", "ANUAL", "Otra Cosa", "2025-12-31", 1.0)]
    got = {r["ticker"]: r for r in statements.normalize(statement_table(spark, rows).repartition(3)).collect()}
    a, b = got["A"], got["B"]
    assert (a["tipo_periodo"], a["ingresos"], a["free_cash_flow"]) == ("TTM", 1100, 55)
    assert (a["total_debt"], a["total_debt_inicio"]) == (7, 6) and (a["cash"], a["cash_inicio"]) == (4, None)
    assert (a["ingresos_inicio_historico"], a["ingresos_fin_historico"], round(a["anios_historico"], 3)) == (900, 1000, 0.999)
    assert a["comparables_anuales"]["ingresos"] == 1000 and a["tasa_impositiva"] == 0.25
    assert a["fecha_balance"] == dt.date(2025, 12, 31) and a["fecha_resultados"] == dt.date(2026, 6, 30)
    assert (b["tipo_periodo"], b["ingresos"], b["free_cash_flow"], b["tasa_impositiva"]) == ("ANUAL", 1000, 50, 0.3)
    assert b["anios_historico"] is None
    assert (got["C"]["ingresos"], got["C"]["cash"], got["C"]["tasa_impositiva"]) == (None, None, 0.25)
    assert got["C"]["fecha_resultados"] == dt.date(2025, 12, 31)


def test_normalising_takes_one_scan_and_one_shuffle(spark, tmp_path):
    statement_table(spark, [("A", "balance", "ANUAL", "Cash", "2025-12-31", 3.0)]).write.parquet(str(tmp_path / "s"))
    plan = statements.normalize(spark.read.parquet(str(tmp_path / "s")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange SinglePartition" not in plan


def test_unpivot(spark):
    wide = spark.createDataFrame([("A", "EBIT", 1.0, 2.0)], "ticker string, concept string, `2025-12-31` double, `2024-12-31` double")
    rows = readers.unpivot_statements(wide, ["ticker", "concept"]).collect()
    assert {(str(r["period_end"]), r["value"]) for r in rows} == {("2025-12-31", 1.0), ("2024-12-31", 2.0)}


def fact(val, end="2025-12-31", start="2025-01-01", form="10-K", fp="FY", filed="2026-02-01"):
    return {k: v for k, v in dict(start=start, end=end, val=val, form=form, fp=fp, filed=filed).items() if v is not None}


def test_company_facts(spark):
    def units(*items, unit="USD"):
        return {"units": {unit: list(items)}}

    document = {"entityName": "Acme", "facts": {"us-gaap": {
        "Revenues": units(fact(900, "2024-12-31", "2024-01-01"), fact(1000), fact(5000, form="10-Q"), fact(300, start="2025-10-01"), fact(7000, fp="Q3")),
        "SalesRevenueNet": units(fact(999)), "NetIncomeLoss": units(fact(100, fp=None)),
        "OperatingIncomeLoss": units(fact(150)),
        "NetCashProvidedByUsedInOperatingActivities": units(fact(130)), "PaymentsToAcquirePropertyPlantAndEquipment": units(fact(-30)),
        "LongTermDebt": units(fact(200, start=None)), "StockholdersEquity": units(fact(400, "2026-01-31", None), unit="EUR"),
        "CashAndCashEquivalentsAtCarryingValue": units(fact(50, "2025-12-31", None), fact(60, "2025-12-31", None, filed="2026-03-01"))}}}
    docs = spark.createDataFrame([(1, json.dumps(document)), (2, json.dumps({"entityName": "Empty", "facts": {}}))], "cik long, document string")
    got = {r["cik"]: r for r in facts.normalize(facts.parse_documents(docs)).collect()}
    row = got[1]
    assert (row["nombre"], row["ingresos"], row["net_income"], row["free_cash_flow"], row["cash"], row["total_debt"]) == ("Acme", 1000, 100, 100, 60, 200)
    assert row["equity"] is None and row["incidencias_datos"] == "conceptos SEC ausentes: equity" and row["calidad_datos"] == "revisar"
    assert row["conceptos_fuente"]["free_cash_flow"].endswith("- abs(PaymentsToAcquirePropertyPlantAndEquipment)")
    assert row["url_fuente"].endswith("CIK0000000001.json") and row["divisa_financiera"] == "USD"
    assert got[2]["ingresos"] is None and got[2]["fecha_balance"] == "" and got[2]["conceptos_fuente"] == {}


def test_ticker_match_is_literal(spark):
    ids = facts.ticker_ids(spark.createDataFrame([(" iag ", 7), (None, 8), ("X", None)], "ticker string, cik long"))
    wanted = spark.createDataFrame([("IAG.MC",), ("iag",), ("ZZ",)], "ticker string")
    got = {r["ticker"]: (r["cik"], r["error_descarga"]) for r in facts.match_tickers(wanted, ids).collect()}
    assert got == {"IAG.MC": (None, S.NOT_REGISTERED), "IAG": (7, ""), "ZZ": (None, S.NOT_REGISTERED)}


BASE = dict(ticker="A", proveedor_datos="uno", tipo_periodo="ANUAL", divisa_financiera="USD", fecha_resultados="2025-12-31",
            fecha_flujo_caja="2025-12-31", fecha_balance="2025-12-31", error_descarga="", url_fuente="", ingresos=100.0, net_income=100.0,
            ebit=100.0, free_cash_flow=100.0, total_debt=100.0, cash=0.0, equity=None, gasto_intereses=float("nan"), conceptos_fuente={})
KINDS = ", ".join(f"{k} " + ("map<string,string>" if k == "conceptos_fuente" else "double" if k in S.COMPARED_FIELDS else "string") for k in BASE)


def source(spark, *rows):
    return spark.createDataFrame([tuple({**BASE, **r}.values()) for r in rows], KINDS)


def test_verification_states(spark):
    primary = source(spark, {}, {"ticker": "B"}, {"ticker": "C"}, {"ticker": "D"}, {"ticker": "E"}, {"ticker": "F"})
    secondary = source(
        spark, dict(ticker=" a", proveedor_datos="dos", ingresos=105.0, net_income=115.0, ebit=130.0, total_debt=float("inf"), cash=5.0,
                    conceptos_fuente={"ingresos": "Revenues", "net_income": "ProfitLoss", "ebit": "Raro", "free_cash_flow": "x - abs(y)"}),
        dict(ticker="C", divisa_financiera="EUR"), dict(ticker="D", tipo_periodo="TTM"), dict(ticker="E", fecha_resultados="2025-10-31"),
        dict(ticker="F", error_descarga="HTTP 404"))
    table = verification.verify(primary, secondary, "snap_x", "2026-01-01 00:00:00")
    assert table.columns == S.VERIFICATION_COLUMNS and table.count() == 48
    got = {(r["ticker"], r["metrica"]): r for r in table.collect()}
    state = {k: r["estado"] for k, r in got.items()}
    assert state["A", "ingresos"] == "verificado" and state["A", "net_income"] == "aproximacion_semantica"
    assert state["A", "ebit"] == "aproximacion_semantica" and state["A", "free_cash_flow"] == "verificado"
    assert state["A", "total_debt"] == "sin_dato" and state["A", "cash"] == "no_comparable" and state["A", "equity"] == "sin_dato"
    assert got["A", "ingresos"]["detalle"] == "diferencia dentro del 10 %; concepto secundario: Revenues"
    assert got["A", "net_income"]["detalle"].startswith("comparación orientativa (advertencia); beneficio consolidado")
    assert "el concepto Raro no está declarado" in got["A", "ebit"]["detalle"] and round(got["A", "ebit"]["diferencia_pct"], 6) == 0.3
    assert got["A", "equity"]["detalle"] == "equity ausente en primario y secundario"
    assert state["B", "ingresos"] == "sin_cobertura" and got["B", "ingresos"]["proveedor_secundario"] == "sin_cobertura"
    assert got["C", "ingresos"]["detalle"] == "divisas distintas USD/EUR" and state["D", "ingresos"] == "no_comparable"
    assert got["E", "ingresos"]["detalle"] == "fechas contables desalineadas (61 días)" and state["E", "total_debt"] == "verificado"
    assert got["F", "cash"]["detalle"] == "HTTP 404" and state["C", "cash"] == "no_comparable" and state["E", "cash"] == "verificado"
    with pytest.raises(VerificationError):
        verification.verify(primary, secondary, "x", "2026-01-01")
    with pytest.raises(VerificationError):
        verification.verify(primary.drop("ticker"), secondary, "snap_x", "2026-01-01")
    assert verification.repeated_tickers(primary.unionByName(primary.limit(1))).count() == 1
    with pytest.raises(VerificationError, match="more than once"):
        verification.verify(primary, secondary.unionByName(secondary.limit(1)), "snap_x", "2026-01-01")


def test_verification_append_is_idempotent(spark, tmp_path):
    table = verification.verify(source(spark, {}), source(spark, {"ingresos": 99.0}), "snap_x", "2026-01-01 00:00:00")
    path = str(tmp_path / "verification")
    assert writers.append_verification(table, path).count() == 8
    assert writers.append_verification(table.withColumn("estado", F.lit("otro")), path).where("estado = 'otro'").count() == 0
    assert writers.append_verification(table.withColumn("snapshot_id", F.lit("snap_y")), path).count() == 16
    with pytest.raises(VerificationError):
        writers.append_verification(table.drop("estado"), path)


def test_each_document_is_parsed_once(spark):
    from valsieve.operators import facts

    document = '{"entityName": "x", "facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"start": "2023-01-01", "end": "2023-12-31", "val": 1.5, "form": "10-K", "fp": "FY"}]}}}}}'
    rows = [(1, document), (2, "{}"), (3, '{"facts": {}}'), (4, None), (5, "no json")]
    filers = spark.createDataFrame(rows, "cik bigint, document string").repartition(2)
    flat = facts.explode_facts(facts.parse_documents(filers))
    assert [(r.cik, r.concept, r.val) for r in flat.collect()] == [(1, "Revenues", 1.5)]
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
