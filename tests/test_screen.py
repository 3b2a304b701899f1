import json

import pytest
from conftest import ideal
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.operators import integrity, listings, metrics, output, quality, ranking, screen, summaries
from valsieve.plans.analysis import analyze
from valsieve.plans.api import payload


def screened(df, **overrides):
    table = metrics.compute_metrics(df, screen.resolve_thresholds(overrides))
    return {r["ticker"]: r for r in screen.apply_screen(table, screen.resolve_thresholds(overrides)).collect()}


def test_ideal_company_passes(companies):
    rows = screened(companies(ideal(), ideal("REF")))
    assert rows["OK"]["pasa"] and rows["OK"]["motivos_descarte"] == ""


def test_rejections_are_complete_and_ordered(companies):
    rows = screened(companies(
        ideal("MALA", market_cap=100e9, market_cap_eur=5e8, free_cash_flow=None, gasto_intereses=None,
              calidad_datos="revisar", incidencias_datos="resultados obsoleto (700 días)"),
        ideal("DIV", divisa_financiera="USD", divisa_consistente=False),
        ideal("ERR", error_descarga="Timeout", calidad_datos="error", incidencias_datos="Timeout")))
    assert rows["MALA"]["motivos"] == ["calidad", "per", "ev_ebit", "fcf_yield:sin_dato", "cobertura_int:sin_dato", "market_cap_eur"]
    assert rows["MALA"]["motivos_descarte"] == (
        "calidad de datos revisar: resultados obsoleto (700 días); PER 100.0 >= 15.0; EV/EBIT 72.1 >= 12.0; "
        "FCF yield: sin dato; Cobertura int.: sin dato; capitalización 0.50B EUR < 2.0B EUR")
    assert rows["DIV"]["motivos"][:2] == ["divisas", "per:sin_dato"]
    assert rows["ERR"]["motivos"][:2] == ["descarga", "calidad"]


def test_zero_interest_passes_and_negative_multiple_passes(companies):
    rows = screened(companies(ideal("CERO", gasto_intereses=0.0), ideal("NEG", cash=50e9)))
    assert rows["CERO"]["pasa"] and rows["NEG"]["ev_ebit"] < 0 and "ev_ebit" not in rows["NEG"]["motivos"]


def test_regional_median_and_fallback(companies):
    both = companies(*[ideal(f"JP{i}", pais="Japan") for i in range(6)],
                     *[ideal(f"US{i}", pais="United States", net_income=0.5e9) for i in range(6)])
    rows = {r["ticker"]: r for r in metrics.compute_metrics(both).collect()}
    assert rows["JP0"]["per_mediana_sector"] == 10 and rows["US0"]["per_mediana_sector"] == 20
    assert {r["base_mediana"] for r in rows.values()} == {"sector+region"}
    few = companies(*[ideal(f"JP{i}", pais="Japan") for i in range(6)], ideal("SOLA", pais="United States"))
    row = {r["ticker"]: r for r in metrics.compute_metrics(few).collect()}["SOLA"]
    assert (row["base_mediana"], row["n_sector"]) == ("sector_global", 7)


def test_scenarios_choose_the_median_by_their_own_minimum(companies):
    both = companies(*[ideal(f"JP{i}", pais="Japan") for i in range(6)],
                     *[ideal(f"US{i}", pais="United States", net_income=0.8e9) for i in range(6)])
    cases = {"default": {}, "eight": {"min_empresas_sector": 8}, "many": {"min_empresas_sector": 20}}
    found = {}
    for r in screen.screen_scenarios(both, cases).collect():
        found.setdefault(r["escenario"], {})[r["ticker"]] = r
    for name, overrides in cases.items():
        alone = screened(both, **overrides)
        assert alone.keys() == found[name].keys()
        for ticker, r in alone.items():
            for column in ("pasa", "motivos", *S.PEER_COLUMNS):
                assert found[name][ticker][column] == r[column], (name, ticker, column)
    assert {r["base_mediana"] for r in found["eight"].values()} == {S.BASIS_GLOBAL}
    assert {r["base_mediana"] for r in found["default"].values()} == {S.BASIS_REGIONAL}
    assert sum(r["pasa"] for r in found["eight"].values()) == 6


def test_missing_sector_has_no_median(companies):
    rows = {r["ticker"]: r for r in metrics.compute_metrics(companies(
        ideal("A", sector=None), *[ideal(f"B{i}") for i in range(5)], ideal("C", sector="X", net_income=-1.0))).collect()}
    assert rows["A"]["per_mediana_sector"] is None and rows["A"]["n_sector"] is None
    assert (rows["C"]["per_mediana_sector"], rows["C"]["n_sector"]) == (None, 0)


def test_peer_rule_gives_two_reasons_without_pe(companies):
    rows = screened(companies(ideal("SIN", net_income=-1.0), *[ideal(f"B{i}") for i in range(6)]))
    assert rows["SIN"]["motivos"] == ["per:sin_dato", "per_sector:sin_dato"]
    rows = screened(companies(ideal("CARA", net_income=10e9 / 14), *[ideal(f"B{i}") for i in range(6)]))
    assert rows["CARA"]["motivos"] == ["per_sector"]
    assert rows["CARA"]["motivos_descarte"] == "PER 14.0 >= mediana sector 10.0"


def test_thresholds():
    assert screen.resolve_thresholds({"per_max": 20})["per_max"] == 20
    with pytest.raises(ValueError, match="Unknown"):
        screen.resolve_thresholds({"otro": 1})
    with pytest.raises(ValueError):
        screen.resolve_thresholds({"min_empresas_sector": 0})


def test_dual_listings(companies):
    df = companies(
        ideal("GSK.L", nombre="GSK plc", market_cap_eur=89.9e9), ideal("GSKL.XC", nombre="GSK PLC", market_cap_eur=89.8e9),
        ideal("OTRA", nombre="Otra SA"), ideal("X1", nombre=""), ideal("X2", nombre=None),
        ideal("LARGO", nombre="Par", market_cap_eur=None), ideal("PAR", nombre="Par", market_cap_eur=None))
    kept = {r["ticker"] for r in listings.dedup_listings(df).collect()}
    assert kept == {"GSK.L", "OTRA", "X1", "X2", "PAR"}
    assert kept == {r["ticker"] for r in listings.union_parts(df).collect()}


def test_only_candidates_are_ranked(companies):
    result = analyze(companies(
        ideal("MEJOR", ebit=2e9), ideal("PEOR"), ideal("GEMELA", nombre="Gemela"), ideal("FUERA", free_cash_flow=1e7)),
        {"per_bajo_mediana_sector": False})
    rows = [(r["ticker"], r["rank_roic"], r["rank_ey"], r["puntuacion"]) for r in result.ranked.collect()]
    assert rows == [("MEJOR", 1.0, 1.0, 2.0), ("GEMELA", 2.5, 2.5, 5.0), ("PEOR", 2.5, 2.5, 5.0), ("FUERA", None, None, None)]


def test_missing_values_rank_last_and_share(spark):
    df = spark.createDataFrame([("a", 0.3, 1.0), ("b", None, None), ("c", 0.1, None), ("d", None, 2.0)],
                               "ticker string, roic double, earnings_yield double")
    rows = {r["ticker"]: (r["rank_roic"], r["rank_ey"]) for r in ranking.magic_rank(df).collect()}
    assert rows == {"a": (1, 2), "b": (3.5, 3.5), "c": (2, 3.5), "d": (3.5, 1)}


def test_view_and_warnings(companies):
    evaluated = analyze(companies(ideal("A", cash=6e9, pais="Japan"), ideal("B", equity=-1.9e9)), {"per_bajo_mediana_sector": False}).evaluated
    flags = {r["ticker"]: (r["roic_dudoso"], r["mucha_caja"]) for r in screen.warning_lists(evaluated).collect()}
    assert flags == {"A": (False, True), "B": (True, False)}
    assert [r["ticker"] for r in screen.view_filter(evaluated, True, ["Japon"]).collect()] == ["A"]


def test_incident_summary(spark):
    df = spark.createDataFrame([
        ("A", "revisar", "", "campos ausentes: EBIT, EBITDA; divisa de cotización o financiera ausente"),
        ("B", "revisar", "", "campos ausentes: EBIT; flujo de caja obsoleto (600 días); balance obsoleto (600 días)"),
        ("C", "ok", "", ""), ("D", "error", "Timeout: sin respuesta", "Timeout: sin respuesta"), ("E", "revisar", None, None)],
        "ticker string, calidad_datos string, error_descarga string, incidencias_datos string")
    got = {(r["tipo"], r["clave"]): r["n"] for r in quality.incident_summary(df).collect()}
    assert got == {
        ("empresas", "empresas_con_incidencias"): 4, ("categoria", "campos_ausentes"): 2, ("categoria", "divisas"): 1,
        ("categoria", "cuentas_obsoletas"): 1, ("categoria", "errores_descarga"): 1, ("categoria", "otras"): 1,
        ("campo", "EBIT"): 2, ("campo", "EBITDA"): 1}
    order = [r["clave"] for r in quality.incident_report(df).collect() if r["tipo"] == "campo"]
    assert order == ["EBIT", "EBITDA"]


def test_quality_grades(companies):
    df = companies(
        ideal("OK"), ideal("VIEJA", fecha_balance="2024-01-01"), ideal("FUTURA", fecha_resultados="2026-10-01"),
        ideal("NADA", market_cap=None, ingresos=None, ebit=None), ideal("SINFECHA", fecha_flujo_caja="?"),
        ideal("FALLO", error_descarga="Timeout"), ideal("DESFASE", fecha_flujo_caja="2026-03-31"), ideal("NEG", total_debt=-1.0))
    got = {r["ticker"]: (r["calidad_datos"], r["incidencias_datos"]) for r in quality.grade(df, "2026-08-01").collect()}
    assert got["OK"] == ("ok", "")
    assert got["VIEJA"] == ("revisar", "balance obsoleto (943 días)")
    assert got["FUTURA"] == ("revisar", "fecha futura de resultados; resultados y flujo de caja desalineados (93 días)")
    assert got["NADA"] == ("inutilizable", "campos ausentes: capitalización, EBIT, ingresos; capitalización no positiva o ausente")
    assert got["SINFECHA"] == ("revisar", "fecha de flujo de caja ausente")
    assert got["FALLO"] == ("error", "Timeout")
    assert got["DESFASE"][1] == "resultados y flujo de caja desalineados (91 días)"
    assert got["NEG"] == ("revisar", "deuda negativa")


def test_integrity_gate(companies):
    def run(errors):
        rows = [ideal(f"T{i}", error_descarga="x" if i < errors else "", calidad_datos="error" if i < errors else "ok") for i in range(10)]
        requested = companies(*rows)
        evaluated = screen.apply_screen(metrics.compute_metrics(requested))
        return evaluated, summaries.run_control(evaluated, requested)

    integrity.require_valid(*run(2))
    with pytest.raises(ValueError, match="exito_suficiente"):
        integrity.require_valid(*run(3))
    evaluated, control = run(0)
    twice = evaluated.unionByName(evaluated)
    with pytest.raises(ValueError):
        integrity.require_valid(twice, control)


def test_brief_and_chart(companies):
    ranked = analyze(companies(ideal("NOS.LS", net_income=10e9 / 9.5, free_cash_flow=1.71e9), ideal("BBB")),
                     {"per_bajo_mediana_sector": False}).ranked.withColumn("cagr_ingresos", F.lit(None).cast("double"))
    rows = [r["texto"] for r in output.brief_bundle(screen.candidates(ranked)).orderBy("posicion").collect()]
    assert rows[0].endswith("CANDIDATAS (2):") and "NO recomiendes comprar" in rows[0] and output.DISCLAIMER in rows[0]
    text = "\n".join(rows)
    assert "NOS.LS — NOS.LS (Industrials, Europa)" in text and "PER: 9.50" in text and "17.1%" in text and "CAGR ingresos: N/D" in text
    assert rows[1].startswith("1. ") and rows[2].startswith("2. ")
    english = output.candidate_briefs(screen.candidates(ranked), language="en").first()["bloque"]
    assert "Net debt/EBITDA" in english and "(reliable: yes)" in english
    assert output.brief_bundle(ranked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        output.brief_bundle(ranked, language="fr")
    assert {r["simbolo"] for r in output.chart_candidates(ranked).collect()} == {"EURONEXT:NOS", "BBB"}


def test_api_summary_without_candidates(companies):
    df = companies(ideal("A", free_cash_flow=1.0))
    evaluated = analyze(df).evaluated
    row = summaries.api_summary(summaries.run_control(evaluated, df)).first()
    assert row["status"] == "no_candidates" and row["text"].startswith("0 of 1 evaluated")


def test_api_payload(companies):
    df = companies(ideal("A"), ideal("B", free_cash_flow=1.0), ideal("C", gasto_intereses=0.0))
    result = analyze(df, {"per_bajo_mediana_sector": False})
    lines = payload(result, df).collect()
    counts = {}
    for r in lines:
        counts[r["seccion"]] = counts.get(r["seccion"], 0) + 1
    assert counts == {"header": 1, "requested_tickers": 3, "summary": 1, "candidates": 2, "prompt": 3, "discarded": 1}
    one = {r["seccion"]: json.loads(r["json"]) for r in lines}
    assert one["header"]["schema_version"] == "1.0" and one["header"]["thresholds"]["per_bajo_mediana_sector"] is False
    assert (one["summary"]["candidates"], one["summary"]["requested_tickers"], one["summary"]["status"]) == (2, 3, "candidates_found")
    by_ticker = {json.loads(r["json"])["ticker"]: json.loads(r["json"]) for r in lines if r["seccion"] == "candidates"}
    assert by_ticker["C"]["cobertura_int"] is None and by_ticker["A"]["cobertura_int"] == 14.0
    assert "discarded" not in {r["seccion"] for r in payload(result, df, include_discarded=False).collect()}


def test_metric_columns_are_complete(companies):
    assert metrics.compute_metrics(companies(ideal())).columns == S.METRIC_COLUMNS
    bare = companies(ideal()).drop("calidad_datos", "divisa_consistente", "proveedor_datos")
    row = metrics.compute_metrics(bare).first()
    assert (row["calidad_datos"], row["divisa_consistente"], row["proveedor_datos"]) == ("ok", True, "")


def test_empty_input(companies):
    result = analyze(companies())
    assert result.ranked.count() == 0 and "pasa" in result.ranked.columns
