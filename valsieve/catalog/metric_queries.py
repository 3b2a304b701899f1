"""Scalar metrics, one query per ratio, and the full metrics table."""

from __future__ import annotations

from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.catalog import query
from valsieve.catalog.oracle import region_case
from valsieve.functions import cleaning, dates
from valsieve.functions import ratios as R
from valsieve.operators import fx as fx_operators
from valsieve.operators import metrics


def r6(c, name):
    return F.round(c, 6).alias(name)


def ratio_query(key: str, column: str, expression, sql: str | None = None):
    """Register a query that shows one ratio per listing."""
    body = f"SELECT ticker, ROUND({sql or column}, 6) AS {column} FROM ratios"
    query(key, body)(lambda t: t.fundamentals().select("ticker", r6(expression(), column)))


CAP = lambda: R.compatible_cap("market_cap", "divisa_consistente")
ROIC = lambda: R.roic(
    "ebit", "total_debt", "equity", "tasa_impositiva", "total_debt_inicio", "equity_inicio")

ratio_query("metric_pe", "per", lambda: R.pe(CAP(), "net_income"))
ratio_query("metric_ev", "ev", lambda: R.enterprise_value("market_cap", "total_debt", "cash"),
            "market_cap + total_debt - cash")
ratio_query("metric_ev_ebit", "ev_ebit", lambda: R.ev_ebit(CAP(), "total_debt", "cash", "ebit"))
ratio_query("metric_fcf_yield", "fcf_yield", lambda: R.fcf_yield("free_cash_flow", CAP()))
ratio_query("metric_invested_capital", "capital", lambda: R.invested_capital("total_debt", "equity"), "cap1")
ratio_query("metric_roic", "roic", ROIC)
ratio_query("metric_op_margin", "margen_op", lambda: R.operating_margin("ebit", "ingresos"))
ratio_query("metric_net_debt_ebitda", "deuda_ebitda", lambda: R.net_debt_ebitda("total_debt", "cash", "ebitda"))
ratio_query("metric_cagr", "cagr_ingresos", lambda: R.revenue_cagr(
    "ingresos_inicio_historico", "ingresos_fin_historico", "anios_historico"))
ratio_query("metric_earnings_yield", "earnings_yield",
            lambda: R.earnings_yield(R.ev_ebit(CAP(), "total_debt", "cash", "ebit")))
ratio_query("metric_net_cash_pct", "caja_neta_pct_mcap", lambda: R.net_cash_share("cash", "total_debt", CAP()))
ratio_query("currency_compat_cap", "market_cap", CAP, "mc")


@query("safe_div", """
SELECT ticker, ROUND(ebit / NULLIF(gasto_intereses, 0), 6) AS cociente, ROUND(cash / NULLIF(equity_inicio, 0), 6) AS caja_capital
FROM fundamentals""")
def safe_div(t):
    return t.fundamentals().select(
        "ticker", r6(cleaning.safe_div("ebit", "gasto_intereses"), "cociente"),
        r6(cleaning.safe_div("cash", "equity_inicio"), "caja_capital"))


@query("metric_interest_coverage", """
SELECT ticker, cobertura_int = CAST('inf' AS DOUBLE) AS sin_intereses,
  ROUND(CASE WHEN cobertura_int <> CAST('inf' AS DOUBLE) THEN cobertura_int END, 6) AS cobertura_int FROM ratios""")
def interest_coverage(t):
    cover = R.interest_coverage("ebit", "gasto_intereses")
    return t.fundamentals().select(
        "ticker", (cover == cleaning.INFINITY).alias("sin_intereses"), r6(cleaning.finite(cover), "cobertura_int"))


@query("flag_roic_reliable", "SELECT ticker, roic_fiable FROM ratios")
def flag_roic_reliable(t):
    return t.fundamentals().select("ticker", R.roic_reliable(ROIC()).alias("roic_fiable"))


@query("currency_consistent", "SELECT ticker, divisa_cotizacion = divisa_financiera AS consistente FROM listing")
def currency_consistent(t):
    return t.listing().select(
        "ticker", R.currency_consistent("divisa_cotizacion", "divisa_financiera").alias("consistente"))


@query("comparable_region", f"SELECT ticker, pais, {region_case('pais')} AS region FROM listing")
def comparable_region(t):
    return t.listing().select("ticker", "pais", R.comparable_region("pais").alias("region"))


FX_SQL = {"tasa": """
SELECT divisa, MAX_BY(close, fecha) AS tasa, MAX(fecha) AS fecha FROM fx
WHERE fecha > DATE '2024-01-30' - 5 AND fecha <= DATE '2024-01-30' GROUP BY divisa"""}


@query("fx_asof_join", "SELECT divisa, CAST(fecha AS STRING) AS fecha, ROUND(tasa, 6) AS tasa FROM tasa", FX_SQL)
def fx_asof_join(t):
    rates = fx_operators.latest_rates(t.fx(), "2024-01-30")
    return rates.select("divisa", F.col("fecha").cast("string").alias("fecha"), r6(F.col("tasa"), "tasa"))


@query("fx_to_eur", """
SELECT f.ticker, f.divisa_financiera AS divisa, ROUND(f.ingresos * CASE WHEN f.divisa_financiera = 'EUR' THEN 1e0 ELSE t.tasa END, 6) AS eur
FROM fundamentals f LEFT JOIN tasa t ON t.divisa = f.divisa_financiera""", FX_SQL)
def fx_to_eur(t):
    rates = fx_operators.latest_rates(t.fx(), "2024-01-30")
    listed = t.fundamentals().select("ticker", F.col("divisa_financiera").alias("divisa"), "ingresos")
    out = fx_operators.to_eur(listed, rates, "divisa", "ingresos", "eur")
    return out.select("ticker", "divisa", r6(F.col("eur"), "eur"))


@query("fx_by_row", """
SELECT j.snapshot_id, j.ticker, j.divisa, ROUND(j.per * CASE WHEN j.divisa = 'EUR' THEN 1e0 ELSE MAX_BY(f.close, f.fecha) END, 6) AS eur,
 CAST(MAX(f.fecha) AS STRING) AS fecha_tasa
FROM (SELECT *, (['USD', 'GBP', 'JPY', 'EUR'])[CAST(substr(ticker, 2) AS BIGINT) % 4 + 1] AS divisa FROM journal) j
LEFT JOIN (SELECT * FROM fx WHERE day(fecha) % 9 = 1) f ON f.divisa = j.divisa AND f.fecha <= j.dia AND f.fecha > j.dia - 5
GROUP BY j.snapshot_id, j.ticker, j.divisa, j.per""")
def fx_by_row(t):
    """Journal values at the newest rate of the five days before each row; rates come on few days, so some rows have none."""
    rates = t.fx().where(F.dayofmonth("fecha") % 9 == 1)
    user = F.substring("ticker", 2, 20).cast("bigint")
    rows = t.journal().withColumn("divisa", F.element_at(F.array(*map(F.lit, ("USD", "GBP", "JPY", "EUR"))), (user % 4 + 1).cast("int")))
    out = fx_operators.to_eur_at(rows, rates, "divisa", "dia", "per", "eur")
    return out.select("snapshot_id", "ticker", "divisa", r6(F.col("eur"), "eur"), F.col("eur_fecha").cast("string").alias("fecha_tasa"))


METRIC_SQL = """
SELECT ticker, sector, pais, region, divisa_consistente, ROUND(per, 6) AS per, ROUND(ev_ebit, 6) AS ev_ebit,
  ROUND(fcf_yield, 6) AS fcf_yield, ROUND(roic, 6) AS roic, ROUND(margen_op, 6) AS margen_op,
  ROUND(deuda_ebitda, 6) AS deuda_ebitda, ROUND(cagr_ingresos, 6) AS cagr_ingresos,
  ROUND(earnings_yield, 6) AS earnings_yield, ROUND(caja_neta_pct_mcap, 6) AS caja_neta_pct_mcap, roic_fiable,
  ROUND(per_mediana_sector, 6) AS per_mediana_sector, n_sector, base_mediana, error_descarga, calidad_datos FROM metricas"""


@query("metrics_all", METRIC_SQL)
def metrics_all(t):
    m = metrics.compute_metrics(t.observations())
    rounded = ["per", "ev_ebit", "fcf_yield", "roic", "margen_op", "deuda_ebitda", "cagr_ingresos",
               "earnings_yield", "caja_neta_pct_mcap", "per_mediana_sector"]
    return m.select("ticker", "sector", "pais", "region", "divisa_consistente",
                    *[r6(F.col(c), c) for c in rounded],
                    "roic_fiable", "n_sector", "base_mediana", "error_descarga", "calidad_datos")


@query("sector_region_median", """
SELECT sector, region, ROUND(med_regional, 6) AS med_regional, n_regional FROM med_r WHERE n_regional > 0""")
def sector_region_median(t):
    counts = metrics.pe_counts(metrics.ratios(t.observations()))
    return metrics.sector_region_medians(counts).select(
        "sector", "region", r6(F.col("med_regional"), "med_regional"), "n_regional")


@query("peer_median_fallback", """
SELECT ticker, ROUND(per_mediana_sector, 6) AS per_mediana_sector, n_sector, base_mediana FROM metricas""")
def peer_median_fallback(t):
    m = metrics.compute_metrics(t.observations())
    return m.select("ticker", r6(F.col("per_mediana_sector"), "per_mediana_sector"), "n_sector", "base_mediana")


@query("audit_columns", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS fecha_ejecucion, strftime(ts, '%G-W%V') AS semana_iso,
  strftime(ts, 'snap_%Y%m%dT%H%M%S%fZ') AS snapshot_id FROM events""")
def audit_columns(t):
    return t.raw("events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("fecha_ejecucion"),
        dates.iso_week("ts").alias("semana_iso"), dates.snapshot_id("ts").alias("snapshot_id"))


@query("json_clean_projection", """
SELECT ticker, cobertura_int IS NULL OR cobertura_int = CAST('inf' AS DOUBLE) AS sin_valor,
  ROUND(CASE WHEN cobertura_int <> CAST('inf' AS DOUBLE) THEN cobertura_int END, 6) AS cobertura_int FROM ratios""")
def json_clean_projection(t):
    """Through JSON text and back: infinities and NaN must come back as null."""
    from valsieve.operators.output import json_rows

    rows = metrics.ratios(t.fundamentals()).select("ticker", "cobertura_int", "per")
    parsed = json_rows(rows).select(F.from_json("json", "ticker string, cobertura_int double, per double").alias("j"))
    return parsed.select("j.ticker", F.col("j.cobertura_int").isNull().alias("sin_valor"),
                         r6(F.col("j.cobertura_int"), "cobertura_int"))


@query("text_bool", """
SELECT event_id, lower(trim(txt)) IN ('true', '1', 'sí', 'si', 'yes') AS v, lower(trim(txt)) IN ('true', '1', 'sí', 'si') AS v_seguimiento
FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN ' True' WHEN 1 THEN 'YES' WHEN 2 THEN 'sí' WHEN 3 THEN '0' WHEN 4 THEN 'no' WHEN 5 THEN '1 ' ELSE event_type END AS txt FROM events)""")
def text_bool(t):
    k = F.col("event_id") % 7
    text = (F.when(k == 0, " True").when(k == 1, "YES").when(k == 2, "sí").when(k == 3, "0")
            .when(k == 4, "no").when(k == 5, "1 ").otherwise(F.col("event_type")))
    return t.raw("events").select(
        "event_id", cleaning.text_bool(text).alias("v"),
        cleaning.text_bool(text, S.TRUE_WORDS_TRACKING).alias("v_seguimiento"))


@query("safe_numeric", """
SELECT event_id, ROUND(TRY_CAST(txt AS DOUBLE), 6) AS numero, TRY_CAST(txt AS INT) AS entero
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS STRING) WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE concat('9', CAST(user_id AS STRING)) END AS txt FROM events)""")
def safe_numeric(t):
    k, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    text = F.when(k == 0, user).when(k == 1, "n/a").when(k == 2, "").otherwise(F.concat(F.lit("9"), user))
    return t.raw("events").select(
        "event_id", r6(cleaning.safe_double(text), "numero"), cleaning.safe_int(text).alias("entero"))


@query("safe_text", """
SELECT ticker, trim(COALESCE(CASE WHEN pk % 5 = 0 THEN NULL ELSE concat(' ', nombre, ' ') END, '')) AS nombre,
  CAST(TRY_CAST(CASE WHEN pk % 3 = 0 THEN 'sin fecha' ELSE fecha_balance END AS DATE) AS STRING) AS fecha FROM fundamentals""")
def safe_text(t):
    pk = F.substring("ticker", 2, 20).cast("bigint")
    name = F.when(pk % 5 != 0, F.concat(F.lit(" "), "nombre", F.lit(" ")))
    date = F.when(pk % 3 == 0, "sin fecha").otherwise(F.col("fecha_balance"))
    return t.fundamentals().select(
        "ticker", cleaning.blank_to_empty(name).alias("nombre"), cleaning.safe_date(date).cast("string").alias("fecha"))


@query("safe_date", """
SELECT ticker, CAST(fr AS STRING) AS resultados, CAST(fb AS STRING) AS balance, fb IS NULL AS sin_balance FROM limpia""")
def safe_date(t):
    balance = cleaning.safe_date("fecha_balance")
    return t.fundamentals().select(
        "ticker", cleaning.safe_date("fecha_resultados").cast("string").alias("resultados"),
        balance.cast("string").alias("balance"), balance.isNull().alias("sin_balance"))


@query("date_gap_days", """
SELECT ticker, CAST(abs(date_diff('day', fr, ff)) AS BIGINT) AS desfase, abs(date_diff('day', fr, ff)) > 45 AS desalineados FROM limpia""")
def date_gap_days(t):
    gap = dates.day_gap(cleaning.safe_date("fecha_resultados"), cleaning.safe_date("fecha_flujo_caja"))
    return t.fundamentals().select(
        "ticker", gap.cast("bigint").alias("desfase"), (gap > S.MAX_STATEMENT_GAP_DAYS).alias("desalineados"))
