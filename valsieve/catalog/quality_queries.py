"""Quality grades, statements and filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.catalog import query
from valsieve.catalog.tables import TODAY
from valsieve.operators import facts, quality, statements


def r6(name, source=None):
    return F.round(F.col(source or name), 6).alias(name)


@query("quality_grade", "SELECT ticker, calidad AS calidad_datos, incidencias_datos FROM graduada")
def quality_grade(t):
    return quality.grade(t.fundamentals(), TODAY).select("ticker", "calidad_datos", "incidencias_datos")


SUMMARY = """
SELECT 'empresas' AS tipo, 'empresas_con_incidencias' AS clave, COUNT(*) AS n FROM graduada WHERE calidad <> 'ok'
UNION ALL SELECT 'categoria', categoria, COUNT(*) FROM (SELECT ticker, categoria FROM categorias
  UNION ALL SELECT ticker, 'otras' FROM graduada WHERE calidad <> 'ok' AND ticker NOT IN (SELECT ticker FROM categorias)) GROUP BY categoria
UNION ALL SELECT 'campo', campo, menciones FROM campos"""


@query("quality_incident_summary", SUMMARY)
def quality_incident_summary(t):
    return quality.incident_summary(quality.grade(t.fundamentals(), TODAY))


@query("quality_incident_report", f"""
SELECT tipo, clave, n, ROUND(n / CAST((SELECT COUNT(*) FROM graduada) AS DOUBLE), 6) AS cuota FROM resumen""", {"resumen": SUMMARY})
def quality_incident_report(t):
    return quality.incident_report(quality.grade(t.observations(), TODAY)).select("tipo", "clave", "n", r6("cuota"))


@query("incident_classify", """
SELECT ticker, incidencia, CASE WHEN starts_with(m, 'campos ausentes:') THEN 'campos_ausentes' WHEN contains(m, 'divisa') THEN 'divisas'
    WHEN contains(m, 'obsoleto') THEN 'cuentas_obsoletas' WHEN contains(m, 'fecha futura') THEN 'fechas_futuras'
    WHEN contains(m, 'fecha de ') AND contains(m, 'ausente') THEN 'fechas_ausentes'
    WHEN contains(m, 'desalineados') THEN 'periodos_desalineados'
    WHEN contains(m, 'periodo contable no identificado') THEN 'periodo_no_identificado'
    WHEN contains(m, 'capitalización no positiva') OR contains(m, 'deuda negativa') OR contains(m, 'caja negativa') THEN 'valores_invalidos'
    WHEN error_descarga = '' THEN 'otras' END AS categoria FROM incidencia""")
def incident_classify(t):
    from valsieve.functions.text import incident_category

    rows = quality.grade(t.fundamentals(), TODAY).select(
        "ticker", "error_descarga", F.explode(quality.incident_parts()).alias("incidencia"))
    return rows.select("ticker", "incidencia",
                       incident_category("incidencia", F.col("error_descarga") != "").alias("categoria"))


@query("statement_scan", "SELECT statement, basis, concept, COUNT(*) AS filas, COUNT(value) AS con_valor, ROUND(CAST(MAX(value) AS DOUBLE), 6) AS maximo FROM statements GROUP BY ALL")
def statement_scan(t):
    return t.statements().groupBy("statement", "basis", "concept").agg(
        F.count(F.lit(1)).alias("filas"), F.count("value").alias("con_valor"), F.round(F.max("value"), 6).alias("maximo"))


@query("latest_value", "SELECT ticker, statement, basis, campo, ROUND(ultimo, 6) AS ultimo FROM valores")
def latest_value(t):
    return statements.series_values(t.stored_statements()).select("ticker", "statement", "basis", "campo", r6("ultimo"))


@query("latest_and_previous", "SELECT ticker, campo, ROUND(ultimo, 6) AS ultimo, ROUND(anterior, 6) AS anterior FROM valores WHERE statement = 'balance'")
def latest_and_previous(t):
    rows = statements.series_values(t.statements().where(F.col("statement") == "balance"))
    return rows.select("ticker", "campo", r6("ultimo"), r6("anterior"))


HISTORY = """
SELECT ticker, CASE WHEN n >= 2 AND hasta > desde THEN primero END AS i0, CASE WHEN n >= 2 AND hasta > desde THEN ultimo END AS i1,
 CASE WHEN n >= 2 AND hasta > desde THEN date_diff('day', desde, hasta) / 365.25e0 END AS anios
FROM valores WHERE statement = 'resultados' AND basis = 'ANUAL' AND campo = 'ingresos'"""


@query("history_extremes", """SELECT ticker, ROUND(i0, 6) AS ingresos_inicio_historico, ROUND(i1, 6) AS ingresos_fin_historico,
 ROUND(anios, 6) AS anios_historico FROM historia""", {"historia": HISTORY})
def history_extremes(t):
    rows = t.statements().where((F.col("statement") == "resultados") & (F.col("basis") == "ANUAL"))
    out = statements.history_extremes(statements.series_values(rows))
    return out.select("ticker", r6("ingresos_inicio_historico"), r6("ingresos_fin_historico"), r6("anios_historico"))


@query("latest_statement_date", "SELECT ticker, statement, basis, CAST(MAX(period_end) AS STRING) AS fecha FROM statements GROUP BY ticker, statement, basis")
def latest_statement_date(t):
    return statements.latest_statement_dates(t.statements()).withColumn("fecha", F.col("fecha").cast("string"))


@query("period_basis", "SELECT ticker, tipo_periodo FROM base_periodo")
def period_basis(t):
    return statements.period_basis(t.statements())


TAX = """
SELECT ticker, basis, MAX(CASE WHEN campo = 'tax_provision' THEN ultimo END) / NULLIF(MAX(CASE WHEN campo = 'pretax_income' THEN ultimo END), 0) AS tasa
FROM valores WHERE statement = 'resultados' GROUP BY ticker, basis"""


@query("effective_tax_rate", """SELECT ticker, basis, ROUND(CASE WHEN tasa BETWEEN 0 AND 0.5 THEN tasa ELSE 0.25e0 END, 6) AS tasa FROM tasas""", {"tasas": TAX})
def effective_tax_rate(t):
    from valsieve.functions.ratios import effective_tax_rate as rate

    rows = statements.series_values(t.statements().where(F.col("statement") == "resultados"))
    wide = rows.groupBy("ticker", "basis").agg(
        F.max(F.when(F.col("campo") == "tax_provision", F.col("ultimo"))).alias("a"),
        F.max(F.when(F.col("campo") == "pretax_income", F.col("ultimo"))).alias("b"))
    return wide.select("ticker", "basis", F.round(rate("a", "b"), 6).alias("tasa"))


def flow_sql(field: str) -> str:
    return (f"ROUND(MAX(CASE WHEN v.campo = '{field}' AND (v.statement = 'balance' OR v.basis = b.tipo_periodo) THEN v.ultimo END), 6) AS {field}")


def start_sql(field: str) -> str:
    return f"ROUND(MAX(CASE WHEN v.campo = '{field}' THEN v.anterior END), 6) AS {field}_inicio"


NORMAL_FIELDS = ["ingresos", "ebit", "net_income", "gasto_intereses", "ebitda", "free_cash_flow", "total_debt", "cash", "equity"]


@query("normalize_fundamentals", f"""
SELECT v.ticker, b.tipo_periodo, {', '.join(flow_sql(f) for f in NORMAL_FIELDS)}, {', '.join(start_sql(f) for f in statements.BALANCE_FIELDS)},
 ROUND(MAX(h.anios), 6) AS anios_historico, ROUND(MAX(CASE WHEN t.basis = b.tipo_periodo THEN CASE WHEN t.tasa BETWEEN 0 AND 0.5 THEN t.tasa ELSE 0.25e0 END END), 6) AS tasa_impositiva,
 CAST(MAX(CASE WHEN v.statement = 'resultados' AND v.basis = b.tipo_periodo THEN d.fecha END) AS STRING) AS fecha_resultados,
 ROUND(MAX(CASE WHEN v.campo = 'ebit' AND v.basis = 'ANUAL' THEN v.ultimo END), 6) AS ebit_anual
FROM valores v JOIN base_periodo b ON b.ticker = v.ticker LEFT JOIN historia h ON h.ticker = v.ticker LEFT JOIN tasas t ON t.ticker = v.ticker
 LEFT JOIN fechas d ON d.ticker = v.ticker AND d.statement = v.statement AND d.basis = v.basis
GROUP BY v.ticker, b.tipo_periodo""", {
    "historia": HISTORY, "tasas": TAX,
    "fechas": "SELECT ticker, statement, basis, MAX(period_end) AS fecha FROM statements GROUP BY ALL"})
def normalize_fundamentals(t):
    out = statements.normalize(t.stored_statements())
    return out.select(
        "ticker", "tipo_periodo", *[r6(f) for f in NORMAL_FIELDS], *[r6(f"{f}_inicio") for f in statements.BALANCE_FIELDS],
        r6("anios_historico"), r6("tasa_impositiva"), F.col("fecha_resultados").cast("string").alias("fecha_resultados"),
        F.round(F.col("comparables_anuales")["ebit"], 6).alias("ebit_anual"))


@query("facts_explode", """SELECT cik, taxonomy, concept, unidad, inicio AS start, fin AS "end", ROUND(val, 6) AS val, filed FROM hechos_anuales""")
def facts_explode(t):
    flat = facts.explode_facts(facts.parse_documents(t.filings()))
    return flat.select("cik", "taxonomy", "concept", "unidad", "start", "end", r6("val"), "filed")


@query("latest_fact", 'SELECT cik, campo, ROUND(val, 6) AS val, fin AS "end", unidad, concept FROM hecho_ultimo')
def latest_fact(t):
    rows = facts.latest_facts(facts.explode_facts(facts.parse_documents(t.filings())))
    return rows.select("cik", "campo", r6("val"), "end", "unidad", "concept")


def fact_sql(field: str, part: str = "val") -> str:
    return f"MAX(CASE WHEN h.campo = '{field}' THEN h.{part} END)"


@query("normalize_facts", f"""
SELECT d.cik, concat('Filer ', CAST(d.cik AS STRING)) AS nombre, COALESCE({fact_sql('ingresos', 'unidad')}, '') AS divisa_financiera,
 {', '.join(f'ROUND({fact_sql(f)}, 6) AS {f}' for f in ('ingresos', 'net_income', 'ebit', 'total_debt', 'cash', 'equity'))},
 ROUND({fact_sql('cash_operaciones')} - abs({fact_sql('capex')}), 6) AS free_cash_flow,
 COALESCE({fact_sql('ingresos', 'fin')}, '') AS fecha_resultados,
 COALESCE(MAX(CASE WHEN h.campo IN ('total_debt', 'cash', 'equity') THEN h.fin END), '') AS fecha_balance,
 {' || '.join(f"CASE WHEN {fact_sql(f)} IS NULL THEN '{f},' ELSE '' END" for f in S.REQUIRED_FACTS)} AS faltan,
 {fact_sql('net_income', 'concept')} AS concepto_beneficio,
 printf('https://data.sec.gov/api/xbrl/companyfacts/CIK%010d.json', d.cik) AS url_fuente
FROM (SELECT DISTINCT pk AS cik FROM yr) d LEFT JOIN hecho_ultimo h ON h.cik = d.cik GROUP BY d.cik""")
def normalize_facts(t):
    out = facts.normalize(facts.parse_documents(t.stored_filings()))
    names = F.regexp_replace(F.regexp_replace("incidencias_datos", "^conceptos SEC ausentes: ", ""), ", ", ",")
    return out.select(
        "cik", "nombre", "divisa_financiera", *[r6(f) for f in ("ingresos", "net_income", "ebit", "total_debt", "cash", "equity")],
        r6("free_cash_flow"), "fecha_resultados", "fecha_balance",
        F.when(names == "", "").otherwise(F.concat(names, F.lit(","))).alias("faltan"),
        F.col("conceptos_fuente")["net_income"].alias("concepto_beneficio"), "url_fuente")


@query("ticker_id_map", "SELECT concat('T', CAST(p_partkey AS STRING)) AS ticker, p_partkey AS cik FROM part WHERE p_partkey % 10 <> 4")
def ticker_id_map(t):
    return facts.ticker_ids(t.filer_ids())


@query("facts_ticker_join", f"""
SELECT t.ticker, i.cik, CASE WHEN i.cik IS NULL THEN '{S.NOT_REGISTERED}' ELSE '' END AS error_descarga
FROM (SELECT concat('T', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 6 = 0 THEN '.MC' ELSE '' END) AS ticker FROM part) t
LEFT JOIN (SELECT concat('T', CAST(p_partkey AS STRING)) AS ticker, p_partkey AS cik FROM part WHERE p_partkey % 10 <> 4) i ON i.ticker = t.ticker""")
def facts_ticker_join(t):
    pk = F.col("p_partkey")
    wanted = t.raw("part").select(F.concat(
        F.lit("t"), pk.cast("string"), F.when(pk % 6 == 0, ".mc").otherwise("")).alias("ticker"))
    return facts.match_tickers(wanted, facts.ticker_ids(t.filer_ids()))
