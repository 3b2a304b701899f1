"""Independent SQL for DuckDB: named table expressions and a small resolver.

Each entry of ``TABLES`` is one common table expression.  ``with_tables``
prefixes a statement with exactly the expressions it mentions, so every check
stays readable and reads whole tables.
"""

from __future__ import annotations

import re

from valsieve import settings as S
from valsieve.catalog.tables import CAP_FLOOR, COUNTRIES, DISCOVERY_ID, MARKETS, VOLUME_FLOOR


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def nth(values, index: str) -> str:
    return "([" + ", ".join(quoted(v) for v in values) + "])[CAST(" + index + " AS BIGINT) + 1]"


def values_table(rows, columns: str) -> str:
    body = ", ".join(
        "(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) v({columns})"


def stripped_name(column: str) -> str:
    text = f"upper({column})"
    for noise in S.COMPANY_NOISE:
        text = f"replace({text}, {quoted(noise)}, ' ')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def region_case(column: str) -> str:
    arms = " ".join(f"WHEN {column} IN {in_list(c)} THEN {quoted(r)}" for r, c in S.COMPARABLE_REGIONS.items())
    return f"CASE {arms} ELSE {quoted(S.OTHER_REGION)} END"


def reason_list(limit=None) -> str:
    t = {**S.THRESHOLDS, **CAP_FLOOR, **(limit or {})}

    def rule(code, column, passes):
        return f"CASE WHEN {column} IS NULL THEN '{code}:sin_dato' WHEN NOT ({column} {passes}) THEN '{code}' END"

    peers = (
        f"CASE WHEN {str(t['per_bajo_mediana_sector']).lower()} AND n_sector >= {t['min_empresas_sector']} THEN "
        "CASE WHEN per_mediana_sector IS NULL OR per IS NULL THEN 'per_sector:sin_dato' "
        "WHEN per >= per_mediana_sector THEN 'per_sector' END END")
    parts = [
        "CASE WHEN error_descarga <> '' THEN 'descarga' END",
        "CASE WHEN calidad_datos <> 'ok' THEN 'calidad' END",
        "CASE WHEN NOT divisa_consistente THEN 'divisas' END",
        rule("per", "per", f"< {t['per_max']}"), peers,
        rule("ev_ebit", "ev_ebit", f"< {t['ev_ebit_max']}"),
        rule("fcf_yield", "fcf_yield", f"> {t['fcf_yield_min']}"),
        rule("roic", "roic", f"> {t['roic_min']}"),
        rule("margen_op", "margen_op", f"> {t['margen_op_min']}"),
        rule("deuda_ebitda", "deuda_ebitda", f"< {t['deuda_ebitda_max']}"),
        rule("cobertura_int", "cobertura_int", f"> {t['cobertura_intereses_min']}"),
        rule("cagr_ingresos", "cagr_ingresos", f">= {t['crecimiento_ingresos_min']}"),
        rule("market_cap_eur", "market_cap_eur", f"> {t['market_cap_eur_min']}"),
    ]
    return "concat_ws(';', " + ", ".join(parts) + ")"


def peer_choice(minimum: int) -> str:
    """Every listing with the peer median that the given minimum of peers chooses."""
    return f"""
SELECT r.*, CASE WHEN n_regional >= {minimum} THEN med_regional ELSE med_global END AS per_mediana_sector,
  CASE WHEN n_regional >= {minimum} THEN n_regional ELSE n_global END AS n_sector,
  CASE WHEN n_regional >= {minimum} THEN 'sector+region' ELSE 'sector_global' END AS base_mediana
FROM ratios r JOIN med_r USING (sector, region) JOIN med_g USING (sector)"""


COMPONENTS = ("ingresos", "ebit", "ebitda", "net_income", "free_cash_flow", "total_debt_u", "cash_u", "equity_u")


def statement_rows() -> str:
    income = [
        ("'Total Revenue'", "ingresos"),
        ("CASE WHEN pk % 4 = 0 THEN 'Operating Income' ELSE 'EBIT' END", "ebit"),
        ("'Net Income'", "net_income"), ("'EBITDA'", "ebitda"),
        ("'Interest Expense'", "CASE WHEN pk % 13 <> 0 THEN ebit * (pk % 5) / 10 END"),
        ("'Interest Expense Non Operating'", "ebit * 0.1e0"),
        ("'Tax Provision'", "ebit * (pk % 8) / 10"), ("'Pretax Income'", "ebit"),
    ]
    out = []

    def add(statement, basis, concept, value, where="TRUE"):
        out.append(
            f"SELECT concat('T', CAST(pk AS STRING)) AS ticker, pk, '{statement}' AS statement, '{basis}' AS basis, "
            f"{concept} AS concept, make_date(CAST(y AS INT), 12, 31) AS period_end, {value} AS value FROM yr1 WHERE {where}")

    for concept, value in income:
        add("resultados", "ANUAL", concept, value)
        add("resultados", "TTM", concept, f"({value}) * 1.1e0", "y = y1 AND pk % 7 <> 0")
    add("flujo_caja", "ANUAL", "'Free Cash Flow'", "free_cash_flow")
    add("flujo_caja", "TTM", "'Free Cash Flow'", "free_cash_flow * 1.1e0", "y = y1 AND pk % 6 <> 0")
    add("balance", "ANUAL", "'Total Debt'", "total_debt_u")
    add("balance", "ANUAL", "CASE WHEN pk % 3 = 0 THEN 'Cash' ELSE 'Cash And Cash Equivalents' END", "cash_u")
    add("balance", "ANUAL", "'Cash'", "cash_u * 0.5e0", "pk % 3 <> 0")
    add("balance", "ANUAL", "'Stockholders Equity'", "CASE WHEN pk % 5 <> 0 THEN equity_u END")
    add("balance", "ANUAL", "'Total Equity Gross Minority Interest'", "equity_u * 1.2e0")
    return " UNION ALL ".join(out)


def fact_rows() -> str:
    unit = "CASE WHEN pk % 3 = 0 THEN 'EUR' ELSE 'USD' END"
    rows = [
        ("us-gaap", "Revenues", unit, "ingresos", "-01-01"),
        ("us-gaap", "SalesRevenueNet", "'JPY'", "ingresos * 2", "-10-01"),
        ("us-gaap", "NetIncomeLoss", f"CASE WHEN pk % 10 = 0 THEN 'GBP' ELSE {unit} END", "net_income", "-01-01"),
        ("us-gaap", "OperatingIncomeLoss", unit, "ebit", "-01-01"),
        ("us-gaap", "NetCashProvidedByUsedInOperatingActivities", unit, "free_cash_flow * 2", "-01-01"),
        ("us-gaap", "PaymentsToAcquirePropertyPlantAndEquipment", unit, "-free_cash_flow", "-01-01"),
        ("us-gaap", "LongTermDebt", unit, "total_debt_u", None),
        ("us-gaap", "CashAndCashEquivalentsAtCarryingValue", unit, "cash_u", None),
        ("us-gaap", "StockholdersEquity", unit, "equity_u", None),
        ("ifrs-full", "ProfitLoss", unit, "net_income * 1.5e0", "-01-01"),
    ]
    return " UNION ALL ".join(
        f"SELECT pk AS cik, '{tax}' AS taxonomy, '{concept}' AS concept, {unit_sql} AS unidad, "
        + (f"concat(CAST(y AS STRING), '{start}')" if start else "CAST(NULL AS STRING)")
        + f" AS inicio, concat(CAST(y AS STRING), '-12-31') AS fin, {value} AS val, "
        "CASE WHEN (pk + y) % 6 = 0 THEN '10-Q' ELSE '10-K' END AS form, "
        "CASE WHEN (pk + y) % 7 = 0 THEN 'Q4' ELSE 'FY' END AS fp, "
        "concat(CAST(y + 1 AS STRING), '-03-01') AS filed FROM yr"
        for tax, concept, unit_sql, value, start in rows)


def concept_priority(table: dict) -> list[tuple]:
    return [(*((key,) if isinstance(key, str) else key), name, i)
            for key, names in table.items() for i, name in enumerate(names)]


def verification_side() -> str:
    return " UNION ALL ".join(
        f"SELECT p.ticker, '{field}' AS metrica, p.{field} AS v1, s.{field} AS v2, p.{date} AS d1, s.{date} AS d2, "
        "p.tipo_periodo AS t1, s.tipo_periodo AS t2, p.divisa_financiera AS c1, s.divisa_financiera AS c2, "
        f"s.ticker AS st, s.error_descarga AS se, {concept} AS concepto "
        "FROM fundamentals p LEFT JOIN secondary s ON s.ticker = p.ticker"
        for field, date in S.COMPARED_FIELDS.items()
        for concept in [{
            "ingresos": "'Revenues'", "ebit": "'OperatingIncomeLoss'",
            "net_income": "CASE WHEN s.pk % 2 = 0 THEN 'ProfitLoss' ELSE 'NetIncomeLoss' END",
            "free_cash_flow": "'CFO - abs(Capex)'",
            "total_debt": "CASE WHEN s.pk % 5 = 0 THEN 'OtherDebt' ELSE 'LongTermDebt' END",
        }.get(field, "''")])


THEMES = [name for names in S.ETF_THEMES.values() for name in names]
SECTOR_ROWS = [(s, i) for i, s in enumerate(S.SECTORS)]
QUOTA_ROWS = [(r, q, S.SELECTION_QUOTAS[r], i) for i, (r, q) in enumerate(S.DISCOVERY_QUOTAS.items())]

TABLES: dict[str, str] = {
    "listing": f"""
SELECT p_partkey AS pk, concat('T', CAST(p_partkey AS STRING)) AS ticker,
  CASE WHEN p_partkey % 29 = 0 THEN '' ELSE concat(p_name, CASE p_size % 4 WHEN 0 THEN ' plc' WHEN 1 THEN ' Inc.' WHEN 2 THEN ' AG' ELSE '' END) END AS nombre,
  p_type AS sector, {nth(COUNTRIES, 'p_partkey % 25')} AS pais, p_size, p_retailprice,
  CASE WHEN p_partkey % 29 = 0 THEN 'Timeout: no response' ELSE '' END AS error_descarga,
  CASE WHEN p_partkey % 3 = 0 THEN 'USD' ELSE 'EUR' END AS divisa_cotizacion,
  CASE WHEN p_partkey % 17 = 0 THEN 'GBP' WHEN p_partkey % 3 = 0 THEN 'USD' ELSE 'EUR' END AS divisa_financiera
FROM part""",
    "li": """
SELECT l_partkey AS pk, EXTRACT(YEAR FROM l_shipdate) AS y, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS c,
  CAST(ROUND(l_discount * 100) AS BIGINT) AS d, CAST(ROUND(l_tax * 100) AS BIGINT) AS t FROM lineitem""",
    "yr": """
SELECT pk, y, CAST(SUM(c) AS DOUBLE)/1e2 AS ingresos, CAST(SUM(c*(d+t)) AS DOUBLE)/1e4 AS ebit,
  CAST(SUM(c*(d+2*t)) AS DOUBLE)/1e4 AS ebitda, CAST(SUM(c*(d-2)) AS DOUBLE)/1e4 AS net_income,
  CAST(SUM(c*(d-1)) AS DOUBLE)/1e4 AS free_cash_flow, CAST(SUM(c*(t+2)) AS DOUBLE)/4e4 AS total_debt_u,
  CAST(SUM(c*d) AS DOUBLE)/2e4 AS cash_u, CAST(SUM(c*(20+d)) AS DOUBLE)/1e4 AS equity_u
FROM li GROUP BY pk, y""",
    "yr1": "SELECT *, MAX(y) OVER (PARTITION BY pk) AS y1 FROM yr",
    "ext": """
SELECT pk, MAX(y) AS y1, MIN(y) AS y0, MAX_BY(ingresos, y) AS ingresos_fin, MIN_BY(ingresos, y) AS ingresos_ini
FROM yr GROUP BY pk""",
    "fundamentals": """
SELECT l.pk, l.ticker, l.nombre, l.sector, l.pais, l.divisa_cotizacion, l.divisa_financiera,
  (l.divisa_cotizacion = l.divisa_financiera AND l.error_descarga = '') AS divisa_consistente, l.error_descarga,
  CASE WHEN l.error_descarga <> '' THEN 'error' WHEN l.pk % 13 = 0 THEN 'revisar' ELSE 'ok' END AS calidad_datos,
  CASE WHEN l.error_descarga <> '' THEN NULL ELSE a.ingresos * l.p_size / 6e1 END AS market_cap,
  CASE WHEN l.error_descarga <> '' THEN NULL WHEN l.divisa_cotizacion = 'USD' THEN a.ingresos * l.p_size / 6e1 * 9e-1 ELSE a.ingresos * l.p_size / 6e1 END AS market_cap_eur,
  a.net_income, a.ebit, a.ebitda, a.ingresos, e.ingresos_ini AS ingresos_inicio_historico, e.ingresos_fin AS ingresos_fin_historico,
  CAST(CASE WHEN e.y1 > e.y0 THEN e.y1 - e.y0 END AS DOUBLE) AS anios_historico,
  a.free_cash_flow, a.total_debt_u AS total_debt, a.cash_u AS cash, a.equity_u AS equity,
  b.total_debt_u AS total_debt_inicio, b.cash_u AS cash_inicio, b.equity_u AS equity_inicio,
  CASE WHEN l.pk % 13 = 0 THEN NULL WHEN l.pk % 11 = 0 THEN 0e0 ELSE a.ebit * (l.pk % 5) / 1e1 END AS gasto_intereses,
  25e-2 AS tasa_impositiva, 'primario' AS proveedor_datos,
  CASE WHEN l.pk % 7 = 0 THEN 'ANUAL' WHEN l.pk % 37 = 0 THEN '' ELSE 'TTM' END AS tipo_periodo,
  CAST(make_date(CAST(a.y AS INT), 12, 31) AS STRING) AS fecha_resultados,
  CAST(CASE WHEN l.pk % 19 = 0 THEN make_date(CAST(a.y AS INT), 9, 30) ELSE make_date(CAST(a.y AS INT), 12, 31) END AS STRING) AS fecha_flujo_caja,
  CASE WHEN l.pk % 41 = 0 THEN 'pendiente' ELSE CAST(make_date(CAST(a.y AS INT), 12, 31) AS STRING) END AS fecha_balance
FROM listing l LEFT JOIN ext e ON e.pk = l.pk LEFT JOIN yr a ON a.pk = e.pk AND a.y = e.y1 LEFT JOIN yr b ON b.pk = e.pk AND b.y = e.y1 - 1""",
    "secondary": f"""
SELECT pk, ticker, CASE WHEN pk % 17 = 0 THEN 'CHF' ELSE divisa_financiera END AS divisa_financiera,
  CASE WHEN pk % 23 = 0 THEN 'ANUAL' ELSE tipo_periodo END AS tipo_periodo,
  {', '.join(f'{c} * (1 + (pk % 7) * 0.05e0) AS {c}' for c in S.COMPARED_FIELDS)},
  CASE WHEN pk % 11 = 0 THEN CAST(CAST(fecha_resultados AS DATE) + 60 AS STRING) ELSE fecha_resultados END AS fecha_resultados,
  fecha_flujo_caja, fecha_balance, CASE WHEN pk % 31 = 0 THEN 'HTTPError: 404' ELSE '' END AS error_descarga
FROM fundamentals WHERE pk % 9 <> 0""",
    "ratios1": f"""
SELECT *, CASE WHEN divisa_consistente THEN market_cap END AS mc,
  CASE WHEN total_debt + equity > 0 THEN total_debt + equity END AS cap1,
  CASE WHEN total_debt_inicio + equity_inicio > 0 THEN total_debt_inicio + equity_inicio END AS cap0,
  {region_case('pais')} AS region FROM fundamentals""",
    "ratios2": """
SELECT *, CASE WHEN net_income > 0 THEN mc / net_income END AS per,
  CASE WHEN ebit > 0 THEN (mc + total_debt - cash) / ebit END AS ev_ebit,
  free_cash_flow / NULLIF(mc, 0) AS fcf_yield,
  ebit * (1 - tasa_impositiva) / COALESCE((cap0 + cap1) / 2, cap1) AS roic,
  ebit / NULLIF(ingresos, 0) AS margen_op,
  CASE WHEN ebitda > 0 THEN CASE WHEN total_debt - cash <= 0 THEN 0e0 ELSE (total_debt - cash) / ebitda END END AS deuda_ebitda,
  CASE WHEN gasto_intereses = 0 AND ebit IS NOT NULL THEN CAST('inf' AS DOUBLE) ELSE ebit / NULLIF(abs(gasto_intereses), 0) END AS cobertura_int,
  CASE WHEN ingresos_inicio_historico > 0 AND anios_historico > 0 THEN
    CASE WHEN ingresos_fin_historico <= 0 THEN -1e0 ELSE pow(ingresos_fin_historico / ingresos_inicio_historico, 1e0 / anios_historico) - 1 END END AS cagr_ingresos,
  (cash - total_debt) / NULLIF(mc, 0) AS caja_neta_pct_mcap FROM ratios1""",
    "ratios": "SELECT *, 1e0 / NULLIF(ev_ebit, 0) AS earnings_yield, COALESCE(roic <= 1, FALSE) AS roic_fiable FROM ratios2",
    "med_r": "SELECT sector, region, MEDIAN(per) AS med_regional, COUNT(per) AS n_regional FROM ratios GROUP BY ALL",
    "med_g": "SELECT sector, MEDIAN(per) AS med_global, COUNT(per) AS n_global FROM ratios GROUP BY ALL",
    "metricas": peer_choice(S.THRESHOLDS["min_empresas_sector"]),
    "claves": f"SELECT *, {stripped_name('nombre')} AS clave FROM metricas",
    "empresas": """
SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY clave, pais
  ORDER BY COALESCE(market_cap_eur, 0) DESC, length(ticker), ticker) AS rn FROM claves) WHERE rn = 1 OR clave = ''""",
    "evaluadas": f"SELECT *, {reason_list()} AS motivos, {reason_list()} = '' AS pasa FROM empresas",
    "pasan": """
SELECT ticker, RANK() OVER (ORDER BY roic DESC NULLS LAST) + (COUNT(*) OVER (PARTITION BY roic) - 1) / 2e0 AS rank_roic,
  RANK() OVER (ORDER BY earnings_yield DESC NULLS LAST) + (COUNT(*) OVER (PARTITION BY earnings_yield) - 1) / 2e0 AS rank_ey
FROM evaluadas WHERE pasa""",
    "rankeadas": """
SELECT e.*, p.rank_roic, p.rank_ey, p.rank_roic + p.rank_ey AS puntuacion
FROM evaluadas e LEFT JOIN pasan p ON p.ticker = e.ticker""",
    # quality
    "limpia": """
SELECT *, TRY_CAST(fecha_resultados AS DATE) AS fr, TRY_CAST(fecha_flujo_caja AS DATE) AS ff,
  TRY_CAST(fecha_balance AS DATE) AS fb, DATE '2002-12-31' AS hoy FROM fundamentals""",
    "graduada": f"""
SELECT *, CASE WHEN error_descarga <> '' THEN error_descarga ELSE incidencias END AS incidencias_datos,
  CASE WHEN error_descarga <> '' THEN 'error' WHEN faltan_pilares >= 3 THEN 'inutilizable'
       WHEN incidencias <> '' THEN 'revisar' ELSE 'ok' END AS calidad
FROM (SELECT * EXCLUDE (calidad_datos), concat_ws('; ',
  CASE WHEN ausentes <> '' THEN concat('campos ausentes: ', ausentes) END,
  CASE WHEN market_cap IS NULL OR market_cap <= 0 THEN 'capitalización no positiva o ausente' END,
  CASE WHEN total_debt < 0 THEN 'deuda negativa' END, CASE WHEN cash < 0 THEN 'caja negativa' END,
  CASE WHEN divisa_cotizacion = '' OR divisa_financiera = '' THEN 'divisa de cotización o financiera ausente'
       WHEN NOT divisa_consistente THEN concat('divisas incompatibles ', divisa_cotizacion, '/', divisa_financiera) END,
  CASE WHEN tipo_periodo NOT IN ('TTM', 'ANUAL') THEN 'periodo contable no identificado' END,
  {', '.join(
      f"CASE WHEN {c} IS NULL THEN 'fecha de {n} ausente' WHEN date_diff('day', {c}, hoy) > 550 THEN concat('{n} obsoleto (', CAST(date_diff('day', {c}, hoy) AS STRING), ' días)') WHEN date_diff('day', {c}, hoy) < -7 THEN 'fecha futura de {n}' END"
      for n, c in (('resultados', 'fr'), ('flujo de caja', 'ff'), ('balance', 'fb')))},
  CASE WHEN abs(date_diff('day', fr, ff)) > 45 THEN concat('resultados y flujo de caja desalineados (', CAST(abs(date_diff('day', fr, ff)) AS STRING), ' días)') END
 ) AS incidencias,
 {' + '.join(f'CAST({c} IS NULL AS INT)' for c in S.PILLAR_FIELDS)} AS faltan_pilares
 FROM (SELECT *, concat_ws(', ', {', '.join(f"CASE WHEN {c} IS NULL THEN {quoted(n)} END" for c, n in S.ESSENTIAL_FIELDS.items())}) AS ausentes FROM limpia))""",
    "incidencia": """
SELECT ticker, error_descarga, trim(u.parte) AS incidencia, lower(trim(u.parte)) AS m
FROM graduada, UNNEST(string_split(incidencias_datos, ';')) AS u(parte) WHERE trim(u.parte) <> ''""",
    "categorias": """
SELECT DISTINCT ticker, categoria FROM (
  SELECT ticker, 'errores_descarga' AS categoria FROM graduada WHERE error_descarga <> '' OR calidad = 'error'
  UNION ALL
  SELECT ticker, CASE WHEN starts_with(m, 'campos ausentes:') THEN 'campos_ausentes' WHEN contains(m, 'divisa') THEN 'divisas'
    WHEN contains(m, 'obsoleto') THEN 'cuentas_obsoletas' WHEN contains(m, 'fecha futura') THEN 'fechas_futuras'
    WHEN contains(m, 'fecha de ') AND contains(m, 'ausente') THEN 'fechas_ausentes'
    WHEN contains(m, 'desalineados') THEN 'periodos_desalineados'
    WHEN contains(m, 'periodo contable no identificado') THEN 'periodo_no_identificado'
    WHEN contains(m, 'capitalización no positiva') OR contains(m, 'deuda negativa') OR contains(m, 'caja negativa') THEN 'valores_invalidos'
    WHEN error_descarga = '' THEN 'otras' END FROM incidencia) WHERE categoria IS NOT NULL""",
    "campos": """
SELECT trim(f.campo) AS campo, COUNT(*) AS menciones FROM (SELECT incidencia FROM incidencia WHERE starts_with(m, 'campos ausentes:')),
  UNNEST(string_split(substr(incidencia, strpos(incidencia, ':') + 1), ',')) AS f(campo) WHERE trim(f.campo) <> '' GROUP BY 1""",
    # journal
    "day_ev": """
SELECT * FROM (SELECT *, CAST(ts AS DATE) AS dia, ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "journal": f"""
SELECT concat('snap_', CAST(dia AS STRING)) AS snapshot_id, CAST(dia AS TIMESTAMP) AS fecha_ejecucion, dia,
  concat('U', CAST(user_id AS STRING)) AS ticker, concat('Compañía ', CAST(user_id AS STRING)) AS nombre,
  {nth(S.SECTORS, 'user_id % 9')} AS sector, {nth(list(S.COMPARABLE_REGIONS), 'user_id % 4')} AS region,
  CASE WHEN event_type = 'error' THEN 'Timeout: no response' ELSE '' END AS error_descarga,
  (value > 20 AND event_type <> 'error') AS pasa, value AS per, value / 2 AS ev_ebit, value / 100 AS roic,
  CASE WHEN value > 20 THEN ROUND(value * 2) END AS puntuacion FROM day_ev""",
    "runs": """
SELECT snapshot_id, fecha_ejecucion, CAST(date_trunc('week', dia) AS DATE) AS semana, (EXTRACT(DAY FROM dia) % 3 <> 0) AS oficial,
  ROW_NUMBER() OVER (PARTITION BY date_trunc('week', dia) ORDER BY dia) AS revision
FROM (SELECT DISTINCT snapshot_id, fecha_ejecucion, dia FROM journal) s WHERE dia >= DATE '2024-01-04'""",
    "efectivas": """
SELECT snapshot_id, 'oficial' AS origen FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY semana ORDER BY revision DESC, fecha_ejecucion DESC) AS k FROM runs WHERE oficial) WHERE k = 1
UNION ALL SELECT DISTINCT snapshot_id, 'legacy' FROM journal WHERE snapshot_id NOT IN (SELECT snapshot_id FROM runs)""",
    "oficial": "SELECT * FROM journal WHERE snapshot_id IN (SELECT snapshot_id FROM efectivas)",
    "senales": """
SELECT * EXCLUDE (antes) FROM (SELECT *, LAG(pasa, 1, FALSE) OVER (PARTITION BY ticker ORDER BY fecha_ejecucion, snapshot_id) AS antes
  FROM oficial WHERE error_descarga = '') WHERE pasa AND NOT antes""",
    "prices": """
SELECT concat('U', CAST(user_id AS STRING)) AS ticker, dia AS fecha, 50 + value AS close FROM day_ev WHERE event_type <> 'error'""",
    "senal_precio": """
SELECT s.ticker, s.dia AS entrada, p.fecha, p.close,
  MAX(p.close) OVER (PARTITION BY s.ticker, s.dia ORDER BY p.fecha) AS maximo
FROM senales s LEFT JOIN prices p ON p.ticker = s.ticker AND p.fecha >= s.dia""",
    "tracking": """
SELECT concat('U', CAST(user_id AS STRING)) AS ticker, CAST(date_trunc('week', ts) AS DATE) AS fecha_entrada,
  CAST(ts AS DATE) AS fecha_calculo, CASE WHEN event_type <> 'error' THEN value / 50 - 1 END AS retorno_total, event_id AS orden FROM events""",
    "fx": """
SELECT CAST(ts AS DATE) AS fecha, (['USD', 'GBP', 'JPY'])[user_id % 3 + 1] AS divisa,
  CAST(MAX(CAST(ROUND(value * 100) AS BIGINT)) // 100 AS DOUBLE) / 1000 + 0.5e0 AS close FROM events WHERE event_type <> 'error' GROUP BY ALL""",
    # statements and filings
    "statements": statement_rows(),
    "conceptos": values_table(concept_priority(S.STATEMENT_CONCEPTS), "statement, campo, concept, prioridad"),
    "serie": """
SELECT s.*, c.campo, c.prioridad, MIN(c.prioridad) OVER (PARTITION BY s.ticker, s.statement, s.basis, c.campo) AS mejor
FROM statements s JOIN conceptos c ON c.statement = s.statement AND c.concept = s.concept WHERE s.value IS NOT NULL""",
    "valores": """
SELECT ticker, statement, basis, campo, MAX_BY(value, period_end) AS ultimo,
  MAX(CASE WHEN k = 2 THEN value END) AS anterior, MIN_BY(value, period_end) AS primero, COUNT(*) AS n,
  MIN(period_end) AS desde, MAX(period_end) AS hasta
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, statement, basis, campo ORDER BY period_end DESC) AS k FROM serie WHERE prioridad = mejor)
GROUP BY ALL""",
    "base_periodo": """
SELECT ticker, CASE WHEN SUM(CAST(statement = 'resultados' AND basis = 'TTM' AS INT)) > 0 AND SUM(CAST(statement = 'flujo_caja' AND basis = 'TTM' AS INT)) > 0
  THEN 'TTM' ELSE 'ANUAL' END AS tipo_periodo FROM statements GROUP BY ticker""",
    "hechos": fact_rows(),
    "hechos_anuales": """
SELECT * FROM hechos WHERE form = '10-K' AND fp = 'FY' AND val IS NOT NULL
 AND (inicio IS NULL OR date_diff('day', CAST(inicio AS DATE), CAST(fin AS DATE)) BETWEEN 300 AND 430)""",
    "conceptos_sec": values_table(concept_priority(S.FACT_CONCEPTS), "campo, concept, prioridad"),
    "hechos_campo": f"""
SELECT h.*, c.campo, c.prioridad FROM hechos_anuales h JOIN conceptos_sec c ON c.concept = h.concept
WHERE (h.inicio IS NULL) = (c.campo IN {in_list(S.INSTANT_FIELDS)})""",
    "unidad_filer": """
SELECT cik, unidad FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cik ORDER BY fin DESC, filed DESC, prioridad) AS k FROM hechos_campo WHERE campo = 'ingresos') WHERE k = 1""",
    "hecho_ultimo": """
SELECT * EXCLUDE (k) FROM (SELECT h.*, ROW_NUMBER() OVER (PARTITION BY h.cik, h.campo ORDER BY h.fin DESC, h.filed DESC, h.prioridad) AS k
 FROM hechos_campo h LEFT JOIN unidad_filer u ON u.cik = h.cik WHERE u.unidad IS NULL OR h.unidad = u.unidad) WHERE k = 1""",
    # discovery and universes
    "quotes": f"""
SELECT {nth(MARKETS, 's_nationkey')} AS region, {nth(S.SECTORS, 'p_partkey % 9')} AS sector,
  concat('T', CAST(p_partkey AS STRING)) AS ticker, p_partkey AS pk, p_retailprice AS price,
  CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS mcap_c, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""",
    "cuotas": values_table(QUOTA_ROWS, "region, cuota, cuota_sel, ro"),
    "sectores": values_table(SECTOR_ROWS, "sector, so"),
    "filtradas": f"""
SELECT q.*, c.cuota, c.cuota_sel, c.ro, s.so FROM quotes q JOIN cuotas c USING (region) JOIN sectores s USING (sector)
WHERE price >= 2 AND volume >= {VOLUME_FLOOR}""",
    "topn": """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY region, sector ORDER BY mcap_c DESC, ticker) AS rank_bucket FROM filtradas) WHERE rank_bucket <= cuota""",
    "catalogo": """
SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY ro, so, rank_bucket) AS k FROM topn) WHERE k = 1""",
    "titulares": "SELECT concat('T', CAST(p_partkey AS STRING)) AS ticker FROM part WHERE p_partkey % 4 = 0",
    "seleccion": """
SELECT *, CASE WHEN rank_bucket <= cuota_sel THEN 'balanced_rank_v1:cuota_base' ELSE 'balanced_rank_v1:retencion_incumbente' END AS origen_inclusion
FROM catalogo WHERE rank_bucket <= cuota_sel OR (rank_bucket <= cuota_sel + 3 AND ticker IN (SELECT ticker FROM titulares))""",
    "supervivientes": "SELECT * FROM seleccion WHERE pk % 10 <> 3",
    "descartadas": "SELECT * FROM seleccion WHERE pk % 10 = 3",
    "reserva": "SELECT * FROM catalogo WHERE ticker NOT IN (SELECT ticker FROM seleccion)",
    "huecos": "SELECT *, ROW_NUMBER() OVER (PARTITION BY region, sector ORDER BY rank_bucket, ticker) AS k FROM descartadas",
    "cola": "SELECT *, ROW_NUMBER() OVER (PARTITION BY region, sector ORDER BY rank_bucket, ticker) AS k FROM reserva",
    "paso1": """
SELECT h.ticker AS removed_ticker, c.ticker AS replacement_ticker, h.region, h.sector AS sector_origen, c.sector AS sector_reemplazo,
  c.rank_bucket AS rank_reemplazo, h.ro, h.so, h.rank_bucket FROM huecos h LEFT JOIN cola c ON c.region = h.region AND c.sector = h.sector AND c.k = h.k""",
    "huecos2": """
SELECT *, ROW_NUMBER() OVER (PARTITION BY region ORDER BY so, rank_bucket, removed_ticker) AS k FROM paso1 WHERE replacement_ticker IS NULL""",
    "cola2": """
SELECT *, ROW_NUMBER() OVER (PARTITION BY region ORDER BY CAST(rank_bucket AS DOUBLE) / cuota, rank_bucket, so, ticker) AS k FROM reserva
WHERE ticker NOT IN (SELECT replacement_ticker FROM paso1 WHERE replacement_ticker IS NOT NULL)""",
    "reemplazos": """
SELECT removed_ticker, replacement_ticker, 'mismo_bucket' AS strategy, region, sector_origen, sector_reemplazo, rank_reemplazo FROM paso1 WHERE replacement_ticker IS NOT NULL
UNION ALL
SELECT h.removed_ticker, c.ticker, CASE WHEN c.ticker IS NULL THEN 'sin_reserva' ELSE 'misma_region' END, h.region, h.sector_origen, c.sector, c.rank_bucket
FROM huecos2 h LEFT JOIN cola2 c ON c.region = h.region AND c.k = h.k""",
    "huella": """
SELECT region, CAST(COUNT(*) AS BIGINT) AS ticker_count, sha256(concat(string_agg(ticker, chr(10) ORDER BY ticker), chr(10))) AS hash
FROM catalogo GROUP BY region""",
    # verification
    "pares": verification_side(),
    "verificadas": """
SELECT *, CASE
  WHEN st IS NULL OR se <> '' THEN 'sin_cobertura' WHEN v1 IS NULL OR v2 IS NULL THEN 'sin_dato'
  WHEN c1 = '' OR c2 = '' OR c1 <> c2 THEN 'no_comparable' WHEN t1 = '' OR t2 = '' OR t1 <> t2 THEN 'no_comparable'
  WHEN TRY_CAST(d1 AS DATE) IS NULL OR TRY_CAST(d2 AS DATE) IS NULL THEN 'no_comparable'
  WHEN abs(date_diff('day', TRY_CAST(d1 AS DATE), TRY_CAST(d2 AS DATE))) > 45 THEN 'no_comparable'
  WHEN v1 = 0 AND v2 <> 0 THEN 'no_comparable'
  WHEN v1 = 0 THEN 'verificado'
  WHEN abs(v2 - v1) / abs(v1) <= 0.10 THEN 'verificado' WHEN abs(v2 - v1) / abs(v1) <= 0.25 THEN 'advertencia'
  ELSE 'discrepancia_material' END AS numerico FROM pares""",
    "fondos": f"""
SELECT CASE pk % 3 WHEN 0 THEN 'etf' WHEN 1 THEN 'fondo' ELSE 'accion' END AS tipo_activo, region,
  CASE WHEN pk % 3 = 2 THEN sector ELSE {nth(THEMES, f'pk % {len(THEMES)}')} END AS category, ticker, pk, price, mcap_c, volume FROM quotes""",
}


UID = "concat('uv_', CAST(2024 + ({nk}) // 4 AS STRING), 'q', CAST(({nk}) % 4 + 1 AS STRING), '_r01')"
TABLES["mercados"] = f"SELECT n_nationkey AS nk, {nth(MARKETS, 'n_nationkey')} AS region, {UID.format(nk='n_nationkey')} AS universe_id FROM nation WHERE n_nationkey < 22"
TABLES["miembros"] = "SELECT m.universe_id, c.* FROM catalogo c JOIN mercados m USING (region)"
TABLES["versiones1"] = """
SELECT m.*, COALESCE(h.ticker_count, 0) AS cuenta, COALESCE(h.hash, '') AS huella_real,
 CASE WHEN nk = 21 THEN 'active' WHEN nk = 8 THEN 'archived' WHEN nk % 3 = 0 THEN 'draft' ELSE 'retired' END AS status FROM mercados m LEFT JOIN huella h USING (region)"""
TABLES["versiones"] = f"""
SELECT nk, CASE WHEN nk = 5 THEN 'universo-5' ELSE universe_id END AS universe_id,
 CASE WHEN nk IN (6, 7) THEN 'oficiales/repetido.csv' ELSE concat('oficiales/', universe_id, '.csv') END AS path, status,
 CASE WHEN nk = 9 THEN 'ayer' ELSE '2024-01-01T00:00:00Z' END AS created_at, CASE WHEN status <> 'draft' AND nk <> 10 THEN '2024-02-01' END AS effective_from,
 CASE WHEN nk = 11 THEN universe_id WHEN nk = 12 THEN 'uv_1999q1_r01' WHEN nk > 0 AND nk <> 6 THEN {UID.format(nk='nk - 1')} END AS supersedes,
 CASE WHEN nk = 13 THEN 'etf' ELSE 'equity' END AS asset_type, cuenta + CASE WHEN nk = 14 THEN 1 ELSE 0 END AS ticker_count,
 CASE WHEN nk = 15 THEN repeat('0', 64) ELSE huella_real END AS sha256, CASE WHEN nk = 16 THEN '' ELSE 'balanced_rank_v1' END AS selection_method FROM versiones1"""


def with_tables(statement: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` plus every table expression the statement needs, in order."""
    known = {**TABLES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str, owner: str | None = None) -> None:
        text = re.sub(r"'(?:[^']|'')*'", "''", text)
        for word in dict.fromkeys(re.findall(r"\b[a-z_][a-z_0-9]*\b", text)):
            follows = re.search(rf"\b(?:FROM|JOIN)\s+{word}\b|,\s*{word}\s+[a-z]\b|\b{word}\.", text)
            if word in known and word != owner and word not in needed and follows:
                visit(known[word], word)
                if word not in needed:
                    needed.append(word)

    visit(statement)
    if not needed:
        return statement.strip()
    ctes = ",\n".join(f"{name} AS ({known[name].strip()})" for name in needed)
    return f"WITH {ctes}\n{statement.strip()}"
