"""JSON, API, chart and text outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.catalog import query
from valsieve.catalog.tables import CAP_FLOOR
from valsieve.functions.text import venue_symbol
from valsieve.operators import journal, listings, metrics, output, screen
from valsieve.plans.analysis import analyze

SUFFIXES = [".MC", ".DE", ".AS", ".L", ""]


@query("venue_symbol", """
SELECT pk, CASE suf WHEN '.MC' THEN concat('BME:T', CAST(pk AS STRING)) WHEN '.DE' THEN concat('XETR:T', CAST(pk AS STRING))
 WHEN '.AS' THEN concat('EURONEXT:T', CAST(pk AS STRING)) WHEN ' X' THEN NULL ELSE concat('T', CAST(pk AS STRING), suf) END AS simbolo
FROM (SELECT p_partkey AS pk, (['.MC', '.DE', '.AS', '.L', '', ' X'])[p_partkey % 6 + 1] AS suf FROM part)""")
def venue_symbol_query(t):
    from valsieve.catalog.tables import pick

    pk = F.col("p_partkey")
    ticker = F.concat(F.lit(" t"), pk.cast("string"), F.lower(pick([*SUFFIXES, " X"], pk % 6)))
    return t.raw("part").select(pk.alias("pk"), venue_symbol(ticker).alias("simbolo"))


@query("candidates_for_chart", "SELECT ticker, MIN(puntuacion) AS puntuacion, ticker AS simbolo FROM oficial WHERE pasa GROUP BY ticker")
def candidates_for_chart(t):
    rows = journal.effective_journal(t.journal(), t.runs(), "semana")
    return output.chart_candidates(rows).select("ticker", "puntuacion", "simbolo")


BLOCK = """concat(CAST(posicion AS STRING), '. ', ticker, ' — ', nombre, ' (', sector, ', ', region, ')', chr(10),
 '   PER: ', printf('%.2f', per), ' | EV/EBIT: ', printf('%.2f', ev_ebit), ' | FCF yield: N/D | ROIC: ', printf('%.1f%%', roic * 100), ' (fiable: sí)', chr(10),
 '   Deuda neta/EBITDA: N/D | Cobertura intereses: N/D | CAGR ingresos: N/D', chr(10),
 '   Caja neta % cap.: N/D | Capitalización: N/D B EUR | Puntuación ranking: ', printf('%.2f', puntuacion))"""
# Values with few decimals are used, so that rendering never meets a tie.
BRIEFS = {"numeradas": """
SELECT snapshot_id, ticker, nombre, sector, region, FLOOR(per) AS per, FLOOR(ev_ebit) AS ev_ebit, FLOOR(roic * 100) / 100e0 AS roic, puntuacion,
 ROW_NUMBER() OVER (PARTITION BY snapshot_id ORDER BY puntuacion, ticker) AS posicion FROM oficial WHERE pasa"""}


def brief_rows(t):
    rows = journal.effective_journal(t.journal(), t.runs(), "semana").where(F.col("pasa"))
    whole = {"per": F.floor("per").cast("double"), "ev_ebit": F.floor("ev_ebit").cast("double"),
             "roic": F.floor(F.col("roic") * 100) / 100}
    none = F.lit(None).cast("double")
    return rows.withColumns({**whole, "roic_fiable": F.lit(True), **{
        c: none for c in ("fcf_yield", "deuda_ebitda", "cobertura_int", "cagr_ingresos", "caja_neta_pct_mcap", "market_cap_eur")}})


@query("candidate_brief", f"SELECT snapshot_id, ticker, posicion, {BLOCK} AS bloque FROM numeradas", BRIEFS)
def candidate_brief(t):
    return output.candidate_briefs(brief_rows(t), ["snapshot_id"]).select("snapshot_id", "ticker", "posicion", "bloque")


@query("candidate_brief_bundle", f"""
SELECT snapshot_id, posicion, {BLOCK} AS texto FROM numeradas
UNION ALL SELECT snapshot_id, 0, concat('CANDIDATAS (', CAST(COUNT(*) AS STRING), '):') FROM numeradas GROUP BY snapshot_id""", BRIEFS)
def candidate_brief_bundle(t):
    rows = output.brief_bundle(brief_rows(t), ["snapshot_id"])
    title = F.element_at(F.split("texto", "\n"), -1)
    return rows.select("snapshot_id", "posicion", F.when(F.col("posicion") == 0, title).otherwise(F.col("texto")).alias("texto"))


LIMITS = {**S.THRESHOLDS, **CAP_FLOOR}


def printed(value: str, digits: int, after: str = "") -> str:
    return f"printf('%.{digits}f{after.replace('%', '%%')}', {value})"


def half_up(value: str, digits: int, after: str = "") -> str:
    """The shortest decimal form of a double, rounded half up: what Spark prints at decimal ties too."""
    shown = f"CAST(CAST(CAST(abs({value}) AS VARCHAR) AS DECIMAL(38, {digits})) AS VARCHAR)"
    return f"concat(CASE WHEN signbit({value}) THEN '-' ELSE '' END, {shown}, '{after}')"


def reasons_sql(number=printed) -> str:
    """The sentences of the failed rules, in their order."""
    def rule(column, label, name, passes, limit, share=False):
        fails = {"<": ">=", ">": "<=", ">=": "<"}[passes]
        value = number(f"{column} * 100", 1, "%") if share else number(column, 1)
        shown = f"{limit * 100:.0f}%" if share else str(limit)
        return (f"CASE WHEN {column} IS NULL THEN '{label}: sin dato' WHEN {column} {fails} {limit} "
                f"THEN concat('{name} ', {value}, ' {fails} {shown}') END")

    floor = LIMITS["market_cap_eur_min"]
    parts = [
        "CASE WHEN error_descarga <> '' THEN concat('descarga: ', error_descarga) END",
        "CASE WHEN calidad_datos <> 'ok' THEN concat('calidad de datos ', calidad_datos) END",
        "CASE WHEN NOT divisa_consistente THEN 'divisas de cotización y estados financieros incompatibles' END",
        rule("per", "PER", "PER", "<", LIMITS["per_max"]),
        f"CASE WHEN n_sector >= {LIMITS['min_empresas_sector']} THEN CASE WHEN per IS NULL OR per_mediana_sector IS NULL THEN 'PER vs sector: sin dato' "
        f"WHEN per >= per_mediana_sector THEN concat('PER ', {number('per', 1)}, ' >= mediana sector ', {number('per_mediana_sector', 1)}) END END",
        rule("ev_ebit", "EV/EBIT", "EV/EBIT", "<", LIMITS["ev_ebit_max"]),
        rule("fcf_yield", "FCF yield", "FCF yield", ">", LIMITS["fcf_yield_min"], True),
        rule("roic", "ROIC", "ROIC", ">", LIMITS["roic_min"], True),
        rule("margen_op", "Margen op.", "margen operativo", ">", LIMITS["margen_op_min"], True),
        rule("deuda_ebitda", "Deuda/EBITDA", "deuda neta/EBITDA", "<", LIMITS["deuda_ebitda_max"]),
        rule("cobertura_int", "Cobertura int.", "cobertura intereses", ">", LIMITS["cobertura_intereses_min"]),
        rule("cagr_ingresos", "Crec. ingresos", "CAGR ingresos", ">=", LIMITS["crecimiento_ingresos_min"], True),
        f"CASE WHEN market_cap_eur IS NULL THEN 'Capitalización EUR: sin dato' WHEN market_cap_eur <= {floor} THEN "
        f"concat('capitalización ', {number('market_cap_eur / 1e9', 2)}, 'B EUR < {floor / 1e9:.1f}B EUR') END",
    ]
    return "concat_ws('; ', " + ", ".join(parts) + ")"


@query("reason_text", f"SELECT ticker, {reasons_sql(half_up)} = '' AS pasa, {reasons_sql(half_up)} AS motivos_descarte FROM empresas")
def reason_text(t):
    """Verdicts and rendered reasons of the unaltered values, numbers included."""
    companies = listings.dedup_listings(metrics.compute_metrics(t.observations()))
    return screen.apply_screen(companies, LIMITS).select("ticker", "pasa", "motivos_descarte")


@query("export_history_json", """
SELECT 'journal' AS seccion, ticker, snapshot_id, ROUND(per, 6) AS per FROM oficial
UNION ALL SELECT 'ejecuciones', NULL, snapshot_id, NULL FROM runs
UNION ALL SELECT 'candidatas_ultima_semana', ticker, snapshot_id, ROUND(per, 6) FROM oficial WHERE pasa AND fecha_ejecucion = (SELECT MAX(fecha_ejecucion) FROM oficial)
UNION ALL SELECT 'seguimiento', ticker, NULL, NULL FROM tracking""")
def export_history_json(t):
    """The four sections as JSON lines, read back through ``from_json``."""
    from valsieve.plans.history import export_history

    lines = export_history(t.journal(), t.runs(), t.tracking(), "semana")
    parsed = lines.select("seccion", F.from_json("json", "ticker string, snapshot_id string, per double").alias("j"))
    return parsed.select("seccion", "j.ticker", "j.snapshot_id", F.round("j.per", 6).alias("per"))


@query("api_records", "SELECT ticker, pasa, puntuacion FROM rankeadas")
def api_records(t):
    """Candidates and discarded rows as JSON records."""
    ranked = analyze(t.observations(), CAP_FLOOR).ranked
    lines = output.json_rows(ranked.drop("motivos"))
    parsed = lines.select(F.from_json("json", "ticker string, pasa boolean, puntuacion double").alias("j"))
    return parsed.select("j.*")


ROUNDED = ["market_cap", "market_cap_eur", *[c for c in S.RATIO_COLUMNS if c not in ("roic_fiable", "region")], "per_mediana_sector"]
#: Numbers inside the sentences are left out: their values are columns of their own, and ``printf`` renders decimal ties differently.
NUMBER = "[0-9]+[.][0-9]+"
PUBLISHED = [c for c in S.METRIC_COLUMNS if c not in ROUNDED and c not in ("fecha_consulta_utc", "incidencias_datos")]


@query("write_screen_rows", f"""
SELECT {', '.join(PUBLISHED)}, '' AS fecha_consulta_utc, '' AS incidencias_datos, {', '.join(f'ROUND(LEAST({c}, 1e15), 6) AS {c}' for c in ROUNDED)},
 pasa, regexp_replace({reasons_sql()}, '{NUMBER}', '#', 'g') AS motivos_descarte, rank_roic, rank_ey, puntuacion FROM rankeadas""")
def write_screen_rows(t):
    """The published table: every company with metrics, verdict, reasons, ranks."""
    ranked = analyze(t.observations(), CAP_FLOOR).ranked
    return ranked.select(
        *PUBLISHED, *[F.coalesce(c, F.lit("")).alias(c) for c in ("fecha_consulta_utc", "incidencias_datos")],
        *[F.round(F.least(F.col(c), F.lit(1e15)), 6).alias(c) for c in ROUNDED], "pasa",
        F.regexp_replace("motivos_descarte", NUMBER, "#").alias("motivos_descarte"), "rank_roic", "rank_ey", "puntuacion")
