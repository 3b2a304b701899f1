"""Dedup, rules, ranking, views and summaries of one screening run."""

from __future__ import annotations

from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.catalog import query
from valsieve.catalog.oracle import peer_choice, reason_list, stripped_name
from valsieve.catalog.tables import CAP_FLOOR
from valsieve.functions.text import company_key
from valsieve.operators import integrity, listings, metrics, ordering, ranking, screen, summaries
from valsieve.plans.analysis import analyze


def evaluated(t):
    companies = listings.dedup_listings(metrics.compute_metrics(t.observations()))
    return screen.apply_screen(companies, CAP_FLOOR_LIMITS)


CAP_FLOOR_LIMITS = {**S.THRESHOLDS, **CAP_FLOOR}


def codes():
    return F.array_join("motivos", ";").alias("motivos")



@query("company_key", f"SELECT ticker, {stripped_name('nombre')} AS clave FROM listing")
def company_key_query(t):
    return t.listing().select("ticker", company_key("nombre").alias("clave"))


@query("dedup_listings", "SELECT ticker, nombre, pais, ROUND(market_cap_eur, 6) AS market_cap_eur FROM empresas")
def dedup_listings(t):
    return listings.dedup_listings(t.fundamentals()).select(
        "ticker", "nombre", "pais", F.round("market_cap_eur", 6).alias("market_cap_eur"))


@query("union_parts", "SELECT ticker, nombre = '' AS sin_nombre FROM empresas")
def union_parts(t):
    return listings.union_parts(t.fundamentals()).select("ticker", (F.col("nombre") == "").alias("sin_nombre"))


@query("screen_reasons", "SELECT ticker, motivos, CAST(CASE WHEN motivos = '' THEN 0 ELSE length(motivos) - length(replace(motivos, ';', '')) + 1 END AS INT) AS n_motivos FROM evaluadas")
def screen_reasons(t):
    return evaluated(t).select("ticker", codes(), F.size("motivos").alias("n_motivos"))


@query("screen_filter", "SELECT ticker, nombre, sector, region, pasa, motivos, ROUND(per, 6) AS per, ROUND(roic, 6) AS roic FROM evaluadas")
def screen_filter(t):
    return evaluated(t).select("ticker", "nombre", "sector", "region", "pasa", codes(),
                               F.round("per", 6).alias("per"), F.round("roic", 6).alias("roic"))


SCENARIOS = {
    "base": CAP_FLOOR,
    "laxo": {**CAP_FLOOR, "per_max": 30.0, "per_bajo_mediana_sector": False},
    "estricto": {**CAP_FLOOR, "roic_min": 0.2, "min_empresas_sector": 50},
}


@query("threshold_overrides", " UNION ALL ".join(
    f"SELECT '{name}' AS escenario, ticker, base_mediana, n_sector, {reason_list(o)} AS motivos, {reason_list(o)} = '' AS pasa "
    f"FROM ({peer_choice({**S.THRESHOLDS, **o}['min_empresas_sector'])})"
    for name, o in SCENARIOS.items()))
def threshold_overrides(t):
    out = screen.screen_scenarios(t.observations(), SCENARIOS)
    return out.select("escenario", "ticker", "base_mediana", "n_sector", codes(), "pasa")


@query("rank_average", """
SELECT ticker, RANK() OVER (ORDER BY per DESC NULLS LAST) + (COUNT(*) OVER (PARTITION BY per) - 1) / 2e0 AS rank_per FROM ratios""")
def rank_average(t):
    rows = metrics.ratios(t.observations()).select("ticker", "per")
    return ordering.attach_descending_ranks(rows, {"per": "rank_per"}).select("ticker", "rank_per")


@query("magic_rank", """
SELECT ticker, RANK() OVER (ORDER BY roic DESC NULLS LAST) + (COUNT(*) OVER (PARTITION BY roic) - 1) / 2e0 AS rank_roic,
 RANK() OVER (ORDER BY earnings_yield DESC NULLS LAST) + (COUNT(*) OVER (PARTITION BY earnings_yield) - 1) / 2e0 AS rank_ey,
 RANK() OVER (ORDER BY roic DESC NULLS LAST) + (COUNT(*) OVER (PARTITION BY roic) - 1) / 2e0
 + RANK() OVER (ORDER BY earnings_yield DESC NULLS LAST) + (COUNT(*) OVER (PARTITION BY earnings_yield) - 1) / 2e0 AS puntuacion
FROM ratios""")
def magic_rank(t):
    rows = metrics.ratios(t.observations()).select("ticker", "roic", "earnings_yield")
    return ranking.magic_rank(rows).select("ticker", "rank_roic", "rank_ey", "puntuacion")


RANKED_SQL = "SELECT ticker, nombre, sector, region, pasa, motivos, rank_roic, rank_ey, puntuacion FROM rankeadas"


@query("rank_candidates", RANKED_SQL)
def rank_candidates(t):
    ranked = analyze(t.observations(), CAP_FLOOR).ranked
    return ranked.select("ticker", "nombre", "sector", "region", "pasa", codes(), "rank_roic", "rank_ey", "puntuacion")


@query("split_candidates", "SELECT ticker, CASE WHEN pasa THEN 'candidata' ELSE 'descartada' END AS grupo FROM evaluadas")
def split_candidates(t):
    e = evaluated(t)
    return (screen.candidates(e).select("ticker", F.lit("candidata").alias("grupo"))
            .unionByName(screen.discarded(e).select("ticker", F.lit("descartada").alias("grupo"))))


@query("view_filter", """
SELECT ticker, sector, region FROM evaluadas WHERE pasa AND region IN ('Europa', 'Japon', 'Norteamerica') AND sector IN ('ECONOMY', 'SMALL', 'PROMO')""")
def view_filter(t):
    return screen.view_filter(evaluated(t), True, ["Europa", "Japon", "Norteamerica"],
                              ["ECONOMY", "SMALL", "PROMO"]).select("ticker", "sector", "region")


@query("warning_lists", """
SELECT ticker, NOT roic_fiable AS roic_dudoso, COALESCE(caja_neta_pct_mcap > 0.3, FALSE) AS mucha_caja
FROM evaluadas WHERE pasa AND (NOT roic_fiable OR COALESCE(caja_neta_pct_mcap > 0.3, FALSE))""")
def warning_lists(t):
    return screen.warning_lists(evaluated(t)).select("ticker", "roic_dudoso", "mucha_caja")


@query("candidate_semi", """
SELECT ticker, ROUND(ingresos, 6) AS ingresos, ROUND(ebit, 6) AS ebit FROM fundamentals WHERE ticker IN (SELECT ticker FROM evaluadas WHERE pasa)""")
def candidate_semi(t):
    rows = summaries.candidate_fundamentals(t.fundamentals(), evaluated(t))
    return rows.select("ticker", F.round("ingresos", 6).alias("ingresos"), F.round("ebit", 6).alias("ebit"))


@query("annual_view", """
SELECT f.ticker, CASE WHEN f.pk % 2 = 0 THEN 'primario_anual' ELSE 'primario' END AS proveedor_datos,
  CASE WHEN f.pk % 2 = 0 THEN 'ANUAL' ELSE f.tipo_periodo END AS tipo_periodo,
  ROUND(CASE WHEN f.pk % 2 = 0 THEN f.ingresos * 0.9e0 ELSE f.ingresos END, 6) AS ingresos, ROUND(f.ebit, 6) AS ebit
FROM fundamentals f WHERE ticker IN (SELECT ticker FROM evaluadas WHERE pasa)""")
def annual_view(t):
    pk = F.substring("ticker", 2, 20).cast("bigint")
    annual = F.when(pk % 2 == 0, F.create_map(F.lit("ingresos"), F.col("ingresos") * 0.9, F.lit("ebit"), F.col("ebit")))
    rows = t.fundamentals().withColumns({
        "comparables_anuales": annual, "fecha_resultados_anual": F.col("fecha_resultados"),
        "fecha_flujo_caja_anual": F.col("fecha_flujo_caja")})
    view = summaries.annual_view(summaries.candidate_fundamentals(rows, evaluated(t)))
    return view.select("ticker", "proveedor_datos", "tipo_periodo",
                       F.round("ingresos", 6).alias("ingresos"), F.round("ebit", 6).alias("ebit"))


@query("composition_counts", """
SELECT 'region' AS dimension, region AS valor, COUNT(*) AS n, ROUND(COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), 6) AS cuota FROM empresas GROUP BY region
UNION ALL SELECT 'sector', sector, COUNT(*), ROUND(COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), 6) FROM empresas GROUP BY sector""")
def composition_counts(t):
    companies = listings.dedup_listings(metrics.ratios(t.fundamentals()))
    return summaries.composition(companies, ["region", "sector"]).withColumn("cuota", F.round("cuota", 6))


@query("quality_counts", "SELECT calidad_datos AS calidad, COUNT(*) AS n, 'primario' AS proveedores FROM empresas GROUP BY calidad_datos")
def quality_counts(t):
    return summaries.quality_counts(listings.dedup_listings(t.fundamentals()))


CONTROL = """SELECT CAST((SELECT COUNT(*) FROM metricas) AS BIGINT) AS tickers_solicitados, (SELECT COUNT(*) FROM metricas) AS resultados_brutos,
 (SELECT COUNT(*) FROM metricas WHERE error_descarga = '') AS descargas_correctas, (SELECT COUNT(*) FROM metricas WHERE error_descarga <> '') AS errores_descarga,
 (SELECT COUNT(*) FROM metricas) - (SELECT COUNT(*) FROM evaluadas) AS deduplicados, (SELECT COUNT(*) FROM evaluadas) AS empresas_evaluadas,
 (SELECT COUNT(*) FROM evaluadas WHERE pasa) AS candidatas,
 ROUND((SELECT COUNT(*) FROM metricas WHERE error_descarga = '') / CAST((SELECT COUNT(*) FROM metricas) AS DOUBLE), 6) AS tasa_exito_descarga,
 0.8e0 AS umbral_exito_minimo, 'primario' AS proveedor_datos, (SELECT COUNT(*) FROM evaluadas WHERE calidad_datos = 'ok') AS datos_ok,
 (SELECT COUNT(*) FROM evaluadas WHERE calidad_datos = 'revisar') AS datos_revisar,
 (SELECT COUNT(*) FROM evaluadas WHERE calidad_datos IN ('error', 'inutilizable')) AS datos_inutilizables"""


def control(t):
    """The control record from the counts of the job that writes the evaluated table."""
    obtained = t.observations()
    result = analyze(obtained, CAP_FLOOR_LIMITS)
    return summaries.observed_control(result.evaluated, result.counts, obtained, requested=t.listing())


@query("run_control_row", CONTROL)
def run_control_row(t):
    return control(t).withColumn("tasa_exito_descarga", F.round("tasa_exito_descarga", 6))


def gate_sql(run: str, evaluated: str, obtained: str) -> str:
    """The checks of one run: ``obtained`` and ``evaluated`` select from metricas and evaluadas."""
    return f"""
SELECT '{run}' AS ejecucion, *, tickers_duplicados = 0 AND brutos_cuadran AND deduplicados_cuadran AND calidad_cuadra AND exito_suficiente AS valida FROM (
SELECT CAST((SELECT COUNT(*) FROM (SELECT ticker FROM ({evaluated}) GROUP BY ticker HAVING COUNT(*) > 1)) AS BIGINT) AS tickers_duplicados,
 (SELECT COUNT(*) FROM ({obtained})) = (SELECT COUNT(*) FROM listing) AND (SELECT COUNT(*) FROM listing) > 0 AS brutos_cuadran,
 (SELECT COUNT(*) FILTER (WHERE clave = '') + COUNT(DISTINCT CASE WHEN clave <> '' THEN [clave, pais] END)
  FROM (SELECT {stripped_name('nombre')} AS clave, pais FROM ({obtained}))) = (SELECT COUNT(*) FROM ({evaluated})) AS deduplicados_cuadran,
 (SELECT COUNT(*) FROM ({evaluated}) WHERE calidad_datos IN ('ok', 'revisar', 'inutilizable', 'error')) = (SELECT COUNT(*) FROM ({evaluated})) AS calidad_cuadra,
 (SELECT COUNT(*) FROM ({obtained}) WHERE error_descarga = '') >= 0.8 * (SELECT COUNT(*) FROM listing) AS exito_suficiente)"""


#: A whole run; one whose failed downloads were lost on the way; one whose rejected rows were.
GATED_RUNS = {
    "completa": ("SELECT * FROM evaluadas", "SELECT * FROM metricas"),
    "descargas_perdidas": ("SELECT * FROM evaluadas WHERE error_descarga = ''", "SELECT * FROM metricas WHERE error_descarga = ''"),
    "filas_perdidas": ("SELECT * FROM evaluadas WHERE pasa", "SELECT * FROM metricas"),
}


@query("integrity_gate", " UNION ALL ".join(gate_sql(run, *sides) for run, sides in GATED_RUNS.items()))
def integrity_gate(t):
    asked, obtained = t.listing(), t.observations()
    result = analyze(obtained, CAP_FLOOR_LIMITS)
    e = result.evaluated
    delivered = F.col("error_descarga") == ""
    runs = {
        "descargas_perdidas": (e.where(delivered), obtained.where(delivered)),
        "filas_perdidas": (e.where("pasa"), obtained),
    }
    checked = [
        integrity.gate(kept, summaries.run_control(kept, got, requested=asked)).withColumn("ejecucion", F.lit(run))
        for run, (kept, got) in runs.items()
    ]
    whole = integrity.gate(e, summaries.observed_control(e, result.counts, obtained, requested=asked)).withColumn("ejecucion", F.lit("completa"))
    return whole.unionByName(checked[0]).unionByName(checked[1])


@query("api_summary", """
SELECT COUNT(*) AS requested_tickers, (SELECT COUNT(*) FROM metricas) AS raw_results,
 COUNT(*) AS evaluated_companies, COUNT(*) FILTER (WHERE pasa) AS candidates, COUNT(*) FILTER (WHERE NOT pasa) AS discarded,
 (SELECT COUNT(*) FROM metricas WHERE error_descarga <> '') AS download_errors, (SELECT COUNT(*) FROM metricas) - COUNT(*) AS deduplicated_listings,
 CASE WHEN COUNT(*) FILTER (WHERE pasa) > 0 THEN 'candidates_found' ELSE 'no_candidates' END AS status,
 concat(CAST(COUNT(*) FILTER (WHERE pasa) AS STRING), ' of ', CAST(COUNT(*) AS STRING), ' evaluated companies passed every configured quantitative criterion. This result requires primary-source review and is not an investment recommendation.') AS text
FROM evaluadas""")
def api_summary(t):
    return summaries.api_summary(control(t))
