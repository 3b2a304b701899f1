"""Explicit schemas of stored tables; types are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from valsieve import settings as S

NUMBERS = {
    "market_cap", "market_cap_eur", "per", "ev_ebit", "fcf_yield", "roic", "margen_op", "deuda_ebitda",
    "cobertura_int", "cagr_ingresos", "earnings_yield", "caja_neta_pct_mcap", "per_mediana_sector",
    "n_sector", "rank_roic", "rank_ey", "puntuacion", "net_income", "ebit", "ebitda", "ingresos",
    "ingresos_inicio_historico", "ingresos_fin_historico", "anios_historico", "free_cash_flow",
    "total_debt", "cash", "equity", "total_debt_inicio", "cash_inicio", "equity_inicio",
    "gasto_intereses", "tasa_impositiva", "precio_entrada", "precio_actual", "retorno_total",
    "max_drawdown", "dias_en_seguimiento", "valor_primario", "valor_secundario", "diferencia_pct",
    "tasa_exito_descarga", "umbral_exito_minimo",
}
INTEGERS = {
    "revision", "rank_bucket", "cuota_bucket", "tickers_solicitados", "resultados_brutos",
    "descargas_correctas", "errores_descarga", "deduplicados", "empresas_evaluadas", "candidatas",
    "datos_ok", "datos_revisar", "datos_inutilizables",
}
BOOLEANS = {"pasa", "roic_fiable", "divisa_consistente", "oficial"}
INSTANTS = {"fecha_ejecucion", "fecha_calculo", "fecha_entrada"}


def type_of(column: str) -> T.DataType:
    if column in NUMBERS:
        return T.DoubleType()
    if column in INTEGERS:
        return T.IntegerType()
    if column in BOOLEANS:
        return T.BooleanType()
    if column in INSTANTS:
        return T.TimestampType()
    return T.StringType()


def schema_of(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, type_of(c)) for c in columns])


FUNDAMENTALS_COLUMNS = (
    S.IDENTITY_COLUMNS
    + ["net_income", "ebit", "ebitda", "ingresos", "ingresos_inicio_historico", "ingresos_fin_historico",
       "anios_historico", "free_cash_flow", "total_debt", "cash", "equity", "total_debt_inicio",
       "cash_inicio", "equity_inicio", "gasto_intereses", "tasa_impositiva", "error_descarga"]
    + S.PROVENANCE_COLUMNS + ["url_fuente"]
)
EVALUATED_COLUMNS = (
    [c for c in S.METRIC_COLUMNS if c not in S.PROVENANCE_COLUMNS]
    + ["pasa", "motivos_descarte", "rank_roic", "rank_ey", "puntuacion"] + S.PROVENANCE_COLUMNS
)
JOURNAL_COLUMNS = ["fecha_ejecucion", "semana_iso", *EVALUATED_COLUMNS, "snapshot_id"]
TRACKING_COLUMNS = ["fecha_calculo", *S.SIGNAL_COLUMNS, "precio_entrada", "precio_actual", "retorno_total",
                    "max_drawdown", "dias_en_seguimiento", "error_descarga"]

FUNDAMENTALS = schema_of(FUNDAMENTALS_COLUMNS)
JOURNAL = schema_of(JOURNAL_COLUMNS)
CONTROL = schema_of(S.CONTROL_COLUMNS)
TRACKING = schema_of(TRACKING_COLUMNS)
VERIFICATION = schema_of(S.VERIFICATION_COLUMNS)
UNIVERSE = schema_of(S.UNIVERSE_COLUMNS)
DISCOVERY = schema_of(S.DISCOVERY_COLUMNS)
VERSIONS = (
    "universe_id string, path string, status string, created_at string, effective_from string, supersedes string, "
    "asset_type string, ticker_count bigint, sha256 string, selection_method string, notes string"
)
MANIFEST = f"schema_version int, active_universe_id string, universes array<struct<{VERSIONS.replace(' string', ': string').replace(' bigint', ': bigint')}>>"
DISCOVERY_CONTROL = (
    "schema_version int, discovery_id string, created_at string, source string, csv_path string, sha256 string, "
    "catalog_sha256 string, config_sha256 string, "
    "config struct<perfil: string, cuotas_region: map<string, int>, sectores: array<string>>, "
    "control struct<buckets_solicitados: int, buckets_exitosos: int, buckets_fallidos: int, tickers_unicos: int>"
)
