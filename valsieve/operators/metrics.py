"""Ratios of every listing in one projection, plus peer medians."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.functions import ratios as R
from valsieve.operators.ordering import grouped_median, value_counts
from valsieve.session import sized

TEXT_DEFAULTS = {"calidad_datos": "ok"}
#: Both peer groups of a row, before a minimum decides between them.
BOTH_MEDIANS = ["med_regional", "n_regional", "med_global", "n_global"]
EVERY_REGION = ""  # stands beside the regions for a whole sector; no region has this name


def with_defaults(fundamentals: DataFrame) -> DataFrame:
    """Add identity and provenance columns the source does not carry."""
    missing = {}
    for column in S.IDENTITY_COLUMNS + ["error_descarga"] + S.PROVENANCE_COLUMNS:
        if column in fundamentals.columns:
            continue
        if column == "divisa_consistente":
            missing[column] = F.lit(True)
        else:
            missing[column] = F.lit(TEXT_DEFAULTS.get(column, ""))
    return fundamentals.withColumns(missing) if missing else fundamentals


def ratio_expressions() -> dict[str, Column]:
    """Name to expression for the ratios, over the fundamentals columns."""
    cap = R.compatible_cap("market_cap", "divisa_consistente")
    multiple = R.ev_ebit(cap, "total_debt", "cash", "ebit")
    capital_return = R.roic(
        "ebit", "total_debt", "equity", "tasa_impositiva",
        "total_debt_inicio", "equity_inicio",
    )
    return {
        "per": R.pe(cap, "net_income"),
        "ev_ebit": multiple,
        "fcf_yield": R.fcf_yield("free_cash_flow", cap),
        "roic": capital_return,
        "margen_op": R.operating_margin("ebit", "ingresos"),
        "deuda_ebitda": R.net_debt_ebitda("total_debt", "cash", "ebitda"),
        "cobertura_int": R.interest_coverage("ebit", "gasto_intereses"),
        "cagr_ingresos": R.revenue_cagr(
            "ingresos_inicio_historico", "ingresos_fin_historico", "anios_historico"),
        "earnings_yield": R.earnings_yield(multiple),
        "caja_neta_pct_mcap": R.net_cash_share("cash", "total_debt", cap),
        "roic_fiable": R.roic_reliable(capital_return),
        "region": R.comparable_region("pais"),
    }


def ratios(fundamentals: DataFrame) -> DataFrame:
    base = with_defaults(fundamentals)
    extra = ["error_descarga"] + S.PROVENANCE_COLUMNS
    return base.select(
        *S.IDENTITY_COLUMNS,
        *[expression.alias(name) for name, expression in ratio_expressions().items()],
        *extra,
    )


def pe_counts(metrics: DataFrame) -> DataFrame:
    """Valid P/E values per sector and region.  A missing sector has no peers."""
    return value_counts(metrics.where(F.col("sector").isNotNull()), ["sector", "region"], "per")


def sector_region_medians(counts: DataFrame) -> DataFrame:
    return grouped_median(counts, ["sector", "region"], "per", "med_regional", "n_regional")


def sector_medians(counts: DataFrame) -> DataFrame:
    return grouped_median(counts, ["sector"], "per", "med_global", "n_global")


def with_peer_medians(metrics: DataFrame, min_peers: int = S.THRESHOLDS["min_empresas_sector"],
                      source: DataFrame | None = None) -> DataFrame:
    """Peer P/E median by sector and region, or by sector when peers are few."""
    return (
        with_both_medians(metrics, source).withColumns(chosen_median(F.lit(min_peers)))
        .select(*metrics.columns, *S.PEER_COLUMNS)
    )


def with_both_medians(metrics: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Add medians and sizes of both peer groups (``BOTH_MEDIANS``) to every row.

    ``source`` may name a narrower or already written copy of ``metrics`` to
    count from; by default the metrics themselves are read again.  Valid P/E
    values are counted once, and one pass finds the medians of both levels.  The
    medians (a row per sector and region) are written before the join, so the
    metrics are not shuffled by sector when the medians are small enough to
    broadcast.
    """
    counts = sized(pe_counts(metrics if source is None else source), "pe-counts")
    levels = counts.withColumn("region", F.explode(F.array("region", F.lit(EVERY_REGION))))
    peers = sized(grouped_median(levels, ["sector", "region"], "per", "mediana", "n"), "peers")
    whole = F.col("region") == EVERY_REGION
    regional = peers.where(~whole).toDF("sector", "region", "med_regional", "n_regional")
    overall = peers.where(whole).drop("region").toDF("sector", "med_global", "n_global")
    known = F.col("sector").isNotNull()
    return metrics.join(regional, ["sector", "region"], "left").join(overall, "sector", "left").select(
        *metrics.columns, "med_regional",
        F.when(known, F.coalesce("n_regional", F.lit(0))).alias("n_regional"), "med_global",
        F.when(known, F.coalesce("n_global", F.lit(0))).alias("n_global"))


def chosen_median(min_peers: Column) -> dict[str, Column]:
    """The peer columns: the region's group where it has ``min_peers``, else the sector's."""
    enough = F.coalesce(F.col("n_regional") >= min_peers, F.lit(False))
    return {
        "per_mediana_sector": F.when(enough, F.col("med_regional")).otherwise(F.col("med_global")),
        "n_sector": F.when(enough, F.col("n_regional")).otherwise(F.col("n_global")),
        "base_mediana": F.when(enough, S.BASIS_REGIONAL).otherwise(S.BASIS_GLOBAL),
    }


def compute_metrics(fundamentals: DataFrame, thresholds: Mapping = S.THRESHOLDS) -> DataFrame:
    """The full metrics table.  Medians see every row, before any dedup."""
    table = with_peer_medians(ratios(fundamentals), thresholds["min_empresas_sector"])
    return table.select(*S.METRIC_COLUMNS)
