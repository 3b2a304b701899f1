"""Universe life cycle: discover, draft, refine, activate."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.errors import RefinementError, SelectionError
from valsieve.operators import discovery, universe
from valsieve.operators.output import json_struct
from valsieve.session import stage_table


class Draft(NamedTuple):
    members: DataFrame
    version: DataFrame
    summary: DataFrame
    audit: DataFrame


def discover(quotes: DataFrame, config: discovery.DiscoveryConfig, created_at: str,
             failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(catalog, control row).  The ranked rows are few: they are written once."""
    discovery.check_config(config)
    ranked = stage_table(discovery.ranked_buckets(quotes, config), "ranked")
    catalog = discovery.first_seen(ranked).select(
        "ticker", F.lit("accion").alias("tipo_activo"), F.col("region").alias("region_descubrimiento"),
        F.col("sector").alias("sector_descubrimiento"), "rank_bucket", F.col("cuota").alias("cuota_bucket"),
        F.lit(S.DISCOVERY_SOURCE).alias("fuente"), F.lit(created_at).alias("fecha_descubrimiento"),
        "region_ord", "sector_ord")
    return catalog, discovery.coverage_gate(discovery.control(ranked, config, failed))


def audit_record(universe_id: str, config, version: DataFrame, summary: DataFrame) -> DataFrame:
    """The one-row audit document of a draft as JSON."""
    head = version.select(
        F.lit(1).alias("schema_version"), F.lit(universe_id).alias("universe_id"), F.lit("draft").alias("status"),
        F.lit(False).alias("activation_performed"), F.lit(config.perfil).alias("selection_profile"),
        F.lit(discovery.config_hash(config)).alias("selection_config_sha256"),
        F.struct(F.col("path").alias("csv_path"), "ticker_count", "sha256").alias("output"), F.lit(1).alias("_one"))
    body = summary.select(json_struct(summary).alias("summary"), F.lit(1).alias("_one"))
    joined = head.join(body, "_one").drop("_one")
    return joined.select(F.to_json(F.struct(*joined.columns)).alias("json"))


def draft_from_catalog(catalog: DataFrame, incumbents: DataFrame, universe_id: str, supersedes: str,
                       discovery_id: str, created_at: str, config: universe.SelectionConfig | None = None) -> Draft:
    """Select by quota and prepare the draft; activates nothing."""
    config = universe.check_selection_config(config or universe.SelectionConfig())
    selected = stage_table(universe.select_universe(catalog, incumbents, discovery_id, config), "selected")
    summary = universe.selection_summary(selected, catalog, incumbents, config)
    row = summary.first()
    if not row["tamano_valido"]:
        raise SelectionError(
            f"{row['seleccion_final']} tickers; {config.minimo_tickers}-{config.maximo_tickers} are required")
    version = universe.draft_version(
        selected, universe_id, supersedes, created_at, config.perfil,
        f"{discovery_id}; config_sha256={discovery.config_hash(config)}")
    return Draft(universe.members(selected), version, summary, audit_record(universe_id, config, version, summary))


def refined_draft(catalog: DataFrame, members: DataFrame, observed: DataFrame, control: DataFrame, universe_id: str,
                  supersedes: str, discovery_id: str, snapshot_id: str, created_at: str) -> Draft:
    """Replace the members that the observed official run collapsed."""
    config = universe.RefinementConfig()
    checks = universe.observation_checks(control, observed, members, config=config).first()
    broken = [name for name, holds in checks.asDict().items() if not holds]
    if broken:
        raise RefinementError("observation rejected: " + ", ".join(broken))
    split = universe.split_survivors(members, observed)
    kept, gone = split.where(F.col("grupo") == "superviviente"), split.where(F.col("grupo") == "descartado")
    filled = stage_table(universe.refill(catalog, kept, gone), "replacements")
    summary = universe.refine_summary(kept, gone, filled)
    universe.require_refilled(summary)
    refined = universe.refined_members(catalog, kept, filled, discovery_id, snapshot_id, config)
    version = universe.draft_version(
        refined, universe_id, supersedes, created_at, config.perfil,
        f"{supersedes}; {snapshot_id}; config_sha256={discovery.config_hash(config)}")
    return Draft(universe.members(refined), version, summary, audit_record(universe_id, config, version, summary))
