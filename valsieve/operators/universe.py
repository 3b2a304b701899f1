"""Select, refine, compare and version universes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.errors import RefinementError, SelectionError, UniverseError
from valsieve.functions.cleaning import safe_date
from valsieve.operators.discovery import member_hash, quota_table

BUCKET = ["region_descubrimiento", "sector_descubrimiento"]
CANONICAL = ["region_ord", "sector_ord", "rank_bucket", "ticker"]


@dataclass(frozen=True)
class SelectionConfig:
    perfil: str = S.SELECTION_PROFILE
    cuotas_region: Mapping[str, int] = field(default_factory=lambda: dict(S.SELECTION_QUOTAS))
    sectores: Sequence[str] = tuple(S.SECTORS)
    margen_retencion_incumbente: int = S.INCUMBENT_BUFFER
    minimo_tickers: int = S.MIN_SELECTION
    maximo_tickers: int = S.MAX_SELECTION
    perfil_descubrimiento_requerido: str = S.DISCOVERY_PROFILE


@dataclass(frozen=True)
class RefinementConfig:
    perfil: str = S.REFINEMENT_PROFILE
    exigir_ejecucion_oficial: bool = True
    exigir_cobertura_completa: bool = True
    fallback: str = S.SAME_REGION


def check_selection_config(config: SelectionConfig) -> SelectionConfig:
    rules = {
        "unknown profile": config.perfil == S.SELECTION_PROFILE,
        "the profile must cover exactly 22 regions": set(config.cuotas_region) == set(S.SELECTION_QUOTAS),
        "quotas must be positive integers": all(isinstance(q, int) and q > 0 for q in config.cuotas_region.values()),
        "sectors or their order differ from the profile": list(config.sectores) == S.SECTORS,
        "the incumbent buffer cannot be negative": config.margen_retencion_incumbente >= 0,
        "the target interval is not valid": 0 < config.minimo_tickers <= config.maximo_tickers,
    }
    broken = [text for text, holds in rules.items() if not holds]
    if broken:
        raise SelectionError("; ".join(broken))
    return config


def compat_violations(catalog: DataFrame, source_quotas: Mapping[str, int], config: SelectionConfig) -> DataFrame:
    """(ticker, problema): rows outside the profile or with another quota."""
    quotas = quota_table(catalog.sparkSession, source_quotas, "_cuota").drop("region_ord")
    rows = catalog.join(F.broadcast(quotas), catalog["region_descubrimiento"] == quotas["region"], "left")
    inside = F.col("region_descubrimiento").isin(list(config.cuotas_region)) & F.col("sector_descubrimiento").isin(list(config.sectores))
    problem = F.when(~inside, "bucket_fuera_de_perfil").when(
        ~F.coalesce(F.col("cuota_bucket") == F.col("_cuota"), F.lit(False)), "cuota_incoherente")
    return rows.select("ticker", problem.alias("problema")).where("problema is not null")


def with_quota(catalog: DataFrame, config: SelectionConfig) -> DataFrame:
    quotas = quota_table(catalog.sparkSession, config.cuotas_region, "cuota_seleccion").drop("region_ord")
    return catalog.join(F.broadcast(quotas), catalog["region_descubrimiento"] == quotas["region"]).drop("region")


def select_universe(catalog: DataFrame, incumbents: DataFrame, discovery_id: str,
                    config: SelectionConfig | None = None) -> DataFrame:
    """Rows inside the quota, plus incumbents just beyond it.

    The result keeps the order columns; ``members`` gives the stored layout.
    """
    config = check_selection_config(config or SelectionConfig())
    active = incumbents.select(F.col("ticker").alias("_active")).distinct()
    near = with_quota(catalog, config).where(
        F.col("rank_bucket") <= F.col("cuota_seleccion") + config.margen_retencion_incumbente)
    joined = near.join(active, near["ticker"] == active["_active"], "left")
    kind = (
        F.when(F.col("rank_bucket") <= F.col("cuota_seleccion"), "cuota_base")
        .when(F.col("_active").isNotNull(), "retencion_incumbente")
    )
    return joined.withColumn("_kind", kind).where(F.col("_kind").isNotNull()).withColumns({
        "origen_inclusion": F.concat(F.lit(config.perfil + ":"), F.col("_kind")),
        "nota": selection_note(discovery_id),
    }).drop("_kind", "_active")


def selection_note(discovery_id: str):
    return F.format_string(f"{discovery_id}; rank_bucket=%d; cuota_seleccion=%d", "rank_bucket", "cuota_seleccion")


def members(selected: DataFrame) -> DataFrame:
    """The stored layout, in canonical order."""
    return selected.orderBy(*CANONICAL).select(*S.UNIVERSE_COLUMNS)


def diff(origin: DataFrame, target: DataFrame) -> DataFrame:
    """(ticker, cambio): anadido, eliminado or comun."""
    a = origin.select(F.col("ticker").alias("_a")).distinct()
    b = target.select(F.col("ticker").alias("_b")).distinct()
    change = F.when(F.col("_a").isNull(), "anadido").when(F.col("_b").isNull(), "eliminado").otherwise("comun")
    return a.join(b, a["_a"] == b["_b"], "full").select(F.coalesce("_a", "_b").alias("ticker"), change.alias("cambio"))


def selection_summary(selected: DataFrame, catalog: DataFrame, incumbents: DataFrame,
                      config: SelectionConfig | None = None) -> DataFrame:
    """Base, retained, final, kept, added, removed and whether the size fits."""
    config = config or SelectionConfig()
    base = F.col("origen_inclusion").endswith(":cuota_base")
    picked = selected.agg(
        F.count_if(base).alias("seleccion_base"), F.count_if(~base).alias("retencion_incumbentes"),
        F.count(F.lit(1)).alias("seleccion_final")).withColumn("_one", F.lit(1))
    changes = diff(incumbents, selected).agg(
        F.count_if(F.col("cambio") == "comun").alias("permanencias"), F.count_if(F.col("cambio") == "anadido").alias("altas"),
        F.count_if(F.col("cambio") == "eliminado").alias("bajas")).withColumn("_one", F.lit(1))
    size = catalog.agg(F.count(F.lit(1)).alias("snapshot_tickers")).withColumn("_one", F.lit(1))
    return size.join(picked, "_one").join(changes, "_one").drop("_one").withColumn(
        "tamano_valido", F.col("seleccion_final").between(config.minimo_tickers, config.maximo_tickers))


# --- refinement ----------------------------------------------------------------
def split_survivors(universe: DataFrame, observed: DataFrame) -> DataFrame:
    """Members seen in the observed snapshot against those it dropped."""
    seen = observed.select(F.upper(F.trim("ticker")).alias("_seen")).distinct()
    return universe.join(seen, universe["ticker"] == seen["_seen"], "left").withColumn(
        "grupo", F.when(F.col("_seen").isNull(), "descartado").otherwise("superviviente")).drop("_seen")


def refill(catalog: DataFrame, survivors: DataFrame, dropped: DataFrame) -> DataFrame:
    """A replacement for every dropped member.

    Slot *k* of a bucket takes reserve *k* of the same bucket; slots left over
    take the regional reserve in order of rank over quota.  Both passes are
    joins on a position.  Positions are counted inside a bucket or region of
    the catalog, which its quotas bound.  A slot without any reserve is kept
    with the strategy ``sin_reserva``.
    """
    taken = survivors.select("ticker").unionByName(dropped.select("ticker"))
    reserve = catalog.join(taken, "ticker", "left_anti")
    in_bucket = Window.partitionBy(*BUCKET).orderBy("rank_bucket", "ticker")
    slots = catalog.join(dropped.select("ticker"), "ticker", "left_semi").withColumn("_k", F.row_number().over(in_bucket))
    queue = reserve.withColumn("_k", F.row_number().over(in_bucket)).select(
        *BUCKET, "_k", F.col("ticker").alias("replacement_ticker"), F.col("rank_bucket").alias("rank_reemplazo"))
    first = slots.join(queue, [*BUCKET, "_k"], "left")
    same_bucket = first.where(F.col("replacement_ticker").isNotNull()).select(
        F.col("ticker").alias("removed_ticker"), "replacement_ticker", F.lit(S.SAME_BUCKET).alias("strategy"),
        "region_descubrimiento", F.col("sector_descubrimiento").alias("sector_origen"),
        F.col("sector_descubrimiento").alias("sector_reemplazo"), "rank_reemplazo")

    open_order = Window.partitionBy("region_descubrimiento").orderBy("sector_ord", "rank_bucket", "ticker")
    pending = first.where(F.col("replacement_ticker").isNull()).select(
        "ticker", *BUCKET, F.row_number().over(open_order).alias("_k"))
    spare_order = Window.partitionBy("region_descubrimiento").orderBy(
        F.col("rank_bucket") / F.col("cuota_bucket"), "rank_bucket", "sector_ord", "ticker")
    spare = reserve.join(same_bucket.select(F.col("replacement_ticker").alias("ticker")), "ticker", "left_anti").select(
        "region_descubrimiento", F.col("ticker").alias("replacement_ticker"),
        F.col("sector_descubrimiento").alias("sector_reemplazo"), F.col("rank_bucket").alias("rank_reemplazo"),
        F.row_number().over(spare_order).alias("_k"))
    same_region = pending.join(spare, ["region_descubrimiento", "_k"], "left").select(
        F.col("ticker").alias("removed_ticker"), "replacement_ticker",
        F.when(F.col("replacement_ticker").isNull(), "sin_reserva").otherwise(S.SAME_REGION).alias("strategy"),
        "region_descubrimiento", F.col("sector_descubrimiento").alias("sector_origen"), "sector_reemplazo", "rank_reemplazo")
    return same_bucket.unionByName(same_region)


def refined_members(catalog: DataFrame, survivors: DataFrame, replacements: DataFrame,
                    discovery_id: str, snapshot_id: str, config: RefinementConfig | None = None) -> DataFrame:
    """Survivors and replacements in the stored layout, with the order columns."""
    profile = (config or RefinementConfig()).perfil
    origin = survivors.select("ticker", F.lit(f"{profile}:superviviente").alias("origen_inclusion")).unionByName(
        replacements.where(F.col("replacement_ticker").isNotNull()).select(
            F.col("replacement_ticker").alias("ticker"),
            F.concat(F.lit(f"{profile}:relleno_"), F.col("strategy")).alias("origen_inclusion")))
    note = F.format_string(f"{discovery_id}; observacion={snapshot_id}; rank_bucket=%d", "rank_bucket")
    return catalog.join(origin, "ticker").withColumn("nota", note)


def refine_summary(survivors: DataFrame, dropped: DataFrame, replacements: DataFrame) -> DataFrame:
    """Counts of the refinement; complete when every slot was filled."""
    def one(df, *aggregates):
        return df.agg(*aggregates).withColumn("_one", F.lit(1))

    kept = one(survivors, F.count(F.lit(1)).alias("supervivientes_observados"))
    gone = one(dropped, F.count(F.lit(1)).alias("listings_excluidos_antes_descarga"))
    filled = one(replacements, F.count_if(F.col("strategy") == S.SAME_BUCKET).alias("rellenos_mismo_bucket"),
                 F.count_if(F.col("strategy") == S.SAME_REGION).alias("rellenos_misma_region"),
                 F.count_if(F.col("strategy") == "sin_reserva").alias("sin_reserva"))
    total = F.col("supervivientes_observados") + F.col("rellenos_mismo_bucket") + F.col("rellenos_misma_region")
    return kept.join(gone, "_one").join(filled, "_one").drop("_one").withColumns({
        "tickers_origen": F.col("supervivientes_observados") + F.col("listings_excluidos_antes_descarga"),
        "tickers_finales": total, "completo": F.col("sin_reserva") == 0})


def require_refilled(summary: DataFrame) -> None:
    if not summary.first()["completo"]:
        raise RefinementError("no regional reserve for some dropped members")


def observation_checks(control: DataFrame, journal: DataFrame, universe: DataFrame,
                       universe_hash: str | None = None, config: RefinementConfig | None = None) -> DataFrame:
    """One row of named checks on the run a refinement starts from.

    ``control`` holds the control rows and ``journal`` the rows of the
    observed snapshot; ``universe`` the members that run was asked for.
    """
    config = config or RefinementConfig()

    def one(df, *aggregates):
        return df.agg(*aggregates).withColumn("_one", F.lit(1))

    integer = ["tickers_solicitados", "resultados_brutos", "descargas_correctas", "errores_descarga", "deduplicados", "empresas_evaluadas"]
    run = one(control, F.count(F.lit(1)).alias("_runs"), F.max("oficial").alias("_official"),
              F.max("universe_sha256").alias("_hash"), *[F.max(c).alias(c) for c in integer])
    rows = one(journal, F.count(F.lit(1)).alias("_rows"), F.countDistinct("ticker").alias("_tickers"))
    size = one(universe, F.count(F.lit(1)).alias("_members"))
    alien = one(journal.join(universe.select("ticker"), "ticker", "left_anti"), F.count(F.lit(1)).alias("_alien"))
    digest = member_hash(universe).select(F.col("sha256").alias("_real"), F.lit(1).alias("_one"))
    row = run.join(rows, "_one").join(size, "_one").join(alien, "_one").join(digest, "_one")
    asked = F.col("tickers_solicitados")
    return row.select(
        (F.col("_runs") == 1).alias("un_control"),
        (F.col("_official") | F.lit(not config.exigir_ejecucion_oficial)).alias("oficial"),
        (F.col("_hash") == (F.lit(universe_hash) if universe_hash else F.col("_real"))).alias("hash_coincide"),
        ((asked == F.col("_members")) & (F.col("resultados_brutos") == asked)).alias("brutos_cuadran"),
        (((F.col("descargas_correctas") == asked) & (F.col("errores_descarga") == 0))
         | F.lit(not config.exigir_cobertura_completa)).alias("cobertura_completa"),
        ((F.col("_rows") > 0) & (F.col("_rows") == F.col("_tickers"))).alias("journal_sin_repetidos"),
        (F.col("_alien") == 0).alias("supervivientes_en_universo"),
        ((F.col("_rows") == F.col("empresas_evaluadas")) & (F.col("_members") - F.col("_tickers") == F.col("deduplicados"))
         & (asked - F.col("deduplicados") == F.col("empresas_evaluadas"))).alias("deduplicados_cuadran"))


# --- versions --------------------------------------------------------------------
def registry_violations(versions: DataFrame, universe_members: DataFrame, active_id: str) -> DataFrame:
    """(universe_id, problema) for every broken rule of the version registry.

    ``universe_members`` has (universe_id, ticker).
    """
    real = member_hash(universe_members, ["universe_id"]).select(
        F.col("universe_id").alias("_u"), F.col("ticker_count").alias("_count"), F.col("sha256").alias("_sha"))
    declared = versions.select(F.col("universe_id").alias("_declared")).distinct()
    rows = (
        versions.join(real, versions["universe_id"] == real["_u"], "left")
        .join(declared, versions["supersedes"] == declared["_declared"], "left")
    )
    draft = F.col("status") == "draft"
    bad_date = safe_date(F.substring("effective_from", 1, 10)).isNull()
    rules = F.array_compact(F.array(
        F.when(~F.col("universe_id").rlike(S.UNIVERSE_ID_PATTERN), "id_invalido"),
        F.when(~F.col("status").isin(S.UNIVERSE_STATES), "estado_invalido"),
        F.when(safe_date(F.substring("created_at", 1, 10)).isNull(), "creacion_invalida"),
        F.when(bad_date & ~(draft & F.col("effective_from").isNull()), "vigencia_invalida"),
        F.when(F.coalesce(F.col("selection_method"), F.lit("")) == "", "metodo_ausente"),
        F.when(F.coalesce(F.col("asset_type"), F.lit("")) != "equity", "tipo_invalido"),
        F.when(F.col("supersedes").isNotNull() & (
            F.col("_declared").isNull() | (F.col("supersedes") == F.col("universe_id"))), "reemplazo_invalido"),
        F.when(F.coalesce(F.col("path"), F.lit("")) == "", "ruta_ausente"),
        F.when(F.col("ticker_count") != F.coalesce(F.col("_count"), F.lit(0)), "recuento_incoherente"),
        F.when(F.col("sha256") != F.coalesce(F.col("_sha"), F.lit("")), "hash_incoherente")))
    own = rows.select("universe_id", F.explode(rules).alias("problema"))

    def repeated(column, name):
        groups = versions.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(column)
        return versions.join(groups, column, "left_semi").select("universe_id", F.lit(name).alias("problema"))

    active = versions.where(F.col("status") == "active").agg(
        F.count(F.lit(1)).alias("_n"), F.max("universe_id").alias("_id")).where(
        (F.col("_n") != 1) | (F.col("_id") != active_id)).select(F.lit(active_id).alias("universe_id"), F.lit("activo_ambiguo").alias("problema"))
    return own.unionByName(repeated("universe_id", "id_repetido")).unionByName(repeated("path", "ruta_repetida")).unionByName(active)


def numbered(members: DataFrame) -> DataFrame:
    """Add ``posicion``, the 1-based place of every member in canonical order.

    Members are numbered inside their bucket and moved by the members of earlier
    buckets; only the bucket counts, bounded by regions times sectors, meet in
    one task.
    """
    bucket = CANONICAL[:2]
    earlier = Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = members.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).select(
        *bucket, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*bucket).orderBy(*CANONICAL[2:]))
    return (
        members.withColumn("_place", inside).join(offsets, bucket)
        .withColumn("posicion", (F.col("_before") + F.col("_place")).cast("int")).drop("_before", "_place")
    )


def mirror_differences(ordered_members: DataFrame, mirror: DataFrame) -> DataFrame:
    """Positions at which the mirror list differs from the active members.

    Both sides have (posicion, ticker).
    """
    theirs = mirror.select(F.col("posicion").alias("_p"), F.col("ticker").alias("espejo"))
    both = ordered_members.join(theirs, ordered_members["posicion"] == theirs["_p"], "full")
    return both.where(~F.col("ticker").eqNullSafe(F.col("espejo"))).select(
        F.coalesce("posicion", "_p").alias("posicion"), "ticker", "espejo")


def activate(versions: DataFrame, universe_id: str, effective_from: str) -> DataFrame:
    """The draft becomes active, the active one retired; anything else fails."""
    row = versions.where(F.col("universe_id") == universe_id).select("status").first()
    if row is None:
        raise UniverseError(f"not registered: {universe_id}")
    if row["status"] == "active":
        return versions
    if row["status"] != "draft":
        raise UniverseError(f"only a draft can be activated; {universe_id} is {row['status']}")
    chosen = F.col("universe_id") == universe_id
    return versions.withColumns({
        "status": F.when(chosen, "active").when(F.col("status") == "active", "retired").otherwise(F.col("status")),
        "effective_from": F.when(chosen, F.lit(effective_from)).otherwise(F.col("effective_from"))})


def resolve(versions: DataFrame, universe_members: DataFrame, universe_id: str | None = None) -> DataFrame:
    """Members and declared hash of the active universe, or of a given one."""
    wanted = F.col("status") == "active" if universe_id is None else F.col("universe_id") == universe_id
    return universe_members.join(versions.where(wanted).select("universe_id", "sha256", "path"), "universe_id")


def adhoc_identity(tickers: DataFrame) -> DataFrame:
    """Identity of an unregistered list: prefix plus the start of its hash."""
    return member_hash(tickers).select(
        F.concat(F.lit(S.ADHOC_PREFIX), F.substring("sha256", 1, 12)).alias("universe_id"), "sha256", "ticker_count")


def diff_by_reference(universe_members: DataFrame, origin: DataFrame | str, target: DataFrame | str) -> DataFrame:
    """``diff`` with each side given as a version id or as a ticker table."""
    def side(reference):
        if isinstance(reference, str):
            return universe_members.where(F.col("universe_id") == reference)
        return reference

    return diff(side(origin), side(target))


def draft_version(selected: DataFrame, universe_id: str, supersedes: str, created_at: str,
                  method: str, notes: str) -> DataFrame:
    """The registry row of a new draft."""
    return member_hash(selected).select(
        F.lit(universe_id).alias("universe_id"), F.lit(f"oficiales/{universe_id}.csv").alias("path"),
        F.lit("draft").alias("status"), F.lit(created_at).alias("created_at"),
        F.lit(None).cast("string").alias("effective_from"), F.lit(supersedes).alias("supersedes"),
        F.lit("equity").alias("asset_type"), "ticker_count", "sha256",
        F.lit(method).alias("selection_method"), F.lit(notes).alias("notes"))
