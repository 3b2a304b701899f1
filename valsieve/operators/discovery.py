"""Discover listings per market and sector, with quotas and coverage."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from valsieve import settings as S
from valsieve.errors import DiscoveryError
from valsieve.functions.canonical import canonical_json
from valsieve.functions.cleaning import ticker_key
from valsieve.session import fixed_rows

ORDERS = ["region_ord", "sector_ord", "rank_bucket"]


@dataclass(frozen=True)
class DiscoveryConfig:
    """Quotas, sectors and floors of a discovery profile."""

    perfil: str = S.DISCOVERY_PROFILE
    cuotas_region: Mapping[str, int] = field(default_factory=lambda: dict(S.DISCOVERY_QUOTAS))
    sectores: Sequence[str] = tuple(S.SECTORS)
    precio_minimo: float = S.MIN_PRICE
    volumen_medio_minimo: int = S.MIN_AVG_VOLUME
    umbral_buckets: float = S.MIN_BUCKET_COVERAGE
    reintentos: int = S.DISCOVERY_RETRIES

    def capacity(self) -> int:
        return sum(self.cuotas_region.values()) * len(self.sectores)


def check_config(config: DiscoveryConfig) -> DiscoveryConfig:
    expected = set(S.NAMED_UNIVERSES["desarrollados_aproximado"])
    rules = {
        "the profile must cover exactly its 22 regions":
            config.perfil != S.DISCOVERY_PROFILE or set(config.cuotas_region) == expected,
        "every quota must be positive":
            bool(config.cuotas_region) and all(q > 0 for q in config.cuotas_region.values()),
        "sectors must be present and unique":
            bool(config.sectores) and len(set(config.sectores)) == len(config.sectores),
        "floors cannot be negative": config.precio_minimo >= 0 and config.volumen_medio_minimo >= 0,
        "the coverage threshold must be between 0 and 1": 0 <= config.umbral_buckets <= 1,
        "at least one attempt is needed": config.reintentos >= 1,
    }
    broken = [text for text, holds in rules.items() if not holds]
    if broken:
        raise DiscoveryError("; ".join(broken))
    return config


def config_hash(config) -> str:
    """SHA-256 of the canonical JSON of a configuration."""
    data = asdict(config)
    text = json.dumps(data, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=list)
    return hashlib.sha256(text.encode()).hexdigest()


def config_hashes(configs: DataFrame) -> DataFrame:
    """Canonical JSON and SHA-256 of each row's configuration: its columns with the names of ``DiscoveryConfig``.

    Equal to ``config_hash`` of the same values, whatever the order of columns, map
    keys or struct fields.
    """
    kind = StructType([configs.schema[f.name] for f in fields(DiscoveryConfig)])
    names = [F.col(f.name) for f in kind.fields]
    text = canonical_json(F.struct(*names), kind)
    return configs.withColumn("config_json", text).withColumn("config_sha256", F.sha2("config_json", 256))


def quota_violations(quotas: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(region, problema) of a quota table against the regions of its profile."""
    wanted = fixed_rows(quotas.sparkSession, [(r,) for r in expected], "esperada string")
    both = quotas.join(wanted, quotas["region"] == wanted["esperada"], "full")
    problem = (
        F.when(F.col("region").isNull(), "region_ausente").when(F.col("esperada").isNull(), "region_inesperada")
        .when(F.col("cuota") <= 0, "cuota_no_positiva")
    )
    return both.select(F.coalesce("region", "esperada").alias("region"), problem.alias("problema")).where("problema is not null")


def quota_table(spark: SparkSession, quotas: Mapping[str, int], name: str = "cuota") -> DataFrame:
    """(region, quota, order): one row per configured region."""
    rows = [(region, int(quota), i) for i, (region, quota) in enumerate(quotas.items())]
    return fixed_rows(spark, rows, f"region string, {name} int, region_ord int")


def sector_table(spark: SparkSession, sectors: Sequence[str]) -> DataFrame:
    return fixed_rows(spark, [(s, i) for i, s in enumerate(sectors)], "sector string, sector_ord int")


def prefilter(quotes: DataFrame, regions: Sequence[str] | None, categories: Sequence[str],
              min_price: float = S.MIN_PRICE, min_volume: float = S.MIN_AVG_VOLUME,
              kind: str = "accion", category: str = "sector") -> DataFrame:
    """Price, volume, market and category floors, pushed to the scan."""
    if kind not in S.ASSET_KINDS:
        raise ValueError(f"unknown asset kind {kind}; known: {', '.join(sorted(S.ASSET_KINDS))}")
    if not categories:
        raise ValueError("at least one category is needed")
    by_region, by_volume = S.ASSET_KINDS[kind]
    if by_region and not regions:
        raise ValueError(f"asset kind {kind} needs at least one region")
    out = quotes.where(F.col(category).isin(list(categories)) & (F.col("price") >= min_price))
    if by_region:
        out = out.where(F.col("region").isin(list(regions)))
    if by_volume:
        out = out.where(F.col("volume") >= min_volume)
    return out


def size_order() -> list[Column]:
    return [F.desc("mcap_c"), F.asc("ticker")]


def bucket_topn(quotes: DataFrame, keys: Sequence[str], quota) -> DataFrame:
    """Largest listings of every bucket with their rank in it.

    The rank limit is a constant bound as well as a quota, so Spark keeps at
    most that many rows per bucket and map task before the shuffle.
    """
    limit = F.lit(quota) if isinstance(quota, int) else F.col(quota[0])
    bound = quota if isinstance(quota, int) else quota[1]
    order = Window.partitionBy(*keys).orderBy(*size_order())
    return (
        quotes.withColumn("rank_bucket", F.row_number().over(order))
        .where(F.col("rank_bucket") <= bound).where(F.col("rank_bucket") <= limit)
    )


def first_seen(rows: DataFrame, orders: Sequence[str] = tuple(ORDERS)) -> DataFrame:
    """A ticker found in several buckets keeps the first; ranks stay as they are."""
    first = Window.partitionBy("ticker").orderBy(*orders)
    return rows.withColumn("_k", F.row_number().over(first)).where(F.col("_k") == 1).drop("_k")


def ranked_buckets(quotes: DataFrame, config: DiscoveryConfig) -> DataFrame:
    """Filtered, quota-joined and ranked rows, repeats still included."""
    spark = quotes.sparkSession
    kept = prefilter(quotes, list(config.cuotas_region), config.sectores, config.precio_minimo, config.volumen_medio_minimo)
    named = (
        kept.withColumn("ticker", ticker_key("ticker")).where(F.col("ticker") != "")
        .join(F.broadcast(quota_table(spark, config.cuotas_region)), "region")
        .join(F.broadcast(sector_table(spark, config.sectores)), "sector")
    )
    return bucket_topn(named, ["region", "sector"], ("cuota", max(config.cuotas_region.values())))


def discover(quotes: DataFrame, config: DiscoveryConfig, created_at: str) -> DataFrame:
    """The discovery catalog, at most ``config.capacity()`` rows."""
    unique = first_seen(ranked_buckets(quotes, config))
    return unique.select(
        "ticker", F.lit("accion").alias("tipo_activo"), F.col("region").alias("region_descubrimiento"),
        F.col("sector").alias("sector_descubrimiento"), "rank_bucket", F.col("cuota").alias("cuota_bucket"),
        F.lit(S.DISCOVERY_SOURCE).alias("fuente"), F.lit(created_at).alias("fecha_descubrimiento"),
        "region_ord", "sector_ord")


def all_buckets(spark: SparkSession, config: DiscoveryConfig) -> DataFrame:
    """Every configured bucket: sectors are exploded onto each region."""
    sectors = F.explode(F.array(*[F.lit(s) for s in config.sectores])).alias("sector")
    return quota_table(spark, config.cuotas_region).select("region", "cuota", sectors)


def bucket_coverage(ranked: DataFrame, config: DiscoveryConfig) -> DataFrame:
    """Results per configured bucket, empty buckets included."""
    found = ranked.groupBy("region", "sector").agg(F.count(F.lit(1)).alias("resultados"))
    return all_buckets(ranked.sparkSession, config).join(found, ["region", "sector"], "left").select(
        "region", "sector", "cuota", F.coalesce("resultados", F.lit(0)).alias("resultados"))


def control(ranked: DataFrame, config: DiscoveryConfig, failed: DataFrame | None = None) -> DataFrame:
    """The one-row control record of a discovery run.

    ``failed`` lists (region, sector) buckets that could not be read.
    """
    total = len(config.cuotas_region) * len(config.sectores)
    counts = ranked.agg(F.count(F.lit(1)).alias("resultados_brutos"), F.countDistinct("ticker").alias("tickers_unicos"))
    if failed is None:
        counts = counts.withColumn("buckets_fallidos", F.lit(0).cast("bigint"))
    else:
        lost = failed.agg(F.count(F.lit(1)).alias("buckets_fallidos")).withColumn("_one", F.lit(1))
        counts = counts.withColumn("_one", F.lit(1)).join(lost, "_one").drop("_one")
    good = F.lit(total) - F.col("buckets_fallidos")
    return counts.select(
        F.lit(total).cast("bigint").alias("buckets_solicitados"), good.alias("buckets_exitosos"), "buckets_fallidos",
        (good / total).alias("tasa_exito_buckets"), F.lit(config.umbral_buckets).alias("umbral_exito_buckets"),
        "resultados_brutos", (F.col("resultados_brutos") - F.col("tickers_unicos")).alias("duplicados"),
        "tickers_unicos", F.lit(config.capacity()).cast("bigint").alias("capacidad_teorica"))


def coverage_gate(control_row: DataFrame) -> DataFrame:
    """Publishable when enough buckets worked and at least one ticker was found."""
    return control_row.withColumn("publicable", (
        (F.col("tasa_exito_buckets") >= F.col("umbral_exito_buckets")) & (F.col("tickers_unicos") > 0)))


def named_universe(quotes: DataFrame, name: str, per_bucket: int, min_price: float = S.MIN_PRICE,
                   min_volume: float = S.MIN_AVG_VOLUME, sectors: Sequence[str] | None = None,
                   by_sector: bool = True) -> DataFrame:
    """Tickers of a named region list with their bucket order."""
    if name not in S.NAMED_UNIVERSES:
        raise ValueError(f"unknown universe {name}; known: {', '.join(sorted(S.NAMED_UNIVERSES))}")
    regions, wanted = S.NAMED_UNIVERSES[name], list(sectors or S.SECTORS)
    spark = quotes.sparkSession
    rows = (
        prefilter(quotes, regions, wanted, min_price, min_volume)
        .join(F.broadcast(quota_table(spark, dict.fromkeys(regions, 1)).drop("cuota")), "region")
        .join(F.broadcast(sector_table(spark, wanted)), "sector")
    )
    if by_sector:
        ranked = bucket_topn(rows, ["region", "sector"], max(per_bucket, 0))
    else:
        ranked = bucket_topn(rows, ["region"], max(per_bucket, 0)).withColumn("sector_ord", F.lit(0))
    return first_seen(ranked).select("ticker", "region", "sector", *ORDERS)


def asset_catalog(quotes: DataFrame, kind: str, regions: Sequence[str] | None = None,
                  categories: Mapping[str, Sequence[str]] | None = None, per_bucket: int = 25,
                  min_price: float = S.MIN_PRICE, min_volume: float = S.MIN_AVG_VOLUME) -> DataFrame:
    """Tickers labelled by kind, category and region, from the first bucket found.

    A label may stand for several source categories.  Funds have no region.
    """
    defaults = {"accion": {s: [s] for s in S.SECTORS}, "etf": S.ETF_THEMES, "fondo": {}}
    labels = dict(categories or defaults.get(kind, {}))
    if not labels:
        raise ValueError(f"asset kind {kind} has no default categories")
    by_region = S.ASSET_KINDS[kind][0] if kind in S.ASSET_KINDS else True
    spark = quotes.sparkSession
    values = [(v, label, i) for i, (label, names) in enumerate(labels.items()) for v in names]
    named = fixed_rows(spark, values, "category string, categoria string, sector_ord int")
    rows = prefilter(quotes, regions, [v for v, _, _ in values], min_price, min_volume, kind, "category").join(
        F.broadcast(named), "category")
    if by_region:
        rows = rows.join(F.broadcast(quota_table(spark, dict.fromkeys(regions, 1)).drop("cuota")), "region")
    else:
        rows = rows.withColumn("region", F.lit("")).withColumn("region_ord", F.lit(0))
    return first_seen(bucket_topn(rows, ["region", "categoria"], per_bucket)).select(
        "ticker", F.lit(kind).alias("tipo_activo"), "categoria", "region", *ORDERS)


def member_hash(members: DataFrame, keys: Sequence[str] = (), ticker: str = "ticker") -> DataFrame:
    """Order-free SHA-256 of the members of each universe.

    A digest is sequential, so the tickers of one universe meet in one row;
    universes are bounded by their quotas (a few thousand tickers at most).
    """
    text = F.concat(F.array_join(F.array_sort(F.collect_list(ticker)), "\n"), F.lit("\n"))
    return members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ticker_count"), F.sha2(text, 256).alias("sha256"))


def catalog_hash(catalog: DataFrame) -> DataFrame:
    """SHA-256 of the canonical JSON of all catalog rows, in catalog order.

    The catalog is bounded by the capacity of its profile.
    """
    columns = sorted(S.DISCOVERY_COLUMNS)
    row = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]))
    ordered = F.array_sort(F.collect_list(F.struct(*ORDERS, row.alias("json"))))
    text = F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda r: r["json"]), ","), F.lit("]"))
    return catalog.agg(F.count(F.lit(1)).alias("filas"), F.sha2(text, 256).alias("catalog_sha256"))


def catalog_violations(catalog: DataFrame) -> DataFrame:
    """(ticker, problema) for rows a published catalog must not contain."""
    repeats = catalog.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(
        "ticker", F.lit("duplicado").alias("problema"))
    bucket = ["region_descubrimiento", "sector_descubrimiento", "rank_bucket"]
    ranks = catalog.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*bucket)
    same_rank = catalog.join(ranks, bucket, "left_semi").select("ticker", F.lit("rank_repetido").alias("problema"))
    rules = F.array_compact(F.array(
        F.when(~F.col("ticker").rlike(S.TICKER_PATTERN), "formato"),
        F.when((F.col("tipo_activo") != "accion") | (F.col("fuente") != S.DISCOVERY_SOURCE), "tipo_o_fuente"),
        F.when((F.col("rank_bucket") < 1) | (F.col("cuota_bucket") < F.col("rank_bucket")), "rank_y_cuota")))
    own = catalog.select("ticker", F.explode(rules).alias("problema"))
    return repeats.unionByName(same_rank).unionByName(own)
