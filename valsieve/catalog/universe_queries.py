"""Discovery, selection, refinement and version registry."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.catalog import query
from valsieve.catalog.oracle import THEMES, UID, in_list, values_table
from valsieve.catalog.tables import CREATED_AT, DISCOVERY_ID, MARKETS, OBSERVED, VOLUME_FLOOR, pick
from valsieve.operators import discovery, listings, universe
from valsieve.session import shared_folder
from valsieve.sources.quote_pages import read_quote_pages, write_quote_pages

PLACE = {"region": "region_descubrimiento", "sector": "sector_descubrimiento"}
BIG = "CAST({} AS BIGINT)"


@query("quote_scan", "SELECT region, sector, COUNT(*) AS n, ROUND(MAX(price), 6) AS precio_max, CAST(SUM(volume) AS BIGINT) AS volumen, CAST(SUM(mcap_c) AS BIGINT) AS capital FROM quotes GROUP BY ALL")
def quote_scan(t):
    return t.quotes().groupBy("region", "sector").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("price"), 6).alias("precio_max"),
        F.sum("volume").alias("volumen"), F.sum("mcap_c").alias("capital"))


@query("quote_pages", """
SELECT region, sector, ticker, ROUND(price, 6) AS price, CAST(volume AS BIGINT) AS volume, CAST(mcap_c AS BIGINT) AS mcap_c
FROM quotes WHERE region IN ('us', 'de', 'jp') AND sector <> 'Energy' AND volume >= 100""")
def quote_pages(t):
    """All quotes as pages of a listing service; those of three markets are opened."""
    folder = f"{shared_folder(t.spark)}/quote-pages-{uuid.uuid4().hex}"
    write_quote_pages(t.quotes(), folder, 500)
    rows = read_quote_pages(t.spark, folder).where(F.col("region").isin("us", "de", "jp") & (F.col("sector") != "Energy") & (F.col("volume") >= 100))
    return rows.select("region", "sector", "ticker", F.round("price", 6).alias("price"), "volume", "mcap_c")


@query("quote_prefilter", f"""
SELECT tipo_activo, region, category, ticker FROM fondos WHERE price >= 2 AND CASE tipo_activo
 WHEN 'accion' THEN region IN {in_list(S.DISCOVERY_QUOTAS)} AND volume >= {VOLUME_FLOOR} AND category IN {in_list(S.SECTORS)}
 WHEN 'etf' THEN region IN {in_list(S.DISCOVERY_QUOTAS)} AND volume >= {VOLUME_FLOOR} AND category IN ('Technology', 'Health', 'Utilities')
 ELSE category IN ('Real Estate', 'Health') END""")
def quote_prefilter(t):
    quotes, regions = t.fund_quotes(), list(S.DISCOVERY_QUOTAS)
    wanted = {"accion": S.SECTORS, "etf": ["Technology", "Health", "Utilities"], "fondo": ["Real Estate", "Health"]}
    parts = [
        discovery.prefilter(quotes.where(F.col("tipo_activo") == kind), regions, names, 2.0, VOLUME_FLOOR, kind, "category")
        for kind, names in wanted.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("tipo_activo", "region", "category", "ticker")


@query("bucket_topn", f"SELECT region, sector, ticker, {BIG.format('rank_bucket')} AS rank_bucket FROM topn")
def bucket_topn(t):
    rows = discovery.ranked_buckets(t.quotes(), t.config())
    return rows.select("region", "sector", "ticker", F.col("rank_bucket").cast("bigint").alias("rank_bucket"))


@query("quota_join", "SELECT region, ticker, CAST(cuota AS INT) AS cuota, CAST(cuota_sel AS INT) AS cuota_seleccion FROM catalogo")
def quota_join(t):
    rows = universe.with_quota(t.catalog(), universe.SelectionConfig())
    return rows.select(F.col("region_descubrimiento").alias("region"), "ticker", F.col("cuota_bucket").alias("cuota"), "cuota_seleccion")


@query("first_seen_dedup", f"SELECT ticker, region, sector, {BIG.format('rank_bucket')} AS rank_bucket FROM catalogo")
def first_seen_dedup(t):
    rows = discovery.first_seen(discovery.ranked_buckets(t.quotes(), t.config()))
    return rows.select("ticker", "region", "sector", F.col("rank_bucket").cast("bigint").alias("rank_bucket"))


@query("discovery_snapshot", f"""
SELECT ticker, 'accion' AS tipo_activo, region AS region_descubrimiento, sector AS sector_descubrimiento, CAST(rank_bucket AS INT) AS rank_bucket,
 CAST(cuota AS INT) AS cuota_bucket, 'yfinance.screen' AS fuente, '{CREATED_AT}' AS fecha_descubrimiento FROM catalogo""")
def discovery_snapshot(t):
    return discovery.discover(t.quotes(), t.config(), CREATED_AT).select(*S.DISCOVERY_COLUMNS)


@query("bucket_cross", """
SELECT c.region, s.sector, CAST(c.cuota AS INT) AS cuota, COUNT(t.ticker) AS resultados FROM cuotas c CROSS JOIN sectores s
LEFT JOIN topn t ON t.region = c.region AND t.sector = s.sector GROUP BY ALL""")
def bucket_cross(t):
    return discovery.bucket_coverage(discovery.ranked_buckets(t.quotes(), t.config()), t.config())


CONTROL = """
SELECT CAST(198 AS BIGINT) AS buckets_solicitados, 198 - f AS buckets_exitosos, f AS buckets_fallidos, ROUND((198 - f) / 198e0, 6) AS tasa_exito_buckets,
 0.9e0 AS umbral_exito_buckets, n AS resultados_brutos, n - u AS duplicados, u AS tickers_unicos, CAST(2070 AS BIGINT) AS capacidad_teorica
FROM (SELECT COUNT(*) AS n, COUNT(DISTINCT ticker) AS u, (SELECT COUNT(*) FROM (SELECT c.region, s.sector FROM cuotas c CROSS JOIN sectores s
 LEFT JOIN topn t ON t.region = c.region AND t.sector = s.sector GROUP BY ALL HAVING COUNT(t.ticker) = 0)) AS f FROM topn)"""


def control(t):
    ranked = discovery.ranked_buckets(t.quotes(), t.config())
    failed = discovery.bucket_coverage(ranked, t.config()).where(F.col("resultados") == 0)
    return discovery.control(ranked, t.config(), failed)


@query("discovery_control", CONTROL)
def discovery_control(t):
    return control(t).withColumn("tasa_exito_buckets", F.round("tasa_exito_buckets", 6))


@query("coverage_gate", "SELECT buckets_exitosos, tickers_unicos, tasa_exito_buckets >= 0.9 AND tickers_unicos > 0 AS publicable FROM ctl", {"ctl": CONTROL})
def coverage_gate(t):
    return discovery.coverage_gate(control(t)).select("buckets_exitosos", "tickers_unicos", "publicable")


@query("discovery_config_checks", f"""
SELECT COALESCE(q.region, e.region) AS region, CASE WHEN q.region IS NULL THEN 'region_ausente' WHEN e.region IS NULL THEN 'region_inesperada' ELSE 'cuota_no_positiva' END AS problema
FROM (SELECT ({[*MARKETS]!r})[n_nationkey + 1] AS region, n_nationkey % 5 AS cuota FROM nation WHERE n_nationkey <> 3) q
FULL JOIN cuotas e ON e.region = q.region WHERE q.region IS NULL OR e.region IS NULL OR q.cuota <= 0""")
def discovery_config_checks(t):
    nk = F.col("n_nationkey")
    quotas = t.raw("nation").where(nk != 3).select(pick(MARKETS, nk).alias("region"), (nk % 5).alias("cuota"))
    return discovery.quota_violations(quotas, list(S.DISCOVERY_QUOTAS))


@query("config_hash", f"""
SELECT n_nationkey AS mercado, sha256(config_json) AS config_sha256, config_json FROM (SELECT n_nationkey, concat(
 '{{"cuotas_region":{{', CASE WHEN a < b THEN concat('"', a, '":', n_nationkey + 1, ',"', b, '":7') ELSE concat('"', b, '":7,"', a, '":', n_nationkey + 1) END,
 '}},"perfil":"', replace(replace(perfil, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), '","precio_minimo":', CAST(2 + n_nationkey / 4e0 AS VARCHAR),
 ',"reintentos":', 1 + n_nationkey % 3, ',"sectores":[', array_to_string(list_transform(({S.SECTORS!r})[1:1 + n_nationkey % 9], lambda s: concat('"', s, '"')), ','),
 '],"umbral_buckets":', CAST((n_nationkey % 5) / 4e0 AS VARCHAR), ',"volumen_medio_minimo":', n_nationkey * 1000, '}}') AS config_json
 FROM (SELECT *, concat(n_name, ' "á" ', chr(92)) AS perfil, ({[*MARKETS]!r})[n_nationkey % 22 + 1] AS a, ({[*MARKETS]!r})[(n_nationkey + 7) % 22 + 1] AS b FROM nation))""")
def config_hash(t):
    """One configuration for each market, hashed as data."""
    nk = F.col("n_nationkey")
    configs = t.raw("nation").select(
        nk.alias("mercado"), F.concat("n_name", F.lit(' "á" \\')).alias("perfil"),
        F.create_map(pick(MARKETS, nk % 22), (nk + 1).cast("int"), pick(MARKETS, (nk + 7) % 22), F.lit(7)).alias("cuotas_region"),
        F.slice(F.array(*[F.lit(s) for s in S.SECTORS]), F.lit(1), (1 + nk % 9).cast("int")).alias("sectores"),
        (2 + nk / 4).alias("precio_minimo"), (nk * 1000).cast("bigint").alias("volumen_medio_minimo"),
        ((nk % 5) / 4).alias("umbral_buckets"), (1 + nk % 3).cast("int").alias("reintentos"))
    return discovery.config_hashes(configs).select("mercado", "config_sha256", "config_json")


def named_sql(label: str, name: str, per_bucket: int, by_sector: bool) -> str:
    regions = S.NAMED_UNIVERSES[name]
    order = values_table([(r, i) for i, r in enumerate(regions)], "region, ro")
    bucket = "q.region, q.sector" if by_sector else "q.region"
    so = "s.so" if by_sector else "0"
    return f"""
SELECT '{label}' AS universo, ticker, region, sector, CAST(k AS INT) AS rank_bucket FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY ro, so, k) AS v FROM (
 SELECT q.ticker, q.region, q.sector, o.ro, {so} AS so, ROW_NUMBER() OVER (PARTITION BY {bucket} ORDER BY mcap_c DESC, ticker) AS k
 FROM quotes q JOIN ({order}) o ON o.region = q.region JOIN sectores s ON s.sector = q.sector WHERE price >= 2 AND volume >= {VOLUME_FLOOR}) WHERE k <= {per_bucket}) WHERE v = 1"""


NAMED = {"usa": (12, True), "espana": (12, True), "eurozona": (12, True), "nordicos": (40, False),
         "europa_desarrollada": (5, True), "desarrollados_aproximado": (25, False)}


@query("named_universes", " UNION ALL ".join(named_sql(name, name, *shape) for name, shape in NAMED.items()))
def named_universes(t):
    quotes = t.quotes()
    lists = [
        discovery.named_universe(quotes, name, places, 2.0, VOLUME_FLOOR, by_sector=by_sector)
        .select(F.lit(name).alias("universo"), "ticker", "region", "sector", "rank_bucket")
        for name, (places, by_sector) in NAMED.items()
    ]
    return reduce(DataFrame.unionByName, lists)


def asset_sql(kind: str, labels: dict, regions) -> str:
    names = values_table([(v, label, i) for i, (label, vs) in enumerate(labels.items()) for v in vs], "category, categoria, so")
    region = "q.region" if regions else "''"
    ro = f"list_position({list(regions)!r}, q.region)" if regions else "0"
    where = f"AND q.region IN {in_list(regions)} AND volume >= {VOLUME_FLOOR}" if regions else ""
    return f"""
SELECT '{kind}' AS tipo_activo, ticker, categoria, region, CAST(k AS INT) AS rank_bucket FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY ro, so, k) AS v FROM (
 SELECT q.ticker, {region} AS region, n.categoria, {ro} AS ro, n.so, ROW_NUMBER() OVER (PARTITION BY {region}, n.categoria ORDER BY mcap_c DESC, ticker) AS k
 FROM fondos q JOIN ({names}) n ON n.category = q.category WHERE q.tipo_activo = '{kind}' AND price >= 2 {where}) WHERE k <= 25) WHERE v = 1"""


FUNDS = {"Real Estate": ["Real Estate"], "Health": ["Health"], "Energy": ["Equity Energy"]}


@query("asset_catalog", " UNION ALL ".join([
    asset_sql("accion", {s: [s] for s in S.SECTORS}, S.NAMED_UNIVERSES["nordicos"]),
    asset_sql("etf", S.ETF_THEMES, S.NAMED_UNIVERSES["europa_desarrollada"]), asset_sql("fondo", FUNDS, [])]))
def asset_catalog(t):
    quotes = t.fund_quotes()

    def kind(name):
        return quotes.where(F.col("tipo_activo") == name).drop("tipo_activo")

    one_per_fund = kind("fondo")
    parts = [
        discovery.asset_catalog(kind("accion"), "accion", S.NAMED_UNIVERSES["nordicos"], None, 25, 2.0, VOLUME_FLOOR),
        discovery.asset_catalog(kind("etf"), "etf", S.NAMED_UNIVERSES["europa_desarrollada"], None, 25, 2.0, VOLUME_FLOOR),
        discovery.asset_catalog(one_per_fund, "fondo", None, FUNDS, 25, 2.0, VOLUME_FLOOR)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("tipo_activo", "ticker", "categoria", "region", "rank_bucket")


@query("member_hash", "SELECT region, ticker_count, hash AS sha256 FROM huella")
def member_hash(t):
    out = discovery.member_hash(discovery.discover(t.quotes(), t.config(), CREATED_AT), ["region_descubrimiento"])
    return out.withColumnRenamed("region_descubrimiento", "region")


@query("catalog_hash", f"""
SELECT COUNT(*) AS filas, sha256(concat('[', string_agg(concat('{{"cuota_bucket":"', CAST(cuota AS STRING), '","fecha_descubrimiento":"{CREATED_AT}","fuente":"yfinance.screen","rank_bucket":"',
 CAST(rank_bucket AS STRING), '","region_descubrimiento":"', region, '","sector_descubrimiento":"', sector, '","ticker":"', ticker, '","tipo_activo":"accion"}}'), ',' ORDER BY ro, so, rank_bucket), ']')) AS catalog_sha256 FROM catalogo""")
def catalog_hash(t):
    return discovery.catalog_hash(discovery.discover(t.quotes(), t.config(), CREATED_AT))


def tampered(t):
    """The catalog with one kind of damage per group of tickers."""
    pk = F.substring("ticker", 2, 20).cast("bigint")
    return t.catalog().withColumns({
        "tipo_activo": F.when(pk % 13 == 1, "etf").otherwise(F.col("tipo_activo")),
        "rank_bucket": F.when(pk % 11 == 2, F.col("cuota_bucket") + 1).otherwise(F.col("rank_bucket")),
        "ticker": F.when(pk % 17 == 3, "DUP").when(pk % 19 == 4, F.concat("ticker", F.lit(" X"))).otherwise(F.col("ticker"))})


TAMPERED = {"roto": """
SELECT CASE WHEN pk % 17 = 3 THEN 'DUP' WHEN pk % 19 = 4 THEN concat(ticker, ' X') ELSE ticker END AS ticker, region, sector, cuota,
 CASE WHEN pk % 13 = 1 THEN 'etf' ELSE 'accion' END AS tipo, CASE WHEN pk % 11 = 2 THEN cuota + 1 ELSE rank_bucket END AS r FROM catalogo"""}


@query("catalog_checks", """
SELECT ticker, 'duplicado' AS problema FROM roto GROUP BY ticker HAVING COUNT(*) > 1
UNION ALL SELECT ticker, 'rank_repetido' FROM (SELECT *, COUNT(*) OVER (PARTITION BY region, sector, r) AS n FROM roto) WHERE n > 1
UNION ALL SELECT ticker, 'formato' FROM roto WHERE contains(ticker, ' ') UNION ALL SELECT ticker, 'tipo_o_fuente' FROM roto WHERE tipo <> 'accion'
UNION ALL SELECT ticker, 'rank_y_cuota' FROM roto WHERE cuota < r OR r < 1""", TAMPERED)
def catalog_checks(t):
    return discovery.catalog_violations(tampered(t))


@query("selection_compat_checks", """
SELECT ticker, CASE WHEN pk % 23 = 5 OR pk % 29 = 6 THEN 'bucket_fuera_de_perfil' ELSE 'cuota_incoherente' END AS problema
FROM catalogo WHERE pk % 23 = 5 OR pk % 29 = 6 OR pk % 31 = 7""")
def selection_compat_checks(t):
    pk = F.substring("ticker", 2, 20).cast("bigint")
    rows = t.catalog().withColumns({
        "region_descubrimiento": F.when(pk % 23 == 5, "xx").otherwise(F.col("region_descubrimiento")),
        "sector_descubrimiento": F.when(pk % 29 == 6, "Financial Services").otherwise(F.col("sector_descubrimiento")),
        "cuota_bucket": F.when(pk % 31 == 7, F.col("cuota_bucket") + 1).otherwise(F.col("cuota_bucket"))})
    return universe.compat_violations(rows, S.DISCOVERY_QUOTAS, universe.SelectionConfig())


@query("universe_select", f"""
SELECT ticker, origen_inclusion, region AS region_descubrimiento, sector AS sector_descubrimiento,
 concat('{DISCOVERY_ID}; rank_bucket=', CAST(rank_bucket AS STRING), '; cuota_seleccion=', CAST(cuota_sel AS STRING)) AS nota FROM seleccion""")
def universe_select(t):
    return universe.members(t.selected(discovery.discover(t.quotes(), t.config(), CREATED_AT)))


@query("provenance_note", f"SELECT ticker, concat('{DISCOVERY_ID}; rank_bucket=', CAST(rank_bucket AS STRING), '; cuota_seleccion=', CAST(cuota_sel AS STRING)) AS nota FROM catalogo")
def provenance_note(t):
    rows = universe.with_quota(discovery.discover(t.quotes(), t.config(), CREATED_AT), universe.SelectionConfig())
    return rows.select("ticker", universe.selection_note(DISCOVERY_ID).alias("nota"))


@query("selection_summary", """
SELECT (SELECT COUNT(*) FROM catalogo) AS snapshot_tickers, COUNT(*) FILTER (WHERE ends_with(origen_inclusion, 'cuota_base')) AS seleccion_base,
 COUNT(*) FILTER (WHERE ends_with(origen_inclusion, 'incumbente')) AS retencion_incumbentes, COUNT(*) AS seleccion_final,
 COUNT(*) FILTER (WHERE ticker IN (SELECT ticker FROM titulares)) AS permanencias, COUNT(*) FILTER (WHERE ticker NOT IN (SELECT ticker FROM titulares)) AS altas,
 (SELECT COUNT(*) FROM titulares WHERE ticker NOT IN (SELECT ticker FROM seleccion)) AS bajas, COUNT(*) BETWEEN 400 AND 800 AS tamano_valido FROM seleccion""")
def selection_summary(t):
    catalog = t.catalog()
    return universe.selection_summary(t.selected(catalog), catalog, t.incumbents())


def observed(t):
    """Catalog, survivors and dropped members of the observed run."""
    catalog = t.catalog()
    selected = t.selected(catalog)
    seen = selected.where(F.substring("ticker", 2, 20).cast("bigint") % 10 != 3).select(F.lower("ticker").alias("ticker"))
    split = universe.split_survivors(selected, seen)
    return catalog, split.where(F.col("grupo") == "superviviente"), split.where(F.col("grupo") == "descartado")


@query("survivor_split", "SELECT ticker, 'superviviente' AS grupo FROM supervivientes UNION ALL SELECT ticker, 'descartado' FROM descartadas")
def survivor_split(t):
    _, kept, gone = observed(t)
    return kept.select("ticker", "grupo").unionByName(gone.select("ticker", "grupo"))


@query("refine_fill", "SELECT removed_ticker, replacement_ticker, strategy, region AS region_descubrimiento, sector_origen, sector_reemplazo, CAST(rank_reemplazo AS INT) AS rank_reemplazo FROM reemplazos")
def refine_fill(t):
    return universe.refill(*observed(t))


REFINED = f"""
SELECT ticker, 'refine_observed_v1:superviviente' AS origen_inclusion FROM supervivientes
UNION ALL SELECT replacement_ticker, concat('refine_observed_v1:relleno_', strategy) FROM reemplazos WHERE replacement_ticker IS NOT NULL"""


@query("refined_draft", f"""
SELECT r.ticker, r.origen_inclusion, c.region AS region_descubrimiento, c.sector AS sector_descubrimiento,
 concat('{DISCOVERY_ID}; observacion={OBSERVED}; rank_bucket=', CAST(c.rank_bucket AS STRING)) AS nota FROM refinado r JOIN catalogo c ON c.ticker = r.ticker""", {"refinado": REFINED})
def refined_draft(t):
    catalog, kept, gone = observed(t)
    return universe.members(universe.refined_members(catalog, kept, universe.refill(catalog, kept, gone), DISCOVERY_ID, OBSERVED))


@query("refine_summary", """
SELECT (SELECT COUNT(*) FROM supervivientes) AS supervivientes_observados, (SELECT COUNT(*) FROM descartadas) AS listings_excluidos_antes_descarga,
 COUNT(*) FILTER (WHERE strategy = 'mismo_bucket') AS rellenos_mismo_bucket, COUNT(*) FILTER (WHERE strategy = 'misma_region') AS rellenos_misma_region,
 COUNT(*) FILTER (WHERE strategy = 'sin_reserva') AS sin_reserva, (SELECT COUNT(*) FROM seleccion) AS tickers_origen,
 (SELECT COUNT(*) FROM supervivientes) + COUNT(replacement_ticker) AS tickers_finales, COUNT(*) FILTER (WHERE strategy = 'sin_reserva') = 0 AS completo FROM reemplazos""")
def refine_summary(t):
    catalog, kept, gone = observed(t)
    return universe.refine_summary(kept, gone, universe.refill(catalog, kept, gone))


@query("observation_checks", """
SELECT TRUE AS un_control, TRUE AS oficial, c.hash = (SELECT sha256(concat(string_agg(ticker, chr(10) ORDER BY ticker), chr(10))) FROM seleccion) AS hash_coincide,
 c.pedidos = (SELECT COUNT(*) FROM seleccion) AS brutos_cuadran, c.errores = 0 AS cobertura_completa,
 (SELECT COUNT(*) = COUNT(DISTINCT ticker) AND COUNT(*) > 0 FROM supervivientes) AS journal_sin_repetidos,
 (SELECT COUNT(*) = 0 FROM supervivientes WHERE ticker NOT IN (SELECT ticker FROM seleccion)) AS supervivientes_en_universo,
 (SELECT COUNT(*) FROM supervivientes) = c.evaluadas AND (SELECT COUNT(*) FROM seleccion) - (SELECT COUNT(DISTINCT ticker) FROM supervivientes) = c.deduplicados
  AND c.pedidos - c.deduplicados = c.evaluadas AS deduplicados_cuadran
FROM (SELECT sha256(concat(string_agg(ticker, chr(10) ORDER BY ticker), chr(10))) AS hash, COUNT(*) AS pedidos, 0 AS errores,
 COUNT(*) FILTER (WHERE pk % 10 <> 3) AS evaluadas, COUNT(*) FILTER (WHERE pk % 10 = 3) AS deduplicados FROM seleccion) c""")
def observation_checks(t):
    _, kept, gone = observed(t)
    members = kept.unionByName(gone)
    total = F.count(F.lit(1))
    run = discovery.member_hash(members).select(
        F.lit(True).alias("oficial"), F.col("sha256").alias("universe_sha256"),
        *[F.col("ticker_count").alias(c) for c in ("tickers_solicitados", "resultados_brutos", "descargas_correctas")],
        F.lit(0).alias("errores_descarga"), F.lit(1).alias("_one"))
    counts = kept.agg(total.alias("empresas_evaluadas")).withColumn("_one", F.lit(1)).join(
        gone.agg(total.alias("deduplicados")).withColumn("_one", F.lit(1)), "_one")
    return universe.observation_checks(run.join(counts, "_one").drop("_one"), kept, members)


@query("universe_diff", """
SELECT COALESCE(a.ticker, b.ticker) AS ticker, CASE WHEN a.ticker IS NULL THEN 'anadido' WHEN b.ticker IS NULL THEN 'eliminado' ELSE 'comun' END AS cambio
FROM titulares a FULL JOIN seleccion b ON b.ticker = a.ticker""")
def universe_diff(t):
    return universe.diff(t.incumbents(), t.selected(discovery.discover(t.quotes(), t.config(), CREATED_AT)))


A, B = "uv_2024q1_r01", "uv_2024q2_r01"


@query("universe_diff_by_reference", f"""
SELECT COALESCE(a.ticker, b.ticker) AS ticker, CASE WHEN a.ticker IS NULL THEN 'anadido' WHEN b.ticker IS NULL THEN 'eliminado' ELSE 'comun' END AS cambio
FROM (SELECT ticker FROM miembros WHERE universe_id = '{A}') a FULL JOIN (SELECT ticker FROM seleccion) b ON b.ticker = a.ticker""")
def universe_diff_by_reference(t):
    catalog = t.catalog()
    return universe.diff_by_reference(t.regional_members(catalog), A, t.selected(catalog))


@query("universe_checks", """
SELECT universe_id, problema FROM (SELECT v.*, m.n AS real_n, m.hash AS real_hash, d.universe_id AS declarado FROM versiones v
  LEFT JOIN (SELECT m.universe_id, h.ticker_count AS n, h.hash FROM mercados m JOIN huella h USING (region)) m ON m.universe_id = v.universe_id
  LEFT JOIN (SELECT DISTINCT universe_id FROM versiones) d ON d.universe_id = v.supersedes),
 UNNEST([CASE WHEN NOT regexp_matches(universe_id, '^uv_[0-9]{4}q[1-4]_r[0-9]{2}$') THEN 'id_invalido' END, CASE WHEN status NOT IN ('draft', 'active', 'retired') THEN 'estado_invalido' END,
  CASE WHEN TRY_CAST(substr(created_at, 1, 10) AS DATE) IS NULL THEN 'creacion_invalida' END,
  CASE WHEN TRY_CAST(substr(effective_from, 1, 10) AS DATE) IS NULL AND NOT (status = 'draft' AND effective_from IS NULL) THEN 'vigencia_invalida' END,
  CASE WHEN selection_method = '' THEN 'metodo_ausente' END, CASE WHEN asset_type <> 'equity' THEN 'tipo_invalido' END,
  CASE WHEN supersedes IS NOT NULL AND (declarado IS NULL OR supersedes = universe_id) THEN 'reemplazo_invalido' END,
  CASE WHEN ticker_count <> COALESCE(real_n, 0) THEN 'recuento_incoherente' END, CASE WHEN sha256 <> COALESCE(real_hash, '') THEN 'hash_incoherente' END]) AS u(problema) WHERE problema IS NOT NULL
UNION ALL SELECT universe_id, 'ruta_repetida' FROM versiones WHERE path = 'oficiales/repetido.csv'
UNION ALL SELECT 'uv_2024q1_r01', 'activo_ambiguo' WHERE TRUE""")
def universe_checks(t):
    catalog = t.catalog()
    return universe.registry_violations(t.versions(catalog), t.regional_members(catalog), A)


@query("mirror_differences", """
SELECT CAST(posicion AS INT) AS posicion, ticker, CASE WHEN region <> 'us' THEN NULL WHEN rank_bucket = 1 THEN lower(ticker) ELSE ticker END AS espejo FROM (
 SELECT *, ROW_NUMBER() OVER (ORDER BY ro, so, rank_bucket) AS posicion FROM seleccion) WHERE region <> 'us' OR rank_bucket = 1""")
def mirror_differences(t):
    """The whole selection against a mirror that stopped after the first market and changed first places."""
    rows = universe.numbered(t.selected(t.catalog()))
    stale = rows.where(F.col("region_descubrimiento") == "us")
    mirror = stale.select("posicion", F.when(F.col("rank_bucket") == 1, F.lower("ticker")).otherwise(F.col("ticker")).alias("ticker"))
    return universe.mirror_differences(rows.select("posicion", "ticker"), mirror)


@query("universe_activate", f"""
SELECT universe_id, CASE WHEN universe_id = '{A}' THEN 'active' WHEN status = 'active' THEN 'retired' ELSE status END AS status,
 CASE WHEN universe_id = '{A}' THEN '2024-03-01' ELSE effective_from END AS effective_from FROM versiones""")
def universe_activate(t):
    return universe.activate(t.versions(t.catalog()), A, "2024-03-01").select("universe_id", "status", "effective_from")


@query("universe_resolve", f"""
SELECT 'activo' AS modo, m.universe_id, m.ticker, v.sha256 FROM miembros m JOIN versiones v ON v.universe_id = m.universe_id WHERE v.status = 'active'
UNION ALL SELECT 'por_id', m.universe_id, m.ticker, v.sha256 FROM miembros m JOIN versiones v ON v.universe_id = m.universe_id WHERE v.universe_id = '{B}'
UNION ALL SELECT 'adhoc', concat('adhoc_', substr(h, 1, 12)), '', h FROM (SELECT sha256(concat(string_agg(ticker, chr(10) ORDER BY ticker), chr(10))) AS h FROM seleccion)""")
def universe_resolve(t):
    catalog = t.catalog()
    versions, members = t.versions(catalog), t.regional_members(catalog)
    columns = ["universe_id", "ticker", "sha256"]
    active = universe.resolve(versions, members).select(F.lit("activo").alias("modo"), *columns)
    named = universe.resolve(versions, members, B).select(F.lit("por_id").alias("modo"), *columns)
    adhoc = universe.adhoc_identity(t.selected(catalog)).select(F.lit("adhoc").alias("modo"), "universe_id", F.lit("").alias("ticker"), "sha256")
    return active.unionByName(named).unionByName(adhoc)


@query("universe_draft", """
SELECT 'uv_2024q1_r02' AS universe_id, 'oficiales/uv_2024q1_r02.csv' AS path, 'draft' AS status, 'uv_2024q1_r01' AS supersedes,
 COUNT(*) AS ticker_count, sha256(concat(string_agg(ticker, chr(10) ORDER BY ticker), chr(10))) AS sha256 FROM seleccion""")
def universe_draft(t):
    row = universe.draft_version(t.selected(t.catalog()), "uv_2024q1_r02", A, CREATED_AT, S.SELECTION_PROFILE, "")
    return row.select("universe_id", "path", "status", "supersedes", "ticker_count", "sha256")


RAW_TICKERS = """CASE pk % 6 WHEN 0 THEN concat(' t', CAST(pk // 2 AS STRING), ' ') WHEN 1 THEN concat('t', CAST(pk AS STRING)) WHEN 2 THEN '   '
 WHEN 3 THEN concat('T', CAST(pk // 2 AS STRING)) WHEN 4 THEN concat('t ', CAST(pk AS STRING)) ELSE concat(repeat('x', 33), CAST(pk AS STRING)) END"""


def raw_tickers(t):
    pk = F.col("p_partkey")
    s, half = pk.cast("string"), F.floor(pk / 2).cast("string")
    text = (
        F.when(pk % 6 == 0, F.concat(F.lit(" t"), half, F.lit(" "))).when(pk % 6 == 1, F.concat(F.lit("t"), s))
        .when(pk % 6 == 2, "   ").when(pk % 6 == 3, F.concat(F.lit("T"), half))
        .when(pk % 6 == 4, F.concat(F.lit("t "), s)).otherwise(F.concat(F.repeat(F.lit("x"), 33), s)))
    return t.raw("part").select(text.alias("ticker"), pk.alias("orden"))


@query("ticker_normalize", f"""
SELECT ticker, orden, length(ticker) <= 32 AND NOT contains(ticker, ' ') AS valido FROM (SELECT ticker, MIN(orden) AS orden FROM (
 SELECT upper(trim({RAW_TICKERS})) AS ticker, pk AS orden FROM (SELECT p_partkey AS pk FROM part)) WHERE ticker <> '' GROUP BY ticker)""")
def ticker_normalize(t):
    return listings.normalize_tickers(raw_tickers(t))


@query("ticker_strict_check", f"""
SELECT ticker, n AS apariciones, CASE WHEN ticker = '' THEN 'vacio' WHEN contains(ticker, ' ') THEN 'formato' ELSE 'duplicado' END AS problema FROM (
 SELECT upper(trim({RAW_TICKERS})) AS ticker, COUNT(*) AS n FROM (SELECT p_partkey AS pk FROM part) GROUP BY 1) WHERE ticker = '' OR contains(ticker, ' ') OR n > 1""")
def ticker_strict_check(t):
    return listings.ticker_violations(raw_tickers(t))


@query("union_candidate_lists", """
SELECT ticker, 'actual' AS origen FROM titulares UNION ALL SELECT ticker, 'nuevo' FROM seleccion WHERE ticker NOT IN (SELECT ticker FROM titulares)""")
def union_candidate_lists(t):
    return listings.union_candidate_lists(t.incumbents(), t.selected(discovery.discover(t.quotes(), t.config(), CREATED_AT)))
