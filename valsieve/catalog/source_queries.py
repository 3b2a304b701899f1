"""Round trips through the readers, writers and streams.

Each query writes a derived table to a new place in the shared folder with the
library's writer, and returns what its reader finds there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from valsieve import schemas
from valsieve import settings as S
from valsieve.catalog import query
from valsieve.catalog.journal_queries import official_signals
from valsieve.catalog.screen_queries import CAP_FLOOR_LIMITS, CONTROL
from valsieve.catalog.tables import CAP_FLOOR, CREATED_AT, DISCOVERY_ID
from valsieve.operators import discovery, journal, signals, summaries, universe
from valsieve.operators.output import json_rows
from valsieve.plans.analysis import analyze
from valsieve.session import shared_folder
from valsieve.sources import readers, writers
from valsieve.streaming.episodes import stream_episodes
from valsieve.streaming.journal import stream_journal

MOMENT = "2024-02-01 08:00:00"
SNAPSHOT = "snap_20240201T080000000000Z"


def place(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def r6(name, source=None):
    return F.round(F.col(source or name), 6).alias(name)


def week_text(ts):
    from valsieve.functions.dates import iso_week

    return iso_week(ts)


@query("scan_journal", "SELECT strftime(dia, 'snap_%Y%m%dT000000000000Z') AS snapshot_id, ticker, pasa, ROUND(per, 6) AS per, error_descarga FROM journal")
def scan_journal(t):
    """An old text layout without ids: they are derived from the instant."""
    path = place(t, "journal-csv")
    old = t.journal().drop("dia", "snapshot_id").withColumn("pasa", F.when(F.col("pasa"), "True").otherwise("no"))
    old.write.option("header", True).csv(path)
    rows = readers.read_journal(t.spark, path, text=True)
    return rows.select("snapshot_id", "ticker", "pasa", r6("per"), F.coalesce("error_descarga", F.lit("")).alias("error_descarga"))


@query("scan_runs", "SELECT snapshot_id, oficial, CAST(CASE WHEN revision % 3 <> 0 THEN revision END AS INT) AS revision, CAST(CAST(fecha_ejecucion AS DATE) AS STRING) AS dia FROM runs")
def scan_runs(t):
    path = place(t, "runs-csv")
    rows = t.runs().select(
        "snapshot_id", "fecha_ejecucion", F.when(F.col("oficial"), "sí").otherwise("False").alias("oficial"),
        F.when(F.col("revision") % 3 == 0, "sin número").otherwise(F.concat(F.col("revision").cast("string"), F.lit(".0"))).alias("revision"))
    rows.write.option("header", True).csv(path)
    back = readers.read_runs(t.spark, path, text=True)
    return back.select("snapshot_id", "oficial", "revision", F.to_date("fecha_ejecucion").cast("string").alias("dia"))


HEADERS = ["snapshot_id", "ticker", "pasa", "per"]


@query("header_check", """
SELECT DISTINCT CASE day(dia) % 4 WHEN 1 THEN 'breve' WHEN 2 THEN 'otra' ELSE 'girada' END AS capa,
 CASE day(dia) % 4 WHEN 1 THEN 'faltan: per' WHEN 2 THEN 'faltan: ticker; sobran: simbolo, nota' ELSE 'orden o repetición' END AS problema
FROM journal WHERE day(dia) % 4 > 0""")
def header_check(t):
    """The journal in text parts of four layouts: each part with another header than the expected one is named."""
    folder, rows = place(t, "layouts"), t.journal().withColumn("_k", F.dayofmonth("dia") % 4)
    layouts = {
        "actual": HEADERS, "breve": HEADERS[:3], "otra": ["snapshot_id", F.col("ticker").alias("simbolo"), "pasa", "per", F.lit("").alias("nota")],
        "girada": ["ticker", "snapshot_id", "pasa", "per"]}
    for k, (name, columns) in enumerate(layouts.items()):
        part = rows.where(F.col("_k") == k)
        if not part.isEmpty():
            part.select(*columns).write.option("header", True).csv(f"{folder}/{name}")
    found = readers.header_problems(t.spark, folder, HEADERS)
    return found.select(F.regexp_extract("archivo", "/([^/]+)/[^/]+$", 1).alias("capa"), "problema").distinct()


@query("scan_tracking", "SELECT ticker, CAST(fecha_entrada AS STRING) AS fecha_entrada, CAST(fecha_calculo AS STRING) AS fecha_calculo, ROUND(retorno_total, 6) AS retorno_total FROM tracking")
def scan_tracking(t):
    path = place(t, "tracking-csv")
    t.tracking().drop("orden").write.option("header", True).csv(path)
    back = readers.read_tracking(t.spark, path, text=True)
    return back.select("ticker", F.to_date("fecha_entrada").cast("string").alias("fecha_entrada"),
                       F.to_date("fecha_calculo").cast("string").alias("fecha_calculo"), r6("retorno_total"))


@query("append_journal", f"SELECT '{SNAPSHOT}' AS snapshot_id, '2024-W05' AS semana_iso, ticker, pasa, puntuacion FROM rankeadas")
def append_journal(t):
    path = place(t, "journal")
    writers.append_journal(analyze(t.observations(), CAP_FLOOR).ranked, path, MOMENT)
    return readers.read_journal(t.spark, path).select("snapshot_id", "semana_iso", "ticker", "pasa", "puntuacion")


@query("append_control", f"""SELECT '{SNAPSHOT}' AS snapshot_id, '2024-W05' AS semana_iso, CAST(1 AS INT) AS revision, CAST(tickers_solicitados AS INT) AS tickers_solicitados,
 CAST(empresas_evaluadas AS INT) AS empresas_evaluadas, CAST(candidatas AS INT) AS candidatas, tasa_exito_descarga FROM ctl""", {"ctl": CONTROL})
def append_control(t):
    path = place(t, "runs")
    rows = t.observations()
    control = summaries.run_control(analyze(rows, CAP_FLOOR_LIMITS).evaluated, rows)
    writers.append_control(control, path, MOMENT, SNAPSHOT)
    return readers.read_runs(t.spark, path).select(
        "snapshot_id", "semana_iso", "revision", "tickers_solicitados", "empresas_evaluadas", "candidatas", r6("tasa_exito_descarga"))


@query("append_tracking", """
SELECT ticker, CAST(entrada AS STRING) AS fecha_entrada, '2024-02-01' AS fecha_calculo,
 ROUND(CASE WHEN COUNT(close) >= 2 THEN MAX_BY(close, fecha) / MIN_BY(close, fecha) - 1 END, 6) AS retorno_total FROM senal_precio GROUP BY ticker, entrada""")
def append_tracking(t):
    path = place(t, "tracking")
    blank = {c: F.lit(None) for c in S.SIGNAL_COLUMNS if c not in ("ticker", "fecha_entrada")}
    rows = signals.signal_performance(official_signals(t), t.stored_prices()).withColumns(blank)
    writers.append_tracking(rows, path, MOMENT)
    return readers.read_tracking(t.spark, path).select(
        "ticker", F.to_date("fecha_entrada").cast("string").alias("fecha_entrada"),
        F.to_date("fecha_calculo").cast("string").alias("fecha_calculo"), r6("retorno_total"))


@query("write_screen_csv", "SELECT ticker, nombre, pasa, ROUND(per, 6) AS per, ROUND(cagr_ingresos, 6) AS cagr_ingresos, puntuacion FROM rankeadas")
def write_screen_csv(t):
    path = place(t, "screen-csv")
    writers.write_screen_csv(analyze(t.observations(), CAP_FLOOR).ranked, path)
    rows = readers.read_text_table(t.spark, path, schemas.schema_of(schemas.EVALUATED_COLUMNS))
    return rows.select("ticker", F.coalesce("nombre", F.lit("")).alias("nombre"), "pasa", r6("per"), r6("cagr_ingresos"), "puntuacion")


@query("scan_universe_members", "SELECT ticker, origen_inclusion, region AS region_descubrimiento, sector AS sector_descubrimiento FROM seleccion")
def scan_universe_members(t):
    path = place(t, "members") + ".csv"
    universe.members(t.selected(t.catalog())).write.option("header", True).csv(path)
    rows = readers.read_universe_members(t.spark, path, strict=True)
    return rows.select("ticker", "origen_inclusion", "region_descubrimiento", "sector_descubrimiento")


@query("write_universe_members", """
SELECT 'uv_2024q1_r02' AS universe_id, COUNT(*) AS ticker_count, sha256(concat(string_agg(ticker, chr(10) ORDER BY ticker), chr(10))) AS sha256,
 COUNT(*) AS filas FROM seleccion""")
def write_universe_members(t):
    folder = place(t, "registry")
    selected = t.selected(t.catalog())
    version = universe.draft_version(selected, "uv_2024q1_r02", "uv_2024q1_r01", CREATED_AT, S.SELECTION_PROFILE, "")
    registry = writers.write_universe_members(universe.members(selected), version, folder, f"{folder}/versions")
    stored = readers.read_universe_members(t.spark, f"{folder}/oficiales/uv_2024q1_r02.csv", strict=True)
    size = stored.agg(F.count(F.lit(1)).alias("filas")).withColumn("universe_id", F.lit("uv_2024q1_r02"))
    return registry.join(size, "universe_id").select("universe_id", "ticker_count", "sha256", "filas")


@query("write_ticker_list", "SELECT ticker FROM catalogo")
def write_ticker_list(t):
    path = place(t, "tickers")
    writers.write_ticker_list(t.catalog(), path, *discovery.ORDERS)
    return readers.read_universe_members(t.spark, path)


@query("scan_manifest", "SELECT universe_id, status, supersedes, ticker_count, 'uv_2024q1_r01' AS active_universe_id FROM versiones")
def scan_manifest(t):
    """The registry as one JSON document: one version per market, 22 at most."""
    path = place(t, "manifest")
    versions = t.versions(t.catalog())
    document = versions.agg(F.collect_list(F.struct(*S.VERSION_FIELDS)).alias("universes")).select(
        F.lit(1).alias("schema_version"), F.lit("uv_2024q1_r01").alias("active_universe_id"), "universes")
    json_rows(document).write.text(path)
    rows = readers.read_manifest(t.spark, path)
    return rows.select("universe_id", "status", "supersedes", "ticker_count", "active_universe_id")


def published(t):
    """Write catalog and control, and the metadata a selection needs."""
    folder = place(t, "discovery")
    catalog = t.catalog()
    ranked = discovery.ranked_buckets(t.quotes(), t.config())
    control = discovery.control(ranked, t.config())
    writers.write_discovery(catalog, control, folder, DISCOVERY_ID)
    size, digest = discovery.member_hash(catalog).first()
    meta = {
        "schema_version": 1, "discovery_id": DISCOVERY_ID, "sha256": digest,
        "catalog_sha256": discovery.catalog_hash(catalog).first()["catalog_sha256"],
        "config": {"perfil": S.DISCOVERY_PROFILE, "cuotas_region": S.DISCOVERY_QUOTAS, "sectores": S.SECTORS},
        "control": {"tickers_unicos": size}}
    text = t.spark.range(1).select(F.lit(json.dumps(meta)).alias("value"))
    text.write.text(f"{folder}/meta")
    return folder


CATALOG_ROWS = "SELECT ticker, region AS region_descubrimiento, sector AS sector_descubrimiento, CAST(rank_bucket AS INT) AS rank_bucket, CAST(cuota AS INT) AS cuota_bucket FROM catalogo"
CATALOG_COLUMNS = ["ticker", "region_descubrimiento", "sector_descubrimiento", "rank_bucket", "cuota_bucket"]


@query("scan_discovery", CATALOG_ROWS)
def scan_discovery(t):
    """Identity, ranks, counts and both hashes are checked while reading."""
    folder = published(t)
    catalog, _ = readers.read_discovery(t.spark, f"{folder}/{DISCOVERY_ID}.csv", f"{folder}/meta")
    return catalog.select(*CATALOG_COLUMNS)


@query("write_discovery", CATALOG_ROWS)
def write_discovery(t):
    rows = readers.read_text_table(t.spark, f"{published(t)}/{DISCOVERY_ID}.csv", schemas.DISCOVERY)
    return rows.select(*CATALOG_COLUMNS)


@query("journal_stream_append", "SELECT snapshot_id, ticker, pasa FROM journal")
def journal_stream_append(t):
    """The journal streamed twice over the same target: nothing is repeated."""
    source, target = place(t, "stream-in"), place(t, "stream-journal")
    t.journal().withColumn("semana_iso", week_text("fecha_ejecucion")).write.parquet(source)
    schema = t.spark.read.parquet(source).schema
    for run in ("a", "b"):
        rows = t.spark.readStream.schema(schema).parquet(source)
        stream_journal(rows, target, place(t, f"ckpt-{run}"), available_now=True).awaitTermination()
    return readers.read_table(t.spark, target, schema).select("snapshot_id", "ticker", "pasa")


@query("signal_state_stream", "SELECT ticker, CAST(dia AS STRING) AS fecha_entrada, ROUND(per, 6) AS per FROM senales")
def signal_state_stream(t):
    """Two runs of one stream: the second starts from the state of the first."""
    source, out, checkpoint = place(t, "signals-in"), place(t, "signals-out"), place(t, "signals-ckpt")
    rows = journal.effective_journal(t.journal(), t.runs(), "semana").drop("dia")
    half = F.lit("2024-01-16").cast("timestamp")
    for part in (rows.where(F.col("fecha_ejecucion") < half), rows.where(F.col("fecha_ejecucion") >= half)):
        part.write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(rows.schema).parquet(source)
        stream_episodes(stream, out, checkpoint, available_now=True).awaitTermination()
    found = t.spark.read.parquet(out)
    return found.select("ticker", F.to_date("fecha_ejecucion").cast("string").alias("fecha_entrada"), r6("per"))


