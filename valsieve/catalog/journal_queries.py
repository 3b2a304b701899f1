"""Journal, revisions, signals and their performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.catalog import query
from valsieve.operators import integrity, journal, signals


def r6(name, source=None):
    return F.round(F.col(source or name), 6).alias(name)


def text(name):
    return F.col(name).cast("string").alias(name)


@query("effective_snapshots", "SELECT snapshot_id, origen FROM efectivas")
def effective_snapshots(t):
    return journal.effective_snapshots(t.journal(), t.runs(), "semana")


@query("effective_journal", "SELECT snapshot_id, ticker, pasa FROM oficial")
def effective_journal(t):
    return journal.effective_journal(t.journal(), t.runs(), "semana").select("snapshot_id", "ticker", "pasa")


@query("latest_snapshot", "SELECT snapshot_id, ticker, pasa FROM journal WHERE fecha_ejecucion = (SELECT MAX(fecha_ejecucion) FROM journal)")
def latest_snapshot(t):
    return journal.latest_snapshot(t.journal()).select("snapshot_id", "ticker", "pasa")


@query("journal_view", "SELECT snapshot_id, ticker, puntuacion FROM journal")
def journal_view(t):
    return journal.journal_view(t.journal()).select("snapshot_id", "ticker", "puntuacion")


@query("run_revision", """
SELECT CAST(w.semana AS STRING) AS semana, CAST(COALESCE(MAX(r.revision), 0) + 1 AS INT) AS revision
FROM (SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) + 7 AS semana FROM events UNION SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) FROM events) w
LEFT JOIN runs r ON r.semana = w.semana GROUP BY w.semana""")
def run_revision(t):
    week = F.date_trunc("week", "ts").cast("date")
    weeks = t.raw("events").select(F.explode(F.array(week, F.date_add(week, 7))).alias("semana"))
    return journal.next_revision(t.runs(), weeks, "semana").select(text("semana"), "revision")


@query("control_checks", """
SELECT snapshot_id, problema FROM (SELECT snapshot_id, revision,
 CASE EXTRACT(DAY FROM fecha_ejecucion) % 4 WHEN 0 THEN '' WHEN 1 THEN 'uv_2024q1_r01' ELSE 'adhoc_1' END AS uid,
 CASE EXTRACT(DAY FROM fecha_ejecucion) % 4 WHEN 2 THEN 'xyz' ELSE repeat('a', 64) END AS hash, oficial, fecha_ejecucion FROM runs),
 UNNEST([CASE WHEN uid = '' THEN 'identidad_incompleta' END, CASE WHEN hash = 'xyz' THEN 'hash_invalido' END,
  CASE WHEN oficial AND NOT starts_with(uid, 'uv_') THEN 'oficial_sin_universo' END, CASE WHEN revision - 1 < 1 THEN 'revision_invalida' END,
  CASE WHEN EXTRACT(DAY FROM fecha_ejecucion) < 10 THEN 'snapshot_repetido' END]) AS u(problema) WHERE problema IS NOT NULL""")
def control_checks(t):
    k = F.dayofmonth("fecha_ejecucion") % 4
    runs = t.runs().select(
        "snapshot_id", "fecha_ejecucion", "oficial", (F.col("revision") - 1).alias("revision"),
        F.when(k == 0, "").when(k == 1, "uv_2024q1_r01").otherwise("adhoc_1").alias("universe_id"),
        F.when(k == 2, "xyz").otherwise(F.repeat(F.lit("a"), 64)).alias("universe_sha256"),
        F.lit("oficiales/x.csv").alias("universe_path"))
    existing = runs.where(F.dayofmonth("fecha_ejecucion") < 10)
    return integrity.control_violations(runs, existing)


@query("evolve_schema", """
SELECT snapshot_id, ticker, CAST(NULL AS STRING) AS proveedor_datos, CAST(NULL AS STRING) AS calidad_datos FROM journal WHERE dia < DATE '2024-01-10'
UNION ALL SELECT snapshot_id, ticker, 'primario', CASE WHEN error_descarga = '' THEN 'ok' ELSE 'error' END FROM journal WHERE dia >= DATE '2024-01-10'""")
def evolve_schema(t):
    rows = t.journal()
    old = rows.where(F.col("dia") < "2024-01-10").select("snapshot_id", "ticker")
    new = rows.where(F.col("dia") >= "2024-01-10").select(
        "snapshot_id", "ticker", F.lit("primario").alias("proveedor_datos"),
        F.when(F.col("error_descarga") == "", "ok").otherwise("error").alias("calidad_datos"))
    return journal.evolve(old, new.columns, S.PROVENANCE_COLUMNS, trailing=True).unionByName(new)


@query("signal_episodes", "SELECT ticker, nombre, sector, region, CAST(dia AS STRING) AS fecha_entrada, ROUND(per, 6) AS per, ROUND(ev_ebit, 6) AS ev_ebit, ROUND(roic, 6) AS roic, puntuacion FROM senales")
def signal_episodes(t):
    rows = signals.signals(journal.effective_journal(t.journal(), t.runs(), "semana"))
    return rows.select("ticker", "nombre", "sector", "region", F.to_date("fecha_entrada").cast("string").alias("fecha_entrada"),
                       r6("per"), r6("ev_ebit"), r6("roic"), "puntuacion")


def official_signals(t):
    rows = signals.signals(journal.effective_journal(t.journal(), t.runs(), "semana"))
    return rows.select("ticker", F.to_date("fecha_entrada").alias("fecha_entrada"))


@query("signal_price_join", """
SELECT ticker, CAST(entrada AS STRING) AS fecha_entrada, CAST(MIN(fecha) AS STRING) AS fecha_precio, ROUND(MIN_BY(close, fecha), 6) AS precio,
 COUNT(close) AS observaciones FROM senal_precio GROUP BY ticker, entrada""")
def signal_price_join(t):
    rows = signals.signal_prices(official_signals(t), t.stored_prices())
    return rows.select("ticker", text("fecha_entrada"), F.col("fecha").cast("string").alias("fecha_precio"),
                       r6("precio", "close"), F.coalesce("observaciones", F.lit(0)).alias("observaciones"))


@query("signal_performance", """
SELECT ticker, CAST(entrada AS STRING) AS fecha_entrada, ROUND(CASE WHEN COUNT(close) >= 2 THEN MIN_BY(close, fecha) END, 6) AS precio_entrada,
 ROUND(CASE WHEN COUNT(close) >= 2 THEN MAX_BY(close, fecha) END, 6) AS precio_actual,
 ROUND(CASE WHEN COUNT(close) >= 2 THEN MAX_BY(close, fecha) / MIN_BY(close, fecha) - 1 END, 6) AS retorno_total,
 ROUND(CASE WHEN COUNT(close) >= 2 THEN MIN(close / maximo - 1) END, 6) AS max_drawdown,
 CAST(CASE WHEN COUNT(close) >= 2 THEN date_diff('day', MIN(fecha), MAX(fecha)) END AS INT) AS dias_en_seguimiento
FROM senal_precio GROUP BY ticker, entrada""")
def signal_performance(t):
    rows = signals.signal_performance(official_signals(t), t.stored_prices())
    return rows.select("ticker", text("fecha_entrada"), r6("precio_entrada"), r6("precio_actual"),
                       r6("retorno_total"), r6("max_drawdown"), "dias_en_seguimiento")


@query("daily_returns", """
SELECT ticker, CAST(fecha AS STRING) AS fecha, ROUND(close / LAG(close) OVER (PARTITION BY ticker ORDER BY fecha) - 1, 6) AS retorno FROM prices""")
def daily_returns(t):
    return signals.daily_returns(t.stored_prices()).select("ticker", text("fecha"), r6("retorno"))


@query("twr_index", """
SELECT ticker, CAST(fecha AS STRING) AS fecha, ROUND(close / FIRST_VALUE(close) OVER (PARTITION BY ticker ORDER BY fecha), 6) AS indice FROM prices""")
def twr_index(t):
    return signals.wealth_index(t.prices()).select("ticker", text("fecha"), r6("indice"))


@query("max_drawdown", """
SELECT ticker, ROUND(MIN(caida), 6) AS max_drawdown FROM (SELECT ticker, close / MAX(close) OVER (PARTITION BY ticker ORDER BY fecha) - 1 AS caida FROM prices) GROUP BY ticker""")
def max_drawdown(t):
    return signals.drawdowns(t.stored_prices()).select("ticker", r6("max_drawdown"))


CHART = {"grafica": """
SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY ticker, fecha_entrada) AS n FROM
 (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, fecha_entrada, fecha_calculo ORDER BY orden DESC) AS k FROM tracking WHERE retorno_total IS NOT NULL) WHERE k = 1) WHERE n >= 2"""}


@query("chartable_history", "SELECT ticker, CAST(fecha_entrada AS STRING) AS fecha_entrada, CAST(fecha_calculo AS STRING) AS fecha_calculo, ROUND(retorno_total, 6) AS retorno_total, orden FROM grafica", CHART)
def chartable_history(t):
    rows = signals.chartable_history(t.tracking(), 2, "orden")
    return rows.select("ticker", text("fecha_entrada"), text("fecha_calculo"), r6("retorno_total"), "orden")


@query("latest_per_signal", """
SELECT ticker, CAST(fecha_entrada AS STRING) AS fecha_entrada, CAST(fecha_calculo AS STRING) AS fecha_calculo, ROUND(retorno_total, 6) AS retorno_total
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, fecha_entrada ORDER BY fecha_calculo DESC, orden DESC) AS k FROM tracking) WHERE k = 1""")
def latest_per_signal(t):
    rows = signals.latest_per_signal(t.tracking(), "orden")
    return rows.select("ticker", text("fecha_entrada"), text("fecha_calculo"), r6("retorno_total"))


@query("first_last_return", """
SELECT ticker, CAST(fecha_entrada AS STRING) AS fecha_entrada, ROUND(MIN_BY(retorno_total, fecha_calculo), 6) AS primer_retorno,
 ROUND(MAX_BY(retorno_total, fecha_calculo), 6) AS ultimo_retorno, COUNT(*) AS observaciones FROM grafica GROUP BY ticker, fecha_entrada""", CHART)
def first_last_return(t):
    rows = signals.first_last_return(signals.chartable_history(t.tracking(), 2, "orden"))
    return rows.select("ticker", text("fecha_entrada"), r6("primer_retorno"), r6("ultimo_retorno"), "observaciones")
