"""Cross-source verification."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.catalog import query
from valsieve.catalog.oracle import in_list, values_table
from valsieve.catalog.tables import OBSERVED
from valsieve.operators import verification
from valsieve.session import shared_folder, stage_table
from valsieve.sources import writers

MOMENT = "2024-02-02 08:00:00"
DIRECT = " OR ".join(f"(metrica = '{f}' AND concepto IN {in_list(names)})" for f, names in S.DIRECT_CONCEPTS.items())
NOTES = values_table(list(S.APPROXIMATION_NOTES.items()), "concepto, nota")
FINAL = {"notas": NOTES, "finales": f"""
SELECT v.*, CASE WHEN v.st IS NULL OR v.concepto = '' OR ({DIRECT.replace('metrica', 'v.metrica').replace('concepto IN', 'v.concepto IN')}) OR (v.metrica = 'free_cash_flow' AND contains(v.concepto, ' - abs(')) THEN ''
 ELSE COALESCE(n.nota, concat('el concepto ', v.concepto, ' no está declarado como equivalente directo')) END AS nota,
 CASE WHEN v.st IS NOT NULL THEN v.concepto ELSE '' END AS c,
 CASE WHEN numerico IN ('verificado', 'advertencia', 'discrepancia_material') THEN CASE WHEN v1 = 0 THEN 0e0 ELSE abs(v2 - v1) / abs(v1) END END AS dif
FROM verificadas v LEFT JOIN notas n ON n.concepto = v.concepto"""}
STATE = "CASE WHEN nota <> '' AND dif IS NOT NULL THEN 'aproximacion_semantica' ELSE numerico END"


@query("join_verification", "SELECT p.ticker, s.ticker IS NOT NULL AS cubierta, COALESCE(s.error_descarga, '') AS error FROM fundamentals p LEFT JOIN secondary s ON s.ticker = p.ticker")
def join_verification(t):
    # The primary side comes in lower case: the join key is normalised.
    primary = t.fundamentals().withColumn("ticker", F.concat(F.lit(" "), F.lower("ticker")))
    rows = verification.join_sources(primary, t.secondary())
    return rows.select(F.col("p_ticker").alias("ticker"), F.col("s_ticker").isNotNull().alias("cubierta"),
                       F.coalesce("s_error_descarga", F.lit("")).alias("error"))


@query("verify_components", """
SELECT ticker, metrica, numerico AS estado, ROUND(CASE WHEN numerico IN ('verificado', 'advertencia', 'discrepancia_material') THEN
 CASE WHEN v1 = 0 THEN 0e0 ELSE abs(v2 - v1) / abs(v1) END END, 6) AS diferencia_pct FROM verificadas""")
def verify_components(t):
    primary = t.observations()
    rows = verification.compare_components(primary, t.secondary(primary))
    return rows.select(F.col("p_ticker").alias("ticker"), "metrica", "estado", F.round("diferencia_pct", 6).alias("diferencia_pct"))


def verified(t):
    primary = t.observations()
    return verification.verify(primary, t.secondary(primary), OBSERVED, MOMENT)


@query("semantic_override", f"""
SELECT ticker, metrica, {STATE} AS estado, CASE WHEN nota <> '' AND dif IS NOT NULL
 THEN concat('comparación orientativa (', numerico, '); ', nota, '; concepto secundario: ', c) ELSE '' END AS nota FROM finales""", FINAL)
def semantic_override(t):
    return verified(t).select("ticker", "metrica", "estado", F.when(
        F.col("estado") == S.SEMANTIC_STATE, F.col("detalle")).otherwise("").alias("nota"))


@query("verification_summary", f"SELECT {STATE} AS estado, COUNT(*) AS n FROM finales GROUP BY 1", FINAL)
def verification_summary(t):
    return verification.summary(verified(t))


@query("append_verification", f"""
SELECT ticker, metrica, {STATE} AS estado FROM finales
WHERE NOT (metrica IN ('ingresos', 'cash') AND CAST(substr(ticker, 2) AS BIGINT) % 2 = 0)""", FINAL)
def append_verification(t):
    """Half of two components is on file already, and every row comes twice."""
    new = verified(t)
    pk = F.substring("ticker", 2, 20).cast("bigint")
    existing = new.where(F.col("metrica").isin("ingresos", "cash") & (pk % 2 == 0))
    twice = new.withColumn("estado", F.lit("anterior")).withColumn("verificado_en_utc", F.lit("2024-01-01")).unionByName(new)
    return verification.pending(twice, existing).select("ticker", "metrica", "estado")


@query("append_verification_bucketed", f"SELECT ticker, metrica, {STATE} AS estado FROM finales", FINAL)
def append_verification_bucketed(t):
    """Two components first, then all of them twice: the bucketed table holds each row once."""
    new = stage_table(verified(t).select(*S.VERIFICATION_COLUMNS), "verified")
    path = f"{shared_folder(t.spark)}/verification-{uuid.uuid4().hex}"
    for part in (new.where(F.col("metrica").isin("ingresos", "cash")), new, new):
        stored = writers.append_verification_bucketed(part, path, 8)
    return stored.select("ticker", "metrica", "estado")
