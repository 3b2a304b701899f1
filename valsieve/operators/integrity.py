"""Run-level reconciliation and control-row rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.errors import IntegrityError
from valsieve.functions.cleaning import blank_to_empty, text_bool

REQUIRED = ["ticker", "pasa", "error_descarga", "motivos_descarte"]


def gate(evaluated: DataFrame, control: DataFrame) -> DataFrame:
    """One row of named checks; ``valida`` is true when all of them hold.

    Zero candidates is a valid run.  Too many failed downloads are not.
    """
    repeated = (
        evaluated.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("pasa").isNull()).alias("_null"))
        .agg(F.count_if(F.col("_n") > 1).alias("tickers_duplicados"), F.coalesce(F.sum("_null"), F.lit(0)).alias("_sin_veredicto"))
    )
    row = control.withColumn("_one", F.lit(1)).join(repeated.withColumn("_one", F.lit(1)), "_one")
    grades = F.col("datos_ok") + F.col("datos_revisar") + F.col("datos_inutilizables")
    checks = row.select(
        "tickers_duplicados",
        ((F.col("tickers_solicitados") > 0) & (F.col("resultados_brutos") == F.col("tickers_solicitados"))
         & F.col("errores_descarga").between(F.lit(0), F.col("resultados_brutos"))).alias("brutos_cuadran"),
        (F.col("resultados_brutos") - F.col("deduplicados") == F.col("empresas_evaluadas")).alias("deduplicados_cuadran"),
        (grades == F.col("empresas_evaluadas")).alias("calidad_cuadra"),
        F.coalesce(F.col("tasa_exito_descarga") >= F.col("umbral_exito_minimo"), F.lit(False)).alias("exito_suficiente"),
        "_sin_veredicto",
    )
    return checks.withColumn("valida", (
        (F.col("tickers_duplicados") == 0) & (F.col("_sin_veredicto") == 0) & F.col("brutos_cuadran")
        & F.col("deduplicados_cuadran") & F.col("calidad_cuadra") & F.col("exito_suficiente")
    )).drop("_sin_veredicto")


def require_valid(evaluated: DataFrame, control: DataFrame) -> None:
    """Raise before anything is written; reads back one row."""
    missing = sorted(set(REQUIRED) - set(evaluated.columns))
    if missing:
        raise IntegrityError("missing columns: " + ", ".join(missing))
    row = control.first()
    if not 0 <= row["umbral_exito_minimo"] <= 1:
        raise ValueError("the success threshold must be between 0 and 1")
    checks = gate(evaluated, control).first()
    if not checks["valida"]:
        values = checks.asDict()
        failed = [c for c, v in values.items() if c not in ("valida", "tickers_duplicados") and not v]
        if values["tickers_duplicados"]:
            failed.append("tickers_duplicados")
        raise IntegrityError("run rejected: " + (", ".join(failed) or "verdict missing"))


def control_violations(runs: DataFrame, existing: DataFrame) -> DataFrame:
    """(snapshot_id, problema) for control rows that may not be recorded."""
    parts = [blank_to_empty(c) for c in S.CONTROL_UNIVERSE_COLUMNS]
    some = (parts[0] != "") | (parts[1] != "") | (parts[2] != "")
    every = (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    known = existing.select(F.col("snapshot_id").alias("_seen")).distinct()
    rows = runs.join(known, runs["snapshot_id"] == known["_seen"], "left")
    problems = F.array_compact(F.array(
        F.when(some & ~every, "identidad_incompleta"),
        F.when((parts[1] != "") & ~parts[1].rlike(S.SHA256_PATTERN), "hash_invalido"),
        F.when(text_bool("oficial") & ~parts[0].startswith(S.OFFICIAL_UNIVERSE_PREFIX), "oficial_sin_universo"),
        F.when(F.coalesce(F.col("revision"), F.lit(0)) < 1, "revision_invalida"),
        F.when(F.col("_seen").isNotNull(), "snapshot_repetido"),
    ))
    return rows.select("snapshot_id", F.explode(problems).alias("problema"))
