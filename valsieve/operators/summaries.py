"""Run-level counts, composition and the published summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.functions.cleaning import blank_to_empty, has_text
from valsieve.operators.listings import dedup_listings
from valsieve.operators.metrics import with_defaults
from valsieve.operators.ordering import whole_row

MISSING_LABEL = "(sin dato)"
UNUSABLE = ["inutilizable", "error"]


def composition(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Rows and share per value of every dimension, counted in one pass."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit(MISSING_LABEL)).alias("valor"))
        for d in dimensions
    ])).alias("d")
    counts = df.select(pairs).select("d.*").groupBy("dimension", "valor").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("dimension"))
    return counts.withColumn("cuota", F.col("n") / total)


def provider_list():
    names = F.array_sort(F.collect_set(F.when(has_text("proveedor_datos"), blank_to_empty("proveedor_datos"))))
    return F.array_join(names, ",")


def quality_counts(df: DataFrame) -> DataFrame:
    """Rows per grade with the (few) provider names seen."""
    return df.groupBy(F.col("calidad_datos").alias("calidad")).agg(
        F.count(F.lit(1)).alias("n"), provider_list().alias("proveedores"))


def run_control(evaluated: DataFrame, obtained: DataFrame, min_success: float = S.MIN_DOWNLOAD_SUCCESS,
                requested: DataFrame | None = None) -> DataFrame:
    """The one-row control record: what was asked, obtained, kept, passed.

    ``obtained`` has one row per delivered ticker with ``error_descarga``;
    ``requested`` is the list of tickers that were asked for.  Without it the
    delivered ones count as asked, and a lost ticker cannot be seen.  The number
    of collapsed listings comes from ``obtained``, not from the evaluated rows
    that it is there to check.  All sides are one-row aggregates, put side by
    side as columns.
    """
    grade = F.coalesce(F.col("calidad_datos"), F.lit("inutilizable"))
    one, rows = F.lit(1).alias("_one"), F.count(F.lit(1))
    got = obtained.agg(
        one, rows.alias("resultados_brutos"), F.count_if(has_text("error_descarga")).alias("errores_descarga"))
    companies = dedup_listings(with_defaults(obtained)).agg(one, rows.alias("_companies"))
    kept = evaluated.agg(
        one, rows.alias("empresas_evaluadas"), F.count_if("pasa").alias("candidatas"),
        provider_list().alias("proveedor_datos"),
        F.count_if(grade == "ok").alias("datos_ok"), F.count_if(grade == "revisar").alias("datos_revisar"),
        F.count_if(grade.isin(UNUSABLE)).alias("datos_inutilizables"))
    sides = got.join(companies, "_one").join(kept, "_one")
    if requested is None:
        sides = sides.withColumn("tickers_solicitados", F.col("resultados_brutos"))
    else:
        sides = sides.join(requested.agg(one, rows.alias("tickers_solicitados")), "_one")
    correct = F.col("resultados_brutos") - F.col("errores_descarga")
    return sides.select(
        "tickers_solicitados", "resultados_brutos", correct.alias("descargas_correctas"), "errores_descarga",
        (F.col("resultados_brutos") - F.col("_companies")).alias("deduplicados"),
        "empresas_evaluadas", "candidatas",
        F.try_divide(correct, F.col("tickers_solicitados")).alias("tasa_exito_descarga"),
        F.lit(float(min_success)).alias("umbral_exito_minimo"), "proveedor_datos",
        "datos_ok", "datos_revisar", "datos_inutilizables")


class RunCounts:
    """Counts of a run, gathered while its evaluated table is written.

    Rows are counted behind the collapse of listings and behind the rules, so a
    rule that loses rows shows.  Both lie in the last stage of that job, where
    Spark counts each partition once, also when tasks run again after a lost executor.
    """

    def __init__(self) -> None:
        self.companies, self.kept = Observation(), Observation()

    def of_companies(self, df: DataFrame) -> DataFrame:
        return df.observe(self.companies, F.count(F.lit(1)).alias("empresas"))

    def of_kept(self, df: DataFrame) -> DataFrame:
        grade = F.coalesce(F.col("calidad_datos"), F.lit("inutilizable"))
        named = F.when(has_text("proveedor_datos"), blank_to_empty("proveedor_datos"))
        return df.observe(
            self.kept, F.count(F.lit(1)).alias("empresas_evaluadas"), F.count_if("pasa").alias("candidatas"),
            F.min(named).alias("primer_proveedor"), F.max(named).alias("ultimo_proveedor"),
            F.count_if(grade == "ok").alias("datos_ok"), F.count_if(grade == "revisar").alias("datos_revisar"),
            F.count_if(grade.isin(UNUSABLE)).alias("datos_inutilizables"))

    def values(self) -> Mapping[str, object]:
        return self.companies.get | self.kept.get


def observed_control(evaluated: DataFrame, counts: RunCounts, obtained: DataFrame, min_success: float = S.MIN_DOWNLOAD_SUCCESS,
                     requested: DataFrame | None = None) -> DataFrame:
    """The control record of ``run_control`` from counts gathered on the way.

    The evaluated table isn't read again, but for the names of providers where a run has
    several; of ``obtained`` one column is counted, without collapsing its listings once more.
    """
    seen = counts.values()
    first, last = seen["primer_proveedor"] or "", seen["ultimo_proveedor"] or ""
    providers = F.lit(first) if first == last else evaluated.agg(provider_list()).scalar()
    rows = F.count(F.lit(1))
    row = obtained.agg(rows.alias("resultados_brutos"), F.count_if(has_text("error_descarga")).alias("errores_descarga"))
    gross = F.col("resultados_brutos")
    asked = gross if requested is None else requested.agg(rows).scalar()
    correct = gross - F.col("errores_descarga")
    whole = lambda name: F.lit(seen[name]).cast("bigint")
    return row.withColumn("tickers_solicitados", asked).select(
        "tickers_solicitados", "resultados_brutos", correct.alias("descargas_correctas"), "errores_descarga",
        (gross - whole("empresas")).alias("deduplicados"), whole("empresas_evaluadas").alias("empresas_evaluadas"),
        whole("candidatas").alias("candidatas"), F.try_divide(correct, F.col("tickers_solicitados")).alias("tasa_exito_descarga"),
        F.lit(float(min_success)).alias("umbral_exito_minimo"), providers.alias("proveedor_datos"),
        *[whole(c).alias(c) for c in ("datos_ok", "datos_revisar", "datos_inutilizables")])


def api_summary(control: DataFrame, requested: int | None = None) -> DataFrame:
    """The public summary with its deterministic conclusion.

    Without an explicit list, the requested tickers are the evaluated ones.
    """
    asked = F.col("empresas_evaluadas") if requested is None else F.lit(requested).cast("bigint")
    found = F.col("candidatas") > 0
    text = F.format_string(
        "%d of %d evaluated companies passed every configured quantitative criterion. "
        "This result requires primary-source review and is not an investment recommendation.",
        "candidatas", "empresas_evaluadas")
    return control.select(
        asked.alias("requested_tickers"), F.col("resultados_brutos").alias("raw_results"),
        F.col("empresas_evaluadas").alias("evaluated_companies"), F.col("candidatas").alias("candidates"),
        (F.col("empresas_evaluadas") - F.col("candidatas")).alias("discarded"),
        F.col("errores_descarga").alias("download_errors"), F.col("deduplicados").alias("deduplicated_listings"),
        F.when(found, "candidates_found").otherwise("no_candidates").alias("status"), text.alias("text"))


def candidate_fundamentals(fundamentals: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Raw components of the candidates only; the second source needs no more."""
    return fundamentals.join(evaluated.where(F.col("pasa")).select("ticker"), "ticker", "left_semi")


def annual_view(fundamentals: DataFrame) -> DataFrame:
    """Overlay the annual figures, where there are any, over the period ones.

    Of repeated tickers the least row by all columns stays.
    """
    has_annual = F.coalesce(F.size("comparables_anuales") > 0, F.lit(False))
    figures = {
        c: F.when(has_annual & F.map_contains_key("comparables_anuales", c), F.col("comparables_anuales")[c])
        .otherwise(F.col(c))
        for c in S.COMPARED_FIELDS if c in fundamentals.columns
    }
    overlaid = (
        fundamentals.withColumns({
            **figures,
            "proveedor_datos": F.when(has_annual, F.concat("proveedor_datos", F.lit("_anual"))).otherwise(F.col("proveedor_datos")),
            "tipo_periodo": F.when(has_annual, "ANUAL").otherwise(F.col("tipo_periodo")),
            "fecha_resultados": F.when(has_annual, F.col("fecha_resultados_anual")).otherwise(F.col("fecha_resultados")),
            "fecha_flujo_caja": F.when(has_annual, F.col("fecha_flujo_caja_anual")).otherwise(F.col("fecha_flujo_caja")),
        })
        .drop("comparables_anuales", "fecha_resultados_anual", "fecha_flujo_caja_anual")
    )
    first = Window.partitionBy("ticker").orderBy(whole_row(overlaid))
    return overlaid.withColumn("_k", F.row_number().over(first)).where(F.col("_k") == 1).drop("_k")
