"""Data-quality incidents, grades and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.functions.cleaning import blank_to_empty, nan_to_null, safe_date
from valsieve.functions.dates import day_gap
from valsieve.functions.text import incident_category


def date_incident(label: str, column: str, today: Column) -> Column:
    date = safe_date(column)
    age = F.datediff(today, date)
    return (
        F.when(date.isNull(), f"fecha de {label} ausente")
        .when(age > S.MAX_STATEMENT_AGE_DAYS,
              F.concat(F.lit(f"{label} obsoleto ("), age.cast("string"), F.lit(" días)")))
        .when(age < -S.MAX_FUTURE_DAYS, f"fecha futura de {label}")
    )


def incident_list(today: Column) -> Column:
    """Every material problem of a row, in a fixed order, without repeats."""
    missing = F.array_compact(F.array(*[
        F.when(nan_to_null(c).isNull(), label) for c, label in S.ESSENTIAL_FIELDS.items()]))
    quote, books = blank_to_empty("divisa_cotizacion"), blank_to_empty("divisa_financiera")
    gap = day_gap(safe_date("fecha_resultados"), safe_date("fecha_flujo_caja"))
    cap = nan_to_null("market_cap")
    return F.array_distinct(F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("campos ausentes: "), F.array_join(missing, ", "))),
        F.when(cap.isNull() | (cap <= 0), "capitalización no positiva o ausente"),
        F.when(nan_to_null("total_debt") < 0, "deuda negativa"),
        F.when(nan_to_null("cash") < 0, "caja negativa"),
        F.when((quote == "") | (books == ""), "divisa de cotización o financiera ausente")
        .when(~F.coalesce(F.col("divisa_consistente"), F.lit(False)),
              F.concat(F.lit("divisas incompatibles "), quote, F.lit("/"), books)),
        F.when(~blank_to_empty("tipo_periodo").isin(S.PERIOD_TYPES), "periodo contable no identificado"),
        *[date_incident(label, column, today) for label, column in S.STATEMENT_DATES.items()],
        F.when(gap > S.MAX_STATEMENT_GAP_DAYS, F.concat(
            F.lit("resultados y flujo de caja desalineados ("), gap.cast("string"), F.lit(" días)"))),
    )))


def grade(df: DataFrame, today: str | Column) -> DataFrame:
    """Set ``incidencias_datos`` and the grade: ok, revisar, inutilizable, error."""
    day = F.lit(today).cast("date") if isinstance(today, str) else today
    failed = F.coalesce(F.col("error_descarga"), F.lit("")) != ""
    pillars = sum(nan_to_null(c).isNull().cast("int") for c in S.PILLAR_FIELDS)
    return (
        df.withColumn("_incidents", incident_list(day))
        .withColumn("calidad_datos", F.when(failed, "error")
                    .when(pillars >= S.MIN_MISSING_PILLARS, "inutilizable")
                    .when(F.size("_incidents") > 0, "revisar").otherwise("ok"))
        .withColumn("incidencias_datos", F.when(failed, F.col("error_descarga"))
                    .otherwise(F.array_join("_incidents", "; ")))
        .drop("_incidents")
    )


def incident_parts() -> Column:
    parts = F.transform(F.split(blank_to_empty("incidencias_datos"), ";"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def affected(df: DataFrame) -> DataFrame:
    """Rows with any problem, with their distinct categories."""
    quality = F.lower(blank_to_empty("calidad_datos"))
    quality = F.when(quality == "", "ok").otherwise(quality)
    error = blank_to_empty("error_descarga") != ""
    named = F.array_compact(F.transform(F.col("_parts"), lambda p: incident_category(p, error)))
    categories = F.array_distinct(F.concat(
        F.when(error | (quality == "error"), F.array(F.lit("errores_descarga"))).otherwise(F.array().cast("array<string>")),
        named))
    return (
        df.withColumn("_parts", incident_parts())
        .where((quality != "ok") | error | (F.size("_parts") > 0))
        .withColumn("categorias", categories)
        .withColumn("categorias", F.when(F.size("categorias") == 0, F.array(F.lit("otras"))).otherwise(F.col("categorias")))
        .withColumnRenamed("_parts", "partes")
    )


def missing_fields() -> Column:
    """Field names mentioned by the 'missing fields' incidents of a row."""
    mentions = F.filter(F.col("partes"), lambda p: F.lower(p).startswith("campos ausentes:"))
    names = F.flatten(F.transform(mentions, lambda p: F.split(F.element_at(F.split(p, ":", 2), 2), ",")))
    return F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")


def incident_summary(df: DataFrame) -> DataFrame:
    """(tipo, clave, n): companies affected, per category, per missing field.

    One pass: each company adds 1 to the total, to each of its categories
    once, and to each missing field it mentions.
    """
    def tagged(kind, array):
        return F.transform(array, lambda v: F.struct(F.lit(kind).alias("tipo"), v.alias("clave")))

    rows = affected(df).select(F.explode(F.concat(
        tagged("empresas", F.array(F.lit("empresas_con_incidencias"))),
        tagged("categoria", F.col("categorias")), tagged("campo", missing_fields()))).alias("r"))
    return rows.select("r.*").groupBy("tipo", "clave").agg(F.count(F.lit(1)).alias("n"))


def incident_report(df: DataFrame) -> DataFrame:
    """The summary with shares of all rows and printable labels, in order.

    The labels and the number of keys are fixed lists, so the ordering is over
    a handful of rows; the row total is a scalar.
    """
    total = df.select(F.count(F.lit(1))).scalar()
    labels = F.create_map(*[F.lit(x) for pair in S.INCIDENT_CATEGORIES.items() for x in pair])
    order = F.array_position(F.array(*[F.lit(c) for c in S.INCIDENT_CATEGORIES]), F.col("clave"))
    return (
        incident_summary(df)
        .withColumn("etiqueta", F.coalesce(F.try_element_at(labels, F.col("clave")), F.col("clave")))
        .withColumn("cuota", F.col("n") / total)
        .withColumn("_kind", F.array_position(F.array(F.lit("empresas"), F.lit("categoria"), F.lit("campo")), F.col("tipo")))
        .withColumn("_order", F.when(F.col("tipo") == "categoria", order).otherwise(-F.col("n")))
        .orderBy("_kind", "_order", "clave").drop("_kind", "_order")
    )
