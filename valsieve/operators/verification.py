"""Compare candidates with a second source, component by component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.errors import VerificationError
from valsieve.functions.cleaning import INFINITY, blank_to_empty, nan_to_null, safe_date, ticker_key
from valsieve.operators.ordering import ordered_columns
from valsieve.session import fixed_rows


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def side(df: DataFrame, prefix: str) -> DataFrame:
    """One source keyed by the normalised ticker, its fields under ``prefix``."""
    if "ticker" not in df.columns:
        raise VerificationError("a source has no ticker column")
    blank = F.lit("")
    texts = ["proveedor_datos", "tipo_periodo", "error_descarga", "url_fuente",
             *dict.fromkeys(S.COMPARED_FIELDS.values())]
    concepts = column_or(df, "conceptos_fuente", F.lit(None).cast("map<string,string>"))
    return df.select(
        ticker_key("ticker").alias(f"{prefix}ticker"),
        *[blank_to_empty(column_or(df, c, blank)).alias(prefix + c) for c in texts],
        F.upper(blank_to_empty(column_or(df, "divisa_financiera", blank))).alias(prefix + "divisa"),
        *[column_or(df, c, F.lit(None)).cast("double").alias(prefix + c) for c in S.COMPARED_FIELDS],
        concepts.alias(prefix + "conceptos"))


def join_sources(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Every primary company, with the second source where there is one."""
    a, b = side(primary, "p_"), side(secondary, "s_")
    return a.join(b, a["p_ticker"] == b["s_ticker"], "left")


def components(joined: DataFrame) -> DataFrame:
    """One row per company and component: both values, dates and concept."""
    items = F.array(*[
        F.struct(F.lit(name).alias("metrica"), F.col(f"p_{name}").alias("v1"), F.col(f"s_{name}").alias("v2"),
                 F.col(f"p_{date}").alias("d1"), F.coalesce(F.col(f"s_{date}"), F.lit("")).alias("d2"),
                 F.coalesce(F.try_element_at("s_conceptos", F.lit(name)), F.lit("")).alias("concepto"))
        for name, date in S.COMPARED_FIELDS.items()])
    kept = ["p_ticker", "s_ticker", "p_proveedor_datos", "s_proveedor_datos", "p_tipo_periodo", "s_tipo_periodo",
            "p_divisa", "s_divisa", "s_error_descarga", "s_url_fuente"]
    return joined.select(*kept, F.explode(items).alias("c")).select(*kept, "c.*")


def numeric_state() -> tuple[Column, Column, Column]:
    """(state, detail, relative difference); the first matching rule decides."""
    v1, v2 = nan_to_null("v1"), nan_to_null("v2")
    d1, d2 = safe_date("d1"), safe_date("d2")
    gap = F.abs(F.datediff(d1, d2))
    t1, t2 = F.col("p_tipo_periodo"), F.coalesce("s_tipo_periodo", F.lit(""))
    c1, c2 = F.col("p_divisa"), F.coalesce("s_divisa", F.lit(""))
    missing = F.concat(F.col("metrica"), F.lit(" ausente en "), F.concat_ws(
        " y ", F.when(v1.isNull(), "primario"), F.when(v2.isNull(), "secundario")))
    share = F.when(v1 == 0, F.lit(0.0)).otherwise(F.abs(v2 - v1) / F.abs(F.when(v1 != 0, v1)))
    infinite = (F.abs(v1) == INFINITY) | (F.abs(v2) == INFINITY)
    rules = [
        (F.col("s_ticker").isNull(), "sin_cobertura", F.lit("ticker sin cobertura secundaria")),
        (F.col("s_error_descarga") != "", "sin_cobertura", F.col("s_error_descarga")),
        (v1.isNull() | v2.isNull(), "sin_dato", missing),
        ((c1 == "") | (c2 == ""), "no_comparable", F.lit("divisa financiera ausente")),
        (c1 != c2, "no_comparable", F.concat(F.lit("divisas distintas "), c1, F.lit("/"), c2)),
        ((t1 == "") | (t2 == "") | (t1 != t2), "no_comparable", F.concat(
            F.lit("periodos distintos o ausentes "), F.when(t1 == "", "?").otherwise(t1), F.lit("/"),
            F.when(t2 == "", "?").otherwise(t2))),
        (d1.isNull() | d2.isNull(), "no_comparable", F.lit("fecha contable ausente")),
        (gap > S.MAX_STATEMENT_GAP_DAYS, "no_comparable", F.concat(
            F.lit("fechas contables desalineadas ("), gap.cast("string"), F.lit(" días)"))),
        (infinite, "sin_dato", F.lit("valor no finito")),
        ((v1 == 0) & (v2 != 0), "no_comparable", F.lit("el valor primario es cero; diferencia relativa indefinida")),
        (share <= S.VERIFIED_TOLERANCE, "verificado", F.lit("diferencia dentro del 10 %")),
        (share <= S.WARNING_TOLERANCE, "advertencia", F.lit("diferencia entre el 10 % y el 25 %")),
    ]
    state = detail = None
    for condition, name, text in rules:
        state = F.when(condition, name) if state is None else state.when(condition, name)
        detail = F.when(condition, text) if detail is None else detail.when(condition, text)
    state = state.otherwise("discrepancia_material")
    return state, detail.otherwise(F.lit("diferencia superior al 25 %")), share


def concept_notes(spark) -> DataFrame:
    """Approximation notes by concept: a fixed table of a dozen rows."""
    return fixed_rows(spark, list(S.APPROXIMATION_NOTES.items()), "concepto string, nota string")


def direct_concepts(spark) -> DataFrame:
    rows = [(field, name) for field, names in S.DIRECT_CONCEPTS.items() for name in names]
    return fixed_rows(spark, rows, "metrica string, concepto string")


def semantic_override(compared: DataFrame) -> DataFrame:
    """A numeric verdict on a concept that is not equivalent is only indicative."""
    spark = compared.sparkSession
    direct = direct_concepts(spark).withColumn("_direct", F.lit(True))
    joined = (
        compared.join(F.broadcast(direct), ["metrica", "concepto"], "left")
        .join(F.broadcast(concept_notes(spark)), "concepto", "left")
    )
    same_formula = (F.col("metrica") == "free_cash_flow") & F.col("concepto").contains(" - abs(")
    note = F.when((F.col("concepto") == "") | same_formula | F.coalesce("_direct", F.lit(False)), F.lit("")).otherwise(
        F.coalesce("nota", F.concat(F.lit("el concepto "), "concepto", F.lit(" no está declarado como equivalente directo"))))
    override = (note != "") & F.col("estado").isin(S.NUMERIC_STATES)
    detail = F.when(override, F.concat(
        F.lit("comparación orientativa ("), "estado", F.lit("); "), note)).otherwise(F.col("detalle"))
    suffix = F.concat(F.lit("concepto secundario: "), "concepto")
    return joined.withColumns({
        "detalle": F.when(F.col("concepto") == "", detail)
        .otherwise(F.concat_ws("; ", F.when(detail != "", detail), suffix)),
        "estado": F.when(override, S.SEMANTIC_STATE).otherwise(F.col("estado")),
    }).drop("_direct", "nota")


def compare_components(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Numeric state of every component, before the concept check."""
    rows = components(join_sources(primary, secondary))
    state, detail, share = numeric_state()
    return rows.withColumns({"estado": state, "detalle": detail, "_share": share}).withColumn(
        "diferencia_pct", F.when(F.col("estado").isin(S.NUMERIC_STATES), F.col("_share"))).drop("_share")


def verify(primary: DataFrame, secondary: DataFrame, snapshot_id: str, moment: str) -> DataFrame:
    """The verification table: one row per company and component."""
    if not str(snapshot_id or "").startswith(S.SNAPSHOT_PREFIX):
        raise VerificationError("snapshot_id missing or not valid")
    for name, rows in (("primary", side(primary, "t_")), ("secondary", side(secondary, "t_"))):
        if (again := repeated_tickers(rows.select(F.col("t_ticker").alias("ticker"))).first()) is not None:
            raise VerificationError(f"the {name} source gives {again['ticker']} more than once")
    known = semantic_override(compare_components(primary, secondary))

    def provider(column):
        return F.when(F.col(column) == "", "desconocido").otherwise(F.col(column))

    stamp = F.date_format(F.lit(moment).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    empty = F.lit("")
    return known.select(
        F.lit(snapshot_id).alias("snapshot_id"), F.col("p_ticker").alias("ticker"),
        provider("p_proveedor_datos").alias("proveedor_primario"),
        F.when(F.col("s_ticker").isNull(), "sin_cobertura").otherwise(provider("s_proveedor_datos")).alias("proveedor_secundario"),
        F.col("p_tipo_periodo").alias("tipo_periodo_primario"), F.coalesce("s_tipo_periodo", empty).alias("tipo_periodo_secundario"),
        F.col("d1").alias("fecha_periodo_primario"), F.col("d2").alias("fecha_periodo_secundario"),
        F.col("p_divisa").alias("divisa_primaria"), F.coalesce("s_divisa", empty).alias("divisa_secundaria"), "metrica",
        F.col("v1").alias("valor_primario"), F.col("v2").alias("valor_secundario"), "diferencia_pct", "estado", "detalle",
        F.coalesce("s_url_fuente", empty).alias("url_fuente"), stamp.alias("verificado_en_utc"))


def repeated_tickers(df: DataFrame) -> DataFrame:
    """Tickers a source gives more than once; a verification needs none."""
    return df.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def pending(new: DataFrame, existing: DataFrame, order: str = "verificado_en_utc") -> DataFrame:
    """New rows whose key is not on file; of repeated new rows the last stays.

    Rows that agree in ``order`` are told apart by all their columns.  Keys hardly
    repeat, so rows go to their keys first and are sorted there: what a task sorts is a
    shuffle partition, not all components of the companies in one file.
    """
    ties = [F.desc(c) for c in ordered_columns(new) if c not in (*S.VERIFICATION_KEYS, order)]
    last = Window.partitionBy(*S.VERIFICATION_KEYS).orderBy(F.desc(order), *ties)
    dealt = new.repartition(*S.VERIFICATION_KEYS)
    unique = dealt.withColumn("_k", F.row_number().over(last)).where(F.col("_k") == 1).drop("_k")
    return unique.join(existing.select(*S.VERIFICATION_KEYS), S.VERIFICATION_KEYS, "left_anti").select(*new.columns)


def summary(verification: DataFrame) -> DataFrame:
    return verification.groupBy("estado").agg(F.count(F.lit(1)).alias("n"))
