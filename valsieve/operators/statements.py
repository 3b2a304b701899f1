"""From long statement rows to one normalised row per listing.

Input: (ticker, statement, basis, concept, period_end, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.functions import ratios as R
from valsieve.functions.cleaning import nan_to_null
from valsieve.session import fixed_rows

SERIES = ["ticker", "statement", "basis", "campo"]
BALANCE_FIELDS = ["total_debt", "cash", "equity"]
FIGURES = ["ultimo", "anterior", "primero", "desde", "hasta", "n"]


def concept_rows(spark, concepts) -> DataFrame:
    """(keys..., concept, prioridad, cid) from a fixed dictionary: a few dozen rows."""
    keyed = [(*((k,) if isinstance(k, str) else k), name, i)
             for k, names in concepts.items() for i, name in enumerate(names)]
    numbered = [(*row, cid) for cid, row in enumerate(keyed)]
    keys = "statement string, campo string" if len(keyed[0]) == 4 else "campo string"
    return fixed_rows(spark, numbered, f"{keys}, concept string, prioridad int, cid int")


def known_concepts(statements: DataFrame) -> DataFrame:
    return concept_rows(statements.sparkSession, S.STATEMENT_CONCEPTS)


def item_summaries(statements: DataFrame, how: str = "inner") -> DataFrame:
    """Newest, previous and oldest value of every line item of a series.

    One scan, one shuffle by ticker and one sort: all that follows by ticker
    finds its rows in place.  The periods of a listing's line item are bounded by
    its years on file.  ``n`` counts known values; ``fecha`` is the newest period
    even where values are missing.  With ``how="left"`` items that are no field
    stay as well, for their dates.
    """
    value, period = F.col("value"), F.col("period_end")
    rows = (
        statements.withColumn("value", nan_to_null("value"))
        .join(F.broadcast(known_concepts(statements)), ["statement", "concept"], how)
        .select("ticker", "statement", "basis", "cid", "campo", "prioridad", "period_end", "value")
        .repartition("ticker")
    )
    newest = Window.partitionBy("ticker", "statement", "basis", "cid").orderBy(value.isNull(), period.desc(), value.desc())
    whole = newest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = F.when(value.isNotNull(), period)
    return (
        rows.select(
            "*", F.row_number().over(newest).alias("_k"), F.lead("value").over(newest).alias("anterior"),
            F.min_by("value", told).over(whole).alias("primero"), F.min(told).over(whole).alias("desde"),
            F.count("value").over(whole).alias("n"), F.max("period_end").over(whole).alias("fecha"))
        .where(F.col("_k") == 1)
        .withColumns({"ultimo": F.when(period.isNotNull(), value), "hasta": told})
        .select("ticker", "statement", "basis", "campo", "prioridad", *FIGURES, "fecha")
    )


def best_items(items: DataFrame) -> DataFrame:
    """Per series the best line item with any value; series without one keep their newest date.

    The line item is chosen for the whole series, by its priority.
    """
    best = F.when(F.col("n") > 0, F.col("prioridad"))
    return items.groupBy(*SERIES).agg(*[F.min_by(c, best).alias(c) for c in FIGURES], F.max("fecha").alias("fecha"))


def series_values(statements: DataFrame) -> DataFrame:
    """Per (ticker, statement, basis, field): newest, previous, oldest value."""
    return best_items(item_summaries(statements)).where("n > 0").drop("fecha")


def history_extremes(series: DataFrame) -> DataFrame:
    """Oldest and newest annual revenue with the real years between them."""
    years = F.datediff("hasta", "desde") / 365.25
    usable = (F.col("n") >= 2) & (years > 0)
    return series.where(
        (F.col("statement") == "resultados") & (F.col("basis") == "ANUAL") & (F.col("campo") == "ingresos")
    ).select(
        "ticker", F.when(usable, F.col("primero")).alias("ingresos_inicio_historico"),
        F.when(usable, F.col("ultimo")).alias("ingresos_fin_historico"), F.when(usable, years).alias("anios_historico"))


def period_basis(statements: DataFrame) -> DataFrame:
    """TTM only where both income and cash flow have it, else annual for both."""
    def has(statement):
        return F.count_if((F.col("statement") == statement) & (F.col("basis") == "TTM")) > 0

    return statements.groupBy("ticker").agg(
        F.when(has("resultados") & has("flujo_caja"), "TTM").otherwise("ANUAL").alias("tipo_periodo"))


def latest_statement_dates(statements: DataFrame) -> DataFrame:
    """Newest period end per statement and basis, even where values are missing."""
    return statements.groupBy("ticker", "statement", "basis").agg(F.max("period_end").alias("fecha"))


def normalize(statements: DataFrame) -> DataFrame:
    """One wide row per listing, never mixing TTM and annual figures.

    Listings without any usable value stay, with missing figures.  The pivot is
    a fixed list of fields over already reduced series, for both bases; which of
    them holds is known once all rows of a listing are seen.
    """
    series = best_items(item_summaries(statements, "left"))

    def at(statement, basis=None):
        match = F.col("statement") == statement
        return match if basis is None else match & (F.col("basis") == basis)

    def value(field, condition=F.lit(True), column="ultimo"):
        return F.max(F.when((F.col("campo") == field) & condition, F.col(column)))

    def dated(statement, basis=None):
        return F.max(F.when(at(statement, basis), F.col("fecha")))

    flow = ["ingresos", "ebit", "net_income", "gasto_intereses", "ebitda", "free_cash_flow"]
    years = F.datediff("hasta", "desde") / 365.25
    usable = (F.col("campo") == "ingresos") & (F.col("basis") == "ANUAL") & (F.col("n") >= 2) & (years > 0)
    both = [(f, b) for f in [*flow, "tax_provision", "pretax_income"] for b in ("TTM", "ANUAL")]
    wide = series.groupBy("ticker").agg(
        *[value(f, F.col("basis") == b).alias(f"{f}_{b.lower()}") for f, b in both],
        *[value(f).alias(f) for f in BALANCE_FIELDS],
        *[value(f, column="anterior").alias(f"{f}_inicio") for f in BALANCE_FIELDS],
        F.max(F.when(usable, F.col("primero"))).alias("ingresos_inicio_historico"),
        F.max(F.when(usable, F.col("ultimo"))).alias("ingresos_fin_historico"),
        F.max(F.when(usable, years)).alias("anios_historico"),
        F.count_if(at("resultados", "TTM")).alias("_n_income"), F.count_if(at("flujo_caja", "TTM")).alias("_n_cash"),
        dated("resultados", "TTM").alias("_income_ttm"), dated("flujo_caja", "TTM").alias("_cash_ttm"),
        dated("resultados", "ANUAL").alias("fecha_resultados_anual"),
        dated("flujo_caja", "ANUAL").alias("fecha_flujo_caja_anual"), dated("balance").alias("fecha_balance"))
    ttm = (F.col("_n_income") > 0) & (F.col("_n_cash") > 0)

    def chosen(trailing, annual):
        return F.when(ttm, F.col(trailing)).otherwise(F.col(annual))

    annual_map = F.map_from_arrays(
        F.array(*[F.lit(f) for f in S.COMPARED_FIELDS]),
        F.array(*[F.col(f) if f in BALANCE_FIELDS else F.col(f"{f}_anual") for f in S.COMPARED_FIELDS]))
    return wide.withColumns({
        "tipo_periodo": F.when(ttm, "TTM").otherwise("ANUAL"),
        **{f: chosen(f"{f}_ttm", f"{f}_anual") for f in flow},
        "fecha_resultados": chosen("_income_ttm", "fecha_resultados_anual"),
        "fecha_flujo_caja": chosen("_cash_ttm", "fecha_flujo_caja_anual"),
        "tasa_impositiva": R.effective_tax_rate(
            chosen("tax_provision_ttm", "tax_provision_anual"), chosen("pretax_income_ttm", "pretax_income_anual")),
        "comparables_anuales": annual_map,
    }).select(
        "ticker", "tipo_periodo", *flow, *BALANCE_FIELDS, *[f"{f}_inicio" for f in BALANCE_FIELDS],
        "ingresos_inicio_historico", "ingresos_fin_historico", "anios_historico", "tasa_impositiva",
        "fecha_resultados", "fecha_flujo_caja", "fecha_balance",
        "fecha_resultados_anual", "fecha_flujo_caja_anual", "comparables_anuales")
