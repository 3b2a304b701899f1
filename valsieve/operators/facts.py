"""From nested filing documents to one annual observation per filer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.functions.cleaning import finite, safe_date, ticker_key
from valsieve.operators.statements import concept_rows

DOCUMENT_SCHEMA = (
    "entityName string, facts map<string, map<string, struct<units: map<string, array<struct<"
    "start: string, end: string, val: double, form: string, fp: string, filed: string>>>>>>"
)
FIGURES = ["ingresos", "net_income", "ebit", "cash_operaciones", "capex", "total_debt", "cash", "equity", "gasto_intereses"]


def parse_documents(documents: DataFrame, column: str = "document") -> DataFrame:
    return documents.withColumn("doc", F.from_json(column, DOCUMENT_SCHEMA)).select("cik", "doc.*")


def explode_facts(filers: DataFrame) -> DataFrame:
    """Flat annual facts: annual forms, full-year or unmarked periods only.

    A duration must span 300 to 430 days; a fact without a start is an instant.
    Documents without facts go with the filter on the taxonomy: a plain ``explode``
    would have Spark parse each document once more, to see whether it has any.
    """
    flat = (
        filers.select("cik", F.explode_outer("facts").alias("taxonomy", "concepts"))
        .where(F.col("taxonomy").isin(S.FACT_TAXONOMIES))
        .select("cik", "taxonomy", F.explode("concepts").alias("concept", "body"))
        .select("cik", "taxonomy", "concept", F.explode("body.units").alias("unidad", "items"))
        .select("cik", "taxonomy", "concept", "unidad", F.inline("items"))
    )
    blank_start = F.coalesce(F.col("start"), F.lit("")) == ""
    days = F.datediff(safe_date("end"), safe_date("start"))
    return flat.where(
        F.col("form").isin(S.ANNUAL_FORMS)
        & (F.coalesce(F.col("fp"), F.lit("")).isin("", "FY"))
        & F.col("val").isNotNull() & (F.coalesce(F.col("end"), F.lit("")) != "")
        & (blank_start | days.between(*S.ANNUAL_DAYS))
    ).withColumn("instante", blank_start)


def field_facts(facts: DataFrame) -> DataFrame:
    """Facts of the wanted concepts, instants only for balance fields."""
    known = concept_rows(facts.sparkSession, S.FACT_CONCEPTS).drop("cid")
    joined = facts.join(F.broadcast(known), "concept")
    return joined.where(F.col("instante") == F.col("campo").isin(S.INSTANT_FIELDS))


def latest_facts(facts: DataFrame) -> DataFrame:
    """Newest fact per filer and field, in the unit of the filer's revenue.

    Newest means by end, then filing date, then priority.  A filer without
    revenue keeps facts of any unit.  Facts are first reduced to one per
    filer, field and unit (partly before the shuffle); the unit is chosen
    among that handful of rows.
    """
    order = F.struct("end", F.coalesce(F.col("filed"), F.lit("")).alias("filed"), (-F.col("prioridad")).alias("p"))
    newest = F.max(F.struct(order.alias("o"), "val", "concept"))
    per_unit = field_facts(facts).groupBy("cik", "campo", "unidad").agg(newest.alias("f"))
    filer = Window.partitionBy("cik")
    revenue = F.when(F.col("campo") == "ingresos", F.struct("f", "unidad"))
    same = F.col("_unit").isNull() | (F.col("unidad") == F.col("_unit"))
    return (
        per_unit.withColumn("_unit", F.max(revenue).over(filer)["unidad"]).where(same)
        .groupBy("cik", "campo").agg(F.max(F.struct("f", "unidad")).alias("b"))
        .select("cik", "campo", "b.f.val", "b.f.o.end", "b.f.o.filed", "b.unidad", "b.f.concept")
    )


def normalize(filers: DataFrame) -> DataFrame:
    """One row per filer, also for filers without a usable fact."""
    latest = latest_facts(explode_facts(filers))

    def pick(field, part):
        return F.max(F.when(F.col("campo") == field, F.col(part)))

    wide = latest.groupBy("cik").agg(
        *[finite(pick(f, "val")).alias(f) for f in FIGURES],
        *[pick(f, "concept").alias(f"_c_{f}") for f in FIGURES],
        pick("ingresos", "unidad").alias("divisa_financiera"),
        pick("ingresos", "end").alias("fecha_resultados"), pick("cash_operaciones", "end").alias("fecha_flujo_caja"),
        F.max(F.when(F.col("campo").isin(S.INSTANT_FIELDS), F.col("end"))).alias("fecha_balance"))
    joined = filers.select("cik", F.coalesce(F.col("entityName"), F.lit("")).alias("nombre")).join(wide, "cik", "left")
    missing = F.array_compact(F.array(*[F.when(F.col(f"_c_{f}").isNull(), f) for f in S.REQUIRED_FACTS]))
    issues = F.when(F.size(missing) > 0, F.concat(
        F.lit("conceptos SEC ausentes: "), F.array_join(missing, ", "))).otherwise("")
    both = F.col("_c_cash_operaciones").isNotNull() & F.col("_c_capex").isNotNull()
    direct = [f for f in FIGURES if f not in ("cash_operaciones", "capex")]
    entries = F.array_compact(F.array(
        *[F.when(F.col(f"_c_{f}").isNotNull(), F.struct(F.lit(f).alias("k"), F.col(f"_c_{f}").alias("v"))) for f in direct],
        F.when(both, F.struct(F.lit("free_cash_flow").alias("k"), F.concat(
            "_c_cash_operaciones", F.lit(" - abs("), "_c_capex", F.lit(")")).alias("v")))))
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in
             ("divisa_financiera", "fecha_resultados", "fecha_flujo_caja", "fecha_balance")]
    return joined.select(
        "cik", "nombre", *blank, *[f for f in direct],
        (F.col("cash_operaciones") - F.abs("capex")).alias("free_cash_flow"),
        F.lit(S.FACTS_PROVIDER).alias("proveedor_datos"), F.lit("ANUAL").alias("tipo_periodo"),
        F.when(issues == "", "ok").otherwise("revisar").alias("calidad_datos"), issues.alias("incidencias_datos"),
        F.format_string(S.FACTS_URL_FORMAT, F.col("cik")).alias("url_fuente"),
        F.map_from_entries(entries).alias("conceptos_fuente"))


def ticker_ids(registry: DataFrame) -> DataFrame:
    """Normalised ticker to filer id; incomplete rows are ignored."""
    return registry.where((F.coalesce(F.col("ticker"), F.lit("")) != "") & F.col("cik").isNotNull()).select(
        ticker_key("ticker").alias("ticker"), F.col("cik").cast("bigint").alias("cik"))


def match_tickers(tickers: DataFrame, ids: DataFrame) -> DataFrame:
    """Literal match only: a ticker with a dot is a local listing, never a filer.

    Unmatched tickers stay, with the reason.
    """
    wanted = tickers.select(ticker_key("ticker").alias("ticker")).distinct()
    known = ids.select(F.col("ticker").alias("_t"), "cik")
    out = wanted.join(known, (wanted["ticker"] == known["_t"]) & ~wanted["ticker"].contains("."), "left")
    return out.select("ticker", "cik", F.when(F.col("cik").isNull(), S.NOT_REGISTERED).otherwise("").alias("error_descarga"))
