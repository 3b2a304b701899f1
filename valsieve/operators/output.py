"""Publishable forms: JSON rows, API payload, text briefs, chart symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valsieve import settings as S
from valsieve.functions.cleaning import json_number
from valsieve.functions.text import number_text, percent_text, venue_symbol
from valsieve.operators.ordering import positions


def json_struct(df: DataFrame) -> Column:
    """All columns as one struct with NaN and infinities as null."""
    fields = []
    for field in df.schema.fields:
        numeric = isinstance(field.dataType, (T.DoubleType, T.FloatType))
        fields.append((json_number(field.name) if numeric else F.col(field.name)).alias(field.name))
    return F.struct(*fields)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(json_struct(df), {"ignoreNullFields": "false"}).alias("json"))


def export_sections(**sections: DataFrame) -> DataFrame:
    """(section, json) rows; each section stays distributed."""
    parts = [json_rows(df).select(F.lit(name).alias("seccion"), "json") for name, df in sections.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def chart_candidates(evaluated: DataFrame) -> DataFrame:
    """Distinct passers with their venue symbol, by score then ticker."""
    best = (
        evaluated.where(F.coalesce(F.col("pasa"), F.lit(False)))
        .groupBy("ticker").agg(F.min("puntuacion").alias("puntuacion"))
    )
    return best.withColumn("simbolo", venue_symbol("ticker")).orderBy(
        F.asc_nulls_last("puntuacion"), "ticker")


LABELS = {
    # Labels of the brief in both languages.
    "es": {
        "missing": "N/D", "per": "PER", "reliable": "fiable", "yes": "sí", "no": "no",
        "debt": "Deuda neta/EBITDA", "cover": "Cobertura intereses", "growth": "CAGR ingresos",
        "cash": "Caja neta % cap.", "cap": "Capitalización", "score": "Puntuación ranking",
        "title": "CANDIDATAS",
    },
    "en": {
        "missing": "N/A", "per": "P/E", "reliable": "reliable", "yes": "yes", "no": "no",
        "debt": "Net debt/EBITDA", "cover": "Interest coverage", "growth": "Revenue CAGR",
        "cash": "Net cash / market cap", "cap": "Market capitalization", "score": "Ranking score",
        "title": "CANDIDATES",
    },
}
DISCLAIMER = (
    "Nota: estas cifras sirven para estudiar y aprender. No son un consejo para invertir, "
    "y pasar los filtros no dice nada sobre el valor futuro de una empresa. Las fuentes "
    "pueden tener huecos o errores: compara cada dato con las cuentas que publica la empresa."
)
INSTRUCTIONS = {
    "es": (
        "Describe en lenguaje natural qué destaca de cada empresa usando solo las métricas "
        "de abajo, que ya están calculadas. Señala como nota a revisar un ROIC no fiable o "
        "una caja neta alta.\n"
        "- NO recomiendes comprar, vender o mantener ninguna acción.\n"
        "- NO inventes una tesis de inversión, previsiones ni datos que no estén en la lista.\n"
        "- NO dictamines si es buena o mala inversión.\n\n" + DISCLAIMER + "\n"
    ),
    "en": (
        "Describe what stands out for each company using only the metrics below, which are "
        "already calculated. Flag an unreliable ROIC or unusually high net cash for review.\n"
        "You must not recommend buying, selling or holding, invent theses, forecasts or facts, "
        "or judge whether a company is a good investment.\n\n"
        "For study and learning. Compare each number with the accounts that the company "
        "itself publishes.\n"
    ),
}


def check_language(language: str) -> dict[str, str]:
    if language not in LABELS:
        raise ValueError("language must be 'en' or 'es'")
    return LABELS[language]


def brief_block(number, language: str = "es") -> Column:
    """The text block of one candidate; missing figures show as N/D."""
    w = check_language(language)

    def name(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(w["missing"]))

    reliable = F.when(F.coalesce(F.col("roic_fiable"), F.lit(True)), w["yes"]).otherwise(w["no"])
    line1 = F.concat(number.cast("string"), F.lit(". "), name("ticker"), F.lit(" — "), name("nombre"),
                     F.lit(" ("), name("sector"), F.lit(", "), name("region"), F.lit(")"))
    line2 = F.concat(
        F.lit(f"   {w['per']}: "), number_text("per"), F.lit(" | EV/EBIT: "), number_text("ev_ebit"),
        F.lit(" | FCF yield: "), percent_text("fcf_yield"), F.lit(" | ROIC: "), percent_text("roic"),
        F.lit(f" ({w['reliable']}: "), reliable, F.lit(")"))
    line3 = F.concat(
        F.lit(f"   {w['debt']}: "), number_text("deuda_ebitda"), F.lit(f" | {w['cover']}: "),
        number_text("cobertura_int"), F.lit(f" | {w['growth']}: "), percent_text("cagr_ingresos"))
    line4 = F.concat(
        F.lit(f"   {w['cash']}: "), percent_text("caja_neta_pct_mcap"), F.lit(f" | {w['cap']}: "),
        number_text(F.col("market_cap_eur") / 1e9), F.lit(f" B EUR | {w['score']}: "), number_text("puntuacion"))
    return F.concat_ws("\n", line1, line2, line3, line4)


def candidate_briefs(candidates: DataFrame, keys=(), language: str = "es") -> DataFrame:
    """Numbered blocks by score within ``keys`` (for example the snapshot)."""
    check_language(language)
    scoped = candidates if keys else candidates.withColumn("_all", F.lit(0))
    numbered = positions(scoped, list(keys) or ["_all"], "puntuacion", ["ticker"])
    return numbered.withColumn("bloque", brief_block(F.col("posicion"), language)).drop("_all")


def brief_bundle(candidates: DataFrame, keys=(), language: str = "es") -> DataFrame:
    """The whole text as ordered rows: instructions first, then every block.

    Rows are (keys, posicion, texto); written in that order and separated by a
    blank line they form the text.  Nothing is gathered into one row, so a
    snapshot with very many candidates stays distributed.  No candidate, no
    rows.
    """
    w = check_language(language)
    header = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 0).select(
        *keys, F.lit(0).cast("bigint").alias("posicion"),
        F.concat(F.lit(INSTRUCTIONS[language] + f"\n{w['title']} ("), F.col("_n").cast("string"), F.lit("):")).alias("texto"))
    blocks = candidate_briefs(candidates, keys, language).select(
        *keys, F.col("posicion").cast("bigint").alias("posicion"), F.col("bloque").alias("texto"))
    return header.unionByName(blocks)
