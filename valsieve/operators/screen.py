"""Screening rules: every failed rule is kept, in a fixed order."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.functions.cleaning import blank_to_empty, nan_to_null
from valsieve.operators.metrics import chosen_median, ratios, with_both_medians


class Rule(NamedTuple):
    code: str
    label: str          # used when the value is missing
    column: str
    threshold: str
    passes: str         # "<", ">" or ">="
    text: str           # what the failing value is called
    style: str          # "number" or "percent"


RULES = [
    Rule("per", "PER", "per", "per_max", "<", "PER", "number"),
    Rule("ev_ebit", "EV/EBIT", "ev_ebit", "ev_ebit_max", "<", "EV/EBIT", "number"),
    Rule("fcf_yield", "FCF yield", "fcf_yield", "fcf_yield_min", ">", "FCF yield", "percent"),
    Rule("roic", "ROIC", "roic", "roic_min", ">", "ROIC", "percent"),
    Rule("margen_op", "Margen op.", "margen_op", "margen_op_min", ">", "margen operativo", "percent"),
    Rule("deuda_ebitda", "Deuda/EBITDA", "deuda_ebitda", "deuda_ebitda_max", "<",
         "deuda neta/EBITDA", "number"),
    Rule("cobertura_int", "Cobertura int.", "cobertura_int", "cobertura_intereses_min", ">",
         "cobertura intereses", "number"),
    Rule("cagr_ingresos", "Crec. ingresos", "cagr_ingresos", "crecimiento_ingresos_min", ">=",
         "CAGR ingresos", "percent"),
]
OPPOSITE = {"<": ">=", ">": "<=", ">=": "<"}
CODE_SEPARATOR = ";"
TEXT_SEPARATOR = "; "


def resolve_thresholds(overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Defaults with overrides; unknown names and a peer minimum below 1 fail."""
    unknown = sorted(set(overrides or {}) - set(S.THRESHOLDS))
    if unknown:
        raise ValueError(f"Unknown thresholds: {', '.join(unknown)}")
    resolved = {**S.THRESHOLDS, **(overrides or {})}
    if int(resolved["min_empresas_sector"]) < 1:
        raise ValueError("min_empresas_sector must be at least 1")
    return resolved


def limit_of(thresholds: Mapping[str, Any], name: str) -> Column:
    value = thresholds[name]
    return value if isinstance(value, Column) else F.lit(value)


def holds(value: Column, operator: str, limit: Column) -> Column:
    return {"<": value < limit, ">": value > limit, ">=": value >= limit}[operator]


def optional_text(df: DataFrame, column: str, default: str = "") -> Column:
    return blank_to_empty(column) if column in df.columns else F.lit(default)


def peer_rule_active(thresholds: Mapping[str, Any]) -> Column:
    return F.coalesce(
        limit_of(thresholds, "per_bajo_mediana_sector")
        & (F.col("n_sector") >= limit_of(thresholds, "min_empresas_sector")),
        F.lit(False),
    )


def quality_of(df: DataFrame) -> Column:
    grade = F.lower(optional_text(df, "calidad_datos"))
    return F.when(grade == "", F.lit("ok")).otherwise(grade)


def reason_codes(df: DataFrame, thresholds: Mapping[str, Any] = S.THRESHOLDS) -> Column:
    """Array of failed rule codes; ``<code>:sin_dato`` marks a missing value."""
    per, median = nan_to_null("per"), nan_to_null("per_mediana_sector")
    codes = [
        F.when(optional_text(df, "error_descarga") != "", "descarga"),
        F.when(quality_of(df) != "ok", "calidad"),
        F.when(~F.coalesce(F.col("divisa_consistente"), F.lit(False)), "divisas"),
    ]
    for rule in RULES:
        value, limit = nan_to_null(rule.column), limit_of(thresholds, rule.threshold)
        codes.append(
            F.when(value.isNull(), rule.code + ":sin_dato")
            .when(~holds(value, rule.passes, limit), rule.code)
        )
        if rule.code == "per":
            codes.append(F.when(
                peer_rule_active(thresholds),
                F.when(median.isNull() | per.isNull(), "per_sector:sin_dato")
                .when(~(per < median), "per_sector"),
            ))
    cap = nan_to_null("market_cap_eur")
    codes.append(
        F.when(cap.isNull(), "market_cap_eur:sin_dato")
        .when(~(cap > limit_of(thresholds, "market_cap_eur_min")), "market_cap_eur")
    )
    return F.array_compact(F.array(*codes))


def shown(value: Column, style: str) -> Column:
    if style == "percent":
        return F.format_string("%.1f%%", value * 100)
    return F.format_string("%.1f", value)


def reason_texts(df: DataFrame, thresholds: Mapping[str, Any] = S.THRESHOLDS) -> Column:
    """The same rules rendered as sentences; thresholds are plain values here."""
    per, median = nan_to_null("per"), nan_to_null("per_mediana_sector")
    detail = optional_text(df, "incidencias_datos")
    texts = [
        F.when(optional_text(df, "error_descarga") != "",
               F.concat(F.lit("descarga: "), F.col("error_descarga"))
               if "error_descarga" in df.columns else F.lit("")),
        F.when(quality_of(df) != "ok", F.concat(
            F.lit("calidad de datos "), quality_of(df),
            F.when(detail != "", F.concat(F.lit(": "), detail)).otherwise(""))),
        F.when(~F.coalesce(F.col("divisa_consistente"), F.lit(False)),
               "divisas de cotización y estados financieros incompatibles"),
    ]
    for rule in RULES:
        value, limit = nan_to_null(rule.column), thresholds[rule.threshold]
        limit_text = f"{limit:.0%}" if rule.style == "percent" else str(limit)
        texts.append(
            F.when(value.isNull(), f"{rule.label}: sin dato")
            .when(~holds(value, rule.passes, F.lit(limit)), F.concat(
                F.lit(rule.text + " "), shown(value, rule.style),
                F.lit(f" {OPPOSITE[rule.passes]} {limit_text}")))
        )
        if rule.code == "per":
            texts.append(F.when(
                peer_rule_active(thresholds),
                F.when(median.isNull() | per.isNull(), "PER vs sector: sin dato")
                .when(~(per < median), F.concat(
                    F.lit("PER "), shown(per, "number"),
                    F.lit(" >= mediana sector "), shown(median, "number"))),
            ))
    cap, floor = nan_to_null("market_cap_eur"), thresholds["market_cap_eur_min"]
    texts.append(
        F.when(cap.isNull(), "Capitalización EUR: sin dato")
        .when(~(cap > floor), F.concat(
            F.lit("capitalización "), F.format_string("%.2f", cap / 1e9),
            F.lit(f"B EUR < {floor / 1e9:.1f}B EUR")))
    )
    return F.array_compact(F.array(*texts))


def apply_screen(metrics: DataFrame, thresholds: Mapping[str, Any] = S.THRESHOLDS) -> DataFrame:
    """Add ``pasa``, the reason codes and the joined reason text."""
    thresholds = resolve_thresholds(thresholds)
    return (
        metrics.withColumn("motivos", reason_codes(metrics, thresholds))
        .withColumn("pasa", F.size("motivos") == 0)
        .withColumn("motivos_descarte", F.array_join(reason_texts(metrics, thresholds), TEXT_SEPARATOR))
    )


def screen_scenarios(fundamentals: DataFrame, scenarios: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Metrics and verdict of every row under each named set of overrides, in one pass.

    Both peer medians are found once; every scenario's own peer minimum decides
    which of them a row is held against, as if the scenario were run alone.  The
    number of scenarios is fixed by the caller; the rows are multiplied by it,
    not joined.
    """
    resolved = {name: resolve_thresholds(o) for name, o in scenarios.items()}
    options = F.array(*[
        F.struct(F.lit(name).alias("escenario"), *[
            F.lit(value if isinstance(value, bool) else float(value)).alias(key)
            for key, value in limits.items()
        ])
        for name, limits in resolved.items()
    ])
    limits = {key: F.col(f"_s.{key}") for key in S.THRESHOLDS}
    wide = (
        with_both_medians(ratios(fundamentals)).withColumn("_s", F.explode(options))
        .withColumns(chosen_median(limits["min_empresas_sector"]))
        .select(*S.METRIC_COLUMNS, "_s")
    )
    return (
        wide.withColumn("motivos", reason_codes(wide, limits))
        .withColumn("pasa", F.size("motivos") == 0)
        .withColumn("escenario", F.col("_s.escenario")).drop("_s")
    )


def candidates(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(F.col("pasa"))


def discarded(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(~F.col("pasa"))


def view_filter(evaluated: DataFrame, only_candidates: bool = False, regions=(), sectors=(),
                weeks=()) -> DataFrame:
    """The interactive filters; an empty list means no filter."""
    view = candidates(evaluated) if only_candidates else evaluated
    for column, chosen in (("region", regions), ("sector", sectors), ("semana_iso", weeks)):
        if chosen:
            view = view.where(F.col(column).isin(list(chosen)))
    return view


def warning_lists(evaluated: DataFrame) -> DataFrame:
    """Candidates to look at by hand: doubtful ROIC or mostly net cash."""
    return (
        candidates(evaluated)
        .withColumn("roic_dudoso", ~F.col("roic_fiable"))
        .withColumn("mucha_caja", F.coalesce(
            F.col("caja_neta_pct_mcap") > S.HIGH_NET_CASH, F.lit(False)))
        .where(F.col("roic_dudoso") | F.col("mucha_caja"))
    )
