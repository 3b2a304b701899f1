"""Text keys, labels and rendered values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.functions.cleaning import as_col, nan_to_null, ticker_key


def company_key(name) -> Column:
    """Upper-cased name without corporate suffixes, blanks collapsed."""
    key = F.upper(F.coalesce(as_col(name), F.lit("")))
    for noise in S.COMPANY_NOISE:
        key = F.replace(key, F.lit(noise), F.lit(" "))
    return F.trim(F.regexp_replace(key, r"\s+", " "))


def incident_category(incident, has_error) -> Column:
    """Category of one incident text; NULL when an error already explains it."""
    low = F.lower(as_col(incident))
    return (
        F.when(low.startswith("campos ausentes:"), "campos_ausentes")
        .when(low.contains("divisa"), "divisas")
        .when(low.contains("obsoleto"), "cuentas_obsoletas")
        .when(low.contains("fecha futura"), "fechas_futuras")
        .when(low.contains("fecha de ") & low.contains("ausente"), "fechas_ausentes")
        .when(low.contains("desalineados"), "periodos_desalineados")
        .when(low.contains("periodo contable no identificado"), "periodo_no_identificado")
        .when(
            low.contains("capitalización no positiva")
            | low.contains("deuda negativa") | low.contains("caja negativa"),
            "valores_invalidos",
        )
        .when(~as_col(has_error), "otras")
    )


def venue_symbol(ticker) -> Column:
    """``VENUE:SYMBOL`` for a known suffix, the ticker itself otherwise.

    A ticker outside the allowed alphabet or longer than 32 characters is NULL.
    """
    key = ticker_key(ticker)
    chain = None
    for suffix, venue in S.VENUE_PREFIXES.items():
        hit = key.endswith(suffix)
        symbol = F.concat(F.lit(venue + ":"), F.substring(key, F.lit(1), F.length(key) - len(suffix)))
        chain = F.when(hit, symbol) if chain is None else chain.when(hit, symbol)
    valid = key.rlike(S.TICKER_PATTERN) & (F.length(key) <= S.MAX_TICKER_LENGTH)
    return F.when(valid, chain.otherwise(key))



def percent_text(value, digits: int = 1, missing: str = "N/D") -> Column:
    shown = F.format_string(f"%.{digits}f%%", nan_to_null(value) * 100)
    return F.when(nan_to_null(value).isNull(), F.lit(missing)).otherwise(shown)


def number_text(value, digits: int = 2, missing: str = "N/D") -> Column:
    shown = F.format_string(f"%.{digits}f", nan_to_null(value))
    return F.when(nan_to_null(value).isNull(), F.lit(missing)).otherwise(shown)
