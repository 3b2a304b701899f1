"""Missing-value handling: NaN and text blanks become SQL NULL at the edge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from valsieve import settings as S

INFINITY = float("inf")


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def finite(c) -> Column:
    """The value, or NULL when it is missing, NaN or infinite."""
    c = as_col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INFINITY)), c)


def safe_div(a, b) -> Column:
    """``a / b``, NULL when a side is missing or not finite, or ``b`` is 0."""
    return F.try_divide(finite(a), finite(b))


def blank_to_empty(c) -> Column:
    """Trimmed text, ``''`` when missing."""
    return F.coalesce(F.trim(as_col(c).cast("string")), F.lit(""))


def has_text(c) -> Column:
    return blank_to_empty(c) != ""


def text_bool(c, words: Sequence[str] = tuple(S.TRUE_WORDS)) -> Column:
    """Boolean from native or serialised booleans; missing is false."""
    return F.coalesce(
        F.lower(F.trim(as_col(c).cast("string"))).isin(list(words)), F.lit(False)
    )


def safe_double(c) -> Column:
    return nan_to_null(as_col(c).cast("string").try_cast("double"))


def safe_int(c) -> Column:
    return as_col(c).cast("string").try_cast("int")


def safe_date(c) -> Column:
    """Date from text or timestamp; unparsable is NULL."""
    return as_col(c).cast("string").try_cast("date")


def ticker_key(c) -> Column:
    return F.upper(F.trim(as_col(c)))


def json_number(c) -> Column:
    """NaN and infinities are not JSON: emit null."""
    return finite(c)
