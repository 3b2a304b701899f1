"""Audit timestamps, ISO weeks and day gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.functions.cleaning import as_col


def snapshot_id(ts) -> Column:
    """``snap_`` plus the UTC instant to the microsecond."""
    return F.date_format(as_col(ts).cast("timestamp"), S.SNAPSHOT_ID_FORMAT)


def iso_week(ts) -> Column:
    """``YYYY-Www`` with the ISO year, which differs from the calendar year."""
    ts = as_col(ts)
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"),
        F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
    )


def day_gap(a, b) -> Column:
    return F.abs(F.datediff(as_col(a), as_col(b)))
