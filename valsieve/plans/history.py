"""Publishable history: effective journal, runs, tracking, last candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valsieve.operators import journal as J
from valsieve.operators.output import export_sections


def export_history(journal: DataFrame, runs: DataFrame, tracking: DataFrame, week: str = "semana_iso") -> DataFrame:
    """(seccion, json) lines.  Superseded and unofficial snapshots stay out.

    The candidates are those of the newest execution, which need not be the
    only one of its week.
    """
    official = J.effective_journal(journal, runs, week)
    newest = J.latest_snapshot(official).where(F.col("pasa"))
    return export_sections(
        candidatas_ultima_semana=newest, journal=official, ejecuciones=runs, seguimiento=tracking)
