"""Longitudinal tracking of the signals on file."""

from __future__ import annotations

from pyspark.sql import DataFrame

from valsieve.operators import journal as J
from valsieve.operators import signals as G
from valsieve.sources import writers


def track(journal: DataFrame, runs: DataFrame, prices: DataFrame, moment: str | None = None,
          path: str | None = None, week: str = "semana_iso") -> DataFrame:
    """Effective journal, episodes, performance; appended when a path is given."""
    found = G.signals(J.effective_journal(journal, runs, week))
    performance = G.signal_performance(found, prices)
    if path is not None:
        return writers.append_tracking(performance, path, moment)
    return performance
