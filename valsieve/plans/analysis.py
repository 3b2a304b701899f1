"""Analyse fundamentals: metrics, medians, dedup, rules, ranking."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any, NamedTuple

from pyspark.sql import DataFrame

from valsieve.operators import listings, metrics, ranking, screen
from valsieve.operators.summaries import RunCounts
from valsieve.session import stage_table


class Analysis(NamedTuple):
    metrics: DataFrame
    companies: DataFrame
    evaluated: DataFrame
    ranked: DataFrame
    thresholds: dict[str, Any]
    counts: RunCounts | None = None


def analyze(fundamentals: DataFrame, thresholds: Mapping[str, Any] | None = None,
            stage: bool = True) -> Analysis:
    """Medians first, over every listing; only then are listings collapsed.

    With ``stage`` the evaluated table is written once, so the ranks and the
    final join do not compute everything above it again, and the counts of its
    control record are gathered in the same job.
    """
    limits = screen.resolve_thresholds(thresholds)
    table = metrics.compute_metrics(fundamentals, limits)
    companies = listings.dedup_listings(table)
    evaluated, counts = screen.apply_screen(companies, limits), None
    if stage:
        counts = RunCounts()
        counted = counts.of_companies(companies)
        evaluated = stage_table(counts.of_kept(screen.apply_screen(counted, limits)), "evaluated")
    return Analysis(table, companies, evaluated, ranking.rank_candidates(evaluated), limits, counts)
