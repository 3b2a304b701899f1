"""The weekly run: screen, check, record, then verify in the shadow."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.errors import UniverseError
from valsieve.functions.dates import snapshot_id
from valsieve.operators import integrity, summaries, verification
from valsieve.plans.analysis import Analysis, analyze
from valsieve.sources import writers


class WeeklyRun(NamedTuple):
    analysis: Analysis
    control: DataFrame
    snapshot_id: str
    verification: DataFrame | None
    verification_error: str


def run_weekly(fundamentals: DataFrame, journal_path: str, runs_path: str, moment: str,
               universe: Mapping[str, str] | None = None, official: bool = False, active: bool = False,
               origin: str = "local", thresholds: Mapping[str, Any] | None = None,
               secondary: DataFrame | None = None, verification_path: str | None = None,
               run_identity: Mapping[str, str] | None = None,
               requested: DataFrame | None = None) -> WeeklyRun:
    """Nothing is written when the integrity gate rejects the run.

    ``universe`` carries universe_id, universe_sha256 and universe_path; only
    the active universe may back an official run.  ``requested`` lists the tickers
    that were asked for; a run that lost some of them is rejected.  A failing verification is
    reported and never changes the recorded result.
    """
    if official and not active:
        raise UniverseError("an official run needs the active universe")
    analysis = analyze(fundamentals, thresholds)
    control = summaries.observed_control(analysis.evaluated, analysis.counts, fundamentals, requested=requested)
    integrity.require_valid(analysis.evaluated, control)
    spark = fundamentals.sparkSession
    identity = spark.range(1).select(snapshot_id(F.lit(moment).cast("timestamp")).alias("id")).first()["id"]
    writers.append_journal(analysis.ranked, journal_path, moment, identity)
    recorded = writers.append_control(
        control, runs_path, moment, identity, origin, official, **{**(universe or {}), **(run_identity or {})})
    verified, problem = None, ""
    if secondary is not None and verification_path is not None:
        try:
            primary = summaries.candidate_fundamentals(fundamentals, analysis.evaluated)
            if "comparables_anuales" in primary.columns:
                primary = summaries.annual_view(primary)
            verified = writers.append_verification(
                verification.verify(primary, secondary, identity, moment).select(*S.VERIFICATION_COLUMNS), verification_path)
        except Exception as error:  # the shadow check must not fail the run
            problem = f"{type(error).__name__}: {error}"
    return WeeklyRun(analysis, recorded, identity, verified, problem)
