"""The public payload of an analysis, as labelled JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valsieve.operators import output, quality, screen, summaries
from valsieve.plans.analysis import Analysis

SCHEMA_VERSION = "1.0"


def payload(analysis: Analysis, fundamentals: DataFrame, requested: DataFrame | None = None,
            include_discarded: bool = True, language: str = "es") -> DataFrame:
    """(seccion, json) lines: header, summary, incidents, candidates, prompt, discarded.

    Each section stays a distributed set of rows; ``requested`` lists the
    asked tickers, by default those evaluated.
    """
    spark = fundamentals.sparkSession
    control = summaries.run_control(analysis.evaluated, fundamentals, requested=requested)
    header = spark.range(1).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.struct(*[F.lit(v).alias(k) for k, v in analysis.thresholds.items()]).alias("thresholds"))
    tickers = (analysis.evaluated if requested is None else requested).select("ticker")
    sections = {
        "header": header, "requested_tickers": tickers,
        "summary": summaries.api_summary(control, None if requested is None else requested.count()),
        "quality_incidents": quality.incident_summary(analysis.evaluated),
        "candidates": screen.candidates(analysis.ranked).drop("motivos"),
        "prompt": output.brief_bundle(screen.candidates(analysis.ranked), language=language),
    }
    if include_discarded:
        sections["discarded"] = screen.discarded(analysis.ranked).drop("motivos")
    return output.export_sections(**sections)
