"""Composite ranking of the listings that pass every rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valsieve.operators.ordering import attach_descending_ranks

RANK_OF = {"roic": "rank_roic", "earnings_yield": "rank_ey"}


def magic_rank(df: DataFrame) -> DataFrame:
    """Mean ROIC rank plus mean earnings-yield rank; lower is better."""
    return (
        attach_descending_ranks(df, RANK_OF)
        .withColumn("puntuacion", F.col("rank_roic") + F.col("rank_ey"))
    )


def rank_candidates(evaluated: DataFrame, ordered: bool = True) -> DataFrame:
    """Rank passers only; rejected rows keep NULL ranks.

    Ranks are built on a narrow copy of the passers and joined back to the
    passers by ticker, which is unique after the listings are collapsed.  The
    rejected rows, nearly all of them, take no part in any shuffle here.
    """
    passers = evaluated.where(F.col("pasa"))
    ranked = magic_rank(passers.select("ticker", *RANK_OF)).select("ticker", *RANK_OF.values(), "puntuacion")
    none = F.lit(None).cast("double")
    rejected = evaluated.where(~F.col("pasa")).withColumns({c: none for c in [*RANK_OF.values(), "puntuacion"]})
    out = passers.join(ranked, "ticker").select(*rejected.columns).unionByName(rejected)
    if ordered:
        out = out.orderBy(F.desc("pasa"), F.asc_nulls_last("puntuacion"), "ticker")
    return out
