"""Collapse several listings of one company; ticker lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.functions.cleaning import nan_to_null, ticker_key
from valsieve.functions.text import company_key


def with_company_key(df: DataFrame) -> DataFrame:
    return df.withColumn("clave", company_key("nombre"))


def listing_order() -> list[Column]:
    """Largest EUR cap first (missing counts as 0), then the shortest ticker."""
    return [
        F.coalesce(nan_to_null("market_cap_eur"), F.lit(0.0)).desc(),
        F.length("ticker").asc(), F.col("ticker").asc(),
    ]


def dedup_listings(df: DataFrame) -> DataFrame:
    """One row per (company key, country); nameless rows are never grouped.

    ``row_number = 1`` lets Spark keep one row per key and map task before the
    shuffle, so a company with very many listings does not fill one task.  A
    nameless row uses its own ticker as the key.
    """
    keyed = with_company_key(df).withColumn(
        "_alone", F.when(F.col("clave") == "", F.col("ticker")))
    order = Window.partitionBy("clave", "pais", "_alone").orderBy(*listing_order())
    return (
        keyed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1)
        .drop("clave", "_alone", "_n")
    )


def union_parts(df: DataFrame) -> DataFrame:
    """The same result written as a union of named and nameless rows."""
    keyed = with_company_key(df)
    order = Window.partitionBy("clave", "pais").orderBy(*listing_order())
    named = (
        keyed.where(F.col("clave") != "")
        .withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")
    )
    return named.unionByName(keyed.where(F.col("clave") == "")).drop("clave")


def normalize_tickers(df: DataFrame, ticker: str = "ticker", order: str = "orden") -> DataFrame:
    """Trim and upper-case, drop blanks, keep the first occurrence.

    ``valido`` is false for a ticker over 32 characters or with blanks inside.
    """
    first = Window.partitionBy("ticker").orderBy(order)
    return (
        df.select(ticker_key(ticker).alias("ticker"), F.col(order).alias(order))
        .where(F.coalesce(F.col("ticker"), F.lit("")) != "")
        .withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")
        .withColumn(
            "valido",
            (F.length("ticker") <= S.MAX_TICKER_LENGTH) & ~F.col("ticker").rlike(r"\s"),
        )
    )


def ticker_violations(df: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Rows that break the strict rule: blank, wrong alphabet or repeated."""
    counted = (
        df.select(F.coalesce(ticker_key(ticker), F.lit("")).alias("ticker"))
        .groupBy("ticker").agg(F.count(F.lit(1)).alias("apariciones"))
    )
    problem = (
        F.when(F.col("ticker") == "", "vacio")
        .when(~F.col("ticker").rlike(S.TICKER_PATTERN), "formato")
        .when(F.col("apariciones") > 1, "duplicado")
    )
    return counted.withColumn("problema", problem).where(F.col("problema").isNotNull())


def union_candidate_lists(current: DataFrame, extra: DataFrame) -> DataFrame:
    """``current`` followed by the tickers of ``extra`` it does not have."""
    new = extra.select("ticker").distinct().join(current.select("ticker"), "ticker", "left_anti")
    return (
        current.select("ticker", F.lit("actual").alias("origen"))
        .unionByName(new.select("ticker", F.lit("nuevo").alias("origen")))
    )
