"""Currency conversion with the newest usable rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valsieve.functions.cleaning import nan_to_null
from valsieve.functions.ratios import convert_to_eur
from valsieve.session import sized

WINDOW_DAYS = 5


def latest_rates(rates: DataFrame, as_of: str, days: int = WINDOW_DAYS) -> DataFrame:
    """Last close per currency within ``days`` days up to ``as_of``."""
    day = F.lit(as_of).cast("date")
    return (
        rates.where((F.col("fecha") > F.date_sub(day, days)) & (F.col("fecha") <= day))
        .where(nan_to_null("close").isNotNull())
        .groupBy("divisa")
        .agg(F.max_by("close", "fecha").alias("tasa"), F.max("fecha").alias("fecha"))
    )


def to_eur(df: DataFrame, rates: DataFrame, currency: str, amount: str, out: str) -> DataFrame:
    """EUR is 1; a currency without a recent rate yields NULL.

    There is one rate row per currency; the rates are written first, so Spark
    knows that and does not shuffle the amounts by currency.
    """
    known = sized(rates.select(F.col("divisa").alias("_fx"), F.col("tasa").alias("_rate")), "rates")
    rate = F.when(F.upper(F.col(currency)) == "EUR", F.lit(1.0)).otherwise(F.col("_rate"))
    return (
        df.join(known, F.upper(F.col(currency)) == F.col("_fx"), "left")
        .withColumn(out, convert_to_eur(amount, rate)).drop("_fx", "_rate")
    )


def rates_by_day(asked: DataFrame, rates: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Newest rate within ``days`` days up to each asked day: divisa, dia, tasa, fecha.

    ``asked`` has one row per (divisa, dia).  Days and rates of a currency meet
    in calendar months, so no currency is a task of its own; a rate that may still
    be used in the next month is put into both.
    """
    usable = rates.where(nan_to_null("close").isNotNull() & F.col("fecha").isNotNull())
    months = F.array_distinct(F.array(F.trunc("fecha", "month"), F.trunc(F.date_add("fecha", days - 1), "month")))
    offers = usable.select("divisa", F.explode(months).alias("_month"), F.col("fecha").alias("dia"), F.struct("fecha", F.col("close").alias("tasa")).alias("_rate"))
    wanted = asked.select("divisa", F.trunc("dia", "month").alias("_month"), "dia", F.lit(None).cast(offers.schema["_rate"].dataType).alias("_rate"))
    upto = Window.partitionBy("divisa", "_month").orderBy("dia", F.col("_rate").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = wanted.unionByName(offers).withColumn("_last", F.last("_rate", ignorenulls=True).over(upto))
    fresh = F.col("_last.fecha") > F.date_sub("dia", days)
    return both.where(F.col("_rate").isNull()).select(
        "divisa", "dia", F.when(fresh, F.col("_last.tasa")).alias("tasa"), F.when(fresh, F.col("_last.fecha")).alias("fecha"))


def to_eur_at(df: DataFrame, rates: DataFrame, currency: str, day: str, amount: str, out: str, days: int = WINDOW_DAYS) -> DataFrame:
    """Convert each row at the newest rate within ``days`` days before its own day.

    Adds ``out`` and ``out_fecha``, the day of the rate; EUR is 1 and has none.
    However many rows ask, the lookup works on the distinct (currency, day) pairs,
    counted map-side; its result is written, so Spark knows whether it can broadcast it.
    """
    keyed = df.withColumns({"_fx": F.upper(F.col(currency)), "_fx_day": F.to_date(day)})
    asked = keyed.where((F.col("_fx") != "EUR") & F.col("_fx_day").isNotNull()).select(F.col("_fx").alias("divisa"), F.col("_fx_day").alias("dia")).distinct()
    found = sized(rates_by_day(asked, rates, days).where("tasa is not null"), "rates-by-day").select(
        F.col("divisa").alias("_fx"), F.col("dia").alias("_fx_day"), F.col("tasa").alias("_rate"), F.col("fecha").alias("_rate_day"))
    rate = F.when(F.col("_fx") == "EUR", F.lit(1.0)).otherwise(F.col("_rate"))
    return keyed.join(found, ["_fx", "_fx_day"], "left").select(
        *df.columns, convert_to_eur(amount, rate).alias(out), F.col("_rate_day").alias(f"{out}_fecha"))
