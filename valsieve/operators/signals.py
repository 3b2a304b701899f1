"""Signal episodes and their later return and drawdown.

No look-ahead: an entry price is the first close on or after the day of the
signal.  Long histories are cut into calendar segments, so no task has to hold
everything of one ticker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valsieve import settings as S
from valsieve.functions.cleaning import has_text, nan_to_null, text_bool
from valsieve.operators.ordering import whole_row

FROM_HERE = (Window.currentRow, Window.unboundedFollowing)
AFTER_HERE = (1, Window.unboundedFollowing)


def segment_of(ts: Column | str) -> Column:
    """Calendar month: a bounded number of snapshots or closes per ticker."""
    return F.date_trunc("month", ts)


def signal_episodes(journal: DataFrame) -> DataFrame:
    """First row of every run of passes per ticker.

    Rows with a download error keep the state; an absent ticker too.  Inside a
    (ticker, month) segment the previous verdict is a plain ``lag``.  In a
    second window by ticker, only the first rows of the segments meet, and each
    gets the last verdict of the segment before; entries that are already clear
    keep to their own segment there.
    """
    valid = journal.where(~has_text("error_descarga")).withColumns({
        "_pass": text_bool("pasa", S.TRUE_WORDS_TRACKING), "_seg": segment_of("fecha_ejecucion")})
    inside = Window.partitionBy("ticker", "_seg").orderBy("fecha_ejecucion", "snapshot_id")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = (
        valid.withColumns({"_before": F.lag("_pass").over(inside), "_last": F.last("_pass").over(whole)})
        .where(F.col("_before").isNull() | (F.col("_pass") & ~F.col("_before")))
    )
    own_segment = F.when(F.col("_before").isNotNull(), F.col("_seg"))
    across = Window.partitionBy("ticker", own_segment).orderBy("fecha_ejecucion", "snapshot_id")
    state = F.coalesce(F.col("_before"), F.lag("_last").over(across), F.lit(False))
    return (
        edges.withColumn("_state", state).where(F.col("_pass") & ~F.col("_state"))
        .drop("_pass", "_seg", "_before", "_last", "_state")
    )


def signals(journal: DataFrame) -> DataFrame:
    """The episodes in the published layout, with ``fecha_entrada``."""
    named = signal_episodes(journal).withColumnRenamed("fecha_ejecucion", "fecha_entrada")
    return named.select(*[c for c in S.SIGNAL_COLUMNS if c in named.columns])


def daily_returns(prices: DataFrame) -> DataFrame:
    """Return against the last known close before, inside segments and across their edges.

    Days without a close give no row.
    """
    rows = prices.where(F.col("close").isNotNull()).withColumn("_seg", segment_of("fecha"))
    inside = Window.partitionBy("ticker", "_seg").orderBy("fecha")
    across = Window.partitionBy("ticker").orderBy("_seg")
    closing = rows.groupBy("ticker", "_seg").agg(F.max_by("close", "fecha").alias("_end")).select(
        "ticker", "_seg", F.lag("_end").over(across).alias("_carried"))
    before = F.coalesce(F.lag("close").over(inside), F.col("_carried"))
    return (
        rows.join(closing, ["ticker", "_seg"])
        .withColumn("retorno", F.try_divide(F.col("close"), before) - 1).drop("_seg", "_carried")
    )


def wealth_index(prices: DataFrame) -> DataFrame:
    """Time-weighted index from 1.0 at the first known close: the chained returns without flows."""
    prices = prices.where(F.col("close").isNotNull())
    start = prices.groupBy("ticker").agg(F.min_by("close", "fecha").alias("_start"))
    return prices.join(start, "ticker").withColumn(
        "indice", F.try_divide(F.col("close"), F.col("_start"))).drop("_start")


def known_closes(prices: DataFrame) -> DataFrame:
    """ticker, day and close of the days that have one, with their segment."""
    clean = prices.select("ticker", F.to_date("fecha").alias("fecha"), nan_to_null("close").alias("close"))
    return clean.where(F.col("close").isNotNull()).withColumn("_seg", segment_of("fecha"))


def worst_of_segments(low: str, high: str, worst: str, later) -> tuple[Column, Column]:
    """Lowest close of all later segments, and the worst fall that begins in a segment.

    A segment is summarised by its lowest and highest close and its worst fall.
    Two in a row merge: a fall lies in one of them, or goes from the highest close
    of the first to the lowest of the second.
    """
    ahead = F.min(low).over(later)
    return ahead, F.least(F.col(worst), F.try_divide(ahead, F.col(high)) - 1)


def drawdowns(prices: DataFrame) -> DataFrame:
    """Worst fall below the running maximum, per ticker.

    One scan and one shuffle of the closes by (ticker, month); then only a summary
    of each month is shuffled by ticker.
    """
    inside = Window.partitionBy("ticker", "_seg").orderBy("fecha").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("ticker").orderBy("_seg").rowsBetween(*AFTER_HERE)
    fall = F.try_divide(F.col("close"), F.max("close").over(inside)) - 1
    months = known_closes(prices).withColumn("_fall", fall).groupBy("ticker", "_seg").agg(
        F.min("close").alias("_low"), F.max("close").alias("_high"), F.min("_fall").alias("_worst"))
    _, worst = worst_of_segments("_low", "_high", "_worst", later)
    return months.withColumn("_worst", worst).groupBy("ticker").agg(F.min("_worst").alias("max_drawdown"))


def signal_prices(signal_rows: DataFrame, prices: DataFrame, entry: str = "fecha_entrada") -> DataFrame:
    """Every signal with its entry close and day, and what happens from there on; no price keeps NULLs.

    Adds the worst later drawdown, the number of closes, and the last close and
    day.  Signals and closes of a (ticker, month) meet in one shuffle, where each signal
    takes the next close and the suffix values from there.  Months are then told
    from each other by their leading rows only: those carry a mergeable
    summary, get the values of all later months, and hand them back to the signals of
    their month.  A month without a close behind the entry leaves the signal to
    the first later one.  The prices are scanned once, without a join.
    """
    value = "struct<fecha: date, close: double>"
    closes = known_closes(prices).select(
        "ticker", "_seg", F.col("fecha").alias("_day"), F.struct("fecha", "close").cast(value).alias("_close"), F.lit(1).alias("_kind"))
    day = F.to_date(entry)
    asked = signal_rows.select(
        "ticker", segment_of(day).alias("_seg"), day.alias("_day"), F.lit(None).cast(value).alias("_close"),
        F.lit(0).alias("_kind"), F.struct(*signal_rows.columns).alias("_signal"))
    stream = asked.unionByName(closes.withColumn("_signal", F.lit(None).cast(T.StructType(signal_rows.schema.fields))))
    month = Window.partitionBy("ticker", "_seg")
    by_day = month.orderBy("_day", "_kind")
    onward, whole = by_day.rowsBetween(*FROM_HERE), by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    suffix = stream.withColumn("_fall", F.try_divide(F.min("_close.close").over(onward), F.col("_close.close")) - 1)

    def summary(frame) -> Column:
        return F.struct(
            F.first("_close", ignorenulls=True).over(frame).alias("first"), F.last("_close", ignorenulls=True).over(frame).alias("last"),
            F.count("_close").over(frame).alias("n"), F.min("_close.close").over(frame).alias("low"),
            F.max("_close.close").over(frame).alias("high"), F.min("_fall").over(frame).alias("worst"))

    local = suffix.withColumns({"_here": summary(onward), "_month": summary(whole), "_lead": F.row_number().over(by_day) == 1})
    local = local.where(F.col("_lead") | (F.col("_kind") == 0)).select("ticker", "_seg", "_kind", "_signal", "_here", "_month", "_lead")
    # Only the leading row of each month meets those of the other months.
    later = Window.partitionBy("ticker", F.when(~F.col("_lead"), F.col("_seg"))).orderBy("_seg").rowsBetween(*AFTER_HERE)
    low, worst = worst_of_segments("_month.low", "_month.high", "_month.worst", later)
    merged = local.withColumns({"_low": low, "_worst": worst})
    ahead = F.struct(
        F.first("_month.first", ignorenulls=True).over(later).alias("first"), F.last("_month.last", ignorenulls=True).over(later).alias("last"),
        F.coalesce(F.sum("_month.n").over(later), F.lit(0)).alias("n"), F.col("_low").alias("low"), F.min("_worst").over(later).alias("worst"))
    handed = merged.withColumn("_ahead", F.when(F.col("_lead"), ahead)).withColumn("_ahead", F.first("_ahead", ignorenulls=True).over(month))
    entered = handed.where(F.col("_kind") == 0)
    first, last = F.coalesce("_here.first", "_ahead.first"), F.coalesce("_ahead.last", "_here.last")
    observed = F.col("_here.n") + F.col("_ahead.n")
    crossing = F.try_divide(F.col("_ahead.low"), F.col("_here.high")) - 1
    return entered.select(
        "_signal.*", first["fecha"].alias("fecha"), first["close"].alias("close"),
        F.least("_here.worst", crossing, "_ahead.worst").alias("max_drawdown"),
        F.when(first.isNotNull(), observed).alias("observaciones"),
        last["fecha"].alias("ultima_fecha"), last["close"].alias("precio_actual"))


def signal_performance(signal_rows: DataFrame, prices: DataFrame, entry: str = "fecha_entrada") -> DataFrame:
    """Entry and last price, total return, worst drawdown, days followed.

    Fewer than two closes: all figures missing, the signal is kept.
    """
    joined = signal_prices(signal_rows, prices, entry)
    enough = F.coalesce(F.col("observaciones") >= 2, F.lit(False))
    return joined.select(
        *signal_rows.columns,
        F.when(enough, F.col("close")).alias("precio_entrada"),
        F.when(enough, F.col("precio_actual")).alias("precio_actual"),
        F.when(enough, F.try_divide(F.col("precio_actual"), F.col("close")) - 1).alias("retorno_total"),
        F.when(enough, F.col("max_drawdown")).alias("max_drawdown"),
        F.when(enough, F.datediff("ultima_fecha", "fecha")).alias("dias_en_seguimiento"))


KEY = ["ticker", "fecha_entrada"]


def chartable_history(tracking: DataFrame, minimum: int = 2, order: str = "fecha_calculo") -> DataFrame:
    """Signals with at least ``minimum`` observed returns, one per computation.

    ``order`` names the column that says which of two rows of the same
    computation is the later one; rows that agree in it are told apart by all
    their columns, so the choice never depends on how they are stored.
    """
    if minimum < 2:
        return tracking.limit(0)
    valid = tracking.where(
        F.col("ticker").isNotNull() & F.col("fecha_entrada").isNotNull()
        & F.col("fecha_calculo").isNotNull() & nan_to_null("retorno_total").isNotNull())
    last = Window.partitionBy(*KEY, "fecha_calculo").orderBy(F.desc(order), whole_row(valid).desc())
    unique = valid.withColumn("_k", F.row_number().over(last)).where(F.col("_k") == 1).drop("_k")
    sizes = unique.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return unique.join(sizes.select(*KEY), KEY, "left_semi")


def latest_per_signal(tracking: DataFrame, order: str = "fecha_calculo") -> DataFrame:
    """Newest row of every signal; missing keys form groups of their own."""
    newest = Window.partitionBy(*KEY).orderBy(F.desc("fecha_calculo"), F.desc(order), whole_row(tracking).desc())
    return tracking.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") == 1).drop("_k")


def first_last_return(history: DataFrame) -> DataFrame:
    return history.groupBy(*KEY).agg(
        F.min_by("retorno_total", "fecha_calculo").alias("primer_retorno"),
        F.max_by("retorno_total", "fecha_calculo").alias("ultimo_retorno"),
        F.count(F.lit(1)).alias("observaciones"))
