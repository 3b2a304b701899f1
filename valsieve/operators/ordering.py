"""Exact order statistics without sorting a whole group in one task.

A value is mapped to a bucket by a monotone function, so bucket totals give
exact ranks: only the bucket that holds a wanted rank, or each bucket by
itself, is ever ordered in one task.  The number of buckets is bounded by the
double range (``BUCKET_LIMIT``), not by the data.  Rows themselves are numbered in
ordered ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valsieve.functions.cleaning import as_col
from valsieve.session import sized, stage_table

BUCKETS_PER_UNIT = 1024
BUCKET_LIMIT = 1_000_000
MISSING_BUCKET = -2 * BUCKET_LIMIT


def value_bucket(value) -> Column:
    """Monotone integer bucket: fine near zero, logarithmic far away."""
    value = as_col(value)
    scaled = F.signum(value) * F.log1p(F.abs(value)) * BUCKETS_PER_UNIT
    bounded = F.greatest(F.least(scaled, F.lit(float(BUCKET_LIMIT))), F.lit(-float(BUCKET_LIMIT)))
    return F.when(value.isNotNull(), F.floor(bounded))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per (keys, value) with the value's bucket; counted map-side first."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", value_bucket(value))
    )


def grouped_median(counts: DataFrame, keys: Sequence[str], value: str,
                   median: str, size: str) -> DataFrame:
    """Exact median and row count per group from ``value_counts`` output.

    ``counts`` may be finer than ``keys``; equal values are then simply met
    more than once.
    """
    keys = list(keys)
    histogram = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("in_bucket"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = F.floor((F.col("total") + 1) / 2)
    high = F.floor((F.col("total") + 2) / 2)
    targets = (
        histogram.withColumn("total", F.sum("in_bucket").over(group))
        .withColumn("upto", F.sum("in_bucket").over(running))
        .withColumn("before", F.col("upto") - F.col("in_bucket"))
        .where((F.col("upto") >= low) & (F.col("before") < high))
        .select(*keys, "bucket", "total", "before")
    )
    inside = (
        Window.partitionBy(*keys, "bucket").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        counts.join(targets, [*keys, "bucket"])
        .withColumn("position", F.col("before") + F.sum("n").over(inside))
        .where((F.col("position") >= low) & (F.col("position") - F.col("n") < high))
        .groupBy(*keys)
        .agg(
            ((F.min(value) + F.max(value)) / 2).alias(median),
            F.max("total").alias(size),
        )
    )


def descending_ranks(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Average descending rank of every distinct value of each column.

    One row per (keys, measure, value): ties share their mean rank, missing
    values come last and share theirs.  All columns are counted in one pass.
    """
    group = [*keys, "measure"]
    measures = F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))
        for c in columns
    ])).alias("m")
    counts = (
        df.select(*keys, measures).select(*keys, "m.measure", "m.value")
        .groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", F.coalesce(value_bucket("value"), F.lit(MISSING_BUCKET)))
    )
    above = (
        Window.partitionBy(*group).orderBy(F.desc("bucket"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = (
        counts.groupBy(*group, "bucket").agg(F.sum("n").alias("in_bucket"))
        .withColumn("before", F.sum("in_bucket").over(above) - F.col("in_bucket"))
        .drop("in_bucket")
    )
    inside = (
        Window.partitionBy(*group, "bucket").orderBy(F.desc_nulls_last("value"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto = F.col("before") + F.sum("n").over(inside)
    return (
        counts.join(offsets, [*group, "bucket"])
        .select(*group, "value", (upto - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
    )


def ordered_columns(df: DataFrame) -> list[str]:
    """The columns that can be ordered and hashed; maps cannot."""
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def whole_row(df: DataFrame) -> Column:
    """All such columns: a tie order that never depends on storage."""
    return F.struct(*ordered_columns(df))


def attach_descending_ranks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the rank column ``columns[c]`` for every value column ``c``.

    The ranks, one row per distinct value, are written once and joined once per
    column; Spark broadcasts them only when they are small.  All missing values
    share one rank, read as a scalar; their rows match nothing and are spread by
    a hash, so they do not meet in one task.
    """
    ranks = sized(descending_ranks(df, list(columns)), "ranks")
    names, out = list(df.columns), df.withColumn("_hash", F.xxhash64(whole_row(df)))
    for column, rank in columns.items():
        own = ranks.where(F.col("measure") == column)
        side = own.where(F.col("value").isNotNull()).select(
            F.col("value").alias("_value"), F.lit(0).cast("bigint").alias("_zero"), F.col("rank").alias("_rank"))
        missing = own.where(F.col("value").isNull()).select(F.max("rank")).scalar()
        out = out.withColumn("_spread", F.when(F.col(column).isNull(), F.col("_hash")).otherwise(F.lit(0)))
        out = out.join(side, (out[column] == side["_value"]) & (out["_spread"] == side["_zero"]), "left")
        names.append(rank)
        out = out.withColumn(rank, F.when(F.col(column).isNull(), missing).otherwise(F.col("_rank"))).select(*names, "_hash")
    return out.drop("_hash")


def positions(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str],
              position: str = "posicion") -> DataFrame:
    """1-based ascending position within ``keys`` by (score, ties), missing last.

    Rows are dealt to ordered ranges of (keys, score, ties) and written with their
    range, so however many rows share a key, a score or a missing score, a range is
    about as large as any other.  The rows before a range follow from the counts of
    ranges, one row per range and key; inside, rows are numbered range by range.
    Only rows that agree in everything named have to meet.
    """
    keys, order = list(keys), [F.asc_nulls_last(score), *tie]
    placed = stage_table(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized(
        placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "range-offsets")
    inside = Window.partitionBy("_range", *keys).orderBy(*order)
    named = offsets.toDF(*[f"_key{i}" for i in range(len(keys))], "_offset_range", "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    numbered = placed.withColumn("_k", F.row_number().over(inside)).join(named, [F.col("_range") == F.col("_offset_range"), *same])
    return numbered.select(*df.columns, (F.col("_before") + F.col("_k")).alias(position))
