"""Snapshots, revisions and which of them count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.errors import IntegrityError
from valsieve.functions.cleaning import nan_to_null, text_bool
from valsieve.functions.dates import iso_week, snapshot_id
from valsieve.session import sized


def audit_columns(df: DataFrame, moment, identity=None) -> DataFrame:
    """Prefix the UTC instant and ISO week, suffix the snapshot id."""
    ts = moment if isinstance(moment, Column) else F.lit(moment).cast("timestamp")
    named = snapshot_id(ts) if identity is None else F.lit(identity)
    return df.select(
        ts.alias("fecha_ejecucion"), iso_week(ts).alias("semana_iso"),
        *[c for c in df.columns if c not in ("fecha_ejecucion", "semana_iso", "snapshot_id")],
        named.alias("snapshot_id"))


def next_revision(runs: DataFrame, weeks: DataFrame, week: str = "semana_iso") -> DataFrame:
    """Highest revision on file plus one, or 1, for every asked week."""
    highest = runs.groupBy(week).agg(F.max(nan_to_null(F.col("revision").cast("double"))).alias("_max"))
    return weeks.select(week).distinct().join(highest, week, "left").select(
        week, (F.coalesce(F.col("_max"), F.lit(0)) + 1).cast("int").alias("revision"))


def effective_snapshots(journal: DataFrame, runs: DataFrame, week: str = "semana_iso") -> DataFrame:
    """One official revision per week, plus snapshots older than the control table.

    Among official runs of a week the highest revision wins, then the latest.
    """
    revision = F.coalesce(nan_to_null(F.col("revision").cast("double")), F.lit(0.0))
    best = Window.partitionBy(week).orderBy(revision.desc(), F.desc("fecha_ejecucion"), F.desc("snapshot_id"))
    official = (
        runs.where(text_bool("oficial")).withColumn("_k", F.row_number().over(best))
        .where(F.col("_k") == 1).select("snapshot_id", F.lit("oficial").alias("origen"))
    )
    legacy = (
        journal.select("snapshot_id").where(F.col("snapshot_id").isNotNull()).distinct()
        .join(runs.select("snapshot_id"), "snapshot_id", "left_anti")
        .select("snapshot_id", F.lit("legacy").alias("origen"))
    )
    return official.unionByName(legacy)


def effective_journal(journal: DataFrame, runs: DataFrame, week: str = "semana_iso") -> DataFrame:
    """Journal rows of the effective snapshots.

    The ids, one per run on file, are written first: the journal is then
    filtered by a broadcast instead of being shuffled by snapshot.
    """
    return of_snapshots(journal, effective_snapshots(journal, runs, week))


def of_snapshots(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``stored`` whose snapshot occurs in ``wanted``.

    The ids are written first, so Spark knows their size.  It derives a partition
    filter only from a side that itself filters; the comparison, true for every
    id, is there for that: other snapshots' folders are then not read.
    """
    ids = sized(wanted.select("snapshot_id").where(F.col("snapshot_id").isNotNull()).distinct(), "snapshots")
    return stored.join(ids.where(F.col("snapshot_id") >= ""), "snapshot_id", "left_semi")


def latest_snapshot(journal: DataFrame) -> DataFrame:
    """Rows at the newest execution instant, whatever their week."""
    newest = journal.select(F.max("fecha_ejecucion")).scalar()
    return journal.where(F.col("fecha_ejecucion") == newest)


def journal_view(journal: DataFrame) -> DataFrame:
    return journal.orderBy(F.desc("fecha_ejecucion"), F.asc_nulls_last("puntuacion"), "snapshot_id", "ticker")


def evolve(old: DataFrame, target: list[str], allowed: list[str], trailing: bool = False) -> DataFrame:
    """Bring an old layout to ``target``: allowed new columns arrive blank.

    Nothing is invented, and any other difference is an error.  With
    ``trailing`` the new columns must also stand at the end.
    """
    added = [c for c in target if c not in old.columns]
    kept = [c for c in target if c in old.columns]
    if kept != old.columns or any(c not in allowed for c in added):
        raise IntegrityError(f"incompatible layout: {old.columns} cannot become {target}")
    if trailing and target[:len(kept)] != kept:
        raise IntegrityError("new columns may only be added at the end")
    return old.select(*[F.col(c) if c in kept else F.lit(None).cast("string").alias(c) for c in target])


def evolve_control(old: DataFrame) -> DataFrame:
    """The three older control layouts gain their missing trailing columns."""
    extra = [c for c in S.CONTROL_COLUMNS if c not in S.CONTROL_BASE_COLUMNS]
    return evolve(old, S.CONTROL_COLUMNS, extra, trailing=True)


def require_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    if df.columns != expected:
        raise IntegrityError(f"expected the columns {expected}, found {df.columns}")
    return df
