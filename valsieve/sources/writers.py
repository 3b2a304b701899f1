"""Append-only writers.

Tables are Parquet folders without a transactional format, so every write goes
to new files, a key that is already on file is refused or skipped, and the
control row is written last: a snapshot without a control row was interrupted.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valsieve import schemas
from valsieve import settings as S
from valsieve.errors import DiscoveryError, IntegrityError, UniverseError, VerificationError
from valsieve.functions.dates import iso_week, snapshot_id
from valsieve.operators import integrity, verification
from valsieve.operators.journal import audit_columns, next_revision, of_snapshots, require_columns
from valsieve.operators.output import json_rows
from valsieve.sources import readers


def conform(df: DataFrame, schema) -> DataFrame:
    """Columns in declared order and type; a missing one is an error."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise IntegrityError("missing columns: " + ", ".join(missing))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def append_journal(evaluated: DataFrame, path: str, moment: str, snapshot: str | None = None) -> DataFrame:
    """Append the rows of one snapshot under (week, snapshot) folders.

    The id follows from the instant, and the checks only read the folder of that
    snapshot, so ``evaluated`` is computed once.  No rows leave no folder.
    """
    spark = evaluated.sparkSession
    if snapshot is None:
        snapshot = spark.range(1).select(snapshot_id(F.lit(moment).cast("timestamp"))).first()[0]

    def recorded() -> bool:
        on_file = readers.read_journal(spark, path).where(F.col("snapshot_id") == snapshot)
        return on_file.select("snapshot_id").first() is not None

    if recorded():
        raise IntegrityError(f"snapshot {snapshot} is already in {path}")
    rows = conform(audit_columns(evaluated, moment, snapshot), schemas.JOURNAL)
    rows.write.mode("append").partitionBy("semana_iso", "snapshot_id").parquet(path)
    if not recorded():
        raise IntegrityError("there are no rows to record")
    return rows


def append_control(control: DataFrame, path: str, moment: str, snapshot_id: str, origin: str = "local",
                   official: bool = False, revision: int | None = None, **identity: str) -> DataFrame:
    """Append one run row; the revision follows the highest of its ISO week."""
    spark = control.sparkSession
    existing = readers.read_runs(spark, path)
    ts = F.lit(moment).cast("timestamp")
    row = control.select(
        F.lit(snapshot_id).alias("snapshot_id"), ts.alias("fecha_ejecucion"), iso_week(ts).alias("semana_iso"),
        F.lit(origin).alias("origen"), F.lit(official).alias("oficial"), *control.columns,
        *[F.lit(identity.get(c, "")).alias(c) for c in S.CONTROL_RUN_COLUMNS + S.CONTROL_UNIVERSE_COLUMNS])
    if revision is None:
        row = row.join(next_revision(existing, row), "semana_iso")
    else:
        row = row.withColumn("revision", F.lit(revision))
    row = conform(row, schemas.CONTROL)
    problem = integrity.control_violations(row, existing).first()
    if problem is not None:
        raise IntegrityError(f"{problem['problema']}: {snapshot_id}")
    row.coalesce(1).write.mode("append").parquet(path)
    return readers.read_runs(spark, path).where(F.col("snapshot_id") == snapshot_id)


def append_tracking(performance: DataFrame, path: str, moment: str) -> DataFrame:
    rows = performance.withColumn("fecha_calculo", F.lit(moment).cast("timestamp"))
    if "error_descarga" not in rows.columns:
        rows = rows.withColumn("error_descarga", F.lit(""))
    rows = conform(rows, schemas.TRACKING)
    rows.write.mode("append").parquet(path)
    return rows


def append_verification(new: DataFrame, path: str) -> DataFrame:
    """Append only unseen keys, so repeating a run changes nothing.

    The table has a folder per snapshot; only those of ``new`` are read.
    """
    if new.columns != S.VERIFICATION_COLUMNS:
        raise VerificationError("not the verification layout")
    existing = of_snapshots(readers.read_verification(new.sparkSession, path), new)
    rows = conform(verification.pending(new, existing), schemas.VERIFICATION)
    rows.write.mode("append").partitionBy("snapshot_id").parquet(path)
    return readers.read_verification(new.sparkSession, path)


def verification_table(spark, path: str, buckets: int = S.VERIFICATION_BUCKETS) -> str:
    """Declare the bucketed verification table stored at ``path`` and return its name.

    Its rows lie in ``buckets`` buckets of the verification keys; a table that is on file
    must be declared with the number it was made with.
    """
    name = "verification_" + hashlib.sha256(path.encode()).hexdigest()[:16]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.VERIFICATION.fields)
    keys = ", ".join(S.VERIFICATION_KEYS)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def append_verification_bucketed(new: DataFrame, path: str, buckets: int = S.VERIFICATION_BUCKETS) -> DataFrame:
    """``append_verification`` for a table bucketed by its keys.

    The new rows are shuffled to the buckets and meet the stored keys there: what is
    on file, however much, is read bucket by bucket and never shuffled.
    """
    if new.columns != S.VERIFICATION_COLUMNS:
        raise VerificationError("not the verification layout")
    spark = new.sparkSession
    name = verification_table(spark, path, buckets)
    rows = conform(verification.pending(new, spark.table(name)), schemas.VERIFICATION)
    rows.repartition(buckets, *S.VERIFICATION_KEYS).write.insertInto(name)
    return spark.table(name)


def write_screen_csv(ranked: DataFrame, path: str) -> None:
    """Every company with metrics, verdict and reasons."""
    columns = [c for c in schemas.EVALUATED_COLUMNS if c in ranked.columns]
    ranked.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_universe_members(members: DataFrame, version: DataFrame, folder: str, registry: str) -> DataFrame:
    """A new immutable member file, then its registry row.

    ``members`` is bounded by its profile; the file keeps the canonical order.
    """
    require_columns(members, S.UNIVERSE_COLUMNS)
    readers.canonical_members(members)
    row = version.first()
    spark = members.sparkSession
    known = spark.read.schema(schemas.VERSIONS).parquet(registry) if registry_exists(spark, registry) else None
    if known is not None and known.where(F.col("universe_id") == row["universe_id"]).first() is not None:
        raise UniverseError(f"already registered: {row['universe_id']}")
    members.coalesce(1).write.mode("errorifexists").option("header", True).csv(f"{folder}/{row['path']}")
    version.coalesce(1).write.mode("append").parquet(registry)
    return spark.read.schema(schemas.VERSIONS).parquet(registry)


def registry_exists(spark, path: str) -> bool:
    try:
        spark.read.schema(schemas.VERSIONS).parquet(path)
        return True
    except Exception as error:
        if getattr(error, "getCondition", lambda: "")() == "PATH_NOT_FOUND":
            return False
        raise


def write_ticker_list(members: DataFrame, path: str, *order: str) -> None:
    """One ticker per line; part files in name order hold the list in order."""
    members.orderBy(*(order or ("ticker",))).select("ticker").write.mode("overwrite").text(path)


def write_discovery(catalog: DataFrame, control: DataFrame, folder: str, discovery_id: str) -> None:
    """Catalog and control, only when enough buckets were read."""
    row = control.first()
    if row["tasa_exito_buckets"] < row["umbral_exito_buckets"]:
        raise DiscoveryError(f"bucket coverage {row['tasa_exito_buckets']:.1%} is below the minimum")
    if not row["tickers_unicos"]:
        raise DiscoveryError("no ticker was found")
    ordered = catalog.orderBy("region_ord", "sector_ord", "rank_bucket").select(*S.DISCOVERY_COLUMNS)
    ordered.coalesce(1).write.mode("errorifexists").option("header", True).csv(f"{folder}/{discovery_id}.csv")
    json_rows(control).coalesce(1).write.mode("errorifexists").text(f"{folder}/{discovery_id}.json")


def write_history(sections: DataFrame, path: str) -> None:
    """One JSON-lines folder per section."""
    sections.write.mode("overwrite").partitionBy("seccion").text(path)
