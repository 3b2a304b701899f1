"""Typed readers.  A table that does not exist yet is an empty table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valsieve import schemas
from valsieve import settings as S
from valsieve.errors import IntegrityError, SelectionError, UniverseError
from valsieve.functions.cleaning import safe_date, safe_double, safe_int, text_bool
from valsieve.functions.dates import snapshot_id
from valsieve.operators import discovery
from valsieve.operators.journal import require_columns
from valsieve.operators.listings import ticker_violations


def is_missing(error: AnalysisException) -> bool:
    return error.getCondition() in {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def typed(column: str, kind: T.DataType, words=tuple(S.TRUE_WORDS)) -> Column:
    """One text column parsed to its declared type; unparsable is NULL."""
    if isinstance(kind, T.DoubleType):
        return safe_double(column)
    if isinstance(kind, T.IntegerType):
        return F.coalesce(safe_int(column), safe_double(column).cast("int"))
    if isinstance(kind, T.BooleanType):
        return text_bool(column, words)
    if isinstance(kind, T.TimestampType):
        return F.col(column).try_cast("timestamp")
    if isinstance(kind, T.DateType):
        return safe_date(column)
    return F.col(column)


def read_text_table(spark: SparkSession, path: str, schema: T.StructType, words=tuple(S.TRUE_WORDS),
                    multiline: bool = False) -> DataFrame:
    """A CSV with header as declared types; older layouts lack columns.

    With ``multiline`` quoted cells may hold line breaks; each file is then read
    by one task, otherwise Spark splits it.
    """
    try:
        raw = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').csv(path)
    except AnalysisException as error:
        if is_missing(error):
            return spark.createDataFrame([], schema)
        raise
    known = {f.name: f.dataType for f in schema.fields}
    return raw.select(*[
        (typed(c, known[c], words) if c in known else F.col(c)).alias(c) for c in raw.columns])


def header_cells(line: Column, separator: str) -> Column:
    """The cells of one CSV line, quotes taken off."""
    mark = re.escape(separator)
    raw = F.regexp_extract_all(F.concat(line, F.lit(separator)), F.lit(f'("(?:[^"]|"")*"|[^{mark}]*){mark}'), F.lit(1))
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    cells = F.transform(raw, lambda c: F.when(c.startswith('"'), inner(c)).otherwise(c))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(cells)


def read_headers(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """archivo, cabecera: the first line of every part of a stored text table, folders below included.

    A part is told by its path, and its header by the block that begins at its
    first byte: other blocks give no row, and of that block one line per file is
    kept map-side.  Nothing is parsed but the headers.  Empty files have no row.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("archivo"), F.col("_metadata.file_block_start").alias("_start"))
    first = lines.where("_start = 0").withColumn("_at", F.monotonically_increasing_id())
    return first.groupBy("archivo").agg(header_cells(F.min_by("value", "_at"), separator).alias("cabecera"))


def header_problems(spark: SparkSession, path: str, expected: Sequence[str], separator: str = ",") -> DataFrame:
    """(archivo, problema) of every part of a text table whose header isn't exactly ``expected``."""
    wanted = F.array(*[F.lit(c) for c in expected])
    cells = F.col("cabecera")
    named = lambda label, columns: F.when(F.size(columns) > 0, F.concat(F.lit(label), F.array_join(columns, ", ")))
    parts = F.array_compact(F.array(named("faltan: ", F.array_except(wanted, cells)), named("sobran: ", F.array_except(cells, wanted))))
    problem = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(F.lit("orden o repetición"))
    return read_headers(spark, path, separator).where(cells != wanted).select("archivo", problem.alias("problema"))


def require_headers(spark: SparkSession, path: str, expected: Sequence[str]) -> None:
    """Refuse to append to a text table that has parts of another layout; a missing or empty one is fine."""
    try:
        problem = header_problems(spark, path, expected).first()
    except AnalysisException as error:
        if is_missing(error):
            return
        raise
    if problem is not None:
        raise IntegrityError(f"{problem['archivo']}: {problem['problema']}")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table with its declared schema, or an empty one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if is_missing(error):
            return spark.createDataFrame([], schema)
        raise


def read_journal(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    """The journal; rows of old layouts get the id derived from their instant."""
    if not text:
        return read_table(spark, path, schemas.JOURNAL)
    rows = read_text_table(spark, path, schemas.JOURNAL)
    derived = snapshot_id("fecha_ejecucion")
    if "snapshot_id" not in rows.columns:
        return rows.withColumn("snapshot_id", derived)
    return rows.withColumn("snapshot_id", F.coalesce("snapshot_id", derived))


def read_runs(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    return read_text_table(spark, path, schemas.CONTROL) if text else read_table(spark, path, schemas.CONTROL)


def read_tracking(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    if text:
        return read_text_table(spark, path, schemas.TRACKING, tuple(S.TRUE_WORDS_TRACKING))
    return read_table(spark, path, schemas.TRACKING)


def read_verification(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    return read_text_table(spark, path, schemas.VERIFICATION) if text else read_table(spark, path, schemas.VERIFICATION)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "ticker string, statement string, basis string, concept string, period_end date, value double").parquet(path)


def unpivot_statements(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows from a frame with one column per period end date."""
    periods = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(keys, periods, "period_end", "value")
    return long.withColumn("period_end", safe_date("period_end"))


def canonical_members(rows: DataFrame) -> DataFrame:
    """Fail on blank, repeated or non-canonical tickers, otherwise pass through."""
    bad = ticker_violations(rows).select("ticker", "problema").first()
    if bad is not None:
        raise UniverseError(f"{bad['problema']}: {bad['ticker']!r}")
    plain = F.col("ticker") == F.upper(F.trim("ticker"))
    odd = rows.where(~plain).select("ticker").first()
    if odd is not None:
        raise UniverseError(f"ticker not canonical: {odd['ticker']!r}")
    if rows.isEmpty():
        raise UniverseError("the universe has no tickers")
    return rows


def read_universe_members(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Members from CSV, or one ticker per line from a text list."""
    if str(path).lower().endswith(".csv"):
        rows = spark.read.option("header", True).csv(path).na.fill("")
        if strict:
            require_columns(rows, S.UNIVERSE_COLUMNS)
        if "ticker" not in rows.columns:
            raise UniverseError(f"{path} has no ticker column")
    else:
        rows = spark.read.text(path).withColumnRenamed("value", "ticker")
    return canonical_members(rows)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The version registry, one row per version, with the active id."""
    doc = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)
    return doc.select("schema_version", "active_universe_id", F.inline("universes"))


def read_discovery(spark: SparkSession, csv_path: str, json_path: str) -> tuple[DataFrame, DataFrame]:
    """(catalog with order columns, one control row), both validated."""
    raw = spark.read.option("header", True).csv(csv_path)
    require_columns(raw, S.DISCOVERY_COLUMNS)
    rows = raw.select(*[typed(c, schemas.type_of(c)).alias(c) for c in raw.columns])
    control = spark.read.schema(schemas.DISCOVERY_CONTROL).option("multiLine", True).json(json_path)
    # The order of the regions matters; a Python dict of the map would lose it.
    head = control.withColumn("_regions", F.map_keys("config.cuotas_region")).first()
    if head["schema_version"] != 1 or not head["discovery_id"]:
        raise SelectionError("incoherent snapshot identity")
    regions = {r: i for i, r in enumerate(head["_regions"] or [])}
    sectors = {s: i for i, s in enumerate(head["config"]["sectores"] or [])}
    catalog = (
        rows.join(F.broadcast(discovery.quota_table(spark, dict.fromkeys(regions, 1)).drop("cuota")
                              .withColumnRenamed("region", "region_descubrimiento")), "region_descubrimiento", "left")
        .join(F.broadcast(discovery.sector_table(spark, list(sectors)).withColumnRenamed("sector", "sector_descubrimiento")),
              "sector_descubrimiento", "left")
        .select(*S.DISCOVERY_COLUMNS, "region_ord", "sector_ord")
    )
    problem = discovery.catalog_violations(catalog).first()
    if problem is not None:
        raise SelectionError(f"{problem['problema']}: {problem['ticker']}")
    size, digest = discovery.member_hash(catalog).first()
    if head["sha256"] != digest or head["control"]["tickers_unicos"] != size:
        raise SelectionError("the membership hash or count of the snapshot does not match")
    if head["catalog_sha256"] != discovery.catalog_hash(catalog).first()["catalog_sha256"]:
        raise SelectionError("the catalog hash of the snapshot does not match")
    return catalog, control
