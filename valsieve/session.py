"""Session settings and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Plans here have thousands of expressions; do not record a call site for each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Filters on market and sector go to the list of quote pages.
    "spark.sql.python.filterPushdown.enabled": "true",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", app: str = "valsieve") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests, a laptop) a new temporary
    folder is used; on a cluster a folder of one machine would be lost to the
    others, so the setting is required there.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        application = spark.sparkContext.applicationId
        if application not in LOCAL_FOLDERS:
            LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="valsieve-stage-")
        named = LOCAL_FOLDERS[application]
    return named


RUN_FOLDER: ContextVar[str | None] = ContextVar("run_folder", default=None)


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[str]:
    """Tables staged inside share a folder of their own, which is removed at the end.

    Results built inside read those tables, so they must be written before the
    scope is left.  Without a scope staged tables stay until the folder is
    cleared by its owner.  A scope within another is a part of it.
    """
    outer = RUN_FOLDER.get()
    if outer is not None:
        yield outer
        return
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    mark = RUN_FOLDER.set(folder)
    try:
        yield folder
    finally:
        RUN_FOLDER.reset(mark)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it.

    Used where one table feeds several passes.  Later passes read only the
    columns they need, and a lost executor re-reads files instead of
    recomputing the lineage.
    """
    path = f"{RUN_FOLDER.get() or shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str) -> DataFrame:
    """A reduced table written once, so that Spark knows its real size.

    A join then broadcasts it when it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges otherwise.
    Without this the planner only sees the size of the scans above it and may
    shuffle the large side first.
    """
    return stage_table(df, name)


def fixed_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table (names and ``string``/``int`` types in ``schema``).

    Built from SQL ``VALUES``, so Spark knows its exact size and broadcasts it.
    """
    columns = [part.split() for part in schema.split(",")]

    def literal(value, kind):
        if value is None:
            return f"CAST(NULL AS {kind})"
        if kind == "string":
            return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"CAST({value} AS {kind})"

    names = ", ".join(name for name, _ in columns)
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {k}) AS {n}" for n, k in columns) + " LIMIT 0")
    body = ", ".join("(" + ", ".join(literal(v, k) for v, (_, k) in zip(row, columns)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS fixed({names})")
