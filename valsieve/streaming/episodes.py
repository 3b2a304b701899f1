"""Signal episodes from a stream with Spark's keyed state.

The last valid verdict of a ticker is its state.  A micro-batch reads and writes
the state of its own tickers only, however many the stream has seen, and Spark
restores it after a lost executor or a restart.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from valsieve import settings as S
from valsieve.functions.cleaning import has_text, text_bool

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SCHEMA = "pasa boolean, fecha_ejecucion timestamp, snapshot_id string"


def micros(moment: datetime) -> int:
    """Microseconds since 1970: rows come with a time zone, the state in that of the machine."""
    return round(moment.timestamp() * 1e6)


class Episodes(StatefulProcessor):
    """Passes on the rows of a ticker at which it begins to pass.

    Rows of one micro-batch are taken in order of time and snapshot.  A row that is
    older than the state is ignored, so a batch that is sent again adds nothing.  Most
    tickers have a few rows in a batch, so plain rows cost less than a data frame each.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("verdict", STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = sorted(((micros(r.fecha_ejecucion), r.snapshot_id or "", at, r) for at, r in enumerate(rows)), key=lambda r: r[:3])
        stored = self.last.get()
        passing, newest, told = (stored[0], (micros(stored[1]), stored[2]), stored[1]) if stored else (False, None, None)
        for moment, snapshot, _, row in held:
            now = (moment, snapshot)
            if newest is not None and now <= newest:
                continue
            if row.verdict and not passing:
                yield Row(**{name: value for name, value in row.asDict().items() if name != "verdict"})
            passing, newest, told = bool(row.verdict), now, row.fecha_ejecucion
        if newest is not None:
            self.last.update((passing, told, newest[1]))

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, while a query is started; a query keeps the settings of its start."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def episodes(rows: DataFrame) -> DataFrame:
    """The streamed journal rows that begin an episode.

    Rows with a download error, without a ticker or without an instant keep the state.  Rows of later
    micro-batches must not be older than those before.
    """
    valid = rows.where(~has_text("error_descarga") & F.col("ticker").isNotNull() & F.col("fecha_ejecucion").isNotNull())
    marked = valid.withColumn("verdict", F.coalesce(text_bool("pasa", S.TRUE_WORDS_TRACKING), F.lit(False)))
    return marked.groupBy("ticker").transformWithState(Episodes(), rows.schema, "Append", "None")


def stream_episodes(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write each episode once to the Parquet folder ``path``; a restart goes on from ``checkpoint``."""
    with keyed_state(rows.sparkSession):
        writer = episodes(rows).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()
