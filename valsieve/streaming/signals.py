"""Signal episodes from a stream, with the on/off state kept per ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from valsieve import settings as S
from valsieve.functions.cleaning import has_text, text_bool
from valsieve.operators.signals import signal_episodes

STATE_SCHEMA = "ticker string, pasa boolean, fecha_ejecucion timestamp"


def update_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Last valid verdict per ticker; rows with an error change nothing."""
    valid = batch.where(~has_text("error_descarga")).select(
        "ticker", text_bool("pasa", S.TRUE_WORDS_TRACKING).alias("pasa"), "fecha_ejecucion", "snapshot_id")
    rows = state.withColumn("snapshot_id", F.lit("")).unionByName(valid)
    last = F.max_by(F.struct("pasa", "fecha_ejecucion"), F.struct("fecha_ejecucion", "snapshot_id"))
    return rows.groupBy("ticker").agg(last.alias("s")).select("ticker", "s.pasa", "s.fecha_ejecucion")


def batch_episodes(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Episodes of a micro-batch, given the state before it.

    The state enters as one earlier observation per ticker, so the batch
    operator applies unchanged.
    """
    marked = batch.withColumn("_given", F.lit(False))
    columns = {f.name: f.dataType for f in marked.schema.fields}
    given = {"ticker": F.col("ticker"), "pasa": F.col("pasa"), "fecha_ejecucion": F.col("fecha_ejecucion"),
             "error_descarga": F.lit(""), "snapshot_id": F.lit(""), "_given": F.lit(True)}
    before = state.select(*[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])
    return signal_episodes(before.unionByName(marked)).where(~F.col("_given")).drop("_given")


def process_batch(episodes_path: str, state_path: str):
    """A ``foreachBatch`` function; every epoch writes its own episodes folder.

    The state of an epoch goes to one of two folders in turn, so it takes the
    room of two epochs however long the stream runs.  Only the newest epoch is
    ever repeated; the state before it is in the other folder, and its own
    folders are overwritten with the same rows, so a restart neither loses nor
    repeats an episode.
    """

    def state_of(epoch: int) -> str:
        return f"{state_path}/slot={epoch % 2}"

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch > 0:
            state = spark.read.schema(STATE_SCHEMA).parquet(state_of(epoch - 1))
        else:
            state = spark.createDataFrame([], STATE_SCHEMA)
        batch_episodes(state, batch).write.mode("overwrite").parquet(f"{episodes_path}/epoch={epoch}")
        update_state(state, batch).write.mode("overwrite").parquet(state_of(epoch))

    return run


def stream_signals(rows: DataFrame, episodes_path: str, state_path: str, checkpoint: str,
                   available_now: bool = False) -> StreamingQuery:
    """Rows of later micro-batches must not be older than those before."""
    writer = rows.writeStream.foreachBatch(process_batch(episodes_path, state_path)).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
