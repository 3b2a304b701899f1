"""Idempotent journal append from a stream of evaluated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from valsieve.operators.journal import of_snapshots
from valsieve.sources import readers

KEYS = ["snapshot_id", "ticker"]


def append_batch(path: str):
    """A ``foreachBatch`` function: rows already on file are skipped.

    Only the folders of the snapshots in the batch are read.  A repeated
    micro-batch adds nothing, and a snapshot split over two is kept whole.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        known = readers.read_table(batch.sparkSession, path, batch.schema)
        unique = batch.dropDuplicates(KEYS)
        seen = of_snapshots(known.select(*KEYS), batch)
        new = unique.join(seen, KEYS, "left_anti").select(*batch.columns)
        new.write.mode("append").partitionBy("semana_iso", "snapshot_id").parquet(path)

    return write


def stream_journal(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stream of journal rows, each (snapshot, ticker) once."""
    writer = rows.writeStream.foreachBatch(append_batch(path)).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


