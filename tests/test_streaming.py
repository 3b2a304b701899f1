from test_signals import LAYOUT, UTC, expected_entries, journal, random_histories

from pyspark.sql import functions as F

from valsieve.operators.journal import of_snapshots
from valsieve.streaming.episodes import stream_episodes
from valsieve.streaming.journal import stream_journal
from valsieve.streaming.signals import process_batch, stream_signals


def write_batches(df, folder, cuts):
    """One file per time range, so every micro-batch is one range."""
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = df
        if low:
            part = part.where(F.col("fecha_ejecucion") >= low)
        if high:
            part = part.where(F.col("fecha_ejecucion") < high)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/{i:02d}")


def stream_of(spark, folder):
    return spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_stream_signals_equal_batch(spark, tmp_path):
    histories = random_histories(11)
    source = str(tmp_path / "in")
    write_batches(journal(spark, histories), source, ["2025-03-10", "2025-08-01"])
    query = stream_signals(stream_of(spark, source), str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ckpt"), True)
    query.awaitTermination(300)
    rows = spark.read.parquet(str(tmp_path / "out")).select("ticker", "fecha_ejecucion").collect()
    got = [(r["ticker"], r["fecha_ejecucion"].replace(tzinfo=UTC)) for r in rows]
    assert len(got) == len(set(got)) and set(got) == expected_entries(histories)
    assert query.exception() is None


def test_state_takes_two_folders_and_a_repeated_epoch_changes_nothing(spark, tmp_path):
    histories = random_histories(5)
    rows = journal(spark, histories)
    cuts = ["2025-02-01", "2025-03-10", "2025-06-01", "2025-08-01", "2100-01-01"]
    run, low = process_batch(str(tmp_path / "out"), str(tmp_path / "state")), "1900-01-01"
    for epoch, high in enumerate(cuts):
        batch = rows.where((F.col("fecha_ejecucion") >= F.lit(low)) & (F.col("fecha_ejecucion") < F.lit(high)))
        for _ in range(2):  # as after a restart before the commit
            run(batch, epoch)
        low = high
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["slot=0", "slot=1"]
    found = spark.read.parquet(str(tmp_path / "out")).select("ticker", "fecha_ejecucion").collect()
    got = [(r["ticker"], r["fecha_ejecucion"].replace(tzinfo=UTC)) for r in found]
    assert len(got) == len(set(got)) and set(got) == expected_entries(histories)


def test_stream_journal_appends_once(spark, tmp_path):
    df = journal(spark, {"A": [(0, True), (7, True)], "B": [(0, False)]}).withColumn("semana_iso", F.lit("2025-W02"))
    source, target = str(tmp_path / "in"), str(tmp_path / "journal")
    df.coalesce(1).write.parquet(f"{source}/00")
    df.unionByName(df.withColumn("snapshot_id", F.lit("snap_nuevo")).limit(1)).coalesce(1).write.parquet(f"{source}/01")
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    stream_journal(rows, target, str(tmp_path / "ckpt"), True).awaitTermination(300)
    stored = spark.read.parquet(target)
    assert stored.count() == 4 and stored.where("snapshot_id = 'snap_nuevo'").count() == 1
    new = stored.where("snapshot_id = 'snap_nuevo'")
    seen = of_snapshots(stored, new)
    assert seen.count() == 1
    assert "dynamicpruning" in seen._jdf.queryExecution().executedPlan().toString()


def entries(spark, path):
    rows = spark.read.parquet(path).select("ticker", "fecha_ejecucion").collect()
    return [(r["ticker"], r["fecha_ejecucion"].replace(tzinfo=UTC)) for r in rows]


def test_keyed_state_equals_batch_over_restarts(spark, tmp_path):
    histories = random_histories(13)
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "ckpt"))
    rows, low = journal(spark, histories), "1900-01-01"
    for i, high in enumerate(["2025-02-10", "2025-05-01", "2025-08-01", "2100-01-01"]):
        part = rows.where((F.col("fecha_ejecucion") >= F.lit(low)) & (F.col("fecha_ejecucion") < F.lit(high)))
        part.coalesce(1).write.mode("append").parquet(f"{source}/{i:02d}")
        query = stream_episodes(stream_of(spark, source), out, checkpoint, True)  # each part is a run of its own
        query.awaitTermination(300)
        assert query.exception() is None
        low = high
    got = entries(spark, out)
    assert len(got) == len(set(got)) and set(got) == expected_entries(histories)


def test_a_batch_writes_the_state_of_its_own_tickers(spark, tmp_path):
    many = {f"T{i:03d}": [(0, i % 2 == 0)] for i in range(200)}
    few = {"T000": [(0, True), (7, True)], "T001": [(0, False), (7, True)], "NEW": [(7, True)]}
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "ckpt"))
    later = journal(spark, few)
    later = later.where(F.col("fecha_ejecucion") > journal(spark, many).agg(F.max("fecha_ejecucion")).first()[0])
    sizes = []
    for name, part in (("00", journal(spark, many)), ("01", later)):
        part.coalesce(1).write.parquet(f"{source}/{name}")
        query = stream_episodes(stream_of(spark, source), out, checkpoint, True)
        query.awaitTermination(300)
        state = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
        sizes.append((sum(s["numRowsUpdated"] for s in state), state[-1]["numRowsTotal"]))
    assert sizes == [(200, 200), (3, 201)]
    assert sorted(t for t, _ in entries(spark, out))[:3] == ["NEW", "T000", "T001"] and len(entries(spark, out)) == 102


def test_rows_sent_again_and_rows_without_key_add_nothing(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "ckpt"))
    rows = journal(spark, {"A": [(0, True), (7, False), (14, True)]})
    blank = rows.limit(1).withColumn("ticker", F.lit(None).cast("string"))
    for i in range(2):
        rows.unionByName(blank).coalesce(1).write.parquet(f"{source}/{i:02d}")
        stream_episodes(stream_of(spark, source), out, checkpoint, True).awaitTermination(300)
    assert len(entries(spark, out)) == 2


def test_a_ticker_is_read_as_plain_rows():
    from datetime import datetime, timezone

    from pyspark.sql import Row

    from valsieve.streaming.episodes import Episodes

    class Kept:
        value = (False, datetime(2024, 1, 1), "s1")

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    days = [datetime(2024, 1, d, tzinfo=timezone.utc) for d in range(1, 6)]
    rows = [Row(ticker="A", fecha_ejecucion=days[d], snapshot_id=s, verdict=v)
            for d, s, v in ((3, "s4", True), (1, "s2", True), (2, "s3", False), (4, None, True))]
    one = Episodes()
    one.last = Kept()
    assert [r.asDict() for r in one.handleInputRows(("A",), iter(rows), None)] == [
        {"ticker": "A", "fecha_ejecucion": days[1], "snapshot_id": "s2"}, {"ticker": "A", "fecha_ejecucion": days[3], "snapshot_id": "s4"}]
    assert one.last.value == (True, days[4], "")
    assert list(one.handleInputRows(("A",), iter(rows), None)) == []
