import datetime as dt

import pytest
from conftest import ideal
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.errors import IntegrityError, UniverseError
from valsieve.operators import integrity, journal, summaries
from valsieve.plans.analysis import analyze
from valsieve.plans.history import export_history
from valsieve.plans.weekly import run_weekly
from valsieve.sources import readers, writers

UTC = dt.timezone.utc


def stamp(day, hour=7):
    return dt.datetime(2026, 8, day, hour, tzinfo=UTC)


def runs_of(spark, rows):
    return spark.createDataFrame(rows, "snapshot_id string, semana_iso string, oficial string, revision double, fecha_ejecucion timestamp")


def journal_of(spark, ids):
    return spark.createDataFrame([(i, "A") for i in ids], "snapshot_id string, ticker string")


def test_effective_revision_per_week(spark):
    runs = runs_of(spark, [
        ("oficial-1", "2026-W35", "True", 1.0, stamp(24)), ("prueba-2", "2026-W35", "False", 2.0, stamp(25)),
        ("oficial-3", "2026-W35", "sí", 3.0, stamp(26)), ("vieja", "2026-W36", "true", None, stamp(30)),
        ("nueva", "2026-W36", "true", None, stamp(31))])
    rows = journal.effective_snapshots(journal_of(spark, ["legacy", "oficial-1", "prueba-2", "oficial-3", "vieja", "nueva"]), runs)
    assert {r["snapshot_id"] for r in rows.collect()} == {"legacy", "oficial-3", "nueva"}


def test_empty_control_keeps_everything(spark):
    rows = journal.effective_snapshots(journal_of(spark, ["a", "b"]), runs_of(spark, []))
    assert {(r["snapshot_id"], r["origen"]) for r in rows.collect()} == {("a", "legacy"), ("b", "legacy")}


def test_latest_snapshot_is_by_instant(spark):
    df = spark.createDataFrame([("s1", stamp(24, 7), "A"), ("s2", stamp(24, 9), "B"), ("s2", stamp(24, 9), "C")],
                               "snapshot_id string, fecha_ejecucion timestamp, ticker string")
    assert {r["ticker"] for r in journal.latest_snapshot(df).collect()} == {"B", "C"}


def test_next_revision(spark):
    runs = runs_of(spark, [("a", "2026-W35", "true", 1.0, stamp(24)), ("b", "2026-W35", "false", 4.0, stamp(24))])
    weeks = spark.createDataFrame([("2026-W35",), ("2026-W36",)], "semana_iso string")
    assert {tuple(r) for r in journal.next_revision(runs, weeks).collect()} == {("2026-W35", 5), ("2026-W36", 1)}


def test_evolve_control_layouts(spark):
    base = spark.createDataFrame([tuple("x" for _ in S.CONTROL_BASE_COLUMNS)], ", ".join(f"{c} string" for c in S.CONTROL_BASE_COLUMNS))
    out = journal.evolve_control(base)
    assert out.columns == S.CONTROL_COLUMNS and out.first()["universe_id"] is None
    with pytest.raises(IntegrityError):
        journal.evolve_control(base.drop("revision"))
    with pytest.raises(IntegrityError):
        journal.evolve_control(base.withColumn("otra", F.lit(1)))
    with pytest.raises(IntegrityError):
        journal.require_columns(base, S.CONTROL_COLUMNS)


def test_control_rules(spark):
    rows = [("s1", True, 1, "", "", ""), ("s2", True, 1, "uv_2026q3_r01", "a" * 64, "p"), ("s3", False, 0, "adhoc_1", "zz", "p"),
            ("s4", False, 1, "adhoc_1", "a" * 64, ""), ("s5", False, 1, "", "", "")]
    runs = spark.createDataFrame(rows, "snapshot_id string, oficial boolean, revision int, universe_id string, universe_sha256 string, universe_path string")
    seen = spark.createDataFrame([("s5",)], "snapshot_id string")
    got = {tuple(r) for r in integrity.control_violations(runs, seen).collect()}
    assert got == {("s1", "oficial_sin_universo"), ("s3", "hash_invalido"), ("s3", "revision_invalida"),
                   ("s4", "identidad_incompleta"), ("s5", "snapshot_repetido")}


@pytest.fixture
def weekly(companies, tmp_path):
    df = companies(ideal("A"), ideal("B", free_cash_flow=1.0), ideal("C", error_descarga="Timeout", calidad_datos="error"),
                   *[ideal(f"D{i}") for i in range(7)])
    return df, str(tmp_path / "journal"), str(tmp_path / "runs"), str(tmp_path / "verification")


def test_weekly_run_records_and_refuses_repeats(spark, weekly):
    df, journal_path, runs_path, verification_path = weekly
    identity = {"universe_id": "uv_2026q3_r01", "universe_sha256": "a" * 64, "universe_path": "x.csv"}
    loose = {"per_bajo_mediana_sector": False}
    first = run_weekly(df, journal_path, runs_path, "2026-08-24 07:00:00", identity, official=True, active=True, thresholds=loose,
                       secondary=df.drop("calidad_datos"), verification_path=verification_path)
    assert first.snapshot_id == "snap_20260824T070000000000Z" and first.verification_error == ""
    second = run_weekly(df, journal_path, runs_path, "2026-08-25 07:00:00", thresholds=loose)
    stored = readers.read_journal(spark, journal_path)
    assert stored.count() == 20 and {r[0] for r in stored.select("semana_iso").distinct().collect()} == {"2026-W35"}
    assert second.control.first()["revision"] == 2
    row = first.control.first()
    assert (row["candidatas"], row["errores_descarga"], row["oficial"], row["tasa_exito_descarga"]) == (8, 1, True, 0.9)
    assert first.verification.count() == 8 * len(S.COMPARED_FIELDS)
    assert {r["estado"] for r in first.verification.collect()} == {"verificado"}
    with pytest.raises(IntegrityError, match="already"):
        run_weekly(df, journal_path, runs_path, "2026-08-24 07:00:00")
    assert readers.read_journal(spark, journal_path).count() == 20
    lines = export_history(stored, readers.read_runs(spark, runs_path), readers.read_tracking(spark, "/tmp/no-such-table"))
    counts = {r["seccion"]: r["count"] for r in lines.groupBy("seccion").count().collect()}
    assert counts == {"journal": 10, "ejecuciones": 2, "candidatas_ultima_semana": 8}
    assert "NaN" not in "".join(r["json"] for r in lines.collect())


def test_rejected_run_writes_nothing(spark, weekly, companies):
    _, journal_path, runs_path, _ = weekly
    bad = companies(ideal("A", error_descarga="x", calidad_datos="error"), ideal("B"))
    with pytest.raises(IntegrityError):
        run_weekly(bad, journal_path, runs_path, "2026-08-24 07:00:00")
    assert readers.read_journal(spark, journal_path).count() == 0 and readers.read_runs(spark, runs_path).count() == 0
    with pytest.raises(UniverseError):
        run_weekly(bad, journal_path, runs_path, "2026-08-24 07:00:00", official=True)
    whole = companies(ideal("A"), ideal("B"))
    asked = whole.select("ticker").unionByName(companies(ideal("LOST")).select("ticker"))
    with pytest.raises(IntegrityError, match="brutos_cuadran"):
        run_weekly(whole, journal_path, runs_path, "2026-08-24 07:00:00", requested=asked)
    assert readers.read_journal(spark, journal_path).count() == 0


def test_control_sees_rows_lost_after_dedup(companies):
    obtained = companies(ideal("A"), ideal("A2", nombre="A plc"), ideal("B"), ideal("C"))
    evaluated = analyze(obtained).evaluated
    row = summaries.run_control(evaluated, obtained, requested=obtained).first()
    assert row["tickers_solicitados"] == 4 and row["resultados_brutos"] - row["deduplicados"] == row["empresas_evaluadas"]
    assert integrity.gate(evaluated, summaries.run_control(evaluated, obtained)).first()["valida"]
    short = evaluated.where("ticker <> 'C'")
    checks = integrity.gate(short, summaries.run_control(short, obtained, requested=obtained)).first()
    assert not checks["deduplicados_cuadran"] and not checks["valida"]


def test_failing_verification_does_not_fail_the_run(spark, weekly):
    df, journal_path, runs_path, verification_path = weekly
    run = run_weekly(df, journal_path, runs_path, "2026-08-24 07:00:00", secondary=df.drop("ticker"), verification_path=verification_path)
    assert "VerificationError" in run.verification_error and run.control.count() == 1


def test_text_tables(spark, companies, tmp_path):
    old = tmp_path / "journal.csv"
    old.write_text("fecha_ejecucion,semana_iso,ticker,pasa,per\n2026-08-24T07:00:00+00:00,2026-W35,A,True,9.5\n2026-08-24T07:00:00+00:00,2026-W35,B,no,\n")
    rows = {r["ticker"]: r for r in readers.read_journal(spark, str(old), text=True).collect()}
    assert rows["A"]["snapshot_id"] == "snap_20260824T070000000000Z" and rows["A"]["pasa"] is True
    assert rows["B"]["per"] is None and rows["B"]["pasa"] is False
    control = tmp_path / "runs.csv"
    control.write_text("snapshot_id,fecha_ejecucion,oficial,revision\ns,2026-08-24T07:00:00Z,1,2.0\nt,2026-08-24T07:00:00Z,yes,x\n")
    got = {r["snapshot_id"]: (r["oficial"], r["revision"]) for r in readers.read_runs(spark, str(control), text=True).collect()}
    assert got == {"s": (True, 2), "t": (True, None)}
    assert readers.read_journal(spark, str(tmp_path / "none.csv"), text=True).count() == 0
    ranked = analyze(companies(ideal("A"), ideal("B", nombre='Con "comillas", y coma'))).ranked
    writers.write_screen_csv(ranked, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert {r["nombre"] for r in back.collect()} == {"A", 'Con "comillas", y coma'}


def test_audit_columns(spark):
    df = journal.audit_columns(spark.createDataFrame([("A",)], "ticker string"), "2026-08-24T07:00:00Z")
    assert df.columns == ["fecha_ejecucion", "semana_iso", "ticker", "snapshot_id"]
    assert df.first()["snapshot_id"] == "snap_20260824T070000000000Z"


def test_run_control_counts_duplicates(companies):
    df = companies(ideal("A", nombre="Uno"), ideal("AA", nombre="Uno plc"), ideal("B"))
    row = summaries.run_control(analyze(df).evaluated, df).first()
    assert (row["resultados_brutos"], row["deduplicados"], row["empresas_evaluadas"]) == (3, 1, 2)
