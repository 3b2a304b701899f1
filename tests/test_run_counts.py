import re

import pytest
from conftest import ideal
from pyspark.sql import functions as F

from valsieve.errors import IntegrityError
from valsieve.operators import integrity, summaries
from valsieve.plans.analysis import analyze
from valsieve.plans.weekly import run_weekly
from valsieve.session import stage_table
from valsieve.sources import readers


def some_rows():
    return [ideal(f"T{i}", nombre=f"Company {i % 17}", pais="Spain" if i % 2 else "Japan", error_descarga="Timeout" if i % 11 == 0 else "",
                  calidad_datos=("ok", "revisar", "inutilizable")[i % 3], net_income=1e9 * (i % 5)) for i in range(60)]


@pytest.mark.parametrize("providers", [["uno"], ["uno", "dos", ""], [""]])
def test_counts_of_the_writing_job_equal_a_recount(spark, companies, providers):
    rows = companies(*[{**r, "proveedor_datos": providers[i % len(providers)]} for i, r in enumerate(some_rows())])
    asked = rows.select("ticker")
    result = analyze(rows)
    for requested in (None, asked):
        want = summaries.run_control(result.evaluated, rows, requested=requested).first()
        got = summaries.observed_control(result.evaluated, result.counts, rows, requested=requested)
        assert got.first() == want and got.dtypes == summaries.run_control(result.evaluated, rows, requested=requested).dtypes


def test_control_and_gate_scan_the_evaluated_table_once(spark, companies):
    rows = stage_table(companies(*some_rows()), "obtained")
    result = analyze(rows)
    control = summaries.observed_control(result.evaluated, result.counts, rows)
    scans = lambda df: re.findall(r"FileScan parquet \[([^]]*)\]", df._jdf.queryExecution().executedPlan().toString())
    assert [s.split("#")[0] for s in scans(control)] == ["error_descarga"] and "Window" not in control._jdf.queryExecution().executedPlan().toString()
    checks = integrity.gate(result.evaluated, control)
    assert checks.first()["valida"]
    assert sorted([c.split("#")[0] for c in s.split(",")] for s in scans(checks)) == [["error_descarga"], ["ticker", "pasa"]]


def test_lost_rows_show_in_the_counts(spark, companies):
    rows = companies(*some_rows())
    asked = rows.select("ticker").unionByName(spark.createDataFrame([("LOST",)], "ticker string"))
    result = analyze(rows)
    checks = integrity.gate(result.evaluated, summaries.observed_control(result.evaluated, result.counts, rows, requested=asked)).first()
    assert not checks["valida"] and not checks["brutos_cuadran"] and checks["deduplicados_cuadran"]


def test_weekly_run_records_the_counts(spark, companies, tmp_path):
    rows = companies(*some_rows())
    run_weekly(rows, str(tmp_path / "j"), str(tmp_path / "r"), "2026-08-31 07:00:00", requested=rows.select("ticker"))
    row = readers.read_runs(spark, str(tmp_path / "r")).first()
    want = summaries.run_control(analyze(rows).evaluated, rows).first()
    assert {c: row[c] for c in want.asDict()} == want.asDict()
    with pytest.raises(IntegrityError):
        run_weekly(rows, str(tmp_path / "j2"), str(tmp_path / "r2"), "2026-08-31 07:00:00", requested=rows.select("ticker").where(F.col("ticker") > "T2"))
