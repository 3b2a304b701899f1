import datetime as dt
import random

from pyspark.sql import functions as F

from valsieve.operators import signals
from valsieve.plans.tracking import track
from valsieve.sources import readers

UTC = dt.timezone.utc
START = dt.datetime(2025, 1, 6, tzinfo=UTC)
LAYOUT = "ticker string, fecha_ejecucion timestamp, snapshot_id string, pasa boolean, error_descarga string, nombre string, sector string, region string, per double, ev_ebit double, roic double, puntuacion double"


def journal(spark, histories):
    rows = []
    for ticker, states in histories.items():
        for week, state in states:
            when = START + dt.timedelta(days=week)
            rows.append((ticker, when, f"snap_{week:05d}", state is True, "Timeout" if state == "error" else "", ticker, "S", "R", 1.0, 1.0, 1.0, 1.0))
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, LAYOUT).repartition(5)


def expected_entries(histories):
    out = set()
    for ticker, states in histories.items():
        active = False
        for week, state in sorted(states, key=lambda s: s[0]):
            if state == "error":
                continue
            if state and not active:
                out.add((ticker, START + dt.timedelta(days=week)))
            active = state
    return out


def test_known_sequences(spark):
    T, N, E = True, False, "error"
    cases = {"UNA": [T, T], "DOS": [T, T, N, T], "ERROR": [T, E, T], "NUNCA": [N, E, N], "TARDE": [E, N, T], "SOLO": [E]}
    histories = {k: [(7 * i, s) for i, s in enumerate(v)] for k, v in cases.items()}
    rows = signals.signals(journal(spark, histories))
    counts = {r["ticker"]: r["count"] for r in rows.groupBy("ticker").count().collect()}
    assert counts == {"UNA": 1, "DOS": 2, "ERROR": 1, "TARDE": 1}
    assert rows.columns[:5] == ["ticker", "nombre", "sector", "region", "fecha_entrada"]


def random_histories(seed):
    rng = random.Random(seed)
    histories = {"HOT": [(d, rng.choice([True, True, False, "error"])) for d in range(400)]}
    for i in range(30):
        days = sorted(rng.sample(range(0, 500, 3), rng.randint(1, 40)))
        histories[f"T{i}"] = [(d, rng.choice([True, False, "error"])) for d in days]
    return histories


def test_episodes_across_months_match_a_loop(spark):
    histories = random_histories(7)
    rows = signals.signal_episodes(journal(spark, histories)).select("ticker", "fecha_ejecucion").collect()
    got = [(r["ticker"], r["fecha_ejecucion"].replace(tzinfo=UTC)) for r in rows]
    assert len(got) == len(set(got)) and set(got) == expected_entries(histories)


def follow(prices, entry):
    series = [c for d, c in sorted(prices) if d >= entry]
    if len(series) < 2:
        return None
    top, worst = series[0], 0.0
    for c in series:
        top = max(top, c)
        worst = min(worst, c / top - 1)
    days = [d for d, _ in sorted(prices) if d >= entry]
    return series[0], series[-1], series[-1] / series[0] - 1, worst, (days[-1] - days[0]).days


def test_performance_across_months_matches_a_loop(spark):
    rng = random.Random(3)
    base, prices, entries = dt.date(2024, 1, 1), {}, []
    for i in range(12):
        days = sorted(rng.sample(range(700), rng.choice([0, 1, 2, 40, 300])))
        prices[f"T{i}"] = [(base + dt.timedelta(days=d), rng.uniform(1, 200)) for d in days]
        entries += [(f"T{i}", base + dt.timedelta(days=d)) for d in rng.sample(range(-20, 720), 15)]
    rows = [(t, d, c) for t, series in prices.items() for d, c in series]
    table = spark.createDataFrame(rows, "ticker string, fecha date, close double").repartition(6)
    wanted = spark.createDataFrame(entries, "ticker string, fecha_entrada date").repartition(3)
    got = {(r["ticker"], r["fecha_entrada"]): r for r in signals.signal_performance(wanted, table).collect()}
    assert len(got) == len(set(entries))
    for ticker, entry in entries:
        row, want = got[ticker, entry], follow(prices[ticker], entry)
        if want is None:
            assert row["precio_entrada"] is None and row["max_drawdown"] is None and row["dias_en_seguimiento"] is None
        else:
            assert (row["precio_entrada"], row["precio_actual"]) == want[:2]
            assert abs(row["retorno_total"] - want[2]) < 1e-12 and abs(row["max_drawdown"] - want[3]) < 1e-12
            assert row["dias_en_seguimiento"] == want[4]


def test_price_golden_and_daily_series(spark):
    days = [dt.date(2025, 1, 30), dt.date(2025, 1, 31), dt.date(2025, 2, 3), dt.date(2025, 2, 4)]
    table = spark.createDataFrame(list(zip(["A"] * 4, days, [100.0, 110.0, 90.0, 120.0])), "ticker string, fecha date, close double")
    entry = spark.createDataFrame([("A", dt.date(2025, 1, 28)), ("B", dt.date(2025, 1, 28))], "ticker string, fecha_entrada date")
    rows = {r["ticker"]: r for r in signals.signal_performance(entry, table).collect()}
    assert abs(rows["A"]["retorno_total"] - 0.20) < 1e-12 and abs(rows["A"]["max_drawdown"] - (90 / 110 - 1)) < 1e-12
    assert rows["B"]["precio_entrada"] is None
    returns = [r["retorno"] for r in signals.daily_returns(table).orderBy("fecha").collect()]
    assert returns[0] is None and [round(x, 6) for x in returns[1:]] == [0.1, -0.181818, 0.333333]
    assert [round(r["indice"], 6) for r in signals.wealth_index(table).orderBy("fecha").collect()] == [1.0, 1.1, 0.9, 1.2]
    assert abs(signals.drawdowns(table).first()["max_drawdown"] - (90 / 110 - 1)) < 1e-12


def test_chartable_history(spark):
    d = dt.date
    rows = [("A", d(2025, 1, 1), d(2025, 1, 8), 0.1, 1), ("A", d(2025, 1, 1), d(2025, 1, 8), 0.2, 2), ("A", d(2025, 1, 1), d(2025, 1, 15), 0.3, 3),
            ("B", d(2025, 1, 1), d(2025, 1, 8), 0.1, 4), ("B", d(2025, 1, 1), d(2025, 1, 15), None, 5), (None, d(2025, 1, 1), d(2025, 1, 8), 0.1, 6)]
    df = spark.createDataFrame(rows, "ticker string, fecha_entrada date, fecha_calculo date, retorno_total double, orden int")
    got = signals.chartable_history(df, 2, "orden")
    assert sorted((r["ticker"], r["retorno_total"]) for r in got.collect()) == [("A", 0.2), ("A", 0.3)]
    assert signals.chartable_history(df, 1).count() == 0
    last = signals.first_last_return(got).first()
    assert (last["primer_retorno"], last["ultimo_retorno"]) == (0.2, 0.3)
    assert {(r["ticker"], r["orden"]) for r in signals.latest_per_signal(df, "orden").collect()} == {("A", 3), ("B", 5), (None, 6)}


def test_tracking_plan_appends(spark, tmp_path):
    histories = {"A": [(0, True), (7, True)], "B": [(0, False), (7, True)]}
    rows = journal(spark, histories)
    runs = spark.createDataFrame([("snap_00007", "2025-W03", False, 1, START)], "snapshot_id string, semana_iso string, oficial boolean, revision int, fecha_ejecucion timestamp")
    prices = spark.createDataFrame([("A", dt.date(2025, 1, 7), 10.0), ("A", dt.date(2025, 1, 8), 11.0)], "ticker string, fecha date, close double")
    path = str(tmp_path / "tracking")
    track(rows, runs, prices, "2025-02-01 00:00:00", path)
    track(rows, runs, prices, "2025-02-08 00:00:00", path)
    stored = readers.read_tracking(spark, path)
    assert {r["ticker"] for r in stored.collect()} == {"A"} and stored.count() == 2
    assert stored.agg(F.round(F.max("retorno_total"), 6)).first()[0] == 0.1


def test_returns_after_a_missing_close(spark):
    rows = [("A", "2024-01-30", 10.0), ("A", "2024-02-01", 20.0), ("A", "2024-02-02", None), ("A", "2024-02-05", 30.0), ("B", "2024-02-01", None), ("B", "2024-02-02", 5.0)]
    table = spark.createDataFrame(rows, "ticker string, fecha string, close double").withColumn("fecha", F.to_date("fecha"))
    got = {(r["ticker"], str(r["fecha"])): r["retorno"] for r in signals.daily_returns(table).collect()}
    assert got == {("A", "2024-01-30"): None, ("A", "2024-02-01"): 1.0, ("A", "2024-02-05"): 0.5, ("B", "2024-02-02"): None}
    index = {(r["ticker"], str(r["fecha"])): r["indice"] for r in signals.wealth_index(table).collect()}
    assert index["A", "2024-02-05"] == 3.0 and index["B", "2024-02-02"] == 1.0


def test_prices_are_scanned_once_without_a_join(spark, tmp_path):
    path = str(tmp_path / "prices")
    spark.createDataFrame([("A", dt.date(2025, 1, 7), 10.0), ("A", dt.date(2025, 3, 8), 11.0)], "ticker string, fecha date, close double").write.parquet(path)
    prices, entry = spark.read.parquet(path), spark.createDataFrame([("A", dt.date(2025, 1, 28))], "ticker string, fecha_entrada date")
    for df in (signals.signal_performance(entry, prices), signals.drawdowns(prices)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan") == 1 and "Join" not in plan
    row = signals.signal_performance(entry, prices).first()
    assert row["precio_entrada"] is None and row["dias_en_seguimiento"] is None  # one close is not enough


def test_drawdowns_across_months_match_a_loop(spark):
    rng = random.Random(4)
    series = {f"T{i}": [(dt.date(2024, 1, 1) + dt.timedelta(days=d), rng.choice([0.0, 5.0, rng.uniform(1, 99)]) if i % 3 == 0 else rng.uniform(1, 99))
                        for d in sorted(rng.sample(range(500), rng.choice([1, 3, 50, 300])))] for i in range(12)}
    rows = [(t, d, c) for t, s in series.items() for d, c in s]
    got = {r["ticker"]: r["max_drawdown"] for r in signals.drawdowns(spark.createDataFrame(rows, "ticker string, fecha date, close double").repartition(5)).collect()}
    for ticker, s in series.items():
        top, worst = None, None
        for _, c in s:
            top = c if top is None else max(top, c)
            if top > 0:
                worst = min(c / top - 1, 0.0 if worst is None else worst)
        assert got[ticker] == worst or abs(got[ticker] - worst) < 1e-12
