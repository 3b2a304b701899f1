import datetime as dt
import random

from valsieve.operators import fx


def test_rates_by_row_match_a_loop(spark):
    rng, base = random.Random(2), dt.date(2024, 1, 20)
    rates = [(c, base + dt.timedelta(days=d), rng.choice([None, float("nan"), rng.uniform(0.5, 2)])) for c in ("USD", "GBP") for d in rng.sample(range(90), 40)]
    rows = [(i, rng.choice(["USD", "usd", "GBP", "EUR", "XXX", None]), rng.choice([None, base + dt.timedelta(days=rng.randrange(-5, 95))]), float(i)) for i in range(400)]
    table = spark.createDataFrame(rates, "divisa string, fecha date, close double")
    df = spark.createDataFrame(rows, "id int, moneda string, dia date, x double").repartition(6)
    got = {r["id"]: (r["y"], r["y_fecha"]) for r in fx.to_eur_at(df, table, "moneda", "dia", "x", "y").collect()}
    assert len(got) == len(rows)
    for i, currency, day, x in rows:
        code = (currency or "").upper()
        if code == "EUR":
            assert got[i] == (x, None)
            continue
        fresh = [(d, v) for c, d, v in rates if c == code and day and v is not None and v == v and day - dt.timedelta(days=5) < d <= day]
        want = max(fresh) if fresh else None
        assert got[i] == ((x * want[1], want[0]) if want else (None, None))


def test_no_range_join_and_one_row_for_each_pair(spark):
    table = spark.createDataFrame([("USD", dt.date(2024, 1, 31), 0.9)], "divisa string, fecha date, close double")
    asked = spark.createDataFrame([("USD", dt.date(2024, 2, d)) for d in (1, 2, 3, 4, 5)], "divisa string, dia date")
    out = fx.rates_by_day(asked, table)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["dia"].day: r["tasa"] for r in out.collect()} == {1: 0.9, 2: 0.9, 3: 0.9, 4: 0.9, 5: None}
