import random
import statistics
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from valsieve.operators import ordering
from valsieve.session import stage_table, staging_scope


def sample(seed, n=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if rng.random() < 0.6 else rng.choice("abc")
        kind = rng.random()
        value = (None if kind < 0.05 else 7.5 if kind < 0.35 else rng.uniform(-3, 3) if kind < 0.6
                 else rng.lognormvariate(2, 3) * rng.choice([1, -1]))
        rows.append((f"t{i}", group, value))
    return rows


def test_grouped_median_matches_brute_force(spark):
    rows = sample(1) + [("x1", "uno", 4.0), ("x2", "dos", 1.0), ("x3", "dos", 9.0), ("x4", "nada", None)]
    df = spark.createDataFrame(rows, "ticker string, g string, v double").repartition(7)
    counts = ordering.value_counts(df, ["g"], "v")
    got = {r["g"]: (r["m"], r["n"]) for r in ordering.grouped_median(counts, ["g"], "v", "m", "n").collect()}
    values = {}
    for _, g, v in rows:
        if v is not None:
            values.setdefault(g, []).append(v)
    assert got == {g: (statistics.median(v), len(v)) for g, v in values.items()}


def test_coarser_median_from_finer_counts(spark):
    rows = sample(2)
    df = spark.createDataFrame(rows, "ticker string, g string, v double").withColumn("todo", F.lit("x"))
    counts = ordering.value_counts(df, ["todo", "g"], "v")
    row = ordering.grouped_median(counts, ["todo"], "v", "m", "n").first()
    values = [v for _, _, v in rows if v is not None]
    assert (row["m"], row["n"]) == (statistics.median(values), len(values))


def test_average_ranks_match_pandas(spark):
    rows = sample(3)
    df = spark.createDataFrame(rows, "ticker string, g string, v double").repartition(5)
    out = ordering.attach_descending_ranks(df, {"v": "r"}).toPandas().set_index("ticker")["r"].to_dict()
    frame = pd.DataFrame(rows, columns=["ticker", "g", "v"])
    want = dict(zip(frame["ticker"], frame["v"].rank(ascending=False, na_option="bottom")))
    assert out == want


def test_positions_are_a_numbering(spark):
    rows = sample(4, 800)
    df = spark.createDataFrame(rows, "ticker string, g string, v double")
    got = {(r["g"], r["ticker"]): r["posicion"] for r in ordering.positions(df, ["g"], "v", ["ticker"]).collect()}
    want = {}
    for group in {r[1] for r in rows}:
        ordered = sorted((r for r in rows if r[1] == group), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
        want.update({(group, r[0]): i for i, r in enumerate(ordered, 1)})
    assert got == want


def test_bucket_is_monotone(spark):
    values = sorted(random.Random(5).uniform(-1, 1) * 10 ** random.Random(i).randint(-300, 300) for i in range(500))
    df = spark.createDataFrame([(v,) for v in [float("-inf"), *values, float("inf")]], "v double").coalesce(1)
    buckets = [r["b"] for r in df.select(ordering.value_bucket("v").alias("b")).collect()]
    assert buckets == sorted(buckets)


def test_a_staging_scope_removes_only_its_own_tables(spark):
    df = spark.range(5)
    kept = stage_table(df, "kept")
    with staging_scope(spark) as folder:
        staged = stage_table(df, "inside")
        with staging_scope(spark) as same:
            assert same == folder
        assert staged.count() == 5 and all(folder in f for f in staged.inputFiles())
    assert not Path(folder).exists() and kept.count() == 5


def test_positions_with_missing_scores_keep_ranges_small(spark):
    rng = random.Random(9)
    rows = [(f"t{i:05d}", rng.choice("ab"), None if rng.random() < 0.9 else rng.choice([1.0, 2.0, rng.random()])) for i in range(8000)]
    rows += rows[:50]  # repeated rows
    df = spark.createDataFrame(rows, "ticker string, g string, v double").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = df.repartitionByRange("g", F.asc_nulls_last("v"), "ticker").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in placed) < 3 * len(rows) / 16
        got = sorted(tuple(r) for r in ordering.positions(df, ["g"], "v", ["ticker"]).select("g", "posicion", "ticker").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    want = []
    for g in "ab":
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, r[2] or 0.0, r[0]))
        want += [(g, i + 1, r[0]) for i, r in enumerate(own)]
    assert got == sorted(want)
