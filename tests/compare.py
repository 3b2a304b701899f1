"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, float)):
        return ("n", round(float(value), 6) + 0.0)
    return ("s", str(value))


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(shaped, key=repr)


def kind(dtype: str) -> str:
    d = dtype.lower()
    if "bool" in d:
        return "bool"
    if any(x in d for x in ("int", "long", "short")):
        return "int:" + ("big" if "big" in d else "small" if d in ("int", "integer") else d)
    if "double" in d or "float" in d:
        return "double"
    if "varchar" in d or "string" in d:
        return "text"
    return d


def compare(spark, con, folder, name, queries, oracles):
    """(problem or None, rows, spark seconds)."""
    started = time.time()
    df = queries[name](spark, folder)
    rows = df.collect()
    seconds = time.time() - started
    columns, got = normalised(df.columns, [tuple(r) for r in rows])
    if name not in oracles:
        return None, len(got), seconds
    cursor = con.execute(oracles[name])
    described = cursor.description
    sql_columns, want = normalised([d[0] for d in described], cursor.fetchall())
    if columns != sql_columns:
        return f"columns {columns} vs {sql_columns}", len(got), seconds
    kinds = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    sql_kinds = {d[0]: kind(str(d[1])) for d in described}
    if kinds != sql_kinds:
        return f"types {[(c, kinds[c], sql_kinds[c]) for c in kinds if kinds[c] != sql_kinds[c]]}", len(got), seconds
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", len(got), seconds
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} rows differ, e.g. {columns} {bad[0]}", len(got), seconds
    return None, len(got), seconds
