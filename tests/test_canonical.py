import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from valsieve.functions.canonical import canonical_json
from valsieve.operators import discovery

NESTED = "z int, a struct<y: string, b: map<string, array<double>>, c: boolean>, m map<string, struct<k: bigint, A: string>>, `é` string"


def as_json(row):
    def plain(x):
        if hasattr(x, "asDict"):
            return {k: plain(v) for k, v in x.asDict().items()}
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x
    return json.dumps(plain(row), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_nested_values_match_the_json_module(spark):
    odd = "".join(map(chr, range(33))) + "\\u000B \"quoted\" / é 漢 \x7f"
    rows = [
        (1, ("t", {"b": [1.0, None, 0.05], "B": [], "Á": [1e-5, 1.5e16, -2.0, 123456789.125, 0.0, -0.0, 1e300, 1e-300]}, True), {"q": (7, "x"), "p": (None, None)}, odd),
        (None, None, {}, None), (-3, ("", {}, None), None, ""),
        (0, ("\\n", {"": [9007199254740993.0, 1e15, 9.99e15, 0.0001, 0.00012345678901234567, float("inf"), float("nan")]}, False), {"\n\"": (0, "\\")}, "a\\"),
    ]
    df = spark.createDataFrame(rows, NESTED)
    out = df.withColumn("json", canonical_json(F.struct(*df.columns), df.schema))
    for row in out.collect():
        assert row["json"] == as_json(row.asDict() and {k: row[k] for k in df.columns})


def test_other_types_are_refused(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),)], "d date")
    with pytest.raises(TypeError):
        canonical_json(F.col("d"), df.schema["d"].dataType)


def test_config_hashes_equal_the_function(spark):
    configs = [discovery.DiscoveryConfig(), discovery.DiscoveryConfig(perfil='a"\\é', cuotas_region={"us": 3, "de": 1}, sectores=("B", "A"), precio_minimo=0.1, umbral_buckets=1.0)]
    rows = [(c.perfil, dict(reversed(list(c.cuotas_region.items()))), list(c.sectores), float(c.precio_minimo), c.volumen_medio_minimo, c.umbral_buckets, c.reintentos, "extra")
            for c in configs]
    df = spark.createDataFrame(rows, "perfil string, cuotas_region map<string, int>, sectores array<string>, precio_minimo double, volumen_medio_minimo bigint, umbral_buckets double, reintentos int, config_json string")
    got = [r["config_sha256"] for r in discovery.config_hashes(df).collect()]
    text = df.select("perfil").count() and [json.dumps({**c.__dict__, "cuotas_region": dict(c.cuotas_region), "sectores": list(c.sectores), "precio_minimo": float(c.precio_minimo)},
                                                       ensure_ascii=False, sort_keys=True, separators=(",", ":")) for c in configs]
    assert got == [hashlib.sha256(t.encode()).hexdigest() for t in text]
    same = discovery.DiscoveryConfig(perfil='a"\\é', cuotas_region={"de": 1, "us": 3}, sectores=["B", "A"], precio_minimo=0.1, umbral_buckets=1.0)
    assert discovery.config_hash(same) == got[1]
