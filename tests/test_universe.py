import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.errors import DiscoveryError, RefinementError, SelectionError, UniverseError
from valsieve.operators import discovery, listings, universe
from valsieve.plans import lifecycle
from valsieve.sources import readers, writers

REGIONS, SECTORS = list(S.DISCOVERY_QUOTAS), S.SECTORS


def digest(tickers):
    return hashlib.sha256(("\n".join(sorted(tickers)) + "\n").encode()).hexdigest()


def catalog_rows(seed, size=600):
    """A random catalog that a discovery could have published."""
    rng = random.Random(seed)
    regions, sectors = rng.sample(REGIONS, 4), rng.sample(SECTORS, 3)
    rows, n = [], 0
    for region in regions:
        for sector in sectors:
            quota = S.DISCOVERY_QUOTAS[region]
            for rank in sorted(rng.sample(range(1, quota + 1), rng.randint(1, quota))):
                rows.append((f"T{rng.randint(0, 10**6)}X{n}", "accion", region, sector, rank, quota, S.DISCOVERY_SOURCE, "2026-01-01",
                             REGIONS.index(region), SECTORS.index(sector)))
                n += 1
    return rows


LAYOUT = ("ticker string, tipo_activo string, region_descubrimiento string, sector_descubrimiento string, rank_bucket int, "
          "cuota_bucket int, fuente string, fecha_descubrimiento string, region_ord int, sector_ord int")


def loop_refill(rows, survivors, dropped):
    order = {r[0]: (r[8], r[9], r[4], r[0]) for r in rows}
    by = {r[0]: r for r in rows}
    used, out, pending = set(survivors), {}, []
    for slot in sorted(dropped, key=order.get):
        free = [r[0] for r in sorted(rows, key=lambda r: order[r[0]]) if r[2:4] == by[slot][2:4] and r[0] not in used and r[0] not in dropped]
        if free:
            used.add(free[0])
            out[slot] = (free[0], "mismo_bucket")
        else:
            pending.append(slot)
    for slot in pending:
        free = [r for r in rows if r[2] == by[slot][2] and r[0] not in used and r[0] not in dropped]
        free.sort(key=lambda r: (r[4] / r[5], r[4], r[9], r[0]))
        if free:
            used.add(free[0][0])
            out[slot] = (free[0][0], "misma_region")
        else:
            out[slot] = (None, "sin_reserva")
    return out


def test_refill_matches_a_loop(spark):
    """Many random catalogs in one run, told apart by a region prefix."""
    rows, kept, gone, want = [], [], [], {}
    for seed in range(12):
        rng = random.Random(100 + seed)
        part = [(f"{seed}-{r[0]}", r[1], f"{seed}-{r[2]}", *r[3:]) for r in catalog_rows(seed)]
        members = [r[0] for r in part if rng.random() < 0.75]
        dropped = {t for t in members if rng.random() < 0.35}
        survivors = [t for t in members if t not in dropped]
        rows += part
        kept += [(t,) for t in survivors]
        gone += [(t,) for t in dropped]
        want.update(loop_refill(part, survivors, dropped))
    random.Random(1).shuffle(rows)
    catalog = spark.createDataFrame(rows, LAYOUT).repartition(5)
    out = universe.refill(catalog, spark.createDataFrame(kept, "ticker string"), spark.createDataFrame(gone, "ticker string"))
    got = {r["removed_ticker"]: (r["replacement_ticker"], r["strategy"]) for r in out.collect()}
    assert got == want
    assert {s for _, s in got.values()} == {"mismo_bucket", "misma_region", "sin_reserva"}


def test_selection_matches_a_loop_and_ignores_order(spark):
    rows = catalog_rows(42)
    active = {r[0] for r in rows[::3]}
    want = {}
    for r in rows:
        quota = S.SELECTION_QUOTAS[r[2]]
        if r[4] <= quota:
            want[r[0]] = "balanced_rank_v1:cuota_base"
        elif r[4] <= quota + 3 and r[0] in active:
            want[r[0]] = "balanced_rank_v1:retencion_incumbente"
    incumbents = spark.createDataFrame([(t,) for t in active], "ticker string")
    results = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        selected = universe.select_universe(spark.createDataFrame(rows, LAYOUT).repartition(4), incumbents, "disc_x")
        results.append([tuple(r) for r in universe.members(selected).collect()])
    assert results[0] == results[1] and {r[0]: r[1] for r in results[0]} == want
    row = next(r for r in results[0] if r[0] == rows[0][0]) if rows[0][0] in want else results[0][0]
    assert row[4].startswith("disc_x; rank_bucket=")
    order = {r[0]: (r[8], r[9], r[4]) for r in rows}
    assert [r[0] for r in results[0]] == sorted(want, key=order.get)


def quotes(spark, rows):
    return spark.createDataFrame(rows, "region string, sector string, ticker string, price double, mcap_c long, volume long")


def test_discovery_keeps_first_bucket_and_ranks(spark):
    rows = [("us", "Technology", "BIG", 10.0, 300, 500), ("us", "Technology", "DUP", 10.0, 200, 500), ("us", "Technology", "CHEAP", 1.0, 900, 500),
            ("us", "Technology", "THIN", 10.0, 900, 5), ("es", "Technology", "DUP", 10.0, 900, 500), ("es", "Technology", "SOLO", 10.0, 100, 500),
            ("us", "Financial Services", "BANK", 10.0, 900, 500), ("zz", "Technology", "OTHER", 10.0, 900, 500)]
    config = discovery.DiscoveryConfig(perfil="prueba", cuotas_region={"us": 2, "es": 2}, sectores=("Technology",), volumen_medio_minimo=100)
    catalog, control = lifecycle.discover(quotes(spark, rows), config, "2026-01-01")
    got = [(r["ticker"], r["region_descubrimiento"], r["rank_bucket"]) for r in catalog.orderBy("region_ord", "rank_bucket").collect()]
    assert got == [("BIG", "us", 1), ("DUP", "us", 2), ("SOLO", "es", 2)]
    row = control.first()
    assert (row["resultados_brutos"], row["duplicados"], row["tickers_unicos"], row["capacidad_teorica"], row["publicable"]) == (4, 1, 3, 4, True)
    failed = spark.createDataFrame([("es", "Technology")], "region string, sector string")
    assert lifecycle.discover(quotes(spark, rows), config, "x", failed)[1].first()["publicable"] is False


def test_hot_bucket_is_pruned_before_the_shuffle(spark):
    rows = quotes(spark, [("us", "Technology", f"T{i}", 10.0, i, 500) for i in range(50)])
    plan = discovery.bucket_topn(rows, ["region", "sector"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    plan = listings.dedup_listings(rows.selectExpr("ticker", "ticker as nombre", "region as pais", "price as market_cap_eur"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_discovery_config():
    discovery.check_config(discovery.DiscoveryConfig())
    for bad in ({"cuotas_region": {"us": 1}}, {"sectores": ("a", "a")}, {"precio_minimo": -1}, {"umbral_buckets": 2}, {"reintentos": 0}):
        with pytest.raises(DiscoveryError):
            discovery.check_config(discovery.DiscoveryConfig(**bad))
    assert discovery.DiscoveryConfig().capacity() == 2070
    with pytest.raises(SelectionError):
        universe.check_selection_config(universe.SelectionConfig(sectores=("Energy",)))
    assert discovery.config_hash(universe.RefinementConfig()) == hashlib.sha256(
        b'{"exigir_cobertura_completa":true,"exigir_ejecucion_oficial":true,"fallback":"misma_region","perfil":"refine_observed_v1"}').hexdigest()


def test_hashes(spark):
    tickers = ["B", "A.MC", "C-1"]
    a = spark.createDataFrame([(t,) for t in tickers], "ticker string")
    b = spark.createDataFrame([(t,) for t in reversed(tickers)], "ticker string").repartition(3)
    assert discovery.member_hash(a).first()["sha256"] == discovery.member_hash(b).first()["sha256"] == digest(tickers)
    rows = catalog_rows(9)
    catalog = spark.createDataFrame(rows, LAYOUT)
    ordered = sorted(rows, key=lambda r: (r[8], r[9], r[4]))
    text = json.dumps([dict(zip(S.DISCOVERY_COLUMNS, map(str, r[:8]))) for r in ordered], ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert discovery.catalog_hash(catalog).first()["catalog_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert universe.adhoc_identity(a).first()["universe_id"] == "adhoc_" + digest(tickers)[:12]


def test_diff(spark):
    a = spark.createDataFrame([("AAA",), ("BBB.MC",)], "ticker string")
    b = spark.createDataFrame([("BBB.MC",), ("CCC",)], "ticker string")
    assert {tuple(r) for r in universe.diff(a, b).collect()} == {("AAA", "eliminado"), ("BBB.MC", "comun"), ("CCC", "anadido")}


def version(universe_id, status, tickers, **changes):
    row = dict(universe_id=universe_id, path=f"oficiales/{universe_id}.csv", status=status, created_at="2026-08-31T00:00:00Z",
               effective_from=None if status == "draft" else "2026-08-31", supersedes=None, asset_type="equity",
               ticker_count=len(tickers), sha256=digest(tickers), selection_method="manual", notes="")
    row.update(changes)
    return tuple(row.values())


def test_registry(spark):
    from valsieve.schemas import VERSIONS

    members = spark.createDataFrame([("uv_2026q3_r01", "AAA"), ("uv_2026q3_r01", "BBB"), ("uv_2026q3_r02", "BBB")], "universe_id string, ticker string")
    good = spark.createDataFrame([version("uv_2026q3_r01", "active", ["AAA", "BBB"]), version("uv_2026q3_r02", "draft", ["BBB"], supersedes="uv_2026q3_r01")], VERSIONS)
    assert universe.registry_violations(good, members, "uv_2026q3_r01").count() == 0
    bad = spark.createDataFrame([version("uv_2026q3_r01", "active", ["AAA"]), version("uv_2026q3_r02", "active", ["BBB"], supersedes="no")], VERSIONS)
    got = {tuple(r) for r in universe.registry_violations(bad, members, "uv_2026q3_r01").collect()}
    assert got == {("uv_2026q3_r01", "recuento_incoherente"), ("uv_2026q3_r01", "hash_incoherente"),
                   ("uv_2026q3_r02", "reemplazo_invalido"), ("uv_2026q3_r01", "activo_ambiguo")}
    after = {r["universe_id"]: (r["status"], r["effective_from"]) for r in universe.activate(good, "uv_2026q3_r02", "2026-09-01").collect()}
    assert after == {"uv_2026q3_r01": ("retired", "2026-08-31"), "uv_2026q3_r02": ("active", "2026-09-01")}
    with pytest.raises(UniverseError):
        universe.activate(good, "uv_2026q3_r09", "x")
    retired = universe.activate(good, "uv_2026q3_r02", "2026-09-01")
    with pytest.raises(UniverseError):
        universe.activate(retired, "uv_2026q3_r01", "x")
    assert {r["ticker"] for r in universe.resolve(good, members).collect()} == {"AAA", "BBB"}
    assert {r["ticker"] for r in universe.resolve(good, members, "uv_2026q3_r02").collect()} == {"BBB"}
    changes = universe.diff_by_reference(members, "uv_2026q3_r01", "uv_2026q3_r02")
    assert {tuple(r) for r in changes.collect()} == {("AAA", "eliminado"), ("BBB", "comun")}


def test_member_files(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text(",".join(S.UNIVERSE_COLUMNS) + "\nAAA,legacy,,,\nBBB.MC,legacy,,,\n")
    assert readers.read_universe_members(spark, str(good), strict=True).count() == 2
    for name, text in {"dup.txt": "AAA\nAAA\n", "low.txt": "aaa\n", "bad.txt": "A B\n", "blank.csv": "ticker\n\"\"\n"}.items():
        (tmp_path / name).write_text(text)
        with pytest.raises(UniverseError):
            readers.read_universe_members(spark, str(tmp_path / name))
    with pytest.raises(ValueError):
        readers.read_universe_members(spark, str(tmp_path / "blank.csv"), strict=True)
    rows = readers.read_universe_members(spark, str(good))
    writers.write_ticker_list(rows, str(tmp_path / "list"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "list")).collect()] == ["AAA", "BBB.MC"]
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps({"schema_version": 1, "active_universe_id": "uv_2026q3_r01", "universes": [
        dict(zip(S.VERSION_FIELDS, version("uv_2026q3_r01", "active", ["AAA"])))]}, indent=2))
    assert readers.read_manifest(spark, str(manifest)).first()["ticker_count"] == 1


def full_quotes(spark):
    rows = spark.range(22 * 9 * 40).select(
        F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (F.col("id") % 22 + 1).cast("int")).alias("region"),
        F.element_at(F.array(*[F.lit(s) for s in SECTORS]), (F.floor(F.col("id") / 22) % 9 + 1).cast("int")).alias("sector"),
        F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"), F.lit(10.0).alias("price"),
        (F.col("id") * 7919 % 100003).alias("mcap_c"), F.lit(500_000).cast("long").alias("volume"))
    return rows


def test_life_cycle(spark, tmp_path):
    catalog, control = lifecycle.discover(full_quotes(spark), discovery.DiscoveryConfig(), "2026-01-01T00:00:00+00:00")
    row = control.first()
    assert (row["tickers_unicos"], row["buckets_exitosos"], row["duplicados"]) == (2070, 198, 0)
    writers.write_discovery(catalog, control, str(tmp_path), "disc_20260101T000000000000Z")
    ids = [r["ticker"] for r in catalog.select("ticker").collect()]
    meta = {"schema_version": 1, "discovery_id": "disc_20260101T000000000000Z", "sha256": digest(ids),
            "catalog_sha256": discovery.catalog_hash(catalog).first()["catalog_sha256"],
            "config": {"perfil": "p", "cuotas_region": S.DISCOVERY_QUOTAS, "sectores": SECTORS}, "control": {"tickers_unicos": 2070}}
    (tmp_path / "meta.json").write_text(json.dumps(meta))
    csv = str(tmp_path / "disc_20260101T000000000000Z.csv")
    loaded, _ = readers.read_discovery(spark, csv, str(tmp_path / "meta.json"))
    assert loaded.count() == 2070
    (tmp_path / "tampered.json").write_text(json.dumps({**meta, "catalog_sha256": "0" * 64}))
    with pytest.raises(SelectionError, match="catalog hash"):
        readers.read_discovery(spark, csv, str(tmp_path / "tampered.json"))
    incumbents = catalog.where("rank_bucket % 5 = 0 and region_descubrimiento = 'us' and sector_descubrimiento = 'Energy'").select("ticker")
    draft = lifecycle.draft_from_catalog(catalog, incumbents, "uv_2026q3_r02", "uv_2026q3_r01", "disc_x", "2026-01-02")
    summary, made = draft.summary.first(), draft.version.first()
    assert summary["seleccion_base"] == sum(S.SELECTION_QUOTAS.values()) * 9 and summary["tamano_valido"]
    assert json.loads(draft.audit.first()["json"])["summary"]["altas"] == summary["altas"]
    registry = str(tmp_path / "registry")
    assert writers.write_universe_members(draft.members, draft.version, str(tmp_path), registry).count() == 1
    with pytest.raises(UniverseError):
        writers.write_universe_members(draft.members, draft.version, str(tmp_path), registry)
    stored = readers.read_universe_members(spark, str(tmp_path / made["path"]), strict=True)
    assert stored.count() == made["ticker_count"]
    observed = stored.where(F.abs(F.hash("ticker")) % 9 != 0).select("ticker")
    seen, total = observed.count(), stored.count()
    control_row = spark.createDataFrame([(True, made["sha256"], total, total, total, 0, total - seen, seen)],
        "oficial boolean, universe_sha256 string, tickers_solicitados long, resultados_brutos long, descargas_correctas long, errores_descarga long, deduplicados long, empresas_evaluadas long")
    refined = lifecycle.refined_draft(catalog, stored, observed, control_row, "uv_2026q3_r03", "uv_2026q3_r02", "disc_x", "snap_x", "2026-01-03")
    final = refined.summary.first()
    assert final["tickers_finales"] == total and final["rellenos_mismo_bucket"] == total - seen and refined.members.count() == total
    with pytest.raises(RefinementError):
        lifecycle.refined_draft(catalog, stored, observed, control_row.withColumn("oficial", F.lit(False)), "u", "v", "d", "s", "t")
    with pytest.raises(SelectionError):
        lifecycle.draft_from_catalog(catalog.limit(10), incumbents, "uv_2026q3_r09", "x", "d", "t")


def test_asset_kinds(spark):
    rows = spark.createDataFrame([
        ("dk", "Health", "E1", 5.0, 10, 500_000), ("dk", "Equity Energy", "E2", 5.0, 30, 500_000), ("dk", "Energy Limited Partnership", "E3", 5.0, 20, 500_000),
        ("se", "Health", "E1", 5.0, 99, 500_000), ("dk", "Health", "E4", 5.0, 99, 1)], "region string, category string, ticker string, price double, mcap_c long, volume long")
    got = [(r["ticker"], r["categoria"], r["region"], r["rank_bucket"]) for r in discovery.asset_catalog(rows, "etf", ["dk", "se"]).orderBy("ticker").collect()]
    assert got == [("E1", "Healthcare", "dk", 1), ("E2", "Energy", "dk", 1), ("E3", "Energy", "dk", 2)]
    with pytest.raises(ValueError):
        discovery.asset_catalog(rows, "fondo")
    with pytest.raises(ValueError):
        discovery.asset_catalog(rows, "bono", categories={"a": ["a"]})
    assert discovery.asset_catalog(rows, "fondo", categories={"Salud": ["Health"]}).count() == 2
