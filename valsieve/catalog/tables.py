"""Domain tables derived by Spark from the star-schema parquet tables.

The screening jobs take DataFrames with the domain schemas.  For benchmarks
and correctness checks the same shapes are derived from ``part``,
``lineitem``, ``supplier``, ``nation`` and ``events``, whole tables every
time, so the work grows with them.  ``oracle.py`` holds the SQL counterpart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.operators.discovery import DiscoveryConfig, discover, member_hash
from valsieve.operators.universe import select_universe
from valsieve.session import stage_table

# A country and a market code for each of the 25 nations.
COUNTRIES = [
    "United States", "Canada", "United Kingdom", "Germany", "France",
    "Netherlands", "Switzerland", "Spain", "Italy", "Sweden", "Denmark",
    "Norway", "Finland", "Japan", "Australia", "New Zealand", "Singapore",
    "Hong Kong", "China", "South Korea", "Brazil", "Mexico", "India",
    "Portugal", "Ireland",
]
MARKETS = S.NAMED_UNIVERSES["desarrollados_aproximado"] + ["br", "mx", "in"]
CAP_FLOOR = {"market_cap_eur_min": 20000.0}
VOLUME_FLOOR = 20
TODAY = "2002-12-31"
DISCOVERY_ID = "disc_20240201T000000000000Z"
CREATED_AT = "2024-02-01T00:00:00+00:00"
OBSERVED = "snap_20240201T000000000000Z"


def pick(values: list[str], index) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


class Tables:
    """The derived tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- listings and fundamentals -----------------------------------------
    def listing(self) -> DataFrame:
        pk, quote = F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, "USD").otherwise("EUR")
        error = F.when(pk % 29 == 0, "Timeout: no response").otherwise("")
        suffix = (
            F.when(F.col("p_size") % 4 == 0, " plc").when(F.col("p_size") % 4 == 1, " Inc.")
            .when(F.col("p_size") % 4 == 2, " AG").otherwise("")
        )
        return self.raw("part").select(
            pk.alias("pk"), F.concat(F.lit("T"), pk.cast("string")).alias("ticker"),
            F.when(pk % 29 == 0, "").otherwise(F.concat("p_name", suffix)).alias("nombre"),
            F.col("p_type").alias("sector"), pick(COUNTRIES, pk % 25).alias("pais"),
            "p_size", "p_retailprice", error.alias("error_descarga"),
            quote.alias("divisa_cotizacion"),
            F.when(pk % 17 == 0, "GBP").otherwise(quote).alias("divisa_financiera"),
        )

    def yearly(self) -> DataFrame:
        """Statement totals per listing and year, summed in whole cents."""
        c, d, t = F.col("c"), F.col("d"), F.col("t")
        lines = self.raw("lineitem").select(
            F.col("l_partkey").alias("pk"), F.year("l_shipdate").alias("y"),
            cents("l_extendedprice").alias("c"), cents("l_discount").alias("d"),
            cents("l_tax").alias("t"),
        )

        def total(expression: Column, scale: float) -> Column:
            return F.sum(expression).cast("double") / scale

        return lines.groupBy("pk", "y").agg(
            total(c, 1e2).alias("ingresos"), total(c * (d + t), 1e4).alias("ebit"),
            total(c * (d + 2 * t), 1e4).alias("ebitda"), total(c * (d - 2), 1e4).alias("net_income"),
            total(c * (d - 1), 1e4).alias("free_cash_flow"), total(c * (t + 2), 4e4).alias("total_debt_u"),
            total(c * d, 2e4).alias("cash_u"), total(c * (20 + d), 1e4).alias("equity_u"),
        )

    def last_years(self) -> DataFrame:
        """Per listing: newest year, the year before it and the oldest one.

        One shuffle by listing over the yearly totals; a listing has one row
        per calendar year.
        """
        by_year = Window.partitionBy("pk").orderBy("y")
        balance = F.struct("total_debt_u", "cash_u", "equity_u")
        rows = self.yearly().withColumn(
            "prev", F.when(F.lag("y").over(by_year) == F.col("y") - 1, F.lag(balance).over(by_year)))
        newest = F.struct(*[F.col(c) for c in rows.columns if c != "pk"])
        return rows.groupBy("pk").agg(
            F.max_by(newest, "y").alias("a"), F.min("y").alias("y0"),
            F.min_by("ingresos", "y").alias("ingresos_ini"),
        )

    def fundamentals(self) -> DataFrame:
        rows = self.listing().join(self.last_years(), "pk", "left")
        pk, ok = F.col("pk"), F.col("error_descarga") == ""
        cap = F.col("a.ingresos") * F.col("p_size") / 6e1
        year_end = F.make_date("a.y", F.lit(12), F.lit(31))
        return rows.select(
            "ticker", "nombre", "sector", "pais", "divisa_cotizacion", "divisa_financiera",
            ((F.col("divisa_cotizacion") == F.col("divisa_financiera")) & ok).alias("divisa_consistente"),
            "error_descarga",
            F.when(~ok, "error").when(pk % 13 == 0, "revisar").otherwise("ok").alias("calidad_datos"),
            F.when(ok, cap).alias("market_cap"),
            F.when(ok, F.when(F.col("divisa_cotizacion") == "USD", cap * 9e-1).otherwise(cap)).alias("market_cap_eur"),
            *[F.col(f"a.{c}").alias(c) for c in ("net_income", "ebit", "ebitda", "ingresos")],
            F.col("ingresos_ini").alias("ingresos_inicio_historico"),
            F.col("a.ingresos").alias("ingresos_fin_historico"),
            F.when(F.col("a.y") > F.col("y0"), F.col("a.y") - F.col("y0")).cast("double").alias("anios_historico"),
            F.col("a.free_cash_flow").alias("free_cash_flow"),
            *[F.col(f"a.{c}_u").alias(c) for c in ("total_debt", "cash", "equity")],
            *[F.col(f"a.prev.{c}_u").alias(f"{c}_inicio") for c in ("total_debt", "cash", "equity")],
            F.when(pk % 13 == 0, F.lit(None)).when(pk % 11 == 0, F.lit(0.0))
            .otherwise(F.col("a.ebit") * (pk % 5) / 1e1).alias("gasto_intereses"),
            F.lit(0.25).alias("tasa_impositiva"),
            F.lit("primario").alias("proveedor_datos"),
            F.when(pk % 7 == 0, "ANUAL").when(pk % 37 == 0, "").otherwise("TTM").alias("tipo_periodo"),
            year_end.cast("string").alias("fecha_resultados"),
            F.when(pk % 19 == 0, F.make_date("a.y", F.lit(9), F.lit(30)))
            .otherwise(year_end).cast("string").alias("fecha_flujo_caja"),
            F.when(pk % 41 == 0, F.lit("pendiente")).otherwise(year_end.cast("string")).alias("fecha_balance"),
        )

    def observations(self) -> DataFrame:
        """The fundamentals written once: the form in which they are stored.

        Queries that read them in several passes start here.
        """
        return stage_table(self.fundamentals(), "fundamentals")

    def secondary(self, fundamentals: DataFrame | None = None) -> DataFrame:
        """A second, independent source for the same listings."""
        f = self.fundamentals() if fundamentals is None else fundamentals
        pk = F.substring("ticker", 2, 20).cast("bigint")
        factor = 1 + (pk % 7) * 0.05
        concepts = F.create_map(
            F.lit("ingresos"), F.lit("Revenues"),
            F.lit("ebit"), F.lit("OperatingIncomeLoss"),
            F.lit("net_income"), F.when(pk % 2 == 0, "ProfitLoss").otherwise("NetIncomeLoss"),
            F.lit("free_cash_flow"), F.lit("CFO - abs(Capex)"),
            F.lit("total_debt"), F.when(pk % 5 == 0, "OtherDebt").otherwise("LongTermDebt"),
        )
        shifted = F.date_add(F.col("fecha_resultados").cast("date"), 60).cast("string")
        return f.where(pk % 9 != 0).select(
            "ticker", F.lit("secundario").alias("proveedor_datos"),
            F.when(pk % 17 == 0, "CHF").otherwise(F.col("divisa_financiera")).alias("divisa_financiera"),
            F.when(pk % 23 == 0, "ANUAL").otherwise(F.col("tipo_periodo")).alias("tipo_periodo"),
            *[(F.col(c) * factor).alias(c) for c in S.COMPARED_FIELDS],
            F.when(pk % 11 == 0, shifted).otherwise(F.col("fecha_resultados")).alias("fecha_resultados"),
            "fecha_flujo_caja", "fecha_balance",
            F.when(pk % 31 == 0, "HTTPError: 404").otherwise("").alias("error_descarga"),
            F.concat(F.lit("https://filings.example/"), F.col("ticker")).alias("url_fuente"),
            concepts.alias("conceptos_fuente"),
        )

    # --- raw statements and filings ----------------------------------------
    def statements(self) -> DataFrame:
        """Long form: (ticker, statement, basis, concept, period_end, value)."""
        pk, y = F.col("pk"), F.col("y")
        by_year = Window.partitionBy("pk")
        rows = self.yearly().withColumn("y1", F.max("y").over(by_year))

        def cell(statement, basis, concept, value, present=None):
            item = F.struct(F.lit(statement).alias("statement"), F.lit(basis).alias("basis"),
                            concept.alias("concept"), value.cast("double").alias("value"))
            return item if present is None else F.when(present, item)

        income = [
            (F.lit("Total Revenue"), F.col("ingresos")),
            (F.when(pk % 4 == 0, "Operating Income").otherwise("EBIT"), F.col("ebit")),
            (F.lit("Net Income"), F.col("net_income")),
            (F.lit("EBITDA"), F.col("ebitda")),
            (F.lit("Interest Expense"), F.when(pk % 13 != 0, F.col("ebit") * (pk % 5) / 10)),
            (F.lit("Interest Expense Non Operating"), F.col("ebit") * 0.1),
            (F.lit("Tax Provision"), F.col("ebit") * (pk % 8) / 10),
            (F.lit("Pretax Income"), F.col("ebit")),
        ]
        latest_income, latest_cash = (y == F.col("y1")) & (pk % 7 != 0), (y == F.col("y1")) & (pk % 6 != 0)
        cells = [cell("resultados", "ANUAL", c, v) for c, v in income]
        cells += [cell("resultados", "TTM", c, v * 1.1, latest_income) for c, v in income]
        cells += [
            cell("flujo_caja", "ANUAL", F.lit("Free Cash Flow"), F.col("free_cash_flow")),
            cell("flujo_caja", "TTM", F.lit("Free Cash Flow"), F.col("free_cash_flow") * 1.1, latest_cash),
            cell("balance", "ANUAL", F.lit("Total Debt"), F.col("total_debt_u")),
            cell("balance", "ANUAL", F.when(pk % 3 == 0, "Cash").otherwise("Cash And Cash Equivalents"), F.col("cash_u")),
            cell("balance", "ANUAL", F.lit("Cash"), F.col("cash_u") * 0.5, pk % 3 != 0),
            cell("balance", "ANUAL", F.lit("Stockholders Equity"), F.when(pk % 5 != 0, F.col("equity_u"))),
            cell("balance", "ANUAL", F.lit("Total Equity Gross Minority Interest"), F.col("equity_u") * 1.2),
        ]
        return (
            rows.select(F.concat(F.lit("T"), pk.cast("string")).alias("ticker"),
                        F.make_date("y", F.lit(12), F.lit(31)).alias("period_end"),
                        F.explode(F.array(*cells)).alias("s"))
            .where(F.col("s").isNotNull()).select("ticker", "s.statement", "s.basis", "s.concept", "period_end", "s.value")
        )

    def filings(self) -> DataFrame:
        """One JSON document per filer: taxonomy, concept, unit, facts."""
        years = F.sort_array(F.collect_list(F.struct("y", "ingresos", "net_income", "ebit",
                                                     "free_cash_flow", "total_debt_u", "cash_u", "equity_u")))
        docs = self.yearly().groupBy("pk").agg(years.alias("ys"))
        pk = F.col("pk")
        unit = F.when(pk % 3 == 0, "EUR").otherwise("USD")

        def facts(value, instant=False, quarter=False):
            def fact(r):
                start = F.lit(None).cast("string") if instant else F.concat(
                    r["y"].cast("string"), F.lit("-10-01" if quarter else "-01-01"))
                return F.struct(
                    start.alias("start"), F.concat(r["y"].cast("string"), F.lit("-12-31")).alias("end"),
                    value(r).cast("double").alias("val"),
                    F.when((pk + r["y"]) % 6 == 0, "10-Q").otherwise("10-K").alias("form"),
                    F.when((pk + r["y"]) % 7 == 0, "Q4").otherwise("FY").alias("fp"),
                    F.concat((r["y"] + 1).cast("string"), F.lit("-03-01")).alias("filed"))
            return F.transform("ys", fact)

        def concept(unit_column, array):
            return F.struct(F.create_map(unit_column, array).alias("units"))

        gaap = F.create_map(
            F.lit("Revenues"), concept(unit, facts(lambda r: r["ingresos"])),
            F.lit("SalesRevenueNet"), concept(F.lit("JPY"), facts(lambda r: r["ingresos"] * 2, quarter=True)),
            F.lit("NetIncomeLoss"), concept(F.when(pk % 10 == 0, "GBP").otherwise(unit), facts(lambda r: r["net_income"])),
            F.lit("OperatingIncomeLoss"), concept(unit, facts(lambda r: r["ebit"])),
            F.lit("NetCashProvidedByUsedInOperatingActivities"), concept(unit, facts(lambda r: r["free_cash_flow"] * 2)),
            F.lit("PaymentsToAcquirePropertyPlantAndEquipment"), concept(unit, facts(lambda r: -r["free_cash_flow"])),
            F.lit("LongTermDebt"), concept(unit, facts(lambda r: r["total_debt_u"], instant=True)),
            F.lit("CashAndCashEquivalentsAtCarryingValue"), concept(unit, facts(lambda r: r["cash_u"], instant=True)),
            F.lit("StockholdersEquity"), concept(unit, facts(lambda r: r["equity_u"], instant=True)),
        )
        ifrs = F.create_map(F.lit("ProfitLoss"), concept(unit, facts(lambda r: r["net_income"] * 1.5)))
        body = F.struct(
            F.concat(F.lit("Filer "), pk.cast("string")).alias("entityName"),
            F.create_map(F.lit("us-gaap"), gaap, F.lit("ifrs-full"), ifrs).alias("facts"))
        return docs.select(pk.alias("cik"), F.to_json(body).alias("document"))

    def stored_filings(self) -> DataFrame:
        """The documents written once, as they would be stored."""
        return stage_table(self.filings(), "filings")

    def stored_statements(self) -> DataFrame:
        """The statement rows written once, as they would be stored."""
        return stage_table(self.statements(), "statements")

    def filer_ids(self) -> DataFrame:
        pk = F.col("p_partkey")
        return self.raw("part").where(pk % 10 != 4).select(
            F.concat(F.lit("T"), pk.cast("string")).alias("ticker"), pk.alias("cik"))

    # --- journal, control table, prices ------------------------------------
    def day_events(self) -> DataFrame:
        """Last event of each user and day.

        ``row_number = 1`` is pruned before the shuffle, so a very active user
        does not fill one task.
        """
        last = Window.partitionBy("user_id", "dia").orderBy(F.desc("ts"), F.desc("event_id"))
        return (
            self.raw("events").withColumn("dia", F.to_date("ts"))
            .withColumn("rn", F.row_number().over(last)).where(F.col("rn") == 1).drop("rn")
        )

    def journal(self) -> DataFrame:
        user, value = F.col("user_id"), F.col("value")
        failed = F.col("event_type") == "error"
        return self.day_events().select(
            F.concat(F.lit("snap_"), F.col("dia").cast("string")).alias("snapshot_id"),
            F.col("dia").cast("timestamp").alias("fecha_ejecucion"), "dia",
            F.concat(F.lit("U"), user.cast("string")).alias("ticker"),
            F.concat(F.lit("Compañía "), user.cast("string")).alias("nombre"),
            pick(S.SECTORS, user % 9).alias("sector"), pick(list(S.COMPARABLE_REGIONS), user % 4).alias("region"),
            F.when(failed, "Timeout: no response").otherwise("").alias("error_descarga"),
            ((value > 20) & ~failed).alias("pasa"), value.alias("per"), (value / 2).alias("ev_ebit"),
            (value / 100).alias("roic"), F.when(value > 20, F.round(value * 2)).alias("puntuacion"),
        )

    def snapshots(self) -> DataFrame:
        """The distinct snapshots: one small row per day on file."""
        return self.raw("events").select(F.to_date("ts").alias("dia")).distinct()

    def runs(self) -> DataFrame:
        week = F.date_trunc("week", "dia")
        in_week = Window.partitionBy(week).orderBy("dia")
        return self.snapshots().where(F.col("dia") >= F.lit("2024-01-04").cast("date")).select(
            F.concat(F.lit("snap_"), F.col("dia").cast("string")).alias("snapshot_id"),
            F.col("dia").cast("timestamp").alias("fecha_ejecucion"),
            week.cast("date").alias("semana"),
            (F.dayofmonth("dia") % 3 != 0).alias("oficial"),
            F.row_number().over(in_week).alias("revision"),
        )

    def prices(self) -> DataFrame:
        return self.day_events().where(F.col("event_type") != "error").select(
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
            F.col("dia").alias("fecha"), (50 + F.col("value")).alias("close"),
        )

    def stored_prices(self) -> DataFrame:
        """The closes written once, as they would be stored."""
        return stage_table(self.prices(), "prices")

    def tracking(self) -> DataFrame:
        """Computed returns, several per signal and some repeated."""
        dia = F.to_date("ts")
        return self.raw("events").select(
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
            F.date_trunc("week", "ts").cast("date").alias("fecha_entrada"),
            dia.alias("fecha_calculo"),
            F.when(F.col("event_type") != "error", F.col("value") / 50 - 1).alias("retorno_total"),
            F.col("event_id").alias("orden"),
        )

    def fx(self) -> DataFrame:
        """Daily closes of three currencies against EUR, from the events."""
        dia = F.to_date("ts")
        return (
            self.raw("events").where(F.col("event_type") != "error")
            .groupBy(dia.alias("fecha"), pick(["USD", "GBP", "JPY"], F.col("user_id") % 3).alias("divisa"))
            .agg((F.floor(F.max(cents("value")) / 100) / 1000 + 0.5).alias("close"))
        )

    # --- quotes, discovery, universes --------------------------------------
    def quotes(self) -> DataFrame:
        """Listings by market and sector with price, volume and size."""
        suppliers = self.raw("supplier").select("s_suppkey", "s_nationkey")
        parts = self.raw("part").select("p_partkey", "p_retailprice")
        lines = (
            self.raw("lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("l_partkey", "s_nationkey")
            .agg(F.sum(cents("l_extendedprice")).alias("mcap_c"),
                 F.sum(F.col("l_quantity").cast("bigint")).alias("volume"))
        )
        return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
            pick(MARKETS, F.col("s_nationkey")).alias("region"),
            pick(S.SECTORS, F.col("p_partkey") % 9).alias("sector"),
            F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("ticker"),
            F.col("p_retailprice").alias("price"), "mcap_c", "volume",
        )

    def fund_quotes(self) -> DataFrame:
        """Quotes of three asset kinds; ETF and fund categories are themes."""
        themes = [name for names in S.ETF_THEMES.values() for name in names]
        pk = F.substring("ticker", 2, 20).cast("bigint")
        kind = F.when(pk % 3 == 0, "etf").when(pk % 3 == 1, "fondo").otherwise("accion")
        return self.quotes().select(
            kind.alias("tipo_activo"), "region",
            F.when(kind == "accion", F.col("sector")).otherwise(pick(themes, pk % len(themes))).alias("category"),
            "ticker", "price", "mcap_c", "volume",
        )

    def incumbents(self) -> DataFrame:
        """The members of the active universe."""
        pk = F.col("p_partkey")
        return self.raw("part").where(pk % 4 == 0).select(
            F.concat(F.lit("T"), pk.cast("string")).alias("ticker"))

    # --- discovery catalog and registry --------------------------------------
    def config(self) -> DiscoveryConfig:
        """The full profile with a volume floor that fits these tables."""
        return DiscoveryConfig(volumen_medio_minimo=VOLUME_FLOOR)

    def catalog(self) -> DataFrame:
        """The discovery catalog written once: at most one row per quota place."""
        return stage_table(discover(self.quotes(), self.config(), CREATED_AT), "catalog")

    def selected(self, catalog: DataFrame) -> DataFrame:
        return select_universe(catalog, self.incumbents(), DISCOVERY_ID)

    def regional_members(self, catalog: DataFrame) -> DataFrame:
        """One universe per market: the catalog rows of that market."""
        return catalog.join(F.broadcast(self.market_ids()), "region_descubrimiento").select(
            "universe_id", "ticker", "region_ord", "sector_ord", "rank_bucket")

    def market_ids(self) -> DataFrame:
        nk = F.col("n_nationkey")
        return self.raw("nation").where(nk < len(S.DISCOVERY_QUOTAS)).select(
            nk.alias("nk"), pick(MARKETS, nk).alias("region_descubrimiento"), universe_id(nk).alias("universe_id"))

    def versions(self, catalog: DataFrame) -> DataFrame:
        """A registry with one version per market and one broken rule in many."""
        nk = F.col("nk")
        real = member_hash(catalog, ["region_descubrimiento"])
        rows = self.market_ids().join(real, "region_descubrimiento", "left")
        status = (
            F.when(nk == 21, "active").when(nk == 8, "archived").when(nk % 3 == 0, "draft").otherwise("retired"))
        return rows.select(
            F.when(nk == 5, "universo-5").otherwise(F.col("universe_id")).alias("universe_id"),
            F.when(nk.isin(6, 7), "oficiales/repetido.csv")
            .otherwise(F.concat(F.lit("oficiales/"), "universe_id", F.lit(".csv"))).alias("path"),
            status.alias("status"), F.when(nk == 9, "ayer").otherwise("2024-01-01T00:00:00Z").alias("created_at"),
            F.when((status != "draft") & (nk != 10), "2024-02-01").alias("effective_from"),
            F.when(nk == 11, universe_id(nk)).when(nk == 12, "uv_1999q1_r01")
            .when((nk > 0) & (nk != 6), universe_id(nk - 1)).alias("supersedes"),
            F.when(nk == 13, "etf").otherwise("equity").alias("asset_type"),
            (F.coalesce("ticker_count", F.lit(0)) + F.when(nk == 14, 1).otherwise(0)).alias("ticker_count"),
            F.when(nk == 15, F.repeat(F.lit("0"), 64)).otherwise(F.coalesce("sha256", F.lit(""))).alias("sha256"),
            F.when(nk == 16, "").otherwise(S.SELECTION_PROFILE).alias("selection_method"), F.lit("").alias("notes"))


def universe_id(nk) -> Column:
    year = F.lit(2024) + F.floor(nk / 4)
    return F.concat(F.lit("uv_"), year.cast("string"), F.lit("q"), (nk % 4 + 1).cast("string"), F.lit("_r01"))
