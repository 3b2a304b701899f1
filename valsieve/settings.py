"""Fixed values of the screening rules and universe profiles.

Everything in this file is a constant that results depend on: limits, word
lists, quotas, labels and concept names.  No logic lives here.
"""

# --- Screening limits (fixed values) ---------------------------------------
THRESHOLDS = {
    "per_max": 15.0,
    "per_bajo_mediana_sector": True,
    "min_empresas_sector": 5,
    "ev_ebit_max": 12.0,
    "fcf_yield_min": 0.06,
    "roic_min": 0.10,
    "margen_op_min": 0.0,
    "deuda_ebitda_max": 2.5,
    "cobertura_intereses_min": 5.0,
    "crecimiento_ingresos_min": 0.0,
    "market_cap_eur_min": 2_000_000_000,
}
DEFAULT_TAX_RATE = 0.25
MAX_TAX_RATE = 0.50
MAX_RELIABLE_ROIC = 1.00
HIGH_NET_CASH = 0.30

# --- Valuation blocks by country (fixed values) ----------------------------
COMPARABLE_REGIONS = {
    "Norteamerica": ["United States", "Canada"],
    "Europa": [
        "United Kingdom", "Germany", "France", "Netherlands", "Switzerland",
        "Spain", "Italy", "Sweden", "Denmark", "Norway", "Finland", "Belgium",
        "Austria", "Ireland", "Portugal", "Luxembourg", "Iceland",
    ],
    "Japon": ["Japan"],
    "AsiaPacifico": [
        "Australia", "New Zealand", "Singapore", "Hong Kong", "China",
        "South Korea", "Taiwan",
    ],
}
OTHER_REGION = "Otros"
BASIS_REGIONAL = "sector+region"
BASIS_GLOBAL = "sector_global"

# --- Corporate suffixes blanked out of names, in this order (fixed values) --
COMPANY_NOISE = [
    " PLC", " AG", " NV", " N.V.", " SA", " S.A.", " INC", " INC.",
    " CORPORATION", " CORP", " CORP.", " LTD", " LTD.", " LIMITED",
    " CO.", " GROUP", " HOLDINGS", " COMPANY", ",", ".",
]

# --- Data quality (fixed values) -------------------------------------------
MAX_STATEMENT_AGE_DAYS = 550
MAX_FUTURE_DAYS = 7
MAX_STATEMENT_GAP_DAYS = 45
MIN_MISSING_PILLARS = 3
ESSENTIAL_FIELDS = {
    "market_cap": "capitalización",
    "net_income": "beneficio neto",
    "ebit": "EBIT",
    "ebitda": "EBITDA",
    "ingresos": "ingresos",
    "free_cash_flow": "flujo de caja libre",
    "total_debt": "deuda total",
    "cash": "caja",
    "equity": "fondos propios",
    "gasto_intereses": "gasto por intereses",
}
PILLAR_FIELDS = ["market_cap", "ingresos", "ebit", "net_income"]
STATEMENT_DATES = {
    "resultados": "fecha_resultados",
    "flujo de caja": "fecha_flujo_caja",
    "balance": "fecha_balance",
}
PERIOD_TYPES = ["TTM", "ANUAL"]
INCIDENT_CATEGORIES = {
    "campos_ausentes": "campos esenciales ausentes",
    "divisas": "divisas ausentes o incompatibles",
    "cuentas_obsoletas": "estados contables obsoletos",
    "fechas_ausentes": "fechas contables ausentes",
    "fechas_futuras": "fechas contables futuras",
    "periodos_desalineados": "resultados y caja desalineados",
    "periodo_no_identificado": "periodo contable no identificado",
    "valores_invalidos": "valores contables inválidos",
    "errores_descarga": "errores de descarga",
    "otras": "otras incidencias",
}

# --- Column lists (fixed values) -------------------------------------------
PROVENANCE_COLUMNS = [
    "proveedor_datos", "fecha_consulta_utc", "tipo_periodo",
    "fecha_resultados", "fecha_flujo_caja", "fecha_balance",
    "calidad_datos", "incidencias_datos",
]
IDENTITY_COLUMNS = [
    "ticker", "nombre", "sector", "pais", "divisa_cotizacion",
    "divisa_financiera", "divisa_consistente", "market_cap", "market_cap_eur",
]
RATIO_COLUMNS = [
    "per", "ev_ebit", "fcf_yield", "roic", "margen_op", "deuda_ebitda",
    "cobertura_int", "cagr_ingresos", "earnings_yield", "caja_neta_pct_mcap",
    "roic_fiable", "region",
]
PEER_COLUMNS = ["per_mediana_sector", "n_sector", "base_mediana"]
METRIC_COLUMNS = (
    IDENTITY_COLUMNS + RATIO_COLUMNS + PEER_COLUMNS
    + ["error_descarga"] + PROVENANCE_COLUMNS
)
CONTROL_BASE_COLUMNS = [
    "snapshot_id", "fecha_ejecucion", "semana_iso", "origen", "oficial",
    "revision", "tickers_solicitados", "resultados_brutos",
    "descargas_correctas", "errores_descarga", "deduplicados",
    "empresas_evaluadas", "candidatas", "tasa_exito_descarga",
    "umbral_exito_minimo",
]
CONTROL_RUN_COLUMNS = [
    "github_run_id", "github_run_attempt", "github_run_url", "github_sha",
]
CONTROL_UNIVERSE_COLUMNS = ["universe_id", "universe_sha256", "universe_path"]
CONTROL_QUALITY_COLUMNS = [
    "proveedor_datos", "datos_ok", "datos_revisar", "datos_inutilizables",
]
CONTROL_COLUMNS = (
    CONTROL_BASE_COLUMNS + CONTROL_RUN_COLUMNS + CONTROL_UNIVERSE_COLUMNS
    + CONTROL_QUALITY_COLUMNS
)
SIGNAL_COLUMNS = [
    "ticker", "nombre", "sector", "region", "fecha_entrada", "per",
    "ev_ebit", "roic", "puntuacion",
]
UNIVERSE_COLUMNS = [
    "ticker", "origen_inclusion", "region_descubrimiento",
    "sector_descubrimiento", "nota",
]
DISCOVERY_COLUMNS = [
    "ticker", "tipo_activo", "region_descubrimiento", "sector_descubrimiento",
    "rank_bucket", "cuota_bucket", "fuente", "fecha_descubrimiento",
]
VERSION_FIELDS = [
    "universe_id", "path", "status", "created_at", "effective_from",
    "supersedes", "asset_type", "ticker_count", "sha256", "selection_method",
    "notes",
]
VERIFICATION_COLUMNS = [
    "snapshot_id", "ticker", "proveedor_primario", "proveedor_secundario",
    "tipo_periodo_primario", "tipo_periodo_secundario",
    "fecha_periodo_primario", "fecha_periodo_secundario",
    "divisa_primaria", "divisa_secundaria", "metrica", "valor_primario",
    "valor_secundario", "diferencia_pct", "estado", "detalle", "url_fuente",
    "verificado_en_utc",
]
VERIFICATION_KEYS = ["snapshot_id", "ticker", "proveedor_secundario", "metrica"]
#: Buckets of a stored verification table; to be chosen with the size of the history.
VERIFICATION_BUCKETS = 64

# --- Truth words (fixed values) --------------------------------------------
TRUE_WORDS = ["true", "1", "sí", "si", "yes"]
TRUE_WORDS_TRACKING = ["true", "1", "sí", "si"]

# --- Run control (fixed values) --------------------------------------------
MIN_DOWNLOAD_SUCCESS = 0.80
SNAPSHOT_ID_FORMAT = "'snap_'yyyyMMdd'T'HHmmssSSSSSS'Z'"
SNAPSHOT_PREFIX = "snap_"
OFFICIAL_UNIVERSE_PREFIX = "uv_"
ADHOC_PREFIX = "adhoc_"
UNIVERSE_ID_PATTERN = r"^uv_\d{4}q[1-4]_r\d{2}$"
DISCOVERY_ID_PATTERN = r"^disc_\d{8}T\d{12}Z$"
TICKER_PATTERN = r"^[A-Z0-9.^=\-]+$"
SHA256_PATTERN = r"^[0-9a-fA-F]{64}$"
UNIVERSE_STATES = ["draft", "active", "retired"]
MAX_TICKER_LENGTH = 32

# --- Sectors and region lists (fixed values) -------------------------------
SECTORS = [
    "Technology", "Industrials", "Healthcare", "Consumer Cyclical",
    "Consumer Defensive", "Communication Services", "Energy",
    "Basic Materials", "Utilities",
]
NAMED_UNIVERSES = {
    "usa": ["us"],
    "espana": ["es"],
    "eurozona": ["es", "pt", "fr", "de", "it", "nl", "be", "at", "ie", "fi"],
    "nordicos": ["dk", "se", "no", "fi"],
    "europa_desarrollada": [
        "gb", "ch", "de", "fr", "nl", "be", "at", "ie", "es", "pt", "it",
        "dk", "se", "no", "fi",
    ],
    "desarrollados_aproximado": [
        "us", "ca", "gb", "ch", "de", "fr", "nl", "be", "at", "ie", "es",
        "pt", "it", "dk", "se", "no", "fi", "jp", "au", "nz", "sg", "hk",
    ],
}
ETF_THEMES = {
    "Technology": ["Technology"],
    "Healthcare": ["Health"],
    "Energy": ["Equity Energy", "Energy Limited Partnership"],
    "Utilities": ["Utilities"],
    "Basic Materials": ["Equity Precious Metals", "Natural Resources"],
    "Materias Primas": ["Commodities Broad Basket", "Commodities Agriculture"],
    "Inmobiliario": ["Real Estate", "Global Real Estate"],
}
# kind -> (filters on region, filters on volume)
ASSET_KINDS = {
    "accion": (True, True),
    "etf": (True, True),
    "fondo": (False, False),
}

# --- Discovery and selection profiles (fixed values) -----------------------
DISCOVERY_PROFILE = "desarrollados_v1"
DISCOVERY_QUOTAS = {
    "us": 30, "ca": 15, "gb": 15, "ch": 10, "de": 15, "fr": 15, "nl": 10,
    "be": 6, "at": 6, "ie": 6, "es": 10, "pt": 6, "it": 10, "dk": 6, "se": 10,
    "no": 6, "fi": 6, "jp": 15, "au": 15, "nz": 6, "sg": 6, "hk": 6,
}
DISCOVERY_SOURCE = "yfinance.screen"
MIN_PRICE = 2.0
MIN_AVG_VOLUME = 100_000
MIN_BUCKET_COVERAGE = 0.90
DISCOVERY_RETRIES = 2
SELECTION_PROFILE = "balanced_rank_v1"
SELECTION_QUOTAS = {
    "us": 12, "ca": 6, "gb": 6, "ch": 4, "de": 6, "fr": 6, "nl": 4, "be": 2,
    "at": 2, "ie": 2, "es": 4, "pt": 2, "it": 4, "dk": 2, "se": 4, "no": 2,
    "fi": 2, "jp": 6, "au": 6, "nz": 2, "sg": 2, "hk": 2,
}
INCUMBENT_BUFFER = 3
MIN_SELECTION, MAX_SELECTION = 400, 800
REFINEMENT_PROFILE = "refine_observed_v1"
SAME_BUCKET, SAME_REGION = "mismo_bucket", "misma_region"

# --- Statement line items per field, best first (fixed values) -------------
STATEMENT_CONCEPTS = {
    ("resultados", "ingresos"): ["Total Revenue", "Operating Revenue"],
    ("resultados", "ebit"): ["EBIT", "Operating Income"],
    ("resultados", "net_income"): ["Net Income", "Net Income Common Stockholders"],
    ("resultados", "gasto_intereses"): ["Interest Expense", "Interest Expense Non Operating"],
    ("resultados", "ebitda"): ["EBITDA", "Normalized EBITDA"],
    ("resultados", "tax_provision"): ["Tax Provision"],
    ("resultados", "pretax_income"): ["Pretax Income"],
    ("flujo_caja", "free_cash_flow"): ["Free Cash Flow"],
    ("balance", "total_debt"): ["Total Debt"],
    ("balance", "cash"): [
        "Cash Cash Equivalents And Short Term Investments",
        "Cash And Cash Equivalents", "Cash",
    ],
    ("balance", "equity"): ["Stockholders Equity", "Total Equity Gross Minority Interest"],
}

# --- Filing concepts per field, best first (fixed values) ------------------
ANNUAL_FORMS = ["10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A"]
FACT_TAXONOMIES = ["us-gaap", "ifrs-full"]
ANNUAL_DAYS = (300, 430)
FACT_CONCEPTS = {
    "ingresos": [
        "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues",
        "SalesRevenueNet", "Revenue",
    ],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "ebit": ["OperatingIncomeLoss", "ProfitLossFromOperatingActivities"],
    "cash_operaciones": [
        "NetCashProvidedByUsedInOperatingActivities",
        "CashFlowsFromUsedInOperatingActivities",
    ],
    "capex": [
        "PaymentsToAcquirePropertyPlantAndEquipment",
        "PurchaseOfPropertyPlantAndEquipment",
    ],
    "total_debt": [
        "LongTermDebtAndFinanceLeaseObligations",
        "LongTermDebtAndCapitalLeaseObligations", "LongTermDebt",
    ],
    "cash": [
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
        "CashAndCashEquivalentsAtCarryingValue", "CashAndCashEquivalents",
    ],
    "equity": [
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
        "Equity",
    ],
    "gasto_intereses": [
        "InterestExpenseNonOperating", "InterestExpense", "FinanceCosts",
    ],
}
INSTANT_FIELDS = ["total_debt", "cash", "equity"]
REQUIRED_FACTS = ["ingresos", "net_income", "ebit", "total_debt", "cash", "equity"]
FACTS_PROVIDER = "sec_edgar"
FACTS_URL_FORMAT = "https://data.sec.gov/api/xbrl/companyfacts/CIK%010d.json"
NOT_REGISTERED = "ticker no registrado literalmente en SEC EDGAR"

# --- Cross-source verification (fixed values) ------------------------------
VERIFIED_TOLERANCE = 0.10
WARNING_TOLERANCE = 0.25
COMPARED_FIELDS = {
    "ingresos": "fecha_resultados",
    "net_income": "fecha_resultados",
    "ebit": "fecha_resultados",
    "free_cash_flow": "fecha_flujo_caja",
    "total_debt": "fecha_balance",
    "cash": "fecha_balance",
    "equity": "fecha_balance",
    "gasto_intereses": "fecha_resultados",
}
NUMERIC_STATES = ["verificado", "advertencia", "discrepancia_material"]
SEMANTIC_STATE = "aproximacion_semantica"
DIRECT_CONCEPTS = {
    "ingresos": [
        "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues",
        "SalesRevenueNet", "Revenue",
    ],
    "net_income": ["NetIncomeLoss"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue", "CashAndCashEquivalents"],
    "gasto_intereses": ["InterestExpenseNonOperating", "InterestExpense"],
}
APPROXIMATION_NOTES = {
    "ProfitLoss": "beneficio consolidado total; puede incluir participaciones no controladoras",
    "OperatingIncomeLoss": "resultado operativo; no equivale necesariamente al EBIT de Yahoo",
    "ProfitLossFromOperatingActivities": "resultado de actividades operativas; aproximación a EBIT",
    "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest":
        "patrimonio total con participaciones no controladoras",
    "Equity": "patrimonio IFRS total; puede diferir del atribuible a los accionistas",
    "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents":
        "incluye efectivo restringido además de caja y equivalentes",
    "LongTermDebtAndFinanceLeaseObligations":
        "deuda a largo plazo y arrendamientos; no es deuda total garantizada",
    "LongTermDebtAndCapitalLeaseObligations":
        "deuda a largo plazo y arrendamientos; no es deuda total garantizada",
    "LongTermDebt": "deuda a largo plazo; no es deuda total garantizada",
    "FinanceCosts": "costes financieros; pueden incluir conceptos no equivalentes",
}

# --- Chart venues by ticker suffix (fixed values) --------------------------
VENUE_PREFIXES = {
    ".MC": "BME", ".DE": "XETR", ".AS": "EURONEXT", ".PA": "EURONEXT",
    ".LS": "EURONEXT", ".BR": "EURONEXT", ".IR": "EURONEXT", ".MI": "MIL",
    ".VI": "VIE", ".HE": "OMXHEX",
}
