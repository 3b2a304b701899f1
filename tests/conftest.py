import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from valsieve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, memory="6g", app="tests")
    yield session
    session.stop()


def ideal(ticker="OK", **changes):
    """A company that passes every rule."""
    row = dict(
        ticker=ticker, nombre=ticker, sector="Industrials", pais="Spain", divisa_cotizacion="EUR",
        divisa_financiera="EUR", divisa_consistente=True, market_cap=10e9, market_cap_eur=10e9, net_income=1e9,
        ebit=1.4e9, ebitda=1.8e9, ingresos=10e9, ingresos_inicio_historico=8e9, ingresos_fin_historico=10e9,
        anios_historico=4.0, free_cash_flow=0.8e9, total_debt=2e9, cash=1e9, equity=5e9, total_debt_inicio=None,
        cash_inicio=None, equity_inicio=None, gasto_intereses=1e8, tasa_impositiva=0.25, error_descarga="",
        proveedor_datos="prueba", fecha_consulta_utc="", tipo_periodo="TTM", fecha_resultados="2026-06-30",
        fecha_flujo_caja="2026-06-30", fecha_balance="2026-06-30", calidad_datos="ok", incidencias_datos="",
        url_fuente="")
    row.update(changes)
    return row


@pytest.fixture
def companies(spark):
    from valsieve import schemas

    def build(*rows):
        names = [f.name for f in schemas.FUNDAMENTALS.fields]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schemas.FUNDAMENTALS)

    return build
