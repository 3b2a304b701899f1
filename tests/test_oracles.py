import pytest
from compare import compare, connect

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    problem, _, _ = compare(spark, con, FOLDER, name, QUERIES, ORACLES)
    assert problem is None


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.where("pasa").count() > 0
