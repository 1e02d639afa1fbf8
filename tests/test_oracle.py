"""Every registered query equals its DuckDB oracle on the smallest fixture."""

import pytest

from ledgerline.plans.catalog import oracle_queries, spark_queries
from ledgerline.plans.verify import compare, duckdb_connection

from conftest import SF_SMALL

ORACLES = oracle_queries()


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF_SMALL)


def test_every_query_has_an_oracle():
    missing = set(spark_queries()) - set(ORACLES)
    assert not missing, f"queries without SQL oracle: {missing}"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    s_pdf = spark_queries()[name](spark, SF_SMALL).toPandas()
    o_pdf = con.sql(ORACLES[name]).df()
    ok, detail = compare(s_pdf, o_pdf)
    assert ok, detail


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert "realized_pnl" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_column_types_agree(spark, con, name):
    """Same type family per column in Spark and the oracle; dates travel as text."""
    family = {"bigint": "int", "double": "float", "string": "str", "boolean": "bool",
              "timestamp_ntz": "ts", "timestamp": "ts",
              "BIGINT": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool", "TIMESTAMP": "ts"}
    s_types = dict(spark_queries()[name](spark, SF_SMALL).dtypes)
    rel = con.sql(ORACLES[name])
    o_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert {c: family.get(t, t) for c, t in s_types.items()} == {c: family.get(t, t) for c, t in o_types.items()}
