"""Registry of the analytical queries run by the driver, bench and tests.

Each entry binds an operator to the fixture tables of one scale-factor
folder (``build(spark, sf_dir) -> DataFrame``) and, where the query is
expressible in SQL, an independent DuckDB oracle over the same raw parquet
files. Column names and types agree between the two; every output column is
BIGINT, DOUBLE, STRING, BOOLEAN, DATE or TIMESTAMP.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.plans.oracle_views import with_views
from ledgerline.sources.fixtures import LEDGER_AS_OF, PRICE_AS_OF, Fixtures, fixtures


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Fixtures], DataFrame]
    oracle: str | None  # DuckDB SQL over the raw tables, or None (rows-only check)


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query. ``dates`` names its DATE output columns: registered
    results carry dates as ``YYYY-MM-DD`` text (the form the original
    endpoints returned), rendered the same way by Spark and by the oracle, so
    the comparison never depends on how each engine hands dates to clients."""
    def deco(fn: Callable[[Fixtures], DataFrame]):
        sql = None
        if oracle:
            sql = with_views(oracle)
            if dates:
                rep = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates)
                sql = f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS q"
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name)
                       if isinstance(f.dataType, T.DateType) else F.col(f.name) for f in df.schema.fields])


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _dates_as_text(REGISTRY[name].build(fixtures(spark, sf_dir)))


def run_on(tables, name: str) -> DataFrame:
    """Run a registered query on any object with the fixture attributes
    (e.g. a :class:`~ledgerline.sources.warehouse.Warehouse`)."""
    _load()
    return _dates_as_text(REGISTRY[name].build(tables))


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, sf_dir, _n=n: run(spark, sf_dir, _n)) for n in REGISTRY}


def oracle_queries() -> dict[str, str]:
    _load()
    return {n: q.oracle for n, q in REGISTRY.items() if q.oracle}


def _load() -> None:
    # Importing the query modules fills REGISTRY.
    from ledgerline.plans import queries_ledger, queries_market, queries_accounts, queries_streams, queries_tables  # noqa: F401


__all__ = ["REGISTRY", "register", "run", "spark_queries", "oracle_queries", "LEDGER_AS_OF", "PRICE_AS_OF"]
