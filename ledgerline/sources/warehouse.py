"""Persisted ledger tables: write once, read with partition pruning.

``persist_tables`` writes the ledger tables derived from the raw files as
parquet under one folder; the time-indexed facts (``txn``, ``stock_prices``,
``ticks``) are partitioned by year and month, so date-bounded queries read
only the partitions they need. ``Warehouse`` reads them back with the same
attributes as :class:`~ledgerline.sources.fixtures.Fixtures`, so every
operator runs unchanged on either.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.fixtures import Fixtures

# table -> timestamp/date column it is partitioned on (None: unpartitioned)
LAYOUT = {
    "broker": None, "account": None, "stock": None, "portfolio": None, "market_analysis": None,
    "yearly_financials": None, "quarterly_financials": None,
    "txn": "ts", "stock_prices": "date", "ticks": "ts",
}


def write_partitioned(df: DataFrame, path: str, time_col: str | None) -> None:
    """Write ``df`` as parquet; with ``time_col``, partitioned by its year and month.

    Rows are range-partitioned on (year, month, time) before the write: the
    range bounds come from a sample, so a month holding a large share of the
    rows is split over many tasks, while each task still writes to one or
    two month folders (few, evenly sized files)."""
    if time_col is None:
        df.write.mode("overwrite").parquet(path)
        return
    (df.withColumn("year", F.year(time_col)).withColumn("month", F.month(time_col))
       .repartitionByRange("year", "month", time_col)
       .write.mode("overwrite").partitionBy("year", "month").parquet(path))


def persist_tables(fx: Fixtures, out_dir: str, names=None) -> list[str]:
    """Materialise the ledger tables of ``fx`` under ``out_dir`` (one folder per table)."""
    names = list(names or LAYOUT)
    for n in names:
        write_partitioned(getattr(fx, n), os.path.join(out_dir, n), LAYOUT[n])
    return names


class Warehouse:
    """Persisted ledger tables with the attribute interface of ``Fixtures``.

    Partition columns are dropped on read, so schemas equal the derived
    tables. A caller that wants a range of days takes it with :meth:`between`,
    which prunes partitions; the attributes read whole tables.
    """

    def __init__(self, spark: SparkSession, folder: str, fallback: Fixtures | None = None):
        # ``fallback`` serves inputs that are not persisted (raw tables, request batches).
        self.spark, self.folder, self.fallback = spark, folder, fallback

    def _read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(os.path.join(self.folder, name))
        return df.drop("year", "month") if LAYOUT.get(name) else df

    def __getattr__(self, name: str):
        if name in LAYOUT:
            return self._read(name)
        if name not in ("spark", "folder", "fallback") and self.fallback is not None:
            return getattr(self.fallback, name)
        raise AttributeError(name)

    def between(self, name: str, start, end) -> DataFrame:
        """Rows of a partitioned table with ``start <= time <= end`` (dates),
        pruned to the year/month partitions that can hold them."""
        col = LAYOUT[name]
        df = self.spark.read.parquet(os.path.join(self.folder, name))
        s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
        ym = F.col("year") * 12 + F.col("month")
        df = df.where((ym >= F.year(s) * 12 + F.month(s)) & (ym <= F.year(e) * 12 + F.month(e)))
        return df.where((F.col(col).cast("date") >= s) & (F.col(col).cast("date") <= e)).drop("year", "month")

    def tables(self) -> dict[str, DataFrame]:
        return {n: self._read(n) for n in LAYOUT if n not in ("ticks",)}
