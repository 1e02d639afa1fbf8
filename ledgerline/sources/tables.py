"""Sources, sinks and keyed table maintenance.

Tables are immutable parquet datasets. A "write" produces a new version at a
new path; nothing overwrites the path it is reading from. Upserts and deletes
are expressed as joins so they run distributed, shuffle on the table key and
let adaptive execution broadcast whichever side turns out small.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import schemas


# -- S1 / S2 / S3 --------------------------------------------------------------

def read_table(spark: SparkSession, folder: str, name: str,
               columns: Sequence[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Scan ``folder/name.parquet`` (or a directory ``folder/name``).

    Passing ``columns`` is only a convenience: Catalyst prunes unused columns
    from the scan either way, and filters placed on the result are pushed to
    the parquet reader.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:  # Spark resolves both layouts, so any store that it reads will do
        df = reader.parquet(os.path.join(folder, f"{name}.parquet"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = reader.parquet(os.path.join(folder, name))
    return df.select(*columns) if columns else df


def lookup(df: DataFrame, **key_values) -> DataFrame:
    """Point lookup ``WHERE k1 = v1 AND ...`` (pushed to the scan)."""
    cond = F.lit(True)
    for k, v in key_values.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.where(cond)


def lookup_many(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Bulk form of :func:`lookup`: rows of ``df`` whose key is in ``keys``."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


# -- S4 ------------------------------------------------------------------------

def price_history(stock_prices: DataFrame, as_of, days: int | None = None,
                  months: int | None = None) -> DataFrame:
    """Daily closes in a trailing calendar window ending at ``as_of``.

    ``days=7`` / ``months=6`` correspond to the vendor periods ``7d`` / ``6mo``.
    A pure date-range filter, pushed into the scan when ``stock_prices`` is
    read from parquet.
    """
    end = F.lit(as_of).cast("date")
    if months is not None:
        start = F.add_months(end, -months)
    else:
        start = F.date_sub(end, (days or 1) - 1)
    return stock_prices.where((F.col("date") > start if months is not None else F.col("date") >= start)
                              & (F.col("date") <= end))


# -- S5 ------------------------------------------------------------------------

def parse_snapshot(snapshots: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Parse per-ticker vendor JSON into typed columns with the vendor defaults.

    Missing name -> 'Unknown', missing numbers -> 0 (the defaults the refresh
    job applies). Malformed JSON yields all defaults plus ``parse_ok = false``.
    """
    parsed = F.from_json(F.col(raw_col), schemas.SNAPSHOT_FIELDS)
    out = snapshots.withColumn("_s", parsed)
    cols = [F.col("ticker"), F.coalesce(F.col("_s.longName"), F.lit("Unknown")).alias("long_name")]
    for field, name in SNAPSHOT_NAMES.items():
        cols.append(F.coalesce(F.col(f"_s.{field}"), F.lit(0.0)).alias(name))
    # from_json yields an all-null struct for malformed text; a JSON object has keys (maybe none).
    cols.append(F.json_object_keys(F.col(raw_col)).isNotNull().alias("parse_ok"))
    return out.select(*cols)


# Vendor field -> our column name.
SNAPSHOT_NAMES = {
    "trailingPE": "trailing_pe", "dividendYield": "dividend_yield", "marketCap": "market_cap",
    "fiftyTwoWeekHigh": "high_52", "fiftyTwoWeekLow": "low_52", "earningsGrowth": "eps_growth",
    "revenueGrowth": "revenue_growth", "netIncomeToCommon": "net_income", "totalRevenue": "total_revenue",
}


# -- S6 / S7 -------------------------------------------------------------------

def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str],
           update_cols: Sequence[str] | None = None, order_col: str | None = None) -> DataFrame:
    """``INSERT ... ON CONFLICT (keys) DO UPDATE SET c = EXCLUDED.c`` for ``update_cols``.

    Keys present only in ``changes`` are inserted (columns not supplied are
    null); keys present in both take the supplied ``update_cols`` from the
    change, even when the new value is null, and keep every other column.
    Several changes for one key: the last by ``order_col`` wins (without an
    order column, several changes for one key raise an error). One shuffle on
    ``keys`` per side.
    """
    keys = list(keys)
    value_cols = [c for c in base.columns if c not in keys]
    update_cols = list(update_cols) if update_cols is not None else [c for c in changes.columns if c not in keys]
    # One change per key as an aggregate (combines map-side), not a window:
    # many changes to one hot key never gather in one task.
    cols = [c for c in changes.columns if c not in keys]
    pick = F.max_by(F.struct(*cols), F.col(order_col)) if order_col is not None else F.any_value(F.struct(*cols))
    last = changes.groupBy(*keys).agg(pick.alias("_last"), F.count(F.lit(1)).alias("_times"))
    if order_col is None:
        last = last.withColumn("_last", F.when(F.col("_times") == 1, F.col("_last")).otherwise(
            F.raise_error(F.lit(f"several changes for one key ({', '.join(keys)}) and no order column"))))
    changes = last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in cols])
    ch = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in update_cols],
                        F.lit(True).alias("_hit"))
    j = base.join(ch, keys, "full_outer")
    out = []
    for c in value_cols:
        dtype = base.schema[c].dataType
        if c in update_cols:
            out.append(F.when(F.col("_hit"), F.col(f"_new_{c}").cast(dtype)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*keys, *out)


def apply_buys(portfolio: DataFrame, buys: DataFrame) -> DataFrame:
    """Accumulating upsert of positions: quantity added, average price re-weighted.

    ``buys(user_id, stock_ticker, quantity, price)``. Buys are first combined
    per position (map-side partial aggregation), so a hot position is reduced
    before the shuffle; the result is the same as applying them one by one
    because the weighted mean is order independent for buys.
    """
    cents = lambda c: (F.col(c) * 100).cast("bigint")
    agg = buys.groupBy("user_id", "stock_ticker").agg(
        F.sum("quantity").cast("bigint").alias("_bq"), F.sum(F.col("quantity") * cents("price")).alias("_bc"))
    j = portfolio.join(agg, ["user_id", "stock_ticker"], "full_outer")
    nothing = F.lit(0).cast("bigint")
    old_q = F.coalesce(F.col("quantity").cast("bigint"), nothing)
    j = j.withColumn("_q", old_q + F.coalesce("_bq", nothing)) \
         .withColumn("_cost", F.coalesce(cents("avg_price"), nothing) * old_q + F.coalesce("_bc", nothing))
    # whole cents, rounded half up as a NUMERIC(10,2) column stores them
    mean = F.expr("(2 * _cost + _q) div nullif(2 * _q, 0)").cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")
    avg = F.when(F.col("_bq").isNull(), F.col("avg_price")).otherwise(mean.cast("decimal(10,2)"))
    return j.select("user_id", "stock_ticker", F.col("_q").alias("quantity"), avg.alias("avg_price"))


# -- S8 / S10 / S11 ------------------------------------------------------------

def append(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    """Append rows to a parquet dataset (``INSERT INTO``)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_version(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    """Write a new table version to ``path`` (never the path being read)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def delete_keys(base: DataFrame, keys_df: DataFrame, on: Sequence[str] | dict) -> DataFrame:
    """``DELETE FROM base WHERE key IN keys_df``: a left anti join.

    ``on`` is a list of shared column names or a mapping base column -> key column.
    """
    if isinstance(on, dict):
        k = keys_df.select(*[F.col(v).alias(k) for k, v in on.items()]).distinct()
        return base.join(k, list(on.keys()), "left_anti")
    return base.join(keys_df.select(*on).distinct(), list(on), "left_anti")


def cascade_delete(tables: dict[str, DataFrame], parent: str, keys_df: DataFrame,
                   dependents: Iterable[tuple[str, str]], parent_key: str) -> dict[str, DataFrame]:
    """Delete parent keys and, first, every dependent row that references them.

    ``dependents`` lists ``(table, fk_column)`` pairs. Returns new versions of
    all touched tables; the others are passed through unchanged.
    """
    out = dict(tables)
    key = keys_df.select(F.col(parent_key).alias("_k")).distinct()
    for name, fk in dependents:
        out[name] = delete_keys(tables[name], key, {fk: "_k"})
    out[parent] = delete_keys(tables[parent], key, {parent_key: "_k"})
    return out


# -- S12 / S13 -----------------------------------------------------------------

def to_json_rows(df: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """One JSON object per row (dates as ``YYYY-MM-DD``, decimals as numbers)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, date_format)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols)).alias("json"))


def with_defaults(df: DataFrame, defaults: dict[str, Column | object]) -> DataFrame:
    """Fill column defaults (``DEFAULT 0``, ``DEFAULT CURRENT_TIMESTAMP``) for nulls or missing columns."""
    out = df
    for c, v in defaults.items():
        val = v if isinstance(v, Column) else F.lit(v)
        out = out.withColumn(c, F.coalesce(F.col(c), val) if c in df.columns else val)
    return out
