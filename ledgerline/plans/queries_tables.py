"""Queries over the table operations themselves: accumulating upserts, table
versions, JSON rows, defaults, display text and the SQL functions."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import as_double, fmt2, parse_display_number, profit_label
from ledgerline.operators import market
from ledgerline.operators.incremental import Holdings
from ledgerline.plans import queries_ledger  # noqa: F401  (registers holdings_by_day)
from ledgerline.plans.catalog import REGISTRY, Query, register
from ledgerline.plans.sqlfuncs import register_functions
from ledgerline.session import scratch_path
from ledgerline.sources import tables
from ledgerline.sources.versions import Versions

_BUYS = """SELECT user_id, upper(trim(ticker)) AS stock_ticker, quantity, price FROM order_requests
  WHERE type = 'BUY' AND quantity > 0 AND price IS NOT NULL"""


@register("apply_buys", f"""
WITH b AS (SELECT user_id, stock_ticker, SUM(quantity) AS q, SUM(quantity * CAST(price * 100 AS BIGINT)) AS c FROM ({_BUYS}) GROUP BY ALL)
SELECT COALESCE(p.user_id, b.user_id) AS user_id, COALESCE(p.stock_ticker, b.stock_ticker) AS stock_ticker,
       CAST(COALESCE(p.quantity, 0) + COALESCE(b.q, 0) AS BIGINT) AS quantity,
       CAST(CASE WHEN b.q IS NULL THEN p.avg_price
                 ELSE CAST((2 * (COALESCE(CAST(p.avg_price * 100 AS BIGINT) * p.quantity, 0) + b.c) + COALESCE(p.quantity, 0) + b.q)
                           // (2 * (COALESCE(p.quantity, 0) + b.q)) AS DOUBLE) / 100 END AS DOUBLE) AS avg_price
FROM portfolio p FULL JOIN b ON p.user_id = b.user_id AND p.stock_ticker = b.stock_ticker
""")
def _apply_buys(fx):
    buys = fx.order_requests.where("type = 'BUY' AND quantity > 0 AND price IS NOT NULL").select(
        "user_id", F.upper(F.trim("ticker")).alias("stock_ticker"), "quantity", "price")
    return tables.apply_buys(fx.portfolio, buys).select("user_id", "stock_ticker", "quantity", as_double("avg_price").alias("avg_price"))


@register("table_versions", """
WITH lt AS (SELECT ticker, price FROM ticks QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) = 1),
v2 AS (SELECT COALESCE(s.ticker, lt.ticker) AS ticker, s.name,
              CASE WHEN lt.ticker IS NOT NULL THEN lt.price ELSE s.price END AS price
       FROM stock s FULL JOIN lt ON s.ticker = lt.ticker)
SELECT CAST(1 AS BIGINT) AS version, ticker, name, CAST(price AS DOUBLE) AS price FROM stock
UNION ALL SELECT 2, ticker, name, CAST(price AS DOUBLE) FROM v2
UNION ALL SELECT 3, ticker, name, CAST(price AS DOUBLE) FROM v2 WHERE ticker NOT IN (SELECT ticker FROM stock WHERE price IS NULL)
UNION ALL SELECT 4, ticker, name, CAST(price AS DOUBLE) FROM v2 WHERE ticker NOT IN (SELECT ticker FROM stock WHERE price IS NULL)
UNION ALL SELECT 4, concat('N', ticker), name, CAST(price AS DOUBLE) FROM stock
""")
def _table_versions(fx):
    """S6, S8 and S10 on committed versions: stocks stored by key bucket, then
    the latest ticks put in, the unpriced stocks deleted, rows appended; all
    four versions are read."""
    v = Versions(fx.spark, scratch_path(fx.spark, f"versions/stock-{uuid.uuid4().hex}"))
    stock = fx.stock.select("ticker", "name", "price")
    v.replace({"stock": stock}, keys={"stock": ["ticker"]}, buckets=16)
    order = F.struct("ts", "event_id")
    latest = fx.ticks.groupBy("ticker").agg(F.max_by("price", order).alias("price"))
    v.upsert("stock", latest, ["price"])
    v.delete("stock", stock.where("price IS NULL").select("ticker"))
    v.append({"stock": stock.withColumn("ticker", F.concat(F.lit("N"), "ticker"))})
    read = [v.read("stock", n).select(F.lit(n).cast("bigint").alias("version"), "ticker", "name", as_double("price").alias("price")) for n in v.versions()]
    return reduce(DataFrame.unionByName, read)


@register("price_json", """
SELECT concat('{"ticker":"', ticker, '","date":"', strftime(date, '%Y-%m-%d'), '","price":', CAST(price AS DOUBLE),
              CASE WHEN volume IS NULL THEN '' ELSE concat(',"volume":', volume) END, '}') AS json
FROM stock_prices WHERE price IS NOT NULL
""")
def _price_json(fx):
    return tables.to_json_rows(fx.stock_prices.where("price IS NOT NULL").select("ticker", "date", "price", "volume"))


@register("stock_defaults", """
SELECT ticker, COALESCE(name, 'Unknown') AS name, CAST(COALESCE(price, 0) AS DOUBLE) AS price, CAST(0 AS BIGINT) AS volume,
       CAST(COALESCE(high_52, price, 0) AS DOUBLE) AS high_52
FROM stock
""")
def _stock_defaults(fx):
    filled = tables.with_defaults(fx.stock.select("ticker", "name", "price", "high_52"), {
        "name": "Unknown", "volume": F.lit(0).cast("bigint"), "high_52": F.coalesce(F.col("price"), F.lit(0).cast("decimal(10,2)")), "price": F.lit(0).cast("decimal(10,2)")})
    return filled.select("ticker", "name", as_double("price").alias("price"), "volume", as_double("high_52").alias("high_52"))


@register("display_values", """
SELECT ticker, CASE WHEN price IS NULL THEN 'N/A' ELSE printf('%.2f', CAST(price AS DOUBLE)) END AS shown,
       CAST(price AS DOUBLE) AS parsed,
       CASE WHEN CAST(price AS DOUBLE) - CAST(low_52 AS DOUBLE) >= 0 THEN 'profit' WHEN CAST(price AS DOUBLE) - CAST(low_52 AS DOUBLE) < 0 THEN 'loss' END AS label
FROM stock
""")
def _display_values(fx):
    """F15, P11 and the inverse of the shown text."""
    shown = fx.stock.select("ticker", fmt2("price").alias("shown"), profit_label(as_double("price") - as_double("low_52")).alias("label"))
    return shown.select("ticker", "shown", parse_display_number(F.concat(F.lit("₹ "), "shown")).alias("parsed"), "label")


@register("display_sort", """
SELECT DISTINCT CASE WHEN price IS NULL THEN 'N/A' ELSE printf('%.2f', CAST(price AS DOUBLE)) END AS shown,
       COALESCE(CAST(price AS DOUBLE), 0) AS value
FROM stock ORDER BY value DESC LIMIT 50
""")
def _display_sort(fx):
    """The 50 highest prices as shown, by the number in the text."""
    shown = fx.stock.select(fmt2("price").alias("shown")).distinct()
    top = market.sort_by_display(shown, "shown", ascending=False).limit(50)
    return top.select("shown", F.coalesce(parse_display_number("shown"), F.lit(0.0)).alias("value"))


_AS_OF = dt.date(1998, 6, 1)


@register("sql_functions", f"""
WITH priced AS (SELECT s.ticker, s.name, p.price FROM stock_prices p JOIN stock s ON p.ticker = s.ticker WHERE p.date = DATE '{_AS_OF}'),
traded AS (SELECT user_id, stock_ticker AS ticker, SUM(quantity) AS shares FROM txn GROUP BY ALL)
SELECT 'get_high_stocks' AS function, ticker AS key, CAST(high_52 AS DOUBLE) AS value FROM stock WHERE 2.1 * low_52 <= high_52
UNION ALL SELECT 'get_low_stocks', ticker, CAST(low_52 AS DOUBLE) FROM stock WHERE low_52 IS NOT NULL
UNION ALL SELECT 'filter_stocks', concat(y.stock_ticker, '|', y.year), CAST(y.eps_growth AS DOUBLE)
  FROM yearly_financials y JOIN market_analysis m ON y.stock_ticker = m.stock_ticker JOIN stock s ON s.ticker = y.stock_ticker
  WHERE y.eps_growth >= 0 AND m.pe_ratio <= 100
UNION ALL SELECT 'get_user_portfolio', concat(p.user_id, '|', p.stock_ticker), CAST(p.quantity * s.price - p.quantity * p.avg_price AS DOUBLE)
  FROM portfolio p JOIN stock s ON p.stock_ticker = s.ticker
UNION ALL SELECT 'get_portfolio_summary', concat(user_id, '|', name), CAST(SUM(shares * price) AS DOUBLE)
  FROM traded JOIN priced ON traded.ticker = priced.ticker GROUP BY user_id, name
UNION ALL SELECT 'get_moving_averages', s.ticker, round(AVG(CAST(p.price AS DOUBLE)), 6)
  FROM stock s LEFT JOIN stock_prices p ON p.ticker = s.ticker AND p.date >= DATE '{_AS_OF}' - 200 AND p.date <= DATE '{_AS_OF}' GROUP BY s.ticker
UNION ALL SELECT 'pct_change', ticker, (CAST(price AS DOUBLE) - CAST(low_52 AS DOUBLE)) / NULLIF(CAST(low_52 AS DOUBLE), 0) * 100 FROM stock
""")
def _sql_functions(fx):
    """The SQL functions, called from SQL."""
    register_functions(fx.spark, {n: getattr(fx, n) for n in
                                  ("stock", "yearly_financials", "market_analysis", "portfolio", "txn", "stock_prices")})
    calls = {
        "get_high_stocks()": "SELECT ticker, high_52 FROM",
        "get_low_stocks()": "SELECT ticker, low_52 FROM",
        "filter_stocks()": "SELECT concat(ticker, '|', year), eps FROM",
        "get_user_portfolio()": "SELECT concat(user_id, '|', stock_ticker), profit_loss FROM",
        f"get_portfolio_summary(NULL, DATE '{_AS_OF}')": "SELECT concat(user_id, '|', stock_name), total_value FROM",
        f"get_moving_averages(NULL, DATE '{_AS_OF}')": "SELECT ticker, round(moving_avg_200, 6) FROM",
        "stock": "SELECT ticker, pct_change(CAST(price AS DOUBLE), CAST(low_52 AS DOUBLE)) FROM",
    }
    found = []
    for call, select in calls.items():
        name = call.split("(")[0] if "(" in call else "pct_change"
        df = fx.spark.sql(f"{select} {call}").toDF("key", "value")
        found.append(df.select(F.lit(name).alias("function"), "key", as_double("value").alias("value")))
    return reduce(DataFrame.unionByName, found)


def _holdings_incremental(fx):
    """Q8 begun three days before the last trade and taken in day by day from there."""
    last = fx.txn.agg(F.max(F.col("ts").cast("date"))).first()[0]
    kept = Holdings(fx.spark, scratch_path(fx.spark, f"versions/holdings-{uuid.uuid4().hex}"), buckets=16)
    kept.start(fx.txn, last - dt.timedelta(days=3))
    for days in (2, 1, 0):
        kept.add_day(fx.txn, last - dt.timedelta(days=days))
    return kept.intervals()


# it has the oracle of the holdings computed at once
REGISTRY["holdings_incremental"] = Query("holdings_incremental", _holdings_incremental, REGISTRY["holdings_by_day"].oracle)
