"""SQL surface (U1, U2): the original stored table functions and scalar
helpers as Spark SQL functions over temporary views.

``register_functions(spark, tables)`` publishes the tables as temporary views
and defines SQL table functions under the original names, so SQL users can
keep writing ``SELECT * FROM get_high_stocks()``. The bodies are plain Spark
SQL, optimised by Catalyst like any other query; per-user functions take an
optional user id (NULL = every user).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name -> CREATE statement (bodies refer to the temporary views below).
FUNCTIONS = {
    "pct_change": """
CREATE OR REPLACE TEMPORARY FUNCTION pct_change(new_value DOUBLE, old_value DOUBLE)
RETURNS DOUBLE
RETURN (new_value - old_value) / NULLIF(old_value, 0) * 100""",
    "weighted_mean": """
CREATE OR REPLACE TEMPORARY FUNCTION weighted_mean(sum_wx DOUBLE, sum_w DOUBLE)
RETURNS DOUBLE
RETURN sum_wx / NULLIF(sum_w, 0)""",
    "signed_qty": """
CREATE OR REPLACE TEMPORARY FUNCTION signed_qty(kind STRING, quantity BIGINT)
RETURNS BIGINT
RETURN CASE WHEN kind = 'BUY' THEN quantity ELSE -quantity END""",
    "get_high_stocks": """
CREATE OR REPLACE TEMPORARY FUNCTION get_high_stocks(ratio DOUBLE DEFAULT 2.1)
RETURNS TABLE (ticker STRING, name STRING, high_52 DECIMAL(10,2), low_52 DECIMAL(10,2))
RETURN
  WITH span AS (SELECT *, CAST(ratio AS DECIMAL(10,4)) * low_52 AS needed FROM stock)
  SELECT span.ticker, span.name, span.high_52, span.low_52 FROM span WHERE needed <= high_52""",
    "get_low_stocks": """
CREATE OR REPLACE TEMPORARY FUNCTION get_low_stocks()
RETURNS TABLE (ticker STRING, name STRING, high_52 DECIMAL(10,2), low_52 DECIMAL(10,2))
RETURN SELECT known.* FROM (SELECT ticker, name, high_52, low_52 FROM stock) known
       WHERE NOT isnull(known.low_52)""",
    "filter_stocks": """
CREATE OR REPLACE TEMPORARY FUNCTION filter_stocks(min_eps DOUBLE DEFAULT 0, max_pe DOUBLE DEFAULT 100)
RETURNS TABLE (ticker STRING, name STRING, year INT, eps DOUBLE, pe DOUBLE)
RETURN
  WITH cheap AS (SELECT stock_ticker AS ticker, pe_ratio AS pe FROM market_analysis WHERE pe_ratio <= max_pe),
  growing AS (SELECT stock_ticker AS ticker, year, eps_growth AS eps FROM yearly_financials WHERE eps_growth >= min_eps)
  SELECT ticker, stock.name, growing.year, growing.eps, cheap.pe
  FROM growing JOIN cheap USING (ticker) JOIN stock USING (ticker)""",
    "get_user_portfolio": """
CREATE OR REPLACE TEMPORARY FUNCTION get_user_portfolio(user_id_param BIGINT DEFAULT NULL)
RETURNS TABLE (user_id BIGINT, stock_ticker STRING, stock_name STRING, quantity BIGINT,
               avg_price DECIMAL(10,2), current_price DECIMAL(10,2), total_investment DECIMAL(38,2),
               current_value DECIMAL(38,2), profit_loss DECIMAL(38,2), profit_loss_pct DOUBLE,
               total_portfolio_investment DECIMAL(38,2), total_portfolio_value DECIMAL(38,2),
               total_portfolio_pnl DECIMAL(38,2))
RETURN
  WITH p AS (
    SELECT p.user_id, p.stock_ticker, s.name AS stock_name, p.quantity, p.avg_price, s.price AS current_price,
           s.ticker IS NOT NULL AS listed, p.quantity * p.avg_price AS inv,
           CASE WHEN s.ticker IS NOT NULL THEN p.quantity * s.price END AS val
    FROM portfolio p LEFT JOIN stock s ON p.stock_ticker = s.ticker
    WHERE user_id_param IS NULL OR p.user_id = user_id_param),
  w AS (
    SELECT *, SUM(inv) OVER (PARTITION BY user_id) AS t_inv, SUM(val) OVER (PARTITION BY user_id) AS t_val,
           SUM(val - inv) OVER (PARTITION BY user_id) AS t_pnl
    FROM p)
  SELECT user_id, stock_ticker, stock_name, quantity, avg_price, current_price, inv, val, val - inv,
         round(CAST(val - inv AS DOUBLE) / NULLIF(CAST(inv AS DOUBLE), 0) * 100, 2), t_inv, t_val, t_pnl
  FROM w WHERE listed""",
    "get_portfolio_summary": """
CREATE OR REPLACE TEMPORARY FUNCTION get_portfolio_summary(user_id_param BIGINT, as_of DATE)
RETURNS TABLE (user_id BIGINT, stock_name STRING, total_shares BIGINT, total_value DECIMAL(38,2))
RETURN
  WITH priced AS (SELECT ticker, stock.name, stock_prices.price AS close
                  FROM stock_prices JOIN stock USING (ticker) WHERE stock_prices.date = as_of),
  traded AS (SELECT user_id, stock_ticker AS ticker, SUM(quantity) AS shares FROM txn
             WHERE user_id = coalesce(user_id_param, user_id) GROUP BY ALL)
  SELECT user_id, name, SUM(shares), SUM(shares * close) FROM traded JOIN priced USING (ticker) GROUP BY user_id, name""",
    "get_moving_averages": """
CREATE OR REPLACE TEMPORARY FUNCTION get_moving_averages(ticker_param STRING, as_of DATE)
RETURNS TABLE (ticker STRING, moving_avg_50 DOUBLE, moving_avg_200 DOUBLE)
RETURN
  WITH w AS (
    SELECT s.ticker, CAST(sp.price AS DOUBLE) AS price, sp.date >= date_sub(as_of, 50) AS in_50
    FROM stock s LEFT JOIN stock_prices sp
      ON sp.ticker = s.ticker AND sp.date >= date_sub(as_of, 200) AND sp.date <= as_of
    WHERE ticker_param IS NULL OR s.ticker = ticker_param)
  SELECT ticker, AVG(CASE WHEN in_50 THEN price END), AVG(price) FROM w GROUP BY ticker""",
}

VIEWS = ["stock", "yearly_financials", "market_analysis", "portfolio", "txn", "stock_prices"]


def register_functions(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """Create the temporary views and SQL functions; returns the function names."""
    for v in VIEWS:
        if v in tables:
            tables[v].createOrReplaceTempView(v)
    for stmt in FUNCTIONS.values():
        spark.sql(stmt)
    return list(FUNCTIONS)
