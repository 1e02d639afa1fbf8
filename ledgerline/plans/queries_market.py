"""Market queries (Q9, Q10, Q15, Q16, Q19-Q28, Q30) and the batch twins of the
price triggers, bound to the fixtures, with their SQL oracles.

Screens use the fixture parameters that make them selective on synthetic
prices (FIXTURES.md): year 2000, P/E below 21.7, high/low ratio 70.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.exprs import as_double
from ledgerline.operators import market
from ledgerline.plans.catalog import PRICE_AS_OF, register
from ledgerline.plans.queries_ledger import _r2
from ledgerline.sources.tables import parse_snapshot

SCREEN_YEAR = 2000
SCREEN_MAX_PE = 21.7
RANGE_RATIO = 70


@register("moving_averages", f"""
WITH m AS (
  SELECT ticker,
         CAST(SUM(CASE WHEN date >= DATE '{PRICE_AS_OF}' - INTERVAL 50 DAY THEN price END) AS DOUBLE)
           / CAST(NULLIF(COUNT(CASE WHEN date >= DATE '{PRICE_AS_OF}' - INTERVAL 50 DAY THEN price END), 0) AS DOUBLE) AS a50,
         CAST(SUM(price) AS DOUBLE) / CAST(NULLIF(COUNT(price), 0) AS DOUBLE) AS a200
  FROM stock_prices
  WHERE date >= DATE '{PRICE_AS_OF}' - INTERVAL 200 DAY AND date <= DATE '{PRICE_AS_OF}'
  GROUP BY ticker)
SELECT s.ticker, {_r2("m.a50")} AS moving_avg_50, {_r2("m.a200")} AS moving_avg_200
FROM stock s LEFT JOIN m ON s.ticker = m.ticker
""")
def _moving_averages(fx):
    return market.moving_averages(fx.stock, fx.stock_prices, PRICE_AS_OF)


@register("moving_average_series", """
SELECT ticker, date, CAST(price AS DOUBLE) AS price,
       CAST(SUM(price) OVER w AS DOUBLE) / CAST(COUNT(price) OVER w AS DOUBLE) AS moving_avg_50
FROM stock_prices
WINDOW w AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 50 DAY PRECEDING AND CURRENT ROW)
""", dates=("date",))
def _moving_average_series(fx):
    return market.moving_average_series(fx.stock_prices, 50)


@register("moving_average_series_200", """
SELECT ticker, date, CAST(price AS DOUBLE) AS price,
       CAST(SUM(price) OVER w AS DOUBLE) / CAST(COUNT(price) OVER w AS DOUBLE) AS moving_avg_200
FROM stock_prices
WINDOW w AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 200 DAY PRECEDING AND CURRENT ROW)
""", dates=("date",))
def _moving_average_series_200(fx):
    return market.moving_average_series(fx.stock_prices, 200)


@register("top_movers", f"""
WITH r AS (
  SELECT ticker, date, price, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn
  FROM stock_prices WHERE date <= DATE '{PRICE_AS_OF}'),
o AS (SELECT ticker, arg_min(price, date) AS old_price, COUNT(*) AS n FROM r WHERE rn <= 7 GROUP BY ticker),
j AS (
  SELECT s.ticker, s.name, s.price, o.old_price,
         {_r2("(CAST(s.price AS DOUBLE) - CAST(o.old_price AS DOUBLE)) / NULLIF(CAST(o.old_price AS DOUBLE), 0) * 100")} AS percentage_change
  FROM stock s JOIN o ON s.ticker = o.ticker
  WHERE s.price IS NOT NULL AND o.n >= 2),
k AS (SELECT *, CASE WHEN percentage_change > 0 THEN 'gainer' ELSE 'loser' END AS side
      FROM j WHERE percentage_change IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY side ORDER BY CASE WHEN side = 'gainer' THEN -percentage_change
                                                            ELSE percentage_change END, ticker) AS rk
  FROM k)
SELECT side, CAST(rk AS BIGINT) AS rank, ticker, name, CAST(price AS DOUBLE) AS price,
       CAST(old_price AS DOUBLE) AS old_price, percentage_change
FROM ranked WHERE rk <= 5
""")
def _top_movers(fx):
    return market.top_movers(fx.stock, fx.stock_prices, PRICE_AS_OF, n=7, k=5)


@register("high_range_stocks", f"""
SELECT ticker, name, CAST(high_52 AS DOUBLE) AS high_52, CAST(low_52 AS DOUBLE) AS low_52
FROM stock WHERE high_52 >= {RANGE_RATIO} * low_52
""")
def _high_range_stocks(fx):
    return market.high_range_stocks(fx.stock, ratio=RANGE_RATIO)


@register("low_stocks", """
SELECT ticker, name, CAST(high_52 AS DOUBLE) AS high_52, CAST(low_52 AS DOUBLE) AS low_52
FROM stock WHERE low_52 = low_52
""")
def _low_stocks(fx):
    return market.low_stocks(fx.stock)


@register("stock_listing", """
SELECT ticker, name, CAST(price AS DOUBLE) AS price, CAST(high_52 AS DOUBLE) AS high_52,
       CAST(low_52 AS DOUBLE) AS low_52
FROM stock
""")
def _stock_listing(fx):
    return market.stock_listing(fx.stock)


@register("screen_eps_pe", """
WITH cheap AS (SELECT stock_ticker AS ticker, pe_ratio AS pe FROM market_analysis WHERE pe_ratio <= 100),
growing AS (SELECT stock_ticker AS ticker, CAST(year AS BIGINT) AS year, eps_growth AS eps
            FROM yearly_financials WHERE eps_growth >= 0)
SELECT ticker, (SELECT name FROM stock WHERE stock.ticker = growing.ticker) AS name, year, eps, pe
FROM growing JOIN cheap USING (ticker)
WHERE ticker IN (SELECT ticker FROM stock)
""")
def _screen_eps_pe(fx):
    return market.screen_eps_pe(fx.stock, fx.yearly_financials, fx.market_analysis, 0.0, 100.0) \
                 .withColumn("year", F.col("year").cast("bigint"))


@register("highest_eps_growth", f"""
WITH known AS (
  SELECT stock_ticker AS ticker, eps_growth FROM yearly_financials
  WHERE year = {SCREEN_YEAR} AND eps_growth = eps_growth AND stock_ticker IN (SELECT ticker FROM stock)),
ranked AS (SELECT *, row_number() OVER (ORDER BY eps_growth DESC, ticker) AS place FROM known)
SELECT ticker, name, eps_growth FROM ranked JOIN stock USING (ticker) WHERE place <= 5
""")
def _highest_eps_growth(fx):
    return market.highest_eps_growth(fx.stock, fx.yearly_financials, SCREEN_YEAR, k=5)


@register("undervalued_stocks", f"""
WITH growth AS (SELECT stock_ticker AS ticker, max(eps_growth) AS eps_growth FROM yearly_financials
                WHERE year = {SCREEN_YEAR} GROUP BY 1 HAVING max(eps_growth) > 0.1),
value AS (SELECT stock_ticker AS ticker, min(pe_ratio) AS pe_ratio FROM market_analysis
          GROUP BY 1 HAVING min(pe_ratio) < {SCREEN_MAX_PE})
SELECT ticker, name, pe_ratio, eps_growth FROM value NATURAL JOIN growth NATURAL JOIN (SELECT ticker, name FROM stock)
""")
def _undervalued_stocks(fx):
    return market.undervalued_stocks(fx.stock, fx.market_analysis, fx.yearly_financials, SCREEN_YEAR,
                                     max_pe=SCREEN_MAX_PE, min_eps=0.1)


@register("most_traded", """
WITH listed AS (
  SELECT ticker, name, (SELECT max(volume) FROM market_analysis WHERE stock_ticker = ticker) AS total_volume FROM stock)
SELECT ticker, name, total_volume FROM listed
WHERE total_volume >= 0 QUALIFY row_number() OVER (ORDER BY total_volume DESC, ticker) <= 10
""")
def _most_traded(fx):
    return market.most_traded(fx.stock, fx.market_analysis, k=10)


@register("stock_profile", """
WITH y AS (SELECT * FROM yearly_financials
           QUALIFY row_number() OVER (PARTITION BY stock_ticker ORDER BY year DESC) = 1),
q AS (SELECT * FROM quarterly_financials
      QUALIFY row_number() OVER (PARTITION BY stock_ticker ORDER BY quarter DESC) = 1)
SELECT s.ticker, s.name, CAST(s.price AS DOUBLE) AS price, CAST(s.high_52 AS DOUBLE) AS high_52,
       CAST(s.low_52 AS DOUBLE) AS low_52,
       CAST(y.year AS BIGINT) AS yearly_financials_year, y.eps_growth AS yearly_financials_eps_growth,
       y.revenue_growth AS yearly_financials_revenue_growth, CAST(y.profit AS DOUBLE) AS yearly_financials_profit,
       CAST(y.earnings AS DOUBLE) AS yearly_financials_earnings,
       q.quarter AS quarterly_financials_quarter, CAST(q.profit AS DOUBLE) AS quarterly_financials_profit,
       CAST(q.earnings AS DOUBLE) AS quarterly_financials_earnings,
       m.pe_ratio AS market_analysis_pe_ratio, m.dividend_yield AS market_analysis_dividend_yield,
       m.market_cap AS market_analysis_market_cap, m.volume AS market_analysis_volume
FROM stock s
LEFT JOIN y ON s.ticker = y.stock_ticker
LEFT JOIN q ON s.ticker = q.stock_ticker
LEFT JOIN market_analysis m ON s.ticker = m.stock_ticker
""")
def _stock_profile(fx):
    p = market.flatten(market.stock_profile(fx.stock, fx.yearly_financials, fx.quarterly_financials,
                                            fx.market_analysis))
    return p.withColumn("yearly_financials_year", F.col("yearly_financials_year").cast("bigint"))


@register("price_chart", f"""
SELECT ticker, strftime(date, '%Y-%m-%d') AS date, CAST(price AS DOUBLE) AS price
FROM stock_prices
WHERE date > DATE '{PRICE_AS_OF}' - INTERVAL 6 MONTH AND date <= DATE '{PRICE_AS_OF}'
""")
def _price_chart(fx):
    return market.price_chart(fx.stock_prices, PRICE_AS_OF, months=6)


_SNAP = """
  SELECT ticker,
         json_extract_string(raw, '$.longName') AS long_name,
         CAST(json_extract_string(raw, '$.trailingPE') AS DOUBLE) AS trailing_pe,
         CAST(json_extract_string(raw, '$.dividendYield') AS DOUBLE) AS dividend_yield,
         CAST(json_extract_string(raw, '$.marketCap') AS DOUBLE) AS market_cap,
         CAST(json_extract_string(raw, '$.fiftyTwoWeekHigh') AS DOUBLE) AS high_52,
         CAST(json_extract_string(raw, '$.fiftyTwoWeekLow') AS DOUBLE) AS low_52,
         CAST(json_extract_string(raw, '$.earningsGrowth') AS DOUBLE) AS eps_growth,
         CAST(json_extract_string(raw, '$.revenueGrowth') AS DOUBLE) AS revenue_growth,
         CAST(json_extract_string(raw, '$.netIncomeToCommon') AS DOUBLE) AS net_income,
         CAST(json_extract_string(raw, '$.totalRevenue') AS DOUBLE) AS total_revenue
  FROM snapshots"""


@register("market_refresh", f"""
WITH last AS (
  SELECT ticker, arg_max(price, date) AS price, arg_max(volume, date) AS volume
  FROM stock_prices WHERE date <= DATE '{PRICE_AS_OF}' GROUP BY ticker),
snap AS ({_SNAP})
SELECT s.ticker, COALESCE(sn.long_name, 'Unknown') AS name, CAST(l.price AS DOUBLE) AS price,
       COALESCE(sn.high_52, CAST(0 AS DOUBLE)) AS high_52, COALESCE(sn.low_52, CAST(0 AS DOUBLE)) AS low_52,
       COALESCE(sn.trailing_pe, CAST(0 AS DOUBLE)) AS pe_ratio,
       COALESCE(sn.dividend_yield, CAST(0 AS DOUBLE)) * 100 AS dividend_yield,
       {_r2("COALESCE(sn.market_cap, CAST(0 AS DOUBLE)) / 1e6")} AS market_cap,
       CAST(l.volume AS BIGINT) AS volume,
       COALESCE(sn.eps_growth, CAST(0 AS DOUBLE)) AS eps_growth,
       COALESCE(sn.revenue_growth, CAST(0 AS DOUBLE)) AS revenue_growth,
       {_r2("COALESCE(sn.net_income, CAST(0 AS DOUBLE)) / 1e6")} AS profit,
       {_r2("COALESCE(sn.total_revenue, CAST(0 AS DOUBLE)) / 1e6")} AS earnings,
       CAST({SCREEN_YEAR + 1} AS BIGINT) AS year
FROM stock s JOIN last l ON s.ticker = l.ticker LEFT JOIN snap sn ON s.ticker = sn.ticker
""")
def _market_refresh(fx):
    return market.market_refresh(fx.stock, fx.snapshots, fx.stock_prices, PRICE_AS_OF, SCREEN_YEAR + 1) \
                 .withColumn("year", F.col("year").cast("bigint"))


# The refreshed rows upserted into the three tables they belong to.
_REFRESH = f"""WITH last AS (
  SELECT ticker, arg_max(price, date) AS price, arg_max(volume, date) AS volume
  FROM stock_prices WHERE date <= DATE '{PRICE_AS_OF}' GROUP BY ticker),
snap AS ({_SNAP}),
fresh AS (
  SELECT s.ticker, COALESCE(sn.long_name, 'Unknown') AS name, l.price, COALESCE(sn.high_52, 0) AS high_52,
         COALESCE(sn.low_52, 0) AS low_52, COALESCE(sn.trailing_pe, 0) AS pe_ratio,
         COALESCE(sn.dividend_yield, 0) * 100 AS dividend_yield,
         {_r2("COALESCE(sn.market_cap, CAST(0 AS DOUBLE)) / 1e6")} AS market_cap, CAST(l.volume AS BIGINT) AS volume,
         COALESCE(sn.eps_growth, 0) AS eps_growth, COALESCE(sn.revenue_growth, 0) AS revenue_growth,
         {_r2("COALESCE(sn.net_income, CAST(0 AS DOUBLE)) / 1e6")} AS profit,
         {_r2("COALESCE(sn.total_revenue, CAST(0 AS DOUBLE)) / 1e6")} AS earnings
  FROM stock s JOIN last l ON s.ticker = l.ticker LEFT JOIN snap sn ON s.ticker = sn.ticker)
"""


def _refreshed(fx):
    changes = market.market_refresh(fx.stock, fx.snapshots, fx.stock_prices, PRICE_AS_OF, SCREEN_YEAR + 1)
    return market.apply_refresh(fx.stock, fx.market_analysis, fx.yearly_financials, changes)


@register("refresh_stock", _REFRESH + """
SELECT ticker, name, CAST(price AS DOUBLE) AS price, CAST(high_52 AS DOUBLE) AS high_52, CAST(low_52 AS DOUBLE) AS low_52
FROM fresh
UNION ALL
SELECT ticker, name, price, high_52, low_52 FROM stock WHERE ticker NOT IN (SELECT ticker FROM fresh)
""")
def _refresh_stock(fx):
    return _refreshed(fx)[0].select("ticker", "name", *[as_double(c).alias(c) for c in ("price", "high_52", "low_52")])


@register("refresh_market", _REFRESH + """
SELECT ticker AS stock_ticker, CAST(pe_ratio AS DOUBLE) AS pe_ratio, CAST(dividend_yield AS DOUBLE) AS dividend_yield,
       CAST(market_cap AS DOUBLE) AS market_cap, volume
FROM fresh
UNION ALL
SELECT stock_ticker, pe_ratio, dividend_yield, market_cap, volume FROM market_analysis
WHERE stock_ticker NOT IN (SELECT ticker FROM fresh)
""")
def _refresh_market(fx):
    return _refreshed(fx)[1]


@register("refresh_yearly", _REFRESH + f"""
SELECT ticker AS stock_ticker, CAST({SCREEN_YEAR + 1} AS BIGINT) AS year, CAST(eps_growth AS DOUBLE) AS eps_growth,
       CAST(revenue_growth AS DOUBLE) AS revenue_growth, CAST(profit AS DOUBLE) AS profit, CAST(earnings AS DOUBLE) AS earnings
FROM fresh
UNION ALL
SELECT stock_ticker, year, eps_growth, revenue_growth, profit, earnings FROM yearly_financials
WHERE (stock_ticker, year) NOT IN (SELECT (ticker, {SCREEN_YEAR + 1}) FROM fresh)
""")
def _refresh_yearly(fx):
    y = _refreshed(fx)[2]
    return y.select("stock_ticker", F.col("year").cast("bigint").alias("year"), "eps_growth", "revenue_growth",
                    as_double("profit").alias("profit"), as_double("earnings").alias("earnings"))


@register("market_cap", """
SELECT ma.stock_ticker, CAST(s.price AS DOUBLE) AS price, ma.volume,
       CAST(s.price * ma.volume AS DOUBLE) AS market_cap_pv, ma.market_cap AS vendor_market_cap
FROM market_analysis ma JOIN stock s ON ma.stock_ticker = s.ticker
""")
def _market_cap(fx):
    return market.market_cap(fx.stock, fx.market_analysis)


@register("add_or_update_stock", """
WITH c AS (
  SELECT upper(trim(lower(ticker))) AS ticker,
         trim(COALESCE(json_extract_string(raw, '$.longName'), 'Unknown')) AS name,
         CAST(COALESCE(CAST(json_extract_string(raw, '$.trailingPE') AS DOUBLE), 0) AS DECIMAL(10,2)) AS price
  FROM snapshots)
SELECT COALESCE(s.ticker, c.ticker) AS ticker,
       CASE WHEN c.ticker IS NOT NULL THEN c.name ELSE s.name END AS name,
       CAST(CASE WHEN c.ticker IS NOT NULL THEN c.price ELSE s.price END AS DOUBLE) AS price,
       CAST(s.high_52 AS DOUBLE) AS high_52, CAST(s.low_52 AS DOUBLE) AS low_52
FROM stock s FULL OUTER JOIN c ON s.ticker = c.ticker
""")
def _add_or_update_stock(fx):
    snap = parse_snapshot(fx.snapshots)
    changes = snap.select(F.lower("ticker").alias("ticker"), F.col("long_name").alias("name"),
                          F.col("trailing_pe").alias("price"))
    new_stock, _ = market.add_or_update_stock(fx.stock, changes)
    return new_stock.select("ticker", "name", *[as_double(c).alias(c) for c in ("price", "high_52", "low_52")])


_LINES = """concat('T', CAST(l_partkey AS VARCHAR)) AS stock_ticker,
         SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(3,2))) AS profit,
         SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS earnings"""


def _facts(fx):
    l = fx.raw("lineitem")
    ext = l.l_extendedprice.cast("decimal(12,2)")
    return l.select(F.concat(F.lit("T"), l.l_partkey.cast("string")).alias("stock_ticker"),
                    l.l_shipdate.alias("ts"), (ext * (1 - l.l_discount).cast("decimal(3,2)")).alias("profit"),
                    ext.alias("earnings"))


@register("financial_rollup_yearly", f"""
WITH y AS (SELECT {_LINES}, year(l_shipdate) AS year FROM lineitem GROUP BY 1, year(l_shipdate))
SELECT stock_ticker, CAST(year AS BIGINT) AS year,
       CAST(profit - lag(profit) OVER w AS DOUBLE) / CAST(lag(profit) OVER w AS DOUBLE) AS eps_growth,
       CAST(earnings - lag(earnings) OVER w AS DOUBLE) / CAST(lag(earnings) OVER w AS DOUBLE) AS revenue_growth,
       CAST(profit AS DOUBLE) AS profit, CAST(earnings AS DOUBLE) AS earnings
FROM y WINDOW w AS (PARTITION BY stock_ticker ORDER BY year)
""")
def _financial_rollup_yearly(fx):
    return market.financial_rollup(_facts(fx), "year").withColumn("year", F.col("year").cast("bigint"))


@register("financial_rollup_quarterly", f"""
WITH y AS (SELECT {_LINES},
                  concat(CAST(year(l_shipdate) AS VARCHAR), 'Q', CAST(quarter(l_shipdate) AS VARCHAR)) AS quarter
           FROM lineitem GROUP BY 1, 4)
SELECT stock_ticker, quarter,
       CAST(profit - lag(profit) OVER w AS DOUBLE) / CAST(lag(profit) OVER w AS DOUBLE) AS eps_growth,
       CAST(earnings - lag(earnings) OVER w AS DOUBLE) / CAST(lag(earnings) OVER w AS DOUBLE) AS revenue_growth,
       CAST(profit AS DOUBLE) AS profit, CAST(earnings AS DOUBLE) AS earnings
FROM y WINDOW w AS (PARTITION BY stock_ticker ORDER BY quarter)
""")
def _financial_rollup_quarterly(fx):
    return market.financial_rollup(_facts(fx), "quarter")


@register("rolling_high_low", """
SELECT ticker, date,
       CAST(MAX(price) OVER w AS DOUBLE) AS high_52, CAST(MIN(price) OVER w AS DOUBLE) AS low_52
FROM stock_prices
WINDOW w AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW)
""", dates=("date",))
def _rolling_high_low(fx):
    return market.rolling_high_low(fx.stock_prices, 364)
