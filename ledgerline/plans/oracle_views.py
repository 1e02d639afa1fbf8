"""Fixture views as DuckDB SQL, for the independent SQL oracle.

The driver registers only the raw parquet tables in DuckDB, so every oracle
query is prefixed with the domain views it needs as CTEs. The text is the
view list of FIXTURES.md in DuckDB's dialect (``json_extract_string`` for
JSON); the Spark side builds the same tables with the DataFrame API in
``ledgerline.sources.fixtures``.
"""

from __future__ import annotations

import re

# Fixed view definitions (name -> SELECT), in dependency order.
VIEWS: dict[str, str] = {
    "broker": "SELECT n_nationkey AS brokerage_id, n_name AS name FROM nation",
    "account": """SELECT s_suppkey AS user_id, s_name AS name,
       CASE WHEN s_suppkey % 11 = 0 OR s_nationkey >= 22 THEN NULL ELSE s_nationkey END AS brokerage_id,
       CAST(s_acctbal AS DECIMAL(15,2)) AS balance
FROM supplier""",
    "txn": """SELECT concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 14, '0'), lpad(CAST(l_linenumber AS VARCHAR), 2, '0'),
                 lpad(CAST(l_partkey AS VARCHAR), 12, '0'), lpad(CAST(l_suppkey AS VARCHAR), 12, '0'),
                 lpad(CAST(CAST(l_quantity AS INT) AS VARCHAR), 4, '0')) AS transaction_id,
       l_suppkey AS user_id,
       concat('T', CAST(l_partkey AS VARCHAR)) AS stock_ticker,
       CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS type,
       CAST(l_quantity AS INT) AS quantity,
       CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
       l_shipdate AS ts
FROM lineitem""",
    "stock_prices": """SELECT stock_ticker AS ticker, CAST(ts AS DATE) AS date, max_by(price, transaction_id) AS price,
       CAST(SUM(quantity) AS BIGINT) AS volume
FROM txn GROUP BY stock_ticker, CAST(ts AS DATE)""",
    "stock": """SELECT t.ticker, t.name, t.price, h.high_52, h.low_52
FROM (SELECT concat('T', CAST(p_partkey AS VARCHAR)) AS ticker, p_name AS name,
             CASE WHEN p_partkey % 25 = 24 THEN NULL ELSE CAST(p_retailprice * 50 AS DECIMAL(10,2)) END AS price
      FROM part) t
LEFT JOIN (SELECT ticker, max(price) AS high_52, min(price) AS low_52 FROM stock_prices
           WHERE date > DATE '2000-11-04' AND date <= DATE '2001-11-04' GROUP BY ticker) h
  ON t.ticker = h.ticker""",
    "trade_lists": """SELECT user_id, stock_ticker,
         list_reduce(list_concat([{'id': CAST(NULL AS VARCHAR), 'kind': '', 'q': CAST(0 AS BIGINT), 'p': CAST(0 AS BIGINT),
                                   'qty': CAST(0 AS BIGINT), 'avg': CAST(0 AS BIGINT), 'steps': CAST([] AS STRUCT(kind VARCHAR, q BIGINT, p BIGINT, qty BIGINT, avg BIGINT, ok BOOLEAN)[])}],
           list({'id': transaction_id, 'kind': type, 'q': CAST(quantity AS BIGINT), 'p': CAST(price * 100 AS BIGINT),
                 'qty': CAST(0 AS BIGINT), 'avg': CAST(0 AS BIGINT), 'steps': CAST([] AS STRUCT(kind VARCHAR, q BIGINT, p BIGINT, qty BIGINT, avg BIGINT, ok BOOLEAN)[])}
                ORDER BY ts, transaction_id)),
           lambda a, x: {'id': x.id, 'kind': x.kind, 'q': x.q, 'p': x.p,
             'qty': CASE WHEN x.kind = 'BUY' THEN a.qty + x.q WHEN x.q > a.qty THEN a.qty ELSE a.qty - x.q END,
             'avg': CASE WHEN x.kind = 'BUY' THEN (2 * (a.avg * a.qty + x.p * x.q) + a.qty + x.q) // (2 * (a.qty + x.q))
                         WHEN x.q > a.qty THEN a.avg WHEN x.q = a.qty THEN 0 ELSE a.avg END,
             'steps': list_append(a.steps, {'kind': x.kind, 'q': x.q, 'p': x.p,
               'qty': CASE WHEN x.kind = 'BUY' THEN a.qty + x.q WHEN x.q > a.qty THEN a.qty ELSE a.qty - x.q END,
               'avg': CASE WHEN x.kind = 'BUY' THEN (2 * (a.avg * a.qty + x.p * x.q) + a.qty + x.q) // (2 * (a.qty + x.q))
                           WHEN x.q > a.qty THEN a.avg WHEN x.q = a.qty THEN 0 ELSE a.avg END,
               'ok': x.kind = 'BUY' OR x.q <= a.qty})}).steps AS steps
  FROM txn WHERE type IN ('BUY', 'SELL') AND quantity > 0 GROUP BY user_id, stock_ticker""",
    "trade_steps": "SELECT user_id, stock_ticker, unnest(steps) AS step FROM trade_lists",
    "portfolio": """SELECT user_id, stock_ticker, step.qty AS quantity, CAST(step.avg / 100 AS DECIMAL(10,2)) AS avg_price
FROM (SELECT user_id, stock_ticker, steps[-1] AS step FROM trade_lists)
WHERE step.qty > 0""",
    "yearly_financials": """SELECT stock_ticker, year,
       CAST(profit - lag(profit) OVER w AS DOUBLE) / CAST(lag(profit) OVER w AS DOUBLE) AS eps_growth,
       CAST(earnings - lag(earnings) OVER w AS DOUBLE) / CAST(lag(earnings) OVER w AS DOUBLE) AS revenue_growth,
       profit, earnings
FROM (SELECT concat('T', CAST(l_partkey AS VARCHAR)) AS stock_ticker,
             year(l_shipdate) AS year,
             SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(3,2))) AS profit,
             SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS earnings
      FROM lineitem GROUP BY 1, 2) y
WINDOW w AS (PARTITION BY stock_ticker ORDER BY year)""",
    "quarterly_financials": """SELECT concat('T', CAST(l_partkey AS VARCHAR)) AS stock_ticker,
       concat(CAST(year(l_shipdate) AS VARCHAR), 'Q', CAST(quarter(l_shipdate) AS VARCHAR)) AS quarter,
       SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(3,2))) AS profit,
       SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS earnings
FROM lineitem GROUP BY 1, 2""",
    "market_analysis": """SELECT v.stock_ticker,
       CAST(s.price AS DOUBLE) / (CAST(v.amt AS DOUBLE) / CAST(v.volume AS DOUBLE)) AS pe_ratio,
       v.dividend_yield, CAST(s.price * v.volume AS DOUBLE) AS market_cap, v.volume
FROM (SELECT concat('T', CAST(l_partkey AS VARCHAR)) AS stock_ticker,
             CAST(SUM(CAST(l_quantity AS INT)) AS BIGINT) AS volume,
             SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS amt,
             CAST(SUM(CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) / COUNT(*) * 100 AS dividend_yield
      FROM lineitem GROUP BY 1) v
LEFT JOIN stock s ON v.stock_ticker = s.ticker""",
    "ticks": """SELECT event_id, concat('T', CAST((event_id * 7919 + CAST(json_extract_string(props, '$.k') AS BIGINT)) % (SELECT COUNT(*) FROM part) AS VARCHAR)) AS ticker,
       CAST(value AS DECIMAL(10,2)) AS price, ts
FROM events""",
    "order_requests": """SELECT event_id AS order_id, user_id,
       CASE WHEN event_id % 53 = 0 THEN 'X999'
            ELSE concat('T', CAST((event_id * 7919 + CAST(json_extract_string(props, '$.k') AS BIGINT)) % (SELECT COUNT(*) FROM part) AS VARCHAR)) END AS ticker,
       CASE WHEN event_type IN ('click', 'error') THEN 'SELL' ELSE 'BUY' END AS type,
       CAST(event_id % 60 - 3 AS INT) AS quantity,
       CAST(value AS DECIMAL(10,2)) AS price, ts
FROM events""",
    "deposits": """SELECT event_id AS deposit_id, user_id, CAST(value AS DECIMAL(15,2)) - 20 AS amount
FROM events WHERE event_type = 'signup'""",
    "signups": """SELECT c_custkey AS signup_id,
       CASE WHEN c_custkey % 10 = 0 THEN concat('SUPPLIER#', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) ELSE c_name END AS name,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_nationkey + 3 END AS brokerage_id,
       CAST(c_acctbal AS DECIMAL(15,2)) AS balance
FROM customer""",
    "snapshots": """SELECT concat('T', CAST(p_partkey AS VARCHAR)) AS ticker,
       CASE WHEN p_partkey % 7 = 0 THEN concat('{"longName":"', p_name, '"}')
            ELSE concat('{"longName":"', p_name, '","trailingPE":', CAST(p_size AS VARCHAR),
                        ',"marketCap":', CAST(p_size * 1000000 + p_partkey AS VARCHAR),
                        ',"totalRevenue":', CAST(p_size * 500000 + p_partkey AS VARCHAR), '}') END AS raw
FROM part""",
}


def _refs(sql: str) -> set[str]:
    return {v for v in VIEWS if re.search(rf"\b{v}\b", sql)}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every fixture view it (transitively) uses.

    ``sql`` may start with its own ``WITH``; its CTEs are appended after the
    fixture views.
    """
    needed: set[str] = set()
    frontier = _refs(sql)
    while frontier:
        v = frontier.pop()
        if v in needed:
            continue
        needed.add(v)
        frontier |= _refs(VIEWS[v]) - needed
    ordered = [v for v in VIEWS if v in needed]
    body = sql.strip()
    own = ""
    head = "WITH "
    m = re.match(r"(?is)^with(\s+recursive)?\s", body)
    if m:
        if m.group(1):
            head = "WITH RECURSIVE "
        body = body[m.end():].lstrip()
        own = ",\n"
    if not ordered:
        return (head + body) if own else body
    ctes = ",\n".join(f"{v} AS (\n{VIEWS[v]}\n)" for v in ordered)
    return f"{head}{ctes}{own if own else chr(10)}{body}"
