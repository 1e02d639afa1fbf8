"""Ledger queries (Q1-Q8, Q11-Q14) bound to the fixtures, with their SQL oracles."""

from __future__ import annotations

from ledgerline.operators import history, positions
from ledgerline.plans.catalog import LEDGER_AS_OF, PRICE_AS_OF, register

# Mean buy cost of a position up to and including a trade's timestamp, in the
# original correlated-subquery form (the oracle stays literal; Spark uses a
# bucketed running sum).
_MEAN_BUY_COST = """COALESCE((SELECT CAST(SUM(b.quantity * b.price) AS DOUBLE) / NULLIF(CAST(SUM(b.quantity) AS DOUBLE), 0)
          FROM txn b
          WHERE b.user_id = t.user_id AND b.stock_ticker = t.stock_ticker
            AND b.type = 'BUY' AND b.ts <= t.ts), 0)"""


@register("realized_pnl", f"""
SELECT transaction_id, user_id, stock_ticker, date, quantity, price, avg_buy_cost,
       CAST(quantity AS DOUBLE) * (price - avg_buy_cost) AS realized_pnl
FROM (SELECT t.transaction_id, t.user_id, t.stock_ticker, CAST(t.ts AS DATE) AS date,
             CAST(t.quantity AS BIGINT) AS quantity, CAST(t.price AS DOUBLE) AS price,
             {_MEAN_BUY_COST} AS avg_buy_cost
      FROM txn t WHERE t.type = 'SELL') s
""", dates=("date",))
def _realized_pnl(fx):
    return history.realized_pnl(fx.txn)


@register("transaction_history", f"""
WITH ev AS (
  SELECT t.transaction_id, t.user_id, CAST(t.ts AS DATE) AS date, t.stock_ticker, t.type, t.quantity, t.price,
         CASE WHEN t.type = 'SELL'
              THEN CAST(t.quantity AS DOUBLE) * (CAST(t.price AS DOUBLE) - {_MEAN_BUY_COST})
              ELSE CAST(0 AS DOUBLE) END AS realized_pnl
  FROM txn t),
top AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, transaction_id DESC) AS rn
  FROM ev QUALIFY rn <= 15),
up AS (
  SELECT p.user_id, p.stock_ticker, p.quantity * (s.price - p.avg_price) AS u
  FROM portfolio p JOIN stock s ON p.stock_ticker = s.ticker)
SELECT top.user_id, top.transaction_id, top.date, top.stock_ticker, top.type,
       CAST(top.quantity AS BIGINT) AS quantity, CAST(top.price AS DOUBLE) AS price,
       CAST(top.quantity * top.price AS DOUBLE) AS transaction_amount,
       top.realized_pnl, COALESCE(CAST(up.u AS DOUBLE), CAST(0 AS DOUBLE)) AS unrealized_pnl,
       CAST(top.rn AS BIGINT) AS recency_rank
FROM top LEFT JOIN up ON top.user_id = up.user_id AND top.stock_ticker = up.stock_ticker
""", dates=("date",))
def _transaction_history(fx):
    return history.transaction_history(fx.txn, fx.portfolio, fx.stock, k=15)


@register("portfolio_history", f"""
WITH tx AS (
  SELECT user_id, stock_ticker, CAST(ts AS DATE) AS d,
         CASE WHEN type = 'BUY' THEN quantity ELSE -quantity END AS sq
  FROM txn WHERE CAST(ts AS DATE) <= DATE '{LEDGER_AS_OF}'),
first_day AS (SELECT user_id, MIN(d) AS d0 FROM tx GROUP BY user_id),
all_dates AS (
  SELECT user_id,
         CAST(unnest(generate_series(CAST(d0 AS TIMESTAMP), CAST(DATE '{LEDGER_AS_OF}' AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
  FROM first_day),
cumulative_holdings AS (
  SELECT a.user_id, a.date, t.stock_ticker, SUM(t.sq) AS net_quantity
  FROM all_dates a JOIN tx t ON t.user_id = a.user_id AND t.d <= a.date
  GROUP BY a.user_id, a.date, t.stock_ticker),
valued AS (
  SELECT ch.user_id, ch.date,
         SUM(CASE WHEN ch.net_quantity > 0 THEN ch.net_quantity * s.price ELSE 0 END) AS v
  FROM cumulative_holdings ch JOIN stock s ON s.ticker = ch.stock_ticker
  GROUP BY ch.user_id, ch.date)
SELECT a.user_id, a.date, CAST(v.v AS DOUBLE) AS daily_value,
       MAX(CAST(v.v AS DOUBLE)) OVER (PARTITION BY a.user_id ORDER BY a.date
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS portfolio_value
FROM all_dates a LEFT JOIN valued v ON a.user_id = v.user_id AND a.date = v.date
""", dates=("date",))
def _portfolio_history(fx):
    return history.portfolio_history(fx.txn, fx.stock, as_of=LEDGER_AS_OF)


@register("holdings_by_day", f"""
WITH d AS (
  SELECT user_id, stock_ticker, CAST(ts AS DATE) AS date,
         SUM(CASE WHEN type = 'BUY' THEN quantity ELSE -quantity END) AS net_change
  FROM txn WHERE CAST(ts AS DATE) <= DATE '{LEDGER_AS_OF}' GROUP BY 1, 2, 3)
SELECT user_id, stock_ticker, date AS valid_from,
       lead(date) OVER (PARTITION BY user_id, stock_ticker ORDER BY date) AS valid_to,
       CAST(SUM(net_change) OVER (PARTITION BY user_id, stock_ticker ORDER BY date
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS net_quantity
FROM d
""", dates=("valid_from", "valid_to"))
def _holdings_by_day(fx):
    return history.holdings_by_day(fx.txn, LEDGER_AS_OF)


# Floor-form rounding to cents in DuckDB, equal to ``round2`` in Spark.
def _r2(x: str) -> str:
    return (f"(CASE WHEN ({x}) < 0 THEN -(floor(abs({x}) * 100 + 0.5) / 100) "
            f"ELSE floor(abs({x}) * 100 + 0.5) / 100 + 0.0 END)")


_POS = """
  SELECT p.user_id, p.stock_ticker, s.name AS stock_name, p.quantity, p.avg_price, s.price AS current_price,
         s.ticker IS NOT NULL AS listed,
         p.quantity * p.avg_price AS inv,
         CASE WHEN s.ticker IS NOT NULL THEN p.quantity * s.price END AS val,
         CASE WHEN s.ticker IS NOT NULL THEN p.quantity * s.price - p.quantity * p.avg_price END AS pnl
  FROM portfolio p LEFT JOIN stock s ON p.stock_ticker = s.ticker"""


@register("portfolio_positions", f"""
WITH pos AS ({_POS}),
tot AS (SELECT user_id, SUM(inv) AS t_inv, SUM(val) AS t_val, SUM(pnl) AS t_pnl FROM pos GROUP BY user_id)
SELECT pos.user_id, stock_ticker, stock_name, CAST(quantity AS BIGINT) AS quantity,
       CAST(avg_price AS DOUBLE) AS avg_price, CAST(current_price AS DOUBLE) AS current_price,
       CAST(inv AS DOUBLE) AS total_investment, CAST(val AS DOUBLE) AS current_value,
       CAST(pnl AS DOUBLE) AS profit_loss,
       {_r2("CAST(pnl AS DOUBLE) / NULLIF(CAST(inv AS DOUBLE), 0) * 100")} AS profit_loss_pct,
       CAST(t_inv AS DOUBLE) AS total_portfolio_investment, CAST(t_val AS DOUBLE) AS total_portfolio_value,
       CAST(t_pnl AS DOUBLE) AS total_portfolio_pnl
FROM pos JOIN tot ON pos.user_id = tot.user_id
WHERE listed
""")
def _portfolio_positions(fx):
    return positions.portfolio_positions(fx.portfolio, fx.stock)


@register("portfolio_totals", f"""
WITH pos AS ({_POS}),
tot AS (SELECT user_id, SUM(inv) AS t_inv, SUM(val) AS t_val, SUM(pnl) AS t_pnl,
               COUNT(CASE WHEN listed THEN 1 END) AS n_listed FROM pos GROUP BY user_id)
SELECT a.user_id,
       CASE WHEN COALESCE(n_listed, 0) > 0 THEN CAST(t_inv AS DOUBLE) ELSE 0.0 END AS total_investment,
       CASE WHEN COALESCE(n_listed, 0) > 0 THEN CAST(t_val AS DOUBLE) ELSE 0.0 END AS total_value,
       CASE WHEN COALESCE(n_listed, 0) > 0 THEN CAST(t_pnl AS DOUBLE) ELSE 0.0 END AS total_pnl,
       CASE WHEN COALESCE(n_listed, 0) > 0
            THEN {_r2("(CAST(t_val AS DOUBLE) - CAST(t_inv AS DOUBLE)) / NULLIF(CAST(t_inv AS DOUBLE), 0) * 100")}
            ELSE 0.0 END AS total_pnl_pct
FROM account a LEFT JOIN tot ON a.user_id = tot.user_id
""")
def _portfolio_totals(fx):
    return positions.portfolio_totals(fx.account, fx.portfolio, fx.stock)


@register("allocation", f"""
WITH v AS (
  SELECT t.user_id, t.stock_ticker, SUM(t.quantity * s.price) AS stock_value
  FROM txn t JOIN stock s ON t.stock_ticker = s.ticker GROUP BY t.user_id, t.stock_ticker),
w AS (SELECT *, SUM(stock_value) OVER (PARTITION BY user_id) AS total_value FROM v)
SELECT user_id, stock_ticker AS stock_id, CAST(stock_value AS DOUBLE) AS stock_value,
       CAST(total_value AS DOUBLE) AS total_value,
       {_r2("CAST(stock_value AS DOUBLE) / NULLIF(CAST(total_value AS DOUBLE), 0) * 100")} AS allocation_percentage
FROM w
""")
def _allocation(fx):
    return positions.allocation(fx.txn, fx.stock)


@register("portfolio_summary", f"""
SELECT t.user_id, t.stock_ticker, s.name AS stock_name, CAST(SUM(t.quantity) AS BIGINT) AS total_shares,
       CAST(SUM(t.quantity * sp.price) AS DOUBLE) AS total_value
FROM txn t JOIN stock s ON t.stock_ticker = s.ticker
JOIN stock_prices sp ON sp.ticker = s.ticker
WHERE sp.date = DATE '{PRICE_AS_OF}'
GROUP BY t.user_id, t.stock_ticker, s.name
""")
def _portfolio_summary(fx):
    return positions.portfolio_summary(fx.txn, fx.stock, fx.stock_prices, PRICE_AS_OF)


@register("cash_balance", """
WITH f AS (
  SELECT user_id,
         CAST(SUM(CASE WHEN step.kind = 'BUY' THEN step.q * step.p ELSE 0 END) AS DECIMAL(30,2)) * 0.01 AS buy,
         CAST(SUM(CASE WHEN step.kind = 'SELL' AND step.ok THEN step.q * step.p ELSE 0 END) AS DECIMAL(30,2)) * 0.01 AS sell,
         0 AS dep
  FROM trade_steps GROUP BY user_id
  UNION ALL
  SELECT user_id, 0, 0, SUM(amount) FROM deposits WHERE amount > 0 GROUP BY user_id),
g AS (SELECT user_id, SUM(buy) AS buy, SUM(sell) AS sell, SUM(dep) AS dep FROM f GROUP BY user_id)
SELECT a.user_id, CAST(a.balance AS DOUBLE) AS opening_balance,
       CAST(COALESCE(dep, 0) AS DOUBLE) AS deposits, CAST(COALESCE(buy, 0) AS DOUBLE) AS bought,
       CAST(COALESCE(sell, 0) AS DOUBLE) AS sold,
       CAST(a.balance + COALESCE(dep, 0) - COALESCE(buy, 0) + COALESCE(sell, 0) AS DOUBLE) AS balance
FROM account a LEFT JOIN g ON a.user_id = g.user_id
""")
def _cash_balance(fx):
    return positions.cash_balance(fx.account, fx.txn, fx.deposits)


# Ordered replay as a recursive CTE: one recursion step per trade of a position.
_REPLAY = """
WITH RECURSIVE t AS (
  SELECT transaction_id, user_id, stock_ticker, type, CAST(quantity AS BIGINT) AS q,
         CAST(price * 100 AS BIGINT) AS p,
         row_number() OVER (PARTITION BY user_id, stock_ticker ORDER BY ts, transaction_id) AS step
  FROM txn WHERE type IN ('BUY', 'SELL') AND quantity > 0),
r AS (
  SELECT DISTINCT user_id, stock_ticker, CAST(0 AS BIGINT) AS step, CAST(NULL AS VARCHAR) AS transaction_id,
         CAST(NULL AS VARCHAR) AS status, CAST(0 AS BIGINT) AS qty, CAST(0 AS BIGINT) AS avg_c,
         CAST(0 AS BIGINT) AS realized
  FROM t
  UNION ALL
  SELECT t.user_id, t.stock_ticker, t.step, t.transaction_id,
         CASE WHEN t.type = 'BUY' THEN 'BOUGHT' WHEN t.q > r.qty THEN 'REJECTED' ELSE 'SOLD' END,
         CASE WHEN t.type = 'BUY' THEN r.qty + t.q WHEN t.q > r.qty THEN r.qty ELSE r.qty - t.q END,
         CASE WHEN t.type = 'BUY' THEN (2 * (r.avg_c * r.qty + t.p * t.q) + r.qty + t.q) // (2 * (r.qty + t.q))
              WHEN t.q > r.qty THEN r.avg_c
              WHEN r.qty = t.q THEN 0 ELSE r.avg_c END,
         CASE WHEN t.type = 'SELL' AND t.q <= r.qty THEN t.q * (t.p - r.avg_c) ELSE 0 END
  FROM r JOIN t ON t.user_id = r.user_id AND t.stock_ticker = r.stock_ticker AND t.step = r.step + 1)
"""


@register("position_ledger", _REPLAY + """
SELECT user_id, stock_ticker,
       arg_max(qty, step) AS quantity,
       CAST(arg_max(avg_c, step) AS DOUBLE) / 100 AS avg_price,
       CAST(SUM(realized) AS DOUBLE) / 100 AS realized_pnl,
       CAST(COUNT(*) AS BIGINT) AS n_trades,
       CAST(SUM(CASE WHEN status = 'REJECTED' THEN 1 ELSE 0 END) AS BIGINT) AS n_rejected
FROM r WHERE step > 0
GROUP BY user_id, stock_ticker
""")
def _position_ledger(fx):
    return positions.position_ledger(fx.txn)


@register("ledger_steps", _REPLAY + """
SELECT r.transaction_id, r.user_id, r.stock_ticker, t.type, t.q AS quantity, t.p AS price_cents, r.step,
       r.status, r.qty AS qty_after, r.avg_c AS avg_cents_after, r.realized AS realized_cents
FROM r JOIN t ON r.user_id = t.user_id AND r.stock_ticker = t.stock_ticker AND r.step = t.step
WHERE r.step > 0
""")
def _ledger_steps(fx):
    return positions.ledger_steps(fx.txn)


# Orders as a recursive CTE: one recursion step per order of a user, over cash and a map of shares.
_ORDERS = """
WITH RECURSIVE o AS (
  SELECT r.order_id, r.user_id, upper(trim(r.ticker)) AS ticker, upper(r.type) AS type, CAST(r.quantity AS BIGINT) AS q,
         CAST(r.price * 100 AS BIGINT) AS p,
         CASE WHEN r.quantity <= 0 THEN 'invalid_quantity'
              WHEN upper(trim(r.ticker)) NOT IN (SELECT ticker FROM stock) THEN 'unknown_stock'
              WHEN r.price IS NULL THEN 'invalid_price' END AS refused,
         row_number() OVER (PARTITION BY r.user_id ORDER BY r.ts, r.order_id) AS turn
  FROM order_requests r),
opening AS (SELECT user_id, map_from_entries(list({'k': stock_ticker, 'v': {'n': quantity, 'c': CAST(avg_price * 100 AS BIGINT)}})) AS held
            FROM portfolio GROUP BY user_id),
s AS (
  SELECT u.user_id, CAST(0 AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS status, CAST(a.balance * 100 AS BIGINT) AS cash,
         COALESCE(h.held, MAP {'': {'n': CAST(0 AS BIGINT), 'c': CAST(0 AS BIGINT)}}) AS held, CAST(0 AS BIGINT) AS shares,
         CAST(0 AS BIGINT) AS before
  FROM (SELECT DISTINCT user_id FROM o) u LEFT JOIN account a USING (user_id) LEFT JOIN opening h USING (user_id)
  UNION ALL
  SELECT user_id, turn, status,
         CASE WHEN status <> 'accepted' THEN cash WHEN type = 'BUY' THEN cash - q * p ELSE cash + q * p END,
         CASE WHEN status <> 'accepted' THEN held
              ELSE map_concat(held, map_from_entries([{'k': ticker, 'v': {'n': CASE WHEN type = 'BUY' THEN n + q ELSE n - q END,
                'c': CASE WHEN type = 'BUY' THEN (2 * (c * n + p * q) + n + q) // (2 * (n + q)) WHEN n = q THEN 0 ELSE c END}}])) END,
         CASE WHEN status <> 'accepted' THEN n WHEN type = 'BUY' THEN n + q ELSE n - q END, c
  FROM (SELECT *, CASE WHEN refused IS NOT NULL THEN refused
                       WHEN type = 'BUY' AND (cash IS NULL OR cash < q * p) THEN 'insufficient_balance'
                       WHEN type = 'SELL' AND n = 0 THEN 'not_held' WHEN type = 'SELL' AND n < q THEN 'insufficient_shares'
                       ELSE 'accepted' END AS status
        FROM (SELECT o.*, s.cash, s.held, COALESCE(element_at(s.held, o.ticker)[1].n, 0) AS n,
                     COALESCE(element_at(s.held, o.ticker)[1].c, 0) AS c
              FROM s JOIN o ON o.user_id = s.user_id AND o.turn = s.turn + 1) j) k)
"""


def _processed(fx):
    return positions.process_orders(fx.order_requests, fx.account, fx.portfolio, fx.stock)


@register("process_orders", _ORDERS + """
SELECT o.order_id, o.user_id, o.ticker, o.type, o.q AS quantity, CAST(o.p AS DOUBLE) / 100 AS price, s.status,
       CAST(s.cash AS DOUBLE) / 100 AS cash_after, s.shares AS shares_after
FROM s JOIN o ON o.user_id = s.user_id AND o.turn = s.turn
""")
def _process_orders(fx):
    return positions.processed_orders_table(_processed(fx))


@register("sell_proceeds", _ORDERS + """
SELECT o.order_id, o.user_id, o.ticker AS stock_ticker, o.q AS quantity, CAST(o.q * o.p AS DOUBLE) / 100 AS total_value,
       CAST(o.q * (o.p - s.before) AS DOUBLE) / 100 AS profit
FROM s JOIN o ON o.user_id = s.user_id AND o.turn = s.turn
WHERE o.type = 'SELL' AND s.status = 'accepted'
""")
def _sell_proceeds(fx):
    return positions.sell_proceeds(_processed(fx))
