"""Account queries (Q13, Q17, Q18, Q29, Q31, S14) and table audits (K1-K5),
bound to the fixtures, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.exprs import as_double
from ledgerline.operators import accounts, quality
from ledgerline.plans.catalog import register
from ledgerline.schemas import CONSTRAINTS


def _case(col: str, messages: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {col} = '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in messages.items())
    return f"CASE {arms} END"


@register("validate_orders", f"""
WITH o AS (
  SELECT o.order_id, o.user_id, upper(trim(o.ticker)) AS ticker, upper(o.type) AS type, o.quantity, o.price,
         s.ticker IS NOT NULL AS listed, p.quantity AS held, a.balance
  FROM order_requests o
  LEFT JOIN stock s ON s.ticker = upper(trim(o.ticker))
  LEFT JOIN portfolio p ON p.user_id = o.user_id AND p.stock_ticker = upper(trim(o.ticker))
  LEFT JOIN account a ON a.user_id = o.user_id),
c AS (
  SELECT *, CASE WHEN quantity IS NULL OR quantity <= 0
                   OR CAST(quantity AS DOUBLE) <> CAST(floor(quantity) AS DOUBLE) THEN 'invalid_quantity'
                 WHEN type NOT IN ('BUY', 'SELL') OR type IS NULL THEN 'invalid_type'
                 WHEN NOT listed THEN 'unknown_stock'
                 WHEN type = 'BUY' AND (balance IS NULL OR balance < quantity * price) THEN 'insufficient_balance'
                 WHEN type = 'SELL' AND held IS NULL THEN 'not_held'
                 WHEN type = 'SELL' AND held < quantity THEN 'insufficient_shares'
                 ELSE 'accepted' END AS status
  FROM o)
SELECT order_id, user_id, ticker, type, CAST(quantity AS BIGINT) AS quantity, CAST(price AS DOUBLE) AS price,
       CAST(quantity * price AS DOUBLE) AS amount, status, {_case("status", accounts.ORDER_MESSAGES)} AS message
FROM c
""")
def _validate_orders(fx):
    return accounts.validate_orders(fx.order_requests, fx.stock, fx.portfolio, fx.account)


@register("broker_user_counts", """
SELECT CAST(b.brokerage_id AS BIGINT) AS brokerage_id, b.name, CAST(COUNT(u.user_id) AS BIGINT) AS user_count
FROM broker b LEFT JOIN account u ON b.brokerage_id = u.brokerage_id
GROUP BY b.brokerage_id, b.name
""")
def _broker_user_counts(fx):
    return accounts.broker_user_counts(fx.broker, fx.account) \
                   .withColumn("brokerage_id", F.col("brokerage_id").cast("bigint"))


@register("user_directory", """
SELECT u.user_id, u.name, b.name AS brokerage_name, CAST(u.balance AS DOUBLE) AS balance
FROM account u JOIN broker b ON u.brokerage_id = b.brokerage_id
""")
def _user_directory(fx):
    return accounts.user_directory(fx.account, fx.broker)


@register("register_users", f"""
WITH s AS (SELECT *, lower(trim(name)) AS k FROM signups),
j AS (
  SELECT s.*, b.brokerage_id IS NOT NULL AS known, t.k IS NOT NULL AS taken
  FROM s LEFT JOIN broker b ON s.brokerage_id = b.brokerage_id
  LEFT JOIN (SELECT DISTINCT lower(name) AS k FROM account) t ON s.k = t.k),
p AS (
  SELECT *, CASE WHEN brokerage_id IS NULL THEN 'broker_required'
                 WHEN balance IS NULL OR balance < 1000 THEN 'low_balance'
                 WHEN NOT known THEN 'unknown_broker'
                 WHEN taken THEN 'name_taken' END AS pre
  FROM j),
f AS (SELECT k, MIN(signup_id) AS first_id FROM p WHERE pre IS NULL GROUP BY k),
r AS (
  SELECT p.signup_id, p.name, CAST(p.brokerage_id AS BIGINT) AS brokerage_id, CAST(p.balance AS DOUBLE) AS balance,
         COALESCE(p.pre, CASE WHEN p.signup_id = f.first_id THEN 'accepted' ELSE 'name_taken' END) AS status
  FROM p LEFT JOIN f ON p.k = f.k)
SELECT *, {_case("status", accounts.SIGNUP_MESSAGES)} AS message FROM r
""")
def _register_users(fx):
    return accounts.register_users(fx.signups, fx.account, fx.broker)


@register("apply_deposits", """
SELECT a.user_id, CAST(a.balance + COALESCE(c.credit, 0) AS DOUBLE) AS balance
FROM account a
LEFT JOIN (SELECT user_id, SUM(amount) AS credit FROM deposits WHERE amount > 0 GROUP BY user_id) c
  ON a.user_id = c.user_id
""")
def _apply_deposits(fx):
    new_users, _ = accounts.apply_deposits(fx.account, fx.deposits)
    return new_users.select("user_id", as_double("balance").alias("balance"))


@register("deposit_rejects", """
SELECT * FROM (
  SELECT d.deposit_id, d.user_id, CAST(d.amount AS DOUBLE) AS amount,
         CASE WHEN d.amount IS NULL OR d.amount <= 0 THEN 'Amount must be greater than zero'
              WHEN a.user_id IS NULL THEN 'User not found' END AS reason
  FROM deposits d LEFT JOIN account a ON d.user_id = a.user_id) x
WHERE reason IS NOT NULL
""")
def _deposit_rejects(fx):
    _, rejects = accounts.apply_deposits(fx.account, fx.deposits)
    return rejects


@register("purge_stock", """
SELECT p.user_id, p.stock_ticker, p.quantity, CAST(p.avg_price AS DOUBLE) AS avg_price
FROM portfolio p
WHERE p.stock_ticker NOT IN (SELECT ticker FROM stock WHERE price IS NULL)
""")
def _purge_stock(fx):
    _, new_portfolio, _ = _purged(fx)
    return new_portfolio.select("user_id", "stock_ticker", "quantity", as_double("avg_price").alias("avg_price"))


def _purged(fx):
    tickers = fx.stock.where(F.col("price").isNull()).select("ticker")
    refs = [(fx.txn, "stock_ticker"), (fx.yearly_financials, "stock_ticker"),
            (fx.quarterly_financials, "stock_ticker"), (fx.market_analysis, "stock_ticker")]
    return accounts.purge_stock(fx.stock, fx.portfolio, tickers, refs)


# Every part with a trade is referenced; parts without any can go.
_REFERENCED = """(SELECT stock_ticker FROM txn UNION SELECT stock_ticker FROM yearly_financials
  UNION SELECT stock_ticker FROM quarterly_financials UNION SELECT stock_ticker FROM market_analysis)"""


@register("purge_stock_remaining", f"""
SELECT ticker, CAST(price AS DOUBLE) AS price FROM stock WHERE price IS NOT NULL OR ticker IN {_REFERENCED}
""")
def _purge_stock_remaining(fx):
    return _purged(fx)[0].select("ticker", as_double("price").alias("price"))


@register("purge_stock_refused", f"""
SELECT ticker, 'referenced by other tables; its positions were deleted' AS reason
FROM stock WHERE price IS NULL AND ticker IN {_REFERENCED}
""")
def _purge_stock_refused(fx):
    return _purged(fx)[2].select("ticker", "reason")


@register("purge_users_remaining", """
SELECT a.user_id, a.name FROM account a
WHERE a.brokerage_id IS NOT NULL OR a.user_id IN (SELECT user_id FROM txn) OR a.user_id IN (SELECT user_id FROM portfolio)
""")
def _purge_users_remaining(fx):
    ids = fx.account.where(F.col("brokerage_id").isNull()).select("user_id")
    new_users, _ = accounts.purge_users(fx.account, ids, [(fx.txn, "user_id"), (fx.portfolio, "user_id")])
    return new_users.select("user_id", "name")


@register("purge_users", """
SELECT a.user_id,
       CASE WHEN EXISTS (SELECT 1 FROM txn t WHERE t.user_id = a.user_id)
              OR EXISTS (SELECT 1 FROM portfolio p WHERE p.user_id = a.user_id)
            THEN 'refused' ELSE 'deleted' END AS status
FROM account a WHERE a.brokerage_id IS NULL
""")
def _purge_users(fx):
    ids = fx.account.where(F.col("brokerage_id").isNull()).select("user_id")
    _, outcome = accounts.purge_users(fx.account, ids, [(fx.txn, "user_id"), (fx.portfolio, "user_id")])
    return outcome


# -- audits ------------------------------------------------------------------
# Audited tables: the fixture tables, with rows added as if they had been
# appended unchecked, so that every rule has something to find: the incoming
# order requests to the trades and to the price audit, and every fiftieth part
# once more to the stocks, at a price beyond the column and half of them unnamed.

_AUDIT_SOURCES = {name: name for name in CONSTRAINTS}
_AUDIT_SOURCES |= {"txn": "txn_all", "stock": "stock_all", "stock_audit": "stock_audit"}
_TXN_ALL = """txn_all AS (
  SELECT transaction_id, user_id, stock_ticker, type, quantity, price, ts FROM txn
  UNION ALL
  SELECT lpad(CAST(order_id AS VARCHAR), 18, '0'), user_id, ticker, type, quantity, price, ts FROM order_requests),
stock_all AS (
  SELECT ticker, name, price, high_52, low_52 FROM stock
  UNION ALL
  SELECT concat('T', CAST(p_partkey AS VARCHAR)), CASE WHEN p_partkey % 100 > 0 THEN p_name END,
         CAST(p_retailprice * 10000000 AS DECIMAL(18,2)), NULL, NULL
  FROM part WHERE p_partkey % 50 = 0),
stock_audit AS (SELECT order_id AS audit_id, ticker, price AS new_price FROM order_requests)"""


def _audit_tables(fx):
    t = fx.tables()
    o = fx.order_requests
    t["txn"] = t["txn"].unionByName(o.select(F.lpad(F.col("order_id").cast("string"), 18, "0").alias("transaction_id"), "user_id",
                                             F.col("ticker").alias("stock_ticker"), "type", "quantity",
                                             "price", "ts"))
    p = fx.raw("part").where(F.col("p_partkey") % 50 == 0)
    nothing = F.lit(None).cast("decimal(10,2)")
    t["stock"] = fx.stock.unionByName(p.select(
        F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("ticker"),
        F.when(F.col("p_partkey") % 100 > 0, F.col("p_name")).alias("name"),
        (F.col("p_retailprice") * 10000000).cast("decimal(18,2)").alias("price"), nothing.alias("high_52"), nothing.alias("low_52")))
    t["stock_audit"] = o.select(F.col("order_id").alias("audit_id"), "ticker", F.col("price").alias("new_price"))
    return t


def _sql_key(cols) -> str:
    return "concat_ws('|', " + ", ".join(f"COALESCE(CAST({c} AS VARCHAR), 'NULL')" for c in cols) + ")"


def _sel(table, rule, key, value, src, where="", group=""):
    return (f"SELECT '{table}' AS \"table\", '{rule}' AS rule, {key} AS key, CAST({value} AS VARCHAR) AS value "
            f"FROM {src} {where} {group}")


def _audit_sql(kind: str) -> str:
    parts = []
    for name, spec in CONSTRAINTS.items():
        src = _AUDIT_SOURCES[name]
        pk = spec["pk"]
        if kind == "pk":
            for rule, cols in [("primary_key", pk)] + [("unique:" + ",".join(u), u) for u in spec.get("unique", [])]:
                nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
                parts.append(_sel(name, rule + ":duplicate", _sql_key(cols), "COUNT(*)", src,
                                  f"WHERE {nn}", f"GROUP BY {', '.join(cols)} HAVING COUNT(*) > 1"))
            anynull = " OR ".join(f"{c} IS NULL" for c in pk)
            parts.append(_sel(name, "primary_key:null", _sql_key(pk), "NULL", src, f"WHERE {anynull}"))
        elif kind == "fk":
            for cols, parent, pcols in spec.get("fk", []):
                psrc = _AUDIT_SOURCES.get(parent, parent)
                nn = " AND ".join(f"c.{c} IS NOT NULL" for c in cols)
                match = " AND ".join(f"p.{pc} = c.{c}" for c, pc in zip(cols, pcols))
                parts.append(_sel(name, f"foreign_key:{','.join(cols)}->{parent}",
                                  _sql_key([f"c.{c}" for c in pk]), _sql_key([f"c.{c}" for c in cols]), f"{src} c",
                                  f"WHERE {nn} AND NOT EXISTS (SELECT 1 FROM {psrc} p WHERE {match})"))
        elif kind == "check":
            for rule, cond in spec.get("check", {}).items():
                parts.append(_sel(name, "check:" + rule, _sql_key(pk), "'" + cond.replace("'", "''") + "'",
                                  src, f"WHERE NOT ({cond})"))
        elif kind == "not_null":
            for c in spec.get("not_null", []):
                parts.append(_sel(name, "not_null:" + c, _sql_key(pk), "NULL", src, f"WHERE {c} IS NULL"))
        elif kind == "precision":
            for c, (p, s) in spec.get("numeric", {}).items():
                parts.append(_sel(name, f"numeric({p},{s}):{c}", _sql_key(pk), f"CAST({c} AS DECIMAL(38,4))", src,
                                  f"WHERE abs(round(CAST({c} AS DOUBLE), {s})) >= CAST({10 ** (p - s)} AS DOUBLE)"))
            for c, n in spec.get("varchar", {}).items():
                parts.append(_sel(name, f"varchar({n}):{c}", _sql_key(pk), f"length({c})", src,
                                  f"WHERE length({c}) > {n}"))
    return f"WITH {_TXN_ALL}\n" + "\nUNION ALL\n".join(parts)


for _key_name, _kind, _fn in [
    ("check_primary_keys", "pk", quality.check_primary_keys),
    ("check_foreign_keys", "fk", quality.check_foreign_keys),
    ("check_domains", "check", quality.check_domains),
    ("check_not_null", "not_null", quality.check_not_null),
    ("check_precision", "precision", quality.check_precision),
]:
    register(_key_name, _audit_sql(_kind))(lambda fx, _f=_fn: _f(_audit_tables(fx)))
