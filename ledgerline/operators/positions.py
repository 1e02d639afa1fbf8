"""Position and cash operators for all users at once (Q1-Q3, Q7, Q11, Q12, Q14)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerline.functions.exprs import as_double, round2, safe_div

POSITION_KEY = ["user_id", "stock_ticker"]


def _priced_positions(portfolio: DataFrame, stock: DataFrame) -> DataFrame:
    s = stock.select(F.col("ticker").alias("stock_ticker"), F.col("name").alias("stock_name"),
                     F.col("price").alias("current_price"), F.lit(True).alias("_listed"))
    p = portfolio.join(s, "stock_ticker", "left")
    listed = F.col("_listed").isNotNull()
    inv = F.col("quantity") * F.col("avg_price")
    val = F.col("quantity") * F.col("current_price")
    return p.select(
        "user_id", "stock_ticker", "stock_name", "quantity", "avg_price", "current_price", "_listed",
        inv.alias("_inv"),
        F.when(listed, val).alias("_val"),
        F.when(listed, val - inv).alias("_pnl"),
    )


def portfolio_positions(portfolio: DataFrame, stock: DataFrame, user_id=None) -> DataFrame:
    """Q1: every position with cost, value, P&L and P&L %, plus the user's
    totals on each row.

    Total investment counts all of the user's positions; total value and P&L
    only positions in listed stocks (as the original correlated subqueries).
    The three per-user totals are one window over ``user_id``; its partitions
    hold at most one row per listed ticker, whatever the trade volume.
    """
    p = portfolio if user_id is None else portfolio.where(F.col("user_id") == F.lit(user_id))
    p = _priced_positions(p, stock)
    w = Window.partitionBy("user_id")
    p = p.select("*",
                 F.sum("_inv").over(w).alias("_t_inv"),
                 F.sum("_val").over(w).alias("_t_val"),
                 F.sum("_pnl").over(w).alias("_t_pnl"))
    p = p.where(F.col("_listed").isNotNull())
    return p.select(
        "user_id", "stock_ticker", "stock_name",
        F.col("quantity").cast("bigint").alias("quantity"),
        as_double("avg_price").alias("avg_price"),
        as_double("current_price").alias("current_price"),
        as_double("_inv").alias("total_investment"),
        as_double("_val").alias("current_value"),
        as_double("_pnl").alias("profit_loss"),
        round2(safe_div("_pnl", "_inv") * 100).alias("profit_loss_pct"),
        as_double("_t_inv").alias("total_portfolio_investment"),
        as_double("_t_val").alias("total_portfolio_value"),
        as_double("_t_pnl").alias("total_portfolio_pnl"),
    )


def portfolio_totals(users: DataFrame, portfolio: DataFrame, stock: DataFrame) -> DataFrame:
    """Q2: per user total investment, value, P&L and P&L % (guarded division);
    users without a listed position get zeros."""
    p = _priced_positions(portfolio, stock)
    t = p.groupBy("user_id").agg(
        F.sum("_inv").alias("_inv"), F.sum("_val").alias("_val"), F.sum("_pnl").alias("_pnl"),
        F.count("_listed").alias("_n_listed"))
    j = users.select("user_id").join(t, "user_id", "left")
    has = F.coalesce(F.col("_n_listed"), F.lit(0)) > 0
    zero = F.lit(0.0)
    return j.select(
        "user_id",
        F.when(has, as_double("_inv")).otherwise(zero).alias("total_investment"),
        F.when(has, as_double("_val")).otherwise(zero).alias("total_value"),
        F.when(has, as_double("_pnl")).otherwise(zero).alias("total_pnl"),
        F.when(has, round2(safe_div(as_double("_val") - as_double("_inv"), "_inv") * 100))
         .otherwise(zero).alias("total_pnl_pct"),
    )


def allocation(txn: DataFrame, stock: DataFrame, signed: bool = False, user_id=None) -> DataFrame:
    """Q3: share of each ticker in the user's traded value at current prices.

    As in the original, buys and sells both add (``signed=False``); with
    ``signed=True`` sells subtract. Per (user, ticker) sums are partially
    aggregated before the shuffle; the per-user total is a window whose
    partitions hold one row per ticker.
    """
    t = txn if user_id is None else txn.where(F.col("user_id") == F.lit(user_id))
    s = stock.select(F.col("ticker").alias("stock_ticker"), F.col("price").alias("_px"))
    q = F.col("quantity")
    if signed:
        q = F.when(F.col("type") == "BUY", q).otherwise(-q)
    v = t.join(s, "stock_ticker", "inner").groupBy("user_id", "stock_ticker") \
         .agg(F.sum(q * F.col("_px")).alias("stock_value"))
    w = Window.partitionBy("user_id")
    v = v.withColumn("total_value", F.sum("stock_value").over(w))
    return v.select(
        "user_id", F.col("stock_ticker").alias("stock_id"),
        as_double("stock_value").alias("stock_value"),
        as_double("total_value").alias("total_value"),
        round2(safe_div("stock_value", "total_value") * 100).alias("allocation_percentage"),
    )


def portfolio_summary(txn: DataFrame, stock: DataFrame, stock_prices: DataFrame, as_of) -> DataFrame:
    """Q7: per user and stock, shares traded and their value at the closing
    price of day ``as_of`` (the original's intent; all trades count)."""
    sp = stock_prices.where(F.col("date") == F.lit(as_of).cast("date")) \
                     .select(F.col("ticker").alias("stock_ticker"), F.col("price").alias("_close"))
    s = stock.select(F.col("ticker").alias("stock_ticker"), F.col("name").alias("stock_name"))
    j = txn.join(s, "stock_ticker").join(sp, "stock_ticker")
    return j.groupBy("user_id", "stock_ticker", "stock_name").agg(
        F.sum("quantity").cast("bigint").alias("total_shares"),
        as_double(F.sum(F.col("quantity") * F.col("_close"))).alias("total_value"))


def cash_flows(txn: DataFrame, deposits: DataFrame) -> DataFrame:
    """Signed cash movements ``(user_id, kind, amount)``: buys debit, sells
    credit, deposits with a positive numeric amount credit."""
    steps = ledger_steps(txn).where(F.col("status").isin("BOUGHT", "SOLD"))
    amt = (F.col("quantity") * F.col("price_cents")).cast("decimal(30,2)") / 100
    trades = steps.select("user_id",
                          F.when(F.col("type") == "BUY", F.lit("buy")).otherwise(F.lit("sell")).alias("kind"),
                          F.when(F.col("type") == "BUY", -amt).otherwise(amt).cast("decimal(30,2)").alias("amount"))
    a = F.col("amount").try_cast("decimal(30,2)")
    dep = deposits.where(a > 0).select("user_id", F.lit("deposit").alias("kind"), a.alias("amount"))
    return trades.unionByName(dep)


def cash_balance(users: DataFrame, txn: DataFrame, deposits: DataFrame) -> DataFrame:
    """Q11: opening balance + valid deposits - buys + sells, per user; a sell
    that the ordered replay rejects brings no cash.

    Cash flows are summed per user with map-side partial aggregation, so a
    user with a third of all trades still moves one row per map task."""
    f = cash_flows(txn, deposits).groupBy("user_id").agg(
        F.sum(F.when(F.col("kind") == "deposit", F.col("amount"))).alias("_dep"),
        F.sum(F.when(F.col("kind") == "buy", -F.col("amount"))).alias("_buy"),
        F.sum(F.when(F.col("kind") == "sell", F.col("amount"))).alias("_sell"))
    j = users.select("user_id", "balance").join(f, "user_id", "left")
    z = F.lit(0)
    dep, buy, sell = (F.coalesce(F.col(c), z) for c in ("_dep", "_buy", "_sell"))
    return j.select(
        "user_id", as_double("balance").alias("opening_balance"),
        as_double(dep).alias("deposits"), as_double(buy).alias("bought"), as_double(sell).alias("sold"),
        as_double(F.col("balance") + dep - buy + sell).alias("balance"))


# -- Q12: ordered replay of each position ----------------------------------------

_STEP_FIELDS = [
    T.StructField("user_id", T.LongType()),
    T.StructField("stock_ticker", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("price_cents", T.LongType()),
    T.StructField("step", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("qty_after", T.LongType()),
    T.StructField("avg_cents_after", T.LongType()),
    T.StructField("realized_cents", T.LongType()),
]


def ledger_step_schema(trades: DataFrame) -> T.StructType:
    """Columns of a replayed trade; the trade id keeps its type."""
    return T.StructType([T.StructField("transaction_id", trades.schema["transaction_id"].dataType), *_STEP_FIELDS])


def trade_step(qty: int, avg: int, kind: str, q: int, p: int) -> tuple[int, int, str, int]:
    """One trade applied to a position ``(qty, avg_cents)``.

    Returns ``(qty, avg_cents, status, realized_cents)``. Integer cents keep
    the result exact: the average is rounded half up to the cent after each
    buy, as a NUMERIC(10,2) column stores it.
    """
    if p is None or p != p:  # a trade without a price changes nothing
        return qty, avg, "INVALID", 0
    if kind == "BUY":
        new_qty = qty + q
        avg = (2 * (avg * qty + p * q) + new_qty) // (2 * new_qty) if new_qty > 0 else 0
        return new_qty, avg, "BOUGHT", 0
    if q > qty:
        return qty, avg, "REJECTED", 0
    realized = q * (p - avg)
    qty -= q
    return qty, (0 if qty == 0 else avg), "SOLD", realized


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold the trades of each position in (ts, transaction_id) order.

    Input arrives sorted by position and time; the state of the current
    position is carried across Arrow batches, so a position of any length is
    streamed through with constant memory.
    """
    key = None
    qty = avg = seq = 0
    for pdf in batches:
        n = len(pdf)
        users, ticks = pdf["user_id"].tolist(), pdf["stock_ticker"].tolist()
        kinds, qs, ps = pdf["type"].tolist(), pdf["quantity"].tolist(), pdf["price_cents"].tolist()
        steps, status, q_after, a_after, realized = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
        for i in range(n):
            k = (users[i], ticks[i])
            if k != key:
                key, qty, avg, seq = k, 0, 0, 0
            seq += 1
            qty, avg, status[i], realized[i] = trade_step(qty, avg, kinds[i], qs[i], ps[i])
            steps[i], q_after[i], a_after[i] = seq, qty, avg
        out = pdf[["transaction_id", "user_id", "stock_ticker", "type", "quantity", "price_cents"]].copy()
        out["step"], out["status"], out["qty_after"] = steps, status, q_after
        out["avg_cents_after"], out["realized_cents"] = a_after, realized
        yield out


def ledger_steps(txn: DataFrame) -> DataFrame:
    """Q12 (steps): every trade with its replay outcome (BOUGHT / SOLD /
    REJECTED for an oversell) and the position after it.

    BUY adds shares and re-weights the average cost; an accepted SELL keeps
    the average and books ``quantity * (price - average)``; selling out
    resets the average; selling more than held is rejected and leaves the
    position unchanged. The replay is sequential per position by definition:
    trades are hash-partitioned by position and sorted inside each partition,
    then folded by a streaming pass that never holds more than one Arrow batch.
    """
    return _sorted_trades(txn).mapInPandas(_replay, ledger_step_schema(txn))


POSITION_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("stock_ticker", T.StringType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("avg_cents", T.LongType()),
    T.StructField("realized_cents", T.LongType()),
    T.StructField("n_trades", T.LongType()),
    T.StructField("n_rejected", T.LongType()),
])


def _replay_final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Like :func:`_replay`, but emits one row per position: its state after
    the last trade, with realised P&L and counts. A position that spans
    several Arrow batches is emitted once, when the next position starts or
    the partition ends."""
    key = None
    qty = avg = realized = n = rejected = 0
    out = {c: [] for c in POSITION_SCHEMA.fieldNames()}

    def emit():
        for c, v in zip(out, (key[0], key[1], qty, avg, realized, n, rejected)):
            out[c].append(v)

    for pdf in batches:
        users, ticks = pdf["user_id"].tolist(), pdf["stock_ticker"].tolist()
        kinds, qs, ps = pdf["type"].tolist(), pdf["quantity"].tolist(), pdf["price_cents"].tolist()
        for i in range(len(pdf)):
            k = (users[i], ticks[i])
            if k != key:
                if key is not None:
                    emit()
                key, qty, avg, realized, n, rejected = k, 0, 0, 0, 0, 0
            qty, avg, status, rc = trade_step(qty, avg, kinds[i], qs[i], ps[i])
            realized += rc
            n += 1
            rejected += status == "REJECTED"
        if len(out["user_id"]) >= 10000:
            yield pd.DataFrame(out)
            out = {c: [] for c in POSITION_SCHEMA.fieldNames()}
    if key is not None:
        emit()
    if out["user_id"]:
        yield pd.DataFrame(out)


def _sorted_trades(txn: DataFrame) -> DataFrame:
    t = txn.where(F.col("type").isin("BUY", "SELL") & (F.col("quantity") > 0))
    t = t.select("transaction_id", "user_id", "stock_ticker", "type", "ts",
                 F.col("quantity").cast("bigint").alias("quantity"),
                 (F.col("price") * 100).cast("bigint").alias("price_cents"))
    return t.repartition(*POSITION_KEY).sortWithinPartitions(*POSITION_KEY, "ts", "transaction_id").drop("ts")


def position_ledger(txn: DataFrame, keep_steps: bool = False) -> DataFrame:
    """Q12: final position of every (user, ticker) after the ordered replay.

    Columns: quantity, average cost (0 when flat), realised P&L of the
    accepted sells, and the counts of trades and rejected oversells. The fold
    emits the final state itself, so the trades are shuffled exactly once.
    """
    if keep_steps:
        return ledger_steps(txn)
    trades = _sorted_trades(txn).drop("transaction_id")  # sorted by it; the fold doesn't read it
    f = trades.mapInPandas(_replay_final, POSITION_SCHEMA)
    return f.select(
        *POSITION_KEY, "quantity",
        (F.col("avg_cents").cast("double") / 100).alias("avg_price"),
        (F.col("realized_cents").cast("double") / 100).alias("realized_pnl"),
        "n_trades", "n_rejected")


# -- Q13 / Q14: orders that change what the next order is judged by ----------------

ORDER_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("order_id", T.LongType()), ("user_id", T.LongType()), ("ticker", T.StringType()), ("type", T.StringType()),
    ("quantity", T.LongType()), ("price_cents", T.LongType()), ("status", T.StringType()),
    ("cash_after_cents", T.LongType()), ("shares_after", T.LongType()), ("avg_cents_before", T.LongType()))])


class Wallet:
    """One user's cash and positions (shares, average cost in cents) while orders are applied."""

    def __init__(self):
        self.cash: int | None = None
        self.held: dict[str, tuple[int, int]] = {}

    def apply(self, kind: str, ticker: str, q: int, p: int) -> str:
        """Judge one order by the state that the orders before it left, and book it if accepted."""
        shares, avg = self.held.get(ticker, (0, 0))
        if kind == "BUY":
            if self.cash is None or self.cash < q * p:
                return "insufficient_balance"
            self.cash -= q * p
            self.held[ticker] = trade_step(shares, avg, "BUY", q, p)[:2]
            return "accepted"
        if not shares:
            return "not_held"
        if shares < q:
            return "insufficient_shares"
        if self.cash is not None:
            self.cash += q * p
        self.held[ticker] = trade_step(shares, avg, "SELL", q, p)[:2]
        return "accepted"


def _whole(x):
    """None for a null, which pandas may hand over as NaN."""
    return None if x is None or x != x else int(x)


def _apply_orders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive per user: opening cash and positions (turn 0), then orders in time."""
    user, wallet = object(), Wallet()
    for pdf in batches:
        out = {c: [] for c in ORDER_SCHEMA.fieldNames()}
        for turn, u, order, ticker, kind, q, p, status in zip(*(pdf[c].tolist() for c in (
                "turn", "user_id", "order_id", "ticker", "type", "quantity", "price_cents", "status"))):
            u, q, p = _whole(u), _whole(q), _whole(p)
            if u != user:
                user, wallet = u, Wallet()
            if turn == 0:
                if kind == "CASH":
                    wallet.cash = p
                else:
                    wallet.held[ticker] = (q, p)
                continue
            before = wallet.held.get(ticker, (0, 0))[1]
            status = status or wallet.apply(kind, ticker, q, p)
            for c, v in zip(out, (_whole(order), u, ticker, kind, q, p, status, wallet.cash,
                                  wallet.held.get(ticker, (0, 0))[0], before)):
                out[c].append(v)
        yield pd.DataFrame({c: pd.array(v, dtype="Int64") if c not in ("ticker", "type", "status") else v
                            for c, v in out.items()})


def order_rows(orders: DataFrame, users: DataFrame, portfolio: DataFrame, stock: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The orders with what is wrong with them by themselves as ``status``
    (turn 1), and the cash and positions before the first of them (turn 0)."""
    quantity = F.col("quantity")
    whole = quantity.isNotNull() & (quantity > 0) & (quantity.cast("double") == F.floor(quantity).cast("double"))
    kind = F.upper(F.col("type"))
    o = orders.select("order_id", "user_id", F.upper(F.trim("ticker")).alias("ticker"), kind.alias("type"), "quantity",
                      (F.col("price") * 100).cast("bigint").alias("price_cents"), "ts")
    o = o.join(stock.select("ticker", F.lit(True).alias("_listed")), "ticker", "left")
    status = (F.when(~whole, "invalid_quantity")
              .when(~F.coalesce(F.col("type").isin("BUY", "SELL"), F.lit(False)), "invalid_type")
              .when(F.col("_listed").isNull(), "unknown_stock")
              .when(F.col("price_cents").isNull(), "invalid_price"))
    o = o.select(F.lit(1).alias("turn"), "user_id", "order_id", "ticker", "type",
                 F.floor(quantity).cast("bigint").alias("quantity"), "price_cents", status.alias("status"), "ts")
    nothing = {"order_id": "bigint", "status": "string", "ts": o.schema["ts"].dataType}
    opening = portfolio.select(F.lit(0).alias("turn"), "user_id", F.col("stock_ticker").alias("ticker"), F.lit("OPEN").alias("type"),
                               F.col("quantity").cast("bigint").alias("quantity"),
                               (F.col("avg_price") * 100).cast("bigint").alias("price_cents"))
    cash = users.select(F.lit(0).alias("turn"), "user_id", F.lit(None).cast("string").alias("ticker"), F.lit("CASH").alias("type"),
                        F.lit(None).cast("bigint").alias("quantity"), (F.col("balance") * 100).cast("bigint").alias("price_cents"))
    return o, opening.unionByName(cash).withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})


def process_orders(orders: DataFrame, users: DataFrame, portfolio: DataFrame, stock: DataFrame) -> DataFrame:
    """Q13 with state: every order judged by the cash and shares that the
    user's earlier orders (by ts, order_id) left.

    Malformed orders (quantity not a positive whole number, unknown type or
    ticker, no price) are refused first and change nothing. A BUY needs the
    cash, a SELL the shares; an accepted order books both. A user without an
    account has no cash; sells need none. Orders are partitioned by user and
    streamed in order: one user's orders depend on one another, so a task
    holds that user's positions, but never more than a batch of orders.
    """
    o, start = order_rows(orders, users, portfolio, stock)
    rows = o.unionByName(start).repartition("user_id").sortWithinPartitions("user_id", "turn", "ts", "order_id")
    return rows.drop("ts").mapInPandas(_apply_orders, ORDER_SCHEMA)


def processed_orders_table(steps: DataFrame) -> DataFrame:
    """The steps of :func:`process_orders` with money as doubles."""
    cents = lambda c: (F.col(c).cast("double") / 100)
    return steps.select("order_id", "user_id", "ticker", "type", "quantity", cents("price_cents").alias("price"), "status",
                        cents("cash_after_cents").alias("cash_after"), "shares_after")


def sell_proceeds(steps: DataFrame) -> DataFrame:
    """Q14: for each sell order that was accepted (:func:`process_orders`):
    proceeds ``quantity * price`` and profit ``quantity * (price - average
    cost at that moment)``."""
    s = steps.where((F.col("type") == "SELL") & (F.col("status") == "accepted"))
    value = F.col("quantity") * F.col("price_cents")
    profit = F.col("quantity") * (F.col("price_cents") - F.col("avg_cents_before"))
    return s.select("order_id", "user_id", F.col("ticker").alias("stock_ticker"), "quantity",
                    (value.cast("double") / 100).alias("total_value"), (profit.cast("double") / 100).alias("profit"))
