"""Ledger history operators, for all users at once (Q4, Q5, Q6, Q8).

Inputs are the ``txn`` fact table ``(transaction_id, user_id, stock_ticker,
type, quantity, price, ts)``, the ``stock`` dimension and the ``portfolio``
snapshot. Results are DataFrames; nothing is collected.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.exprs import as_double, signed_qty
from ledgerline.operators.scan import bucketed_prefix, match_keys

POSITION_KEY = ["user_id", "stock_ticker"]


def _with_running_buy_cost(txn: DataFrame) -> DataFrame:
    """Every trade plus the lifetime mean buy cost of its position up to and
    including its timestamp (trades at the same timestamp count)."""
    is_buy = F.col("type") == "BUY"
    zero = F.lit(0).cast("bigint")
    # Buy cost in integer cents: exact, and cheaper to sum than wide decimals.
    ev = txn.select(
        "transaction_id", "user_id", "stock_ticker", "type", "quantity", "price", "ts",
        F.col("ts").cast("date").alias("date"),
        F.when(is_buy, F.col("quantity").cast("bigint")).otherwise(zero).alias("_bq"),
        F.when(is_buy, F.col("quantity").cast("bigint") * (F.col("price") * 100).cast("bigint"))
         .otherwise(zero).alias("_bc"),
        *[c for c in txn.columns if c.startswith(("_key_", "_null_"))],
    )
    ev = bucketed_prefix(ev, POSITION_KEY, "date", ["ts"],
                         {"_cum_q": ("sum", "_bq"), "_cum_c": ("sum", "_bc")}, include_peers=True)
    mean = (as_double("_cum_c") / 100.0) / F.nullif(as_double("_cum_q"), F.lit(0.0))
    return ev.withColumn("avg_buy_cost", F.coalesce(mean, F.lit(0.0))).drop("_bq", "_bc", "_cum_q", "_cum_c")


def realized_pnl(txn: DataFrame) -> DataFrame:
    """Q4: profit of each SELL against the lifetime mean cost of the buys made
    up to that moment: ``quantity * (price - mean_buy_cost)``; mean 0 if no buys.

    Earlier sells do not lower the mean (kept as in the original rule; the
    moving average with sells is :func:`ledgerline.operators.positions.position_ledger`).
    """
    ev = _with_running_buy_cost(txn)
    sells = ev.where(F.col("type") == "SELL")
    return sells.select(
        "transaction_id", "user_id", "stock_ticker", "date",
        F.col("quantity").cast("bigint").alias("quantity"),
        as_double("price").alias("price"),
        "avg_buy_cost",
        (as_double("quantity") * (as_double("price") - F.col("avg_buy_cost"))).alias("realized_pnl"),
    )


def unrealized_pnl(portfolio: DataFrame, stock: DataFrame) -> DataFrame:
    """Open-position profit ``quantity * (price - avg_price)`` per (user, ticker)."""
    s = stock.select(F.col("ticker").alias("stock_ticker"), F.col("price").alias("_cur"))
    j = portfolio.join(s, "stock_ticker", "inner")
    return j.select("user_id", "stock_ticker",
                    (F.col("quantity") * (F.col("_cur") - F.col("avg_price"))).alias("unrealized_pnl"))


def transaction_history(txn: DataFrame, portfolio: DataFrame, stock: DataFrame, k: int = 15,
                        user_id=None) -> DataFrame:
    """Q5: the latest ``k`` trades of every user (newest first by date, then
    transaction id), with amount, realised P&L (0 for buys) and the unrealised
    P&L of the user's current position in that ticker (0 if none).

    The realised P&L needs each position's whole buy history, but only for the
    positions that appear among a user's latest ``k`` trades (at most ``k``
    per user). Those positions are found first with a per-user group limit,
    and the running buy cost is computed on their trades only. Ranking that
    subset gives the same top ``k``: it contains every top-``k`` trade.
    """
    t = txn if user_id is None else txn.where(F.col("user_id") == F.lit(user_id))
    t = t.withColumn("date", F.col("ts").cast("date"))
    t, position = match_keys(t, POSITION_KEY)
    w = Window.partitionBy("user_id").orderBy(F.col("date").desc(), F.col("transaction_id").desc())
    # row_number <= k under a window is planned as a per-partition group limit
    # before the shuffle, so only k rows per user and map task move.
    top_keys = (t.select("user_id", *position, "date", "transaction_id")
                 .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
                 .select(*position).distinct())
    ev = _with_running_buy_cost(t.drop("date").join(top_keys, position, "left_semi"))
    is_sell = F.col("type") == "SELL"
    rp = F.when(is_sell, as_double("quantity") * (as_double("price") - F.col("avg_buy_cost"))).otherwise(0.0)
    top = (ev.select("transaction_id", "user_id", "date", "stock_ticker", "type", "quantity", "price",
                     rp.alias("realized_pnl"))
             .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k))
    up = unrealized_pnl(portfolio, stock)
    j = top.join(up, ["user_id", "stock_ticker"], "left")
    return j.select(
        "user_id", "transaction_id", "date", "stock_ticker", "type",
        F.col("quantity").cast("bigint").alias("quantity"),
        as_double("price").alias("price"),
        as_double(F.col("quantity") * F.col("price")).alias("transaction_amount"),
        "realized_pnl",
        F.coalesce(as_double("unrealized_pnl"), F.lit(0.0)).alias("unrealized_pnl"),
        F.col("_rn").cast("bigint").alias("recency_rank"),
    )


def daily_position_changes(txn: DataFrame, as_of) -> DataFrame:
    """Net quantity change per (user, ticker, day), trades up to ``as_of``."""
    t = txn.where(F.col("ts").cast("date") <= F.lit(as_of).cast("date"))
    return t.groupBy("user_id", "stock_ticker", F.col("ts").cast("date").alias("date")) \
            .agg(F.sum(signed_qty()).cast("bigint").alias("net_change"))


def holdings_by_day(txn: DataFrame, as_of) -> DataFrame:
    """Q8: net quantity per (user, ticker) carried forward between trade days,
    as validity intervals ``[valid_from, valid_to)``; ``valid_to`` is null for
    the interval still open at ``as_of``. One row per trade day, not per
    calendar day; expand with :func:`expand_intervals` when needed."""
    d = daily_position_changes(txn, as_of)
    w = Window.partitionBy(*POSITION_KEY).orderBy("date")
    return d.select(
        "user_id", "stock_ticker", F.col("date").alias("valid_from"),
        F.lead("date").over(w).alias("valid_to"),
        F.sum("net_change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("net_quantity"),
    )


def expand_intervals(df: DataFrame, start: str, end_excl: str, as_of, out: str = "date") -> DataFrame:
    """One row per calendar day of each ``[start, end_excl)`` interval, open
    intervals ending at ``as_of``. Runs inside each task (no shuffle)."""
    last = F.coalesce(F.date_sub(F.col(end_excl), 1), F.lit(as_of).cast("date"))
    return df.withColumn(out, F.explode(F.sequence(F.col(start), last, F.expr("INTERVAL 1 DAY"))))


def portfolio_history(txn: DataFrame, stock: DataFrame, as_of=_dt.date(2001, 12, 31),
                      user_id=None) -> DataFrame:
    """Q6: value of every user's portfolio on each calendar day from the first
    trade to ``as_of``.

    ``daily_value`` is the sum over tickers of ``max(net quantity, 0) * price``
    at the **current** price, and ``portfolio_value`` its running maximum (the
    original "carry forward" series, which never falls).

    Delta encoding instead of the literal ``days x earlier trades`` theta
    join: per (user, ticker) the value changes only on trade days, so the
    change of value is computed there, summed per (user, day), and a running
    sum over each user's trade days gives the daily value. Values and running
    maxima are constant between trade days, so the dense calendar is produced
    at the very end by expanding each trade day to its interval, inside the
    task. Windows run on per-day aggregates: each window partition holds at
    most one row per calendar day, however many trades a user makes.
    """
    t = txn if user_id is None else txn.where(F.col("user_id") == F.lit(user_id))
    w = Window.partitionBy(*POSITION_KEY).orderBy("date")
    net = F.sum("net_change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return value_history(daily_position_changes(t, as_of).withColumn("_net", net), stock, as_of)


def value_history(d: DataFrame, stock: DataFrame, as_of) -> DataFrame:
    """Q6 from the net quantity ``_net`` that each position (``user_id,
    stock_ticker``) has from each of its trade days (``date``) on."""
    s = stock.select(F.col("ticker").alias("stock_ticker"), F.col("price").alias("_px"), F.lit(1).alias("_listed"))
    d = d.join(s, "stock_ticker", "left")
    w = Window.partitionBy(*POSITION_KEY).orderBy("date")
    listed = F.col("_listed").isNotNull()
    # Contribution to the day's sum, and whether that contribution is non-null.
    value = F.when(listed & (F.col("_net") > 0) & F.col("_px").isNotNull(), F.col("_net") * F.col("_px")) \
             .otherwise(F.lit(0).cast("decimal(10,2)"))
    counted = F.when(listed & ~((F.col("_net") > 0) & F.col("_px").isNull()), 1).otherwise(0)
    d = d.withColumn("_v", value).withColumn("_c", counted)
    d = d.select("user_id", "date",
                 (F.col("_v") - F.coalesce(F.lag("_v").over(w), F.lit(0))).alias("_dv"),
                 (F.col("_c") - F.coalesce(F.lag("_c").over(w), F.lit(0))).alias("_dc"))
    # Summed per (user, day) before the exchange, so that a user with very many
    # positions sends one row a day and task to the per-user window.
    per_day = d.groupBy("user_id", "date") \
               .agg(F.sum("_dv").alias("_dv"), F.sum("_dc").alias("_dc"))
    wu = Window.partitionBy("user_id").orderBy("date")
    run = wu.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_day = per_day.select(
        "user_id", "date", F.lead("date").over(wu).alias("_next"),
        F.sum("_dv").over(run).alias("_val"), F.sum("_dc").over(run).alias("_cnt"))
    per_day = per_day.withColumn("daily_value", F.when(F.col("_cnt") > 0, as_double("_val")))
    per_day = per_day.withColumn("portfolio_value", F.max("daily_value").over(run))
    days = expand_intervals(per_day.withColumnRenamed("date", "_from"), "_from", "_next", as_of)
    return days.select("user_id", "date", "daily_value", "portfolio_value")
