"""Account operators (Q13, Q17, Q18, Q29, Q31, S14): order validation, broker
counts, user directory, batch sign-ups, purges and deposits.

Every request-handling rule of the original runs here as one set-based job
over a batch of requests against one snapshot of the tables: requests are
enriched with left joins and classified by an ordered ``when`` chain, so the
accepted and rejected rows come out of the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import as_double, norm_name, norm_ticker

# Fixed status codes and messages of the request checks, in the order they
# are applied.
ORDER_MESSAGES = {
    "invalid_quantity": "Quantity must be positive",
    "invalid_type": "Order type must be BUY or SELL",
    "unknown_stock": "Stock not found",
    "insufficient_balance": "Insufficient balance",
    "not_held": "You don't own any shares of this stock",
    "insufficient_shares": "Not enough shares",
    "accepted": "Accepted",
}

SIGNUP_MESSAGES = {
    "broker_required": "Please select a brokerage.",
    "low_balance": "Minimum starting balance is 1000.",
    "unknown_broker": "Invalid brokerage selected.",
    "name_required": "Please enter a username.",
    "name_taken": "Username already taken, try another one.",
    "accepted": "Account created! You can now log in.",
}

MIN_OPENING_BALANCE = 1000


def _message(status: Column, messages: dict[str, str]) -> Column:
    expr = None
    for code, text in messages.items():
        expr = (F.when(status == code, F.lit(text)) if expr is None else expr.when(status == code, F.lit(text)))
    return expr


def validate_orders(orders: DataFrame, stock: DataFrame, portfolio: DataFrame, users: DataFrame) -> DataFrame:
    """Q13: classify every order request.

    Checks in order: quantity must be a positive whole number; type BUY or SELL; the stock
    must exist; a BUY needs a known user whose balance covers
    ``quantity * price``; a SELL needs a position (a missing one counts as 0
    shares) of at least ``quantity``. Each order is judged against the same
    snapshot of balances and positions.
    """
    o = orders.select("order_id", "user_id", norm_ticker("ticker").alias("ticker"), F.upper("type").alias("type"),
                      "quantity", "price")
    s = stock.select("ticker", F.lit(True).alias("_listed"))
    p = portfolio.select("user_id", F.col("stock_ticker").alias("ticker"), F.col("quantity").alias("_held"))
    u = users.select("user_id", F.col("balance").alias("_balance"))
    j = o.join(s, "ticker", "left").join(p, ["user_id", "ticker"], "left").join(u, "user_id", "left")
    amount = F.col("quantity") * F.col("price")
    status = (
        F.when(F.col("quantity").isNull() | (F.col("quantity") <= 0)
               | (F.col("quantity").cast("double") != F.floor(F.col("quantity")).cast("double")), "invalid_quantity")
         .when(~F.coalesce(F.col("type").isin("BUY", "SELL"), F.lit(False)), "invalid_type")
         .when(F.col("_listed").isNull(), "unknown_stock")
         .when((F.col("type") == "BUY") & (F.col("_balance").isNull() | (F.col("_balance") < amount)),
               "insufficient_balance")
         .when((F.col("type") == "SELL") & F.col("_held").isNull(), "not_held")
         .when((F.col("type") == "SELL") & (F.col("_held") < F.col("quantity")), "insufficient_shares")
         .otherwise("accepted"))
    j = j.withColumn("status", status)
    return j.select("order_id", "user_id", "ticker", "type", F.col("quantity").cast("bigint").alias("quantity"),
                    as_double("price").alias("price"), as_double(amount).alias("amount"),
                    "status", _message(F.col("status"), ORDER_MESSAGES).alias("message"))


def accepted_trades(orders: DataFrame, judged: DataFrame) -> DataFrame:
    """The trade rows to append for accepted orders (``buy_stock`` /
    ``sell_stock`` over a batch). Positions and balances are then re-derived
    from the trades (Q11, Q12), never updated in place."""
    ok = judged.where(F.col("status") == "accepted").select("order_id")
    o = orders.join(ok, "order_id", "left_semi")
    return o.select(F.lpad(F.col("order_id").cast("string"), 18, "0").alias("transaction_id"), "user_id",
                    norm_ticker("ticker").alias("stock_ticker"), F.upper("type").alias("type"),
                    F.col("quantity").cast("int").alias("quantity"),
                    F.col("price").cast("decimal(10,2)").alias("price"), "ts")


def broker_user_counts(brokers: DataFrame, users: DataFrame) -> DataFrame:
    """Q17: users per broker, brokers without users included (count 0), most first.

    Users are counted per broker before the join (partial aggregation), so
    the join sees one row per broker."""
    c = users.where(F.col("brokerage_id").isNotNull()).groupBy("brokerage_id") \
             .agg(F.count("user_id").alias("_n"))
    j = brokers.join(c, "brokerage_id", "left")
    return j.select("brokerage_id", "name", F.coalesce("_n", F.lit(0)).cast("bigint").alias("user_count")) \
            .orderBy(F.col("user_count").desc(), "brokerage_id")


def user_directory(users: DataFrame, brokers: DataFrame) -> DataFrame:
    """Q18: users with their broker's name, by user name; users without a
    (known) broker are left out, as by the original inner join."""
    b = brokers.select("brokerage_id", F.col("name").alias("brokerage_name"))
    j = users.join(b, "brokerage_id", "inner")
    return j.select("user_id", "name", "brokerage_name", as_double("balance").alias("balance")) \
            .orderBy("name", "user_id")


def register_users(signups: DataFrame, users: DataFrame, brokers: DataFrame) -> DataFrame:
    """Q29: judge a batch of sign-ups.

    Checks in order: a broker is required; the opening balance must be at
    least 1000; the broker must exist; a name is required and must be free, compared
    case-insensitively after trimming, both against existing users and
    against earlier accepted sign-ups of the same batch (lowest
    ``signup_id`` wins). Duplicates inside the batch are settled with an
    aggregation (first id per name) rather than a window, so one very common
    name cannot gather in a single task.
    """
    s = signups.withColumn("_key", norm_name("name"))
    b = brokers.select("brokerage_id", F.lit(True).alias("_known"))
    taken = users.select(F.lower(F.col("name")).alias("_key")).distinct().withColumn("_taken", F.lit(True))
    j = s.join(b, "brokerage_id", "left").join(taken, "_key", "left")
    pre = (F.when(F.col("brokerage_id").isNull(), "broker_required")
            .when(F.col("balance").isNull() | (F.col("balance") < MIN_OPENING_BALANCE), "low_balance")
            .when(F.col("_known").isNull(), "unknown_broker")
            .when(F.coalesce(F.col("_key"), F.lit("")) == "", "name_required")
            .when(F.col("_taken").isNotNull(), "name_taken"))
    j = j.withColumn("_pre", pre)
    first = j.where(F.col("_pre").isNull()).groupBy("_key").agg(F.min("signup_id").alias("_first"))
    j = j.join(first, "_key", "left")
    status = F.coalesce(F.col("_pre"),
                        F.when(F.col("signup_id") == F.col("_first"), "accepted").otherwise("name_taken"))
    j = j.withColumn("status", status)
    return j.select("signup_id", "name", F.col("brokerage_id").cast("bigint").alias("brokerage_id"),
                    as_double("balance").alias("balance"), "status",
                    _message(F.col("status"), SIGNUP_MESSAGES).alias("message"))


def accepted_users(judged: DataFrame, id_offset: int) -> DataFrame:
    """New user rows for accepted sign-ups; ``user_id = id_offset + signup_id``
    (deterministic, no global numbering pass)."""
    a = judged.where(F.col("status") == "accepted")
    return a.select((F.lit(id_offset) + F.col("signup_id")).cast("bigint").alias("user_id"), "name",
                    F.col("brokerage_id").cast("int").alias("brokerage_id"),
                    F.col("balance").cast("decimal(15,2)").alias("balance"))


def apply_deposits(users: DataFrame, deposits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Credit valid deposits (numeric and > 0) to known users.

    Returns ``(users_with_new_balance, rejects)``; a reject carries the
    reason: invalid amount, or user not found. Deposits are summed per user
    before the join (partial aggregation)."""
    amt = F.col("amount").try_cast("decimal(30,2)")
    d = deposits.withColumn("_amt", amt)
    valid = d.where(F.col("_amt") > 0)
    known = users.select("user_id").withColumn("_known", F.lit(True))
    dk = d.join(known, "user_id", "left")
    reason = F.when(F.col("_amt").isNull() | (F.col("_amt") <= 0), "Amount must be greater than zero") \
              .when(F.col("_known").isNull(), "User not found")
    rejects = dk.select("deposit_id", "user_id", as_double("_amt").alias("amount"), reason.alias("reason")) \
                .where(F.col("reason").isNotNull())
    credit = valid.groupBy("user_id").agg(F.sum("_amt").alias("_credit"))
    new_users = users.join(credit, "user_id", "left").withColumn(
        "balance", (F.col("balance") + F.coalesce(F.col("_credit"), F.lit(0))).cast("decimal(15,2)")).drop("_credit")
    return new_users, rejects


def _referenced(keys: DataFrame, key: str, refs: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Keys that appear in any referencing table (one semi join per table)."""
    hit = None
    for df, fk in refs:
        h = keys.join(df.select(F.col(fk).alias(key)).distinct(), key, "left_semi")
        hit = h if hit is None else hit.unionByName(h)
    return hit.distinct() if hit is not None else keys.limit(0)


def purge_stock(stock: DataFrame, portfolio: DataFrame, tickers: DataFrame,
                references: Sequence[tuple[DataFrame, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q31 (stock): delete the positions in ``tickers``, then the stock rows
    that nothing else references. A ticker still referenced (by trades,
    financials, market rows) is kept and reported, as the foreign keys would
    refuse its deletion; its positions are gone all the same, since the
    original commits each statement by itself. Returns ``(new_stock,
    new_portfolio, refused)``."""
    t = tickers.select(F.upper(F.col("ticker")).alias("ticker")).distinct()
    new_portfolio = portfolio.join(t.withColumnRenamed("ticker", "stock_ticker"), "stock_ticker", "left_anti")
    refused = _referenced(t, "ticker", references)
    deletable = t.join(refused, "ticker", "left_anti")
    new_stock = stock.join(deletable, "ticker", "left_anti")
    return new_stock, new_portfolio, refused.withColumn("reason", F.lit("referenced by other tables; its positions were deleted"))


def purge_users(users: DataFrame, user_ids: DataFrame,
                references: Sequence[tuple[DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """Q31 (user): delete users nothing references; report the others.
    Returns ``(new_users, outcome(user_id, status))``."""
    ids = user_ids.select("user_id").distinct()
    refused = _referenced(ids, "user_id", references)
    outcome = ids.join(refused.withColumn("_ref", F.lit(True)), "user_id", "left").select(
        "user_id", F.when(F.col("_ref").isNotNull(), "refused").otherwise("deleted").alias("status"))
    deletable = ids.join(refused, "user_id", "left_anti")
    return users.join(deletable, "user_id", "left_anti"), outcome
