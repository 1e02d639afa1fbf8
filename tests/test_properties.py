"""Invariants of the operators on the smallest fixture."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.operators import history, market, positions
from ledgerline.sources.fixtures import LEDGER_AS_OF


def test_allocation_sums_to_100_per_user(fx):
    a = positions.allocation(fx.txn, fx.stock)
    bad = a.groupBy("user_id").agg(F.sum("allocation_percentage").alias("s")) \
           .where(F.abs(F.col("s") - 100) > 0.01 * F.lit(100)).count()
    assert bad == 0


def test_position_pnl_sums_to_user_total(fx):
    p = positions.portfolio_positions(fx.portfolio, fx.stock)
    g = p.groupBy("user_id").agg(F.sum("profit_loss").alias("s"), F.first("total_portfolio_pnl").alias("t"))
    assert g.where(F.abs(F.col("s") - F.col("t")) > 1e-6 * F.abs(F.col("t")) + 1e-6).count() == 0


def test_running_max_never_decreases(fx):
    h = history.portfolio_history(fx.txn, fx.stock, LEDGER_AS_OF)
    w = Window.partitionBy("user_id").orderBy("date")
    h = h.withColumn("_prev", F.lag("portfolio_value").over(w))
    assert h.where(F.col("portfolio_value") < F.col("_prev")).count() == 0


def test_ledger_quantities_never_negative(fx):
    assert positions.ledger_steps(fx.txn).where("qty_after < 0").count() == 0


def test_audit_rows_chain(fx):
    a = market.price_audit(fx.ticks, fx.stock)
    w = Window.partitionBy("ticker").orderBy("change_date", "event_id")
    broken = a.withColumn("_next_old", F.lead("old_price").over(w)) \
              .where(F.col("_next_old").isNotNull() & (F.col("_next_old") != F.col("new_price")))
    assert broken.count() == 0


def test_holdings_intervals_are_contiguous(fx):
    h = history.holdings_by_day(fx.txn, LEDGER_AS_OF)
    w = Window.partitionBy("user_id", "stock_ticker").orderBy("valid_from")
    h = h.withColumn("_next", F.lead("valid_from").over(w))
    assert h.where(F.col("_next") != F.col("valid_to")).count() == 0


def test_sql_functions(spark, fx):
    from ledgerline.plans.sqlfuncs import register_functions
    register_functions(spark, fx.tables())
    n_high = spark.sql("SELECT count(*) AS n FROM get_high_stocks(70)").first().n
    assert n_high == market.high_range_stocks(fx.stock, 70).count()
    assert spark.sql("SELECT count(*) AS n FROM get_user_portfolio()").first().n == \
        positions.portfolio_positions(fx.portfolio, fx.stock).count()
    assert spark.sql("SELECT pct_change(110, 100) AS p").first().p == 10.0
