"""Persisted, partitioned ledger tables give the same results and prune partitions."""

import contextlib
import io

from ledgerline.operators import history, market, positions
from ledgerline.sources.fixtures import LEDGER_AS_OF, PRICE_AS_OF
from ledgerline.sources.warehouse import Warehouse, persist_tables


def _same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_warehouse_tables_give_the_same_results(spark, fx, tmp_path):
    persist_tables(fx, str(tmp_path))
    wh = Warehouse(spark, str(tmp_path))
    _same(history.realized_pnl(wh.txn), history.realized_pnl(fx.txn))
    _same(positions.position_ledger(wh.txn), positions.position_ledger(fx.txn))
    _same(history.portfolio_history(wh.txn, wh.stock, LEDGER_AS_OF), history.portfolio_history(fx.txn, fx.stock, LEDGER_AS_OF))
    _same(market.moving_averages(wh.stock, wh.stock_prices, PRICE_AS_OF),
          market.moving_averages(fx.stock, fx.stock_prices, PRICE_AS_OF))
    _same(market.price_audit(wh.ticks, wh.stock), market.price_audit(fx.ticks, fx.stock))


def test_date_range_prunes_partitions(spark, fx, tmp_path):
    persist_tables(fx, str(tmp_path), ["stock_prices"])
    wh = Warehouse(spark, str(tmp_path))
    df = wh.between("stock_prices", "2001-05-05", PRICE_AS_OF)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    assert "PartitionFilters: [isnotnull(year" in buf.getvalue()
    _same(df, fx.stock_prices.where("date >= DATE'2001-05-05' AND date <= DATE'2001-11-04'"))
