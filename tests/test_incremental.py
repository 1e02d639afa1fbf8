"""Holdings and history taken in day by day equal the ones computed from all trades."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import history
from ledgerline.operators.incremental import CLOSED, OPEN, Holdings

DAY = dt.date(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def trades(spark):
    at = lambda d: dt.datetime.combine(DAY + dt.timedelta(days=d), dt.time(10))
    data = [(1, "A", "BUY", 10, at(0)), (1, "A", "SELL", 4, at(0)), (2, "B", "BUY", 5, at(0)), (1, "A", "SELL", 6, at(2)),
            (1, "B", "BUY", 1, at(2)), (3, None, "BUY", 2, at(2)), (2, "B", "BUY", 5, at(4)), (1, "A", "BUY", 3, at(5)),
            (1, "A", "SELL", 3, at(5)), (4, "X", "SELL", 7, at(5))]
    return spark.createDataFrame(data, "user_id long, stock_ticker string, type string, quantity int, ts timestamp_ntz")


def test_day_by_day_equals_all_at_once(spark, scratch, trades):
    stock = spark.createDataFrame([("A", 2), ("B", 3)], "ticker string, p int").select("ticker", F.col("p").cast("decimal(10,2)").alias("price"))
    kept = Holdings(spark, scratch, buckets=8)
    assert kept.last_day() is None
    for d in range(6):
        day = DAY + dt.timedelta(days=d)
        kept.add_day(trades, day)
        known = trades.where("stock_ticker IS NOT NULL")
        assert kept.last_day() == day
        assert rows(kept.intervals().where("stock_ticker IS NOT NULL")) == rows(history.holdings_by_day(known, day))
        assert rows(kept.portfolio_history(stock)) == rows(history.portfolio_history(trades, stock, day))
    before = rows(kept.intervals())
    kept.add_day(trades, DAY + dt.timedelta(days=5))  # the last day once more
    kept.add_day(trades, DAY)
    assert rows(kept.intervals()) == before


def test_a_day_rewrites_its_buckets_only(spark, scratch, trades):
    kept = Holdings(spark, scratch, buckets=32)
    kept.add_day(trades, DAY)
    wide = spark.range(500).select(F.col("id").alias("user_id"), F.lit("W").alias("stock_ticker"), F.lit("BUY").alias("type"),
                                   F.lit(1).alias("quantity"), F.lit(dt.datetime(2024, 1, 2, 9)).cast("timestamp_ntz").alias("ts"))
    kept.add_day(wide, DAY + dt.timedelta(days=1))
    parts = lambda name: {p["folder"] for p in kept.versions.manifest()["tables"][name]["parts"]}
    old = parts(OPEN), parts(CLOSED)
    kept.add_day(trades, DAY + dt.timedelta(days=2))  # three positions
    assert len(parts(OPEN) - old[0]) <= 3 and len(parts(OPEN) & old[0]) >= 29 and old[1] < parts(CLOSED)


def test_a_lost_day_leaves_the_day_before(spark, scratch, trades, monkeypatch):
    kept = Holdings(spark, scratch, buckets=4)
    kept.add_day(trades, DAY)
    before = rows(kept.intervals())

    def dies(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(kept.versions.folder, "publish", dies)
    with pytest.raises(RuntimeError):
        kept.add_day(trades, DAY + dt.timedelta(days=2))
    monkeypatch.undo()
    assert rows(kept.intervals()) == before and kept.last_day() == DAY
    kept.add_day(trades, DAY + dt.timedelta(days=2))
    assert rows(kept.intervals().where("stock_ticker IS NOT NULL")) == rows(
        history.holdings_by_day(trades.where("stock_ticker IS NOT NULL"), DAY + dt.timedelta(days=2)))


def test_no_trades_at_all(spark, scratch, trades):
    kept = Holdings(spark, scratch)
    kept.add_day(trades.limit(0), DAY)
    assert kept.intervals().collect() == [] and kept.last_day() == DAY


def test_kept_positions_stay_where_they_are(spark, scratch, trades, monkeypatch):
    """The open intervals are begun without ordering their days, and a day doesn't send them through a join's shuffle."""
    kept = Holdings(spark, scratch, buckets=4)
    plans, write = [], kept.versions._write

    def watched(df, folder, *args, **kw):
        if folder.endswith(f"/{OPEN}"):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, folder, *args, **kw)

    monkeypatch.setattr(kept.versions, "_write", watched)
    more = trades.union(trades.where("user_id = 3")).union(trades.selectExpr("user_id", "stock_ticker", "type", "CAST(NULL AS INT)", "ts"))
    kept.start(more, DAY + dt.timedelta(days=2))
    assert rows(kept.intervals()) == rows(history.holdings_by_day(more, DAY + dt.timedelta(days=2)))
    kept.add_day(more, DAY + dt.timedelta(days=4))
    assert "Window" not in plans[0] and "FullOuter" not in plans[1]
