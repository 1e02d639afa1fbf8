"""Each streaming job, drained over several micro-batches, equals its batch twin."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import market
from ledgerline.sources.fixtures import Fixtures
from ledgerline.sources.versions import ChangeLog
from ledgerline.streaming import jobs

from conftest import SF_SMALL


def _same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """The events table dealt at random into 6 files, so that every file
    holds rows of all days."""
    d = str(tmp_path_factory.mktemp("events"))
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    ev.repartition(6, F.xxhash64("event_id")).write.mode("append").parquet(d)
    return d


def _streams(spark, d, max_files=1):
    ev = jobs.event_stream(spark, d, file_glob="part-*.parquet", max_files_per_trigger=max_files)
    n = Fixtures(spark, SF_SMALL).n_parts
    return Fixtures.orders_from(ev, n), Fixtures.ticks_from(ev, n)


def test_market_cap_and_refresh_streams(spark, fx, split_events, tmp_path):
    _, ticks = _streams(spark, split_events)
    q, changes = jobs.start_market_cap_stream(ticks, str(tmp_path / "mcap"), checkpoint=str(tmp_path / "ck1"))
    q.awaitTermination()
    twin = market.market_cap_live(fx.ticks, fx.stock, fx.market_analysis)
    got = jobs.live_market_cap(changes, fx.stock, fx.market_analysis)
    _same(got, twin.select(*got.columns))
    q, changes = jobs.start_refresh_stream(ticks, str(tmp_path / "refresh"), checkpoint=str(tmp_path / "ck2"))
    q.awaitTermination()
    got = jobs.refreshed_stock(changes, fx.stock)
    _same(got, market.refresh_from_ticks(fx.stock, fx.ticks).select(*got.columns))


def test_broker_count_stream(spark, fx, tmp_path):
    sup = spark.read.parquet(os.path.join(SF_SMALL, "supplier.parquet"))
    s = spark.readStream.schema(sup.schema).option("pathGlobFilter", "supplier.parquet").parquet(SF_SMALL)
    new_users = Fixtures(spark, SF_SMALL).account  # same projection, applied to the stream below
    users = s.select(F.col("s_suppkey").alias("user_id"),
                     F.when(((F.col("s_suppkey") % 11) == 0) | (F.col("s_nationkey") >= 22), F.lit(None))
                      .otherwise(F.col("s_nationkey")).alias("brokerage_id"))
    q = jobs.run_to_table(jobs.broker_count_stream(users), "t_bc", mode="complete")
    q.awaitTermination()
    for _ in range(2):  # the second run on one checkpoint has nothing to add
        q, versions = jobs.start_broker_counts(users, str(tmp_path / "tables"), checkpoint=str(tmp_path / "ck"))
        q.awaitTermination()
    assert versions.versions() == [1]
    _same(versions.read("broker_counts"), spark.table("t_bc"))
    twin = new_users.where("brokerage_id IS NOT NULL").groupBy("brokerage_id").agg(F.count("user_id").alias("user_count"))
    _same(spark.table("t_bc"), twin)


def test_ohlc_stream_equals_daily_twin(spark, fx, split_events):
    _, ticks = _streams(spark, split_events)
    q = jobs.run_to_table(jobs.ohlc_stream(ticks), "t_ohlc", mode="complete")
    q.awaitTermination()
    _same(spark.table("t_ohlc"), market.daily_ohlc(fx.ticks))


def test_stock_before_the_first_batch(spark, fx, tmp_path):
    changes = ChangeLog(spark, str(tmp_path / "never"), jobs.latest_tick_state(fx.ticks).schema, ["ticker"])
    _same(jobs.refreshed_stock(changes, fx.stock), fx.stock)


def test_volume_changes_reach_the_market_cap(spark, fx, tmp_path):
    """T5 takes volume changes as well as prices, in any order of files."""
    d = str(tmp_path / "in")
    ticks = fx.ticks.withColumn("volume", F.when(F.col("event_id") % 3 == 0, F.col("event_id")))
    for lo, hi in ((500, 10_000_000), (0, 500)):  # the later rows arrive first
        ticks.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.mode("append").parquet(d)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(d)
    q, changes = jobs.start_market_cap_stream(stream, str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    order = F.struct("ts", "event_id")
    want = ticks.groupBy("ticker").agg(F.max_by("price", order).cast("double").alias("p"),
                                       F.max_by("volume", F.when(F.col("volume").isNotNull(), order)).alias("v"))
    got = {r["stock_ticker"]: r for r in jobs.live_market_cap(changes, fx.stock, fx.market_analysis).collect()}
    for r in want.collect():
        if r["ticker"] in got:
            assert got[r["ticker"]]["price"] == r["p"]
            assert r["v"] is None or got[r["ticker"]]["volume"] == r["v"]


def test_orders_carry_cash_and_shares_forward(spark):
    """Two buys that only one balance covers, two sells of the same shares."""
    from ledgerline.operators import positions
    t0 = [F.lit(f"2024-01-01 10:0{i}:00").cast("timestamp_ntz") for i in range(6)]
    base = spark.createDataFrame([(1, 7, "a", "buy", 1, 90, 0), (2, 7, "A", "BUY", 1, 90, 1), (3, 7, "B", "SELL", 10, 5, 2),
                                  (4, 7, "B", "SELL", 10, 5, 3), (5, 7, "A", "BUY", 1, 50, 4), (6, 8, "A", "BUY", 1, 1, 5),
                                  (7, 7, "Z", "BUY", 1, 1, 5), (8, 7, "A", "BUY", 0, 1, 5), (9, 7, "A", "BUY", 1, None, 5)],
                                 "order_id long, user_id long, ticker string, type string, quantity int, price int, m int")
    orders = base.withColumn("ts", F.element_at(F.array(*t0), F.col("m") + 1)).withColumn("price", F.col("price").cast("decimal(10,2)"))
    users = spark.createDataFrame([(7, 100)], "user_id long, balance int").withColumn("balance", F.col("balance").cast("decimal(15,2)"))
    held = spark.createDataFrame([(7, "B", 10, 3)], "user_id long, stock_ticker string, quantity long, avg_price int") \
        .withColumn("avg_price", F.col("avg_price").cast("decimal(10,2)"))
    stock = spark.createDataFrame([("A",), ("B",)], "ticker string")
    steps = positions.process_orders(orders, users, held, stock)
    got = {r["order_id"]: (r["status"], r["cash_after"], r["shares_after"]) for r in positions.processed_orders_table(steps).collect()}
    assert got == {1: ("accepted", 10.0, 1), 2: ("insufficient_balance", 10.0, 1), 3: ("accepted", 60.0, 0), 4: ("not_held", 60.0, 0),
                   5: ("accepted", 10.0, 2), 6: ("insufficient_balance", None, 0), 7: ("unknown_stock", 10.0, 0),
                   8: ("invalid_quantity", 10.0, 2), 9: ("invalid_price", 10.0, 2)}
    assert [tuple(r) for r in positions.sell_proceeds(steps).collect()] == [(3, 7, "B", 10, 50.0, 20.0)]
