"""Null keys, days with several rows, repeated changes, and ids far beyond the test scale."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline import schemas
from ledgerline.operators import history, market
from ledgerline.operators.scan import bucketed_lag, bucketed_prefix, sliding_range
from ledgerline.session import ensure_checkpoint_dir
from ledgerline.sources.fixtures import fixtures
from ledgerline.sources.tables import read_table, upsert


def _rows(spark):
    ts = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(i, u, t, when, v) for i, (u, t, when, v) in enumerate(
        (u, t, when, 10 * n + 1)
        for u in (1, 2, None) for t in ("A", "", None)
        for n, when in enumerate((None, None, ts(1, 1), ts(1, 1), ts(1, 5), ts(3, 1))))]
    return (spark.createDataFrame(rows, "id long, u long, t string, ts timestamp_ntz, v long")
            .withColumn("day", F.col("ts").cast("date")))


@pytest.mark.parametrize("peers", [True, False])
def test_prefix_with_nulls_equals_the_plain_window(spark, peers):
    df = _rows(spark)
    w = Window.partitionBy("u", "t").orderBy(*(["ts"] if peers else ["ts", "id"]))
    w = w.rangeBetween(Window.unboundedPreceding, 0) if peers else w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"))
    got = bucketed_prefix(df, ["u", "t"], "day", ["ts"] if peers else ["ts", "id"],
                          {"s": ("sum", "v"), "m": ("max", "v")}, include_peers=peers)
    assert got.columns == [*df.columns, "s", "m"] and got.count() == df.count() == 54
    assert sorted(got.select("id", "s", "m").collect()) == sorted(want.collect())


def test_lag_with_nulls_equals_the_plain_window(spark):
    df = _rows(spark)
    want = df.select("id", F.lag("v").over(Window.partitionBy("u", "t").orderBy("ts", "id")).alias("p"))
    got = bucketed_lag(df, ["u", "t"], "day", ["ts", "id"], "v", "p")
    key = lambda r: r["id"]
    assert sorted(got.select("id", "p").collect(), key=key) == sorted(want.collect(), key=key)


def test_sells_with_null_keys_stay(spark):
    rows = [("1", None, "A", "SELL", 1, 1, None), ("2", 1, None, "SELL", 1, 1, None), ("3", 1, "A", "SELL", 1, 1, None),
            ("4", 1, "A", "SELL", 1, 1, dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "transaction_id string, user_id long, stock_ticker string, type string, quantity int, "
                                     "price int, ts timestamp_ntz")
    got = history.realized_pnl(df.withColumn("price", F.col("price").cast("decimal(10,2)"))).collect()
    assert sorted(r["transaction_id"] for r in got) == ["1", "2", "3", "4"] and {r["avg_buy_cost"] for r in got} == {0.0}


@pytest.mark.parametrize("n", [1, 50, 127, 128, 200])
def test_every_frame_counts_closes_of_one_day_as_peers(spark, n):
    day = dt.date(2024, 1, 1)
    rows = [("A", day, 1.0), ("A", day, 3.0), ("A", day + dt.timedelta(days=1), None), ("A", day + dt.timedelta(days=n), 5.0),
            ("A", day + dt.timedelta(days=n + 1), 7.0)]
    sp = spark.createDataFrame(rows, "ticker string, date date, price double").withColumn("price", F.col("price").cast("decimal(10,2)"))
    w = Window.partitionBy("ticker").orderBy(F.unix_date("date")).rangeBetween(-n, 0)
    want = sp.select("date", F.avg("price").over(w).cast("double").alias("m")).collect()
    got = market.moving_average_series(sp, n).select("date", F.col(f"moving_avg_{n}").alias("m")).collect()
    assert sorted((r["date"], round(r["m"], 9)) for r in got) == sorted((r["date"], round(r["m"], 9)) for r in want)
    top = sliding_range(sp, ["ticker"], "date", n, {"hi": ("max", "price")}).select("date", "hi").collect()
    hi = sp.select("date", F.max("price").over(w).alias("hi")).collect()
    assert sorted(top, key=str) == sorted(hi, key=str)


def test_upsert_applies_the_last_change_or_refuses(spark):
    base = spark.createDataFrame([("A", 1)], "k string, v int")
    twice = spark.createDataFrame([("A", 2, 1), ("A", 3, 2), ("B", 4, 1)], "k string, v int, seq int")
    assert sorted(upsert(base, twice, ["k"], ["v"], "seq").collect()) == [("A", 3), ("B", 4)]
    with pytest.raises(Exception, match="several changes"):
        upsert(base, twice.drop("seq"), ["k"]).collect()


def test_admin_changes_of_one_ticker_apply_in_order(spark):
    stock = spark.createDataFrame([], schemas.STOCK) if hasattr(schemas, "STOCK") else None
    if stock is None:
        stock = spark.createDataFrame([], "ticker string, name string, price decimal(10,2), high_52 decimal(10,2), low_52 decimal(10,2)")
    changes = spark.createDataFrame([("a", "one", 1, 1), ("A", "two", 2, 2), ("b", "x", 3, 3), (" B ", "y", 4, 4)],
                                    "ticker string, name string, price int, seq int")
    new, rejects = market.add_or_update_stock(stock, changes, "seq")
    assert sorted((r["ticker"], r["name"]) for r in new.collect()) == [("A", "two"), ("B", "y")] and rejects.count() == 0


def test_two_snapshots_of_a_ticker_refresh_it_once(spark):
    snaps = spark.createDataFrame([("A", '{"longName":"old"}', 1), ("A", '{"longName":"new"}', 2)], "ticker string, raw string, seq int")
    stock = spark.createDataFrame([("A",)], "ticker string")
    closes = spark.createDataFrame([("A", dt.date(2024, 1, 1), 5, 6)], "ticker string, date date, price int, volume int")
    got = market.market_refresh(stock, snaps, closes, dt.date(2024, 1, 2), 2024, order_col="seq").collect()
    assert [(r["ticker"], r["name"]) for r in got] == [("A", "new")]


def test_trade_ids_are_unique_at_a_thousand_times_the_keys(spark, tmp_path):
    l = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    big = l.withColumn("l_orderkey", F.col("l_orderkey") + 150_000 * 1000).union(l)
    big.write.parquet(str(tmp_path / "lineitem.parquet"))
    txn = fixtures(spark, str(tmp_path)).txn
    assert txn.select("transaction_id").distinct().count() == txn.count() == 2 * l.count()


def test_one_stock_for_every_part(spark, fx):
    assert fx.stock.count() == fx.raw("part").count() == fx.snapshots.count()


def test_tables_in_either_layout_and_by_uri(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(4).write.parquet(str(tmp_path / "b"))
    assert read_table(spark, str(tmp_path), "a").count() == 3 and read_table(spark, f"file://{tmp_path}", "b").count() == 4
    assert fixtures(spark, "s3a://lake/x").sf_dir == "s3a://lake/x"


def test_a_cluster_needs_a_shared_checkpoint_folder(spark):
    class Cluster:
        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="checkpoint"):
        ensure_checkpoint_dir(Cluster)
