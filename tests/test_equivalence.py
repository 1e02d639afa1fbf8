"""Set-based rewrites equal the literal forms they replace."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.operators import history
from ledgerline.operators.scan import bucketed_lag, bucketed_prefix
from ledgerline.sources.fixtures import LEDGER_AS_OF


def _same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_portfolio_history_equals_literal_theta_join(spark, fx):
    """Delta encoding (Q6) against the original days x earlier-trades join, in Spark SQL."""
    fx.txn.createOrReplaceTempView("t_txn")
    fx.stock.createOrReplaceTempView("t_stock")
    literal = spark.sql(f"""
      WITH first_day AS (SELECT user_id, MIN(CAST(ts AS DATE)) AS d0 FROM t_txn GROUP BY user_id),
      all_dates AS (SELECT user_id, explode(sequence(d0, DATE '{LEDGER_AS_OF}')) AS date FROM first_day),
      ch AS (SELECT a.user_id, a.date, t.stock_ticker,
                    SUM(CASE WHEN t.type = 'BUY' THEN t.quantity ELSE -t.quantity END) AS net
             FROM all_dates a JOIN t_txn t ON t.user_id = a.user_id AND CAST(t.ts AS DATE) <= a.date
             GROUP BY a.user_id, a.date, t.stock_ticker),
      v AS (SELECT ch.user_id, ch.date, SUM(CASE WHEN net > 0 THEN net * s.price ELSE 0 END) AS v
            FROM ch JOIN t_stock s ON s.ticker = ch.stock_ticker GROUP BY ch.user_id, ch.date)
      SELECT a.user_id, a.date, CAST(v.v AS DOUBLE) AS daily_value,
             MAX(CAST(v.v AS DOUBLE)) OVER (PARTITION BY a.user_id ORDER BY a.date
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS portfolio_value
      FROM all_dates a LEFT JOIN v ON a.user_id = v.user_id AND a.date = v.date""")
    _same(history.portfolio_history(fx.txn, fx.stock, LEDGER_AS_OF), literal)


def test_realized_pnl_equals_correlated_subquery(spark, fx):
    fx.txn.createOrReplaceTempView("t_txn")
    literal = spark.sql("""
      SELECT s.transaction_id,
             CAST(s.quantity AS DOUBLE) * (CAST(s.price AS DOUBLE) - COALESCE((
               SELECT CAST(SUM(b.quantity * b.price) AS DOUBLE) / NULLIF(CAST(SUM(b.quantity) AS DOUBLE), 0)
               FROM t_txn b WHERE b.user_id = s.user_id AND b.stock_ticker = s.stock_ticker
                 AND b.type = 'BUY' AND b.ts <= s.ts), 0)) AS realized_pnl
      FROM t_txn s WHERE s.type = 'SELL'""")
    _same(history.realized_pnl(fx.txn).select("transaction_id", "realized_pnl"), literal)


def _skewed(spark, n=4000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 30)}"
        day = rnd.randint(0, 20)
        rows.append((i, key, day, day * 100 + rnd.randint(0, 5), rnd.choice([None, rnd.randint(-50, 50)])))
    return spark.createDataFrame(rows, "id long, key string, day int, t int, v int")


def test_bucketed_prefix_equals_plain_window_with_a_hot_key(spark):
    df = _skewed(spark)
    got = bucketed_prefix(df, ["key"], "day", ["t"], {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v")})
    w = Window.partitionBy("key").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("hi"),
                     F.min("v").over(w).alias("lo"))
    _same(got.select("id", F.col("s").cast("long").alias("s"), "hi", "lo"),
          want.select("id", F.col("s").cast("long").alias("s"), "hi", "lo"))


def test_bucketed_prefix_rows_frame(spark):
    df = _skewed(spark, seed=5)
    got = bucketed_prefix(df, ["key"], "day", ["t", "id"], {"s": ("sum", "v")}, include_peers=False)
    w = Window.partitionBy("key").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w).alias("s"))
    _same(got.select("id", F.col("s").cast("long").alias("s")), want.select("id", F.col("s").cast("long").alias("s")))


def test_bucketed_lag_equals_plain_lag(spark):
    df = _skewed(spark, seed=9)
    got = bucketed_lag(df, ["key"], "day", ["t", "id"], "v", "prev")
    want = df.withColumn("prev", F.lag("v").over(Window.partitionBy("key").orderBy("t", "id")))
    _same(got.select("id", "prev"), want.select("id", "prev"))


def test_bucketed_lag_has_prev_flag(spark):
    df = _skewed(spark, seed=11)
    got = bucketed_lag(df, ["key"], "day", ["t", "id"], "v", "prev", has_prev="hp")
    w = Window.partitionBy("key").orderBy("t", "id")
    want = df.select("id", (F.row_number().over(w) > 1).alias("hp"))
    _same(got.select("id", "hp"), want)


def test_sliding_range_equals_range_window(spark):
    import datetime as dt
    from ledgerline.operators.scan import sliding_range
    rnd = random.Random(13)
    rows = []
    for key in ("a", "b", "c"):
        for d in sorted(rnd.sample(range(0, 2000), 700)):
            rows.append((key, dt.date(2000, 1, 1) + dt.timedelta(days=d), rnd.choice([None, rnd.randint(-100, 100)])))
    df = spark.createDataFrame(rows, "key string, day date, v int")
    for span in (0, 6, 364):
        got = sliding_range(df, ["key"], "day", span,
                            {"mx": ("max", "v"), "mn": ("min", "v"), "s": ("sum", "v"), "n": ("count", "v")})
        w = Window.partitionBy("key").orderBy(F.unix_date("day")).rangeBetween(-span, 0)
        want = df.select("key", "day", F.max("v").over(w).alias("mx"), F.min("v").over(w).alias("mn"),
                         F.sum("v").over(w).cast("long").alias("s"), F.count("v").over(w).alias("n"))
        _same(got.select("key", "day", "mx", "mn", F.col("s").cast("long").alias("s"), "n"), want)
