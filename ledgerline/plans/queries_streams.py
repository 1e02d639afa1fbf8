"""The streaming operators (T1-T7) drained over the events files, and their
batch twins, with their SQL oracles."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ledgerline.functions.exprs import as_double
from ledgerline.operators import market
from ledgerline.operators.positions import processed_orders_table
from ledgerline.plans.catalog import REGISTRY, Query, register
from ledgerline.plans.queries_ledger import _REPLAY, _r2
from ledgerline.session import scratch_path
from ledgerline.streaming import jobs, ordered


@register("price_audit", f"""
WITH t AS (
  SELECT k.ticker, k.event_id, k.ts, k.price, s.price AS seed,
         lag(k.price) OVER (PARTITION BY k.ticker ORDER BY k.ts, k.event_id) AS prev,
         row_number() OVER (PARTITION BY k.ticker ORDER BY k.ts, k.event_id) AS rn
  FROM ticks k JOIN stock s ON k.ticker = s.ticker),
o AS (SELECT *, CASE WHEN rn = 1 THEN seed ELSE prev END AS old_price FROM t)
SELECT ticker, event_id, ts AS change_date, CAST(old_price AS DOUBLE) AS old_price, CAST(price AS DOUBLE) AS new_price,
       {_r2("(CAST(price AS DOUBLE) - CAST(old_price AS DOUBLE)) / NULLIF(CAST(old_price AS DOUBLE), 0) * 100")} AS change_percentage
FROM o WHERE old_price IS DISTINCT FROM price
""")
def _price_audit(fx):
    return market.price_audit(fx.ticks, fx.stock)


@register("running_high_low", """
SELECT k.ticker, k.event_id, k.ts, CAST(k.price AS DOUBLE) AS price,
       CAST(greatest(s.high_52, max(CASE WHEN k.price > 0 THEN k.price END) OVER w) AS DOUBLE) AS high_52,
       CAST(least(s.low_52, min(k.price) OVER w) AS DOUBLE) AS low_52
FROM ticks k JOIN stock s ON k.ticker = s.ticker
WINDOW w AS (PARTITION BY k.ticker ORDER BY k.ts, k.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def _running_high_low(fx):
    return market.running_high_low(fx.ticks, fx.stock)


_LATEST_TICK = """
  SELECT ticker, price FROM ticks
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) = 1"""


@register("market_cap_live", f"""
WITH lt AS ({_LATEST_TICK})
SELECT ma.stock_ticker, CAST(COALESCE(lt.price, s.price) AS DOUBLE) AS price, ma.volume,
       CAST(COALESCE(lt.price, s.price) * ma.volume AS DOUBLE) AS market_cap_pv
FROM market_analysis ma JOIN stock s ON ma.stock_ticker = s.ticker LEFT JOIN lt ON lt.ticker = s.ticker
""")
def _market_cap_live(fx):
    return market.market_cap_live(fx.ticks, fx.stock, fx.market_analysis)


@register("refresh_from_ticks", f"""
WITH lt AS ({_LATEST_TICK})
SELECT s.ticker, s.name, CAST(CASE WHEN lt.ticker IS NOT NULL THEN lt.price ELSE s.price END AS DOUBLE) AS price,
       CAST(s.high_52 AS DOUBLE) AS high_52, CAST(s.low_52 AS DOUBLE) AS low_52
FROM stock s LEFT JOIN lt ON lt.ticker = s.ticker
""")
def _refresh_from_ticks(fx):
    r = market.refresh_from_ticks(fx.stock, fx.ticks)
    return r.select("ticker", "name", *[as_double(c).alias(c) for c in ("price", "high_52", "low_52")])


@register("daily_ohlc", """
SELECT ticker, CAST(ts AS DATE) AS day,
       CAST(arg_min(price, (ts, event_id)) AS DOUBLE) AS open, CAST(max(price) AS DOUBLE) AS high,
       CAST(min(price) AS DOUBLE) AS low, CAST(arg_max(price, (ts, event_id)) AS DOUBLE) AS close,
       COUNT(*) AS n_ticks
FROM ticks GROUP BY ticker, CAST(ts AS DATE)
""", dates=("day",))
def _daily_ohlc(fx):
    return market.daily_ohlc(fx.ticks)


# -- the streams themselves, drained to the shared folder and read back ------------


def _folder(fx, name: str) -> str:
    return scratch_path(fx.spark, f"streams/{name}-{uuid.uuid4().hex}")


def _events(fx):
    return jobs.fixture_streams(fx.spark, fx.sf_dir, fx.n_parts)


#: How far behind the newest event a file may arrive; no file of the tables is.
_DELAY = "60 days"


def _steps(fx, steps, name: str, max_files_per_trigger: int | None = 64):
    """``steps(orders, ticks)`` drained over the events, closed by a heartbeat; the on-time steps."""
    out = _folder(fx, name)
    beats = f"{out}/heartbeats"
    ordered.ensure_folder(fx.spark, beats)

    ev = jobs.event_stream(fx.spark, fx.sf_dir, max_files_per_trigger=max_files_per_trigger)
    ev = ordered.with_heartbeats(ev, beats)
    rows = steps(fx.orders_from(ev, fx.n_parts), fx.ticks_from(ev, fx.n_parts))
    sink = ordered.SplitSink(fx.spark, f"{out}/tables", name)
    ordered.drain(lambda: rows, sink, f"{out}/checkpoint")
    ordered.beat(fx.spark, beats, dt.datetime(9000, 1, 1))
    ordered.drain(lambda: rows, sink, f"{out}/checkpoint")
    return sink.steps()


_ORDER_TRADES = """FROM (SELECT lpad(CAST(order_id AS VARCHAR), 18, '0') AS transaction_id, user_id,
                 upper(trim(ticker)) AS stock_ticker, type, quantity, price, ts FROM order_requests) WHERE"""


@register("stream_positions", _REPLAY.replace("FROM txn WHERE", _ORDER_TRADES) + """
SELECT r.transaction_id, r.user_id, r.stock_ticker, t.type, t.q AS quantity, t.p AS price_cents, r.step,
       r.status, r.qty AS qty_after, r.avg_c AS avg_cents_after, r.realized AS realized_cents
FROM r JOIN t ON r.user_id = t.user_id AND r.stock_ticker = t.stock_ticker AND r.step = t.step
WHERE r.step > 0
""")
def _stream_positions(fx):
    rows = _steps(fx, lambda orders, _: ordered.position_steps(jobs.trades_from_orders(orders), _DELAY), "positions")
    return rows.drop("ts")


def _price_steps(fx):
    with ordered.Kept() as keep:
        return _steps(fx, lambda _, ticks: ordered.price_steps(ticks, fx.stock, _DELAY, keep), "prices")


def _stream_price_audit(fx):
    return jobs.audit_rows(_price_steps(fx))


def _stream_high_low(fx):
    return jobs.high_low_rows(_price_steps(fx))


def _stream_orders(fx):
    with ordered.Kept() as keep:
        rows = _steps(fx, lambda orders, _: ordered.order_steps(orders, fx.account, fx.portfolio, fx.stock, _DELAY, keep), "orders")
    return processed_orders_table(rows)


def _stream_market_cap(fx):
    out = _folder(fx, "market-cap")
    q, changes = jobs.start_market_cap_stream(_events(fx)[1], f"{out}/rows", checkpoint=f"{out}/checkpoint")
    q.awaitTermination()
    return jobs.live_market_cap(changes, fx.stock, fx.market_analysis)


def _stream_refresh(fx):
    out = _folder(fx, "refresh")
    q, changes = jobs.start_refresh_stream(_events(fx)[1], f"{out}/rows", checkpoint=f"{out}/checkpoint")
    q.awaitTermination()
    r = jobs.refreshed_stock(changes, fx.stock)
    return r.select("ticker", "name", *[as_double(c).alias(c) for c in ("price", "high_52", "low_52")])


# a stream has its batch twin's oracle
for _name, _twin, _build in (("price_audit_stream", "price_audit", _stream_price_audit),
                             ("running_high_low_stream", "running_high_low", _stream_high_low),
                             ("stream_orders", "process_orders", _stream_orders),
                             ("stream_market_cap", "market_cap_live", _stream_market_cap),
                             ("stream_refresh", "refresh_from_ticks", _stream_refresh)):
    REGISTRY[_name] = Query(_name, _build, REGISTRY[_twin].oracle)


@register("stream_broker_counts", """
SELECT CAST(brokerage_id AS BIGINT) AS brokerage_id, COUNT(user_id) AS user_count FROM account WHERE brokerage_id IS NOT NULL GROUP BY brokerage_id
""")
def _stream_broker_counts(fx):
    raw = fx.raw("supplier")
    new = (fx.spark.readStream.schema(raw.schema).option("pathGlobFilter", "supplier*.parquet").parquet(fx.sf_dir)
           .select(F.col("s_suppkey").alias("user_id"),
                   F.when(((F.col("s_suppkey") % 11) == 0) | (F.col("s_nationkey") >= 22), F.lit(None))
                   .otherwise(F.col("s_nationkey")).alias("brokerage_id")))
    out = _folder(fx, "broker-counts")
    q, versions = jobs.start_broker_counts(new, f"{out}/tables", checkpoint=f"{out}/checkpoint")
    q.awaitTermination()
    rows = versions.read("broker_counts")
    return rows.withColumn("brokerage_id", F.col("brokerage_id").cast("bigint"))
