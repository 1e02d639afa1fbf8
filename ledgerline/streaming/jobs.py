"""Structured Streaming forms of the trigger logic.

Each job reads an append-only stream, keeps per-key state in the state store
(RocksDB) and writes to a sink; checkpoints live under the shared folder named
by ``spark.checkpoint.dir``, so a restarted query resumes where it stopped.
Every job has a batch twin in ``ledgerline.operators`` and, drained with
``availableNow``, produces the same rows, in whatever order files arrive.

* T1-T4 (positions, orders with cash, price audit, high and low) are in
  ``ledgerline.streaming.ordered``.
* T5/T7: latest tick per ticker kept by a streaming aggregation; changed rows
  go to a compacted change log, the latest per ticker is taken on read.
* T6 ``broker_count_stream``: users per broker, a streaming aggregation whose
  result is a committed table version.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.functions.exprs import as_double, pct_change, round2
from ledgerline.session import scratch_path
from ledgerline.sources.fixtures import Fixtures
from ledgerline.sources.tables import upsert
from ledgerline.sources.versions import ChangeLog, Versions

# -- sources --------------------------------------------------------------------


def event_stream(spark: SparkSession, folder: str, file_glob: str = "events*.parquet",
                 max_files_per_trigger: int | None = 64, watermark: str | None = None) -> DataFrame:
    """The ``events`` table as an append-only file stream.

    ``max_files_per_trigger`` bounds the work of a micro-batch, also while a
    backlog is drained; no result depends on it. With ``watermark`` the zone-less ``ts`` is cast to TIMESTAMP
    (session zone UTC) and replayed events are dropped by ``event_id``
    within the watermark, so an at-least-once producer does not double-apply.
    """
    r = spark.readStream.schema(schemas.EVENTS).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = r.parquet(folder)
    if watermark:
        ev = (ev.withColumn("event_time", F.col("ts").cast("timestamp"))
                .withWatermark("event_time", watermark)
                .dropDuplicatesWithinWatermark(["event_id"]))
    return ev


def _checkpoint(spark: SparkSession, name: str, checkpoint: str | None) -> str:
    return checkpoint or scratch_path(spark, os.path.join("streams", name))


# -- T1-T4: rows from the steps that ledgerline.streaming.ordered computes ------------


def trades_from_orders(orders: DataFrame) -> DataFrame:
    """Order requests as trade rows (the rows a buy/sell handler would insert)."""
    return orders.select(F.lpad(F.col("order_id").cast("string"), 18, "0").alias("transaction_id"), "user_id",
                         F.upper(F.trim("ticker")).alias("stock_ticker"), "type", "quantity", "price", "ts")


def audit_rows(steps: DataFrame) -> DataFrame:
    """T3 output: audit rows of the price steps (twin: ``market.price_audit``)."""
    return steps.where("changed").select(
        "ticker", "event_id", F.col("ts").alias("change_date"), "old_price", F.col("price").alias("new_price"),
        round2(pct_change("price", "old_price")).alias("change_percentage"))


def high_low_rows(steps: DataFrame) -> DataFrame:
    """T4 output (twin: ``market.running_high_low``)."""
    return steps.select("ticker", "event_id", "ts", "price", "high_52", "low_52")


# -- T5 / T7: latest tick per ticker, upserted per micro-batch --------------------------


def latest_tick_state(ticks: DataFrame) -> DataFrame:
    """Streaming aggregation: latest price per ticker by (ts, event_id), and
    where ticks carry a ``volume`` its latest known value."""
    order = F.struct("ts", "event_id")
    known = [F.max_by("volume", F.when(F.col("volume").isNotNull(), order)).alias("volume")] if "volume" in ticks.columns else []
    g = ticks.groupBy("ticker").agg(F.max_by(F.struct("price", "ts", "event_id"), order).alias("_r"), *known)
    return g.select("ticker", F.col("_r.price").alias("price"), *(["volume"] if known else []),
                    F.col("_r.ts").alias("ts"), F.col("_r.event_id").alias("event_id"))


def _start_changes(ticks: DataFrame, out_path: str, name: str, checkpoint: str | None, available_now: bool):
    state = latest_tick_state(ticks)
    changes = ChangeLog(ticks.sparkSession, out_path, state.schema, ["ticker"])
    w = state.writeStream.outputMode("update").foreachBatch(changes.write) \
        .option("checkpointLocation", _checkpoint(ticks.sparkSession, name, checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start(), changes


def start_market_cap_stream(ticks: DataFrame, out_path: str, checkpoint: str | None = None, available_now: bool = True):
    """T5: keep the latest price (and volume, where ticks carry one) of every
    ticker; :func:`live_market_cap` recomputes ``price * volume`` from them."""
    return _start_changes(ticks, out_path, "market_cap", checkpoint, available_now)


def live_market_cap(changes: ChangeLog, stock: DataFrame, market: DataFrame) -> DataFrame:
    """Market caps with the changed prices and volumes applied (twin: ``market.market_cap_live``)."""
    latest = changes.latest()
    volume = F.col("_vol") if "volume" in latest.columns else F.lit(None)
    fresh = latest.select(F.col("ticker").alias("stock_ticker"), F.col("price").alias("_px"),
                          *([F.col("volume").alias("_vol")] if "volume" in latest.columns else []))
    j = (market.select("stock_ticker", "volume").join(stock.select(F.col("ticker").alias("stock_ticker"), "price"), "stock_ticker")
         .join(fresh, "stock_ticker", "left"))
    price, shares = F.coalesce("_px", "price"), F.coalesce(volume, F.col("volume"))
    return j.select("stock_ticker", as_double(price).alias("price"), shares.alias("volume"),
                    as_double(price * shares).alias("market_cap_pv"))


def start_refresh_stream(ticks: DataFrame, out_path: str, checkpoint: str | None = None, available_now: bool = True):
    """Keep every ticker's latest tick; :func:`refreshed_stock` upserts them."""
    return _start_changes(ticks, out_path, "refresh", checkpoint, available_now)


def refreshed_stock(changes: ChangeLog, stock: DataFrame) -> DataFrame:
    """The stock table with every listed ticker's latest tick price (twin: ``market.refresh_from_ticks``)."""
    changed = changes.latest().join(stock.select("ticker"), "ticker", "left_semi").select("ticker", "price")
    return upsert(stock, changed, ["ticker"], ["price"])


# -- event-time windows ------------------------------------------------------------


def ohlc_stream(ticks: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Daily OHLC per ticker over a tumbling one-day event-time window.

    ``ts`` is zone-less, so it is cast to TIMESTAMP (session zone UTC) for the
    watermark. In append mode a day is emitted once the watermark passes its
    end (later ticks for it are dropped as late); in update or complete mode
    open days are emitted as they change. Twin: ``market.daily_ohlc``.
    """
    t = ticks.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", watermark)
    order = F.struct("ts", "event_id")
    g = t.groupBy(F.window("event_time", "1 day").alias("w"), "ticker").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("n_ticks"))
    return g.select("ticker", F.col("w.start").cast("date").alias("day"),
                    *[as_double(c).alias(c) for c in ("open", "high", "low", "close")], "n_ticks")


# -- T6 ---------------------------------------------------------------------------


def broker_count_stream(new_users: DataFrame) -> DataFrame:
    """Users per broker over a stream of inserted users (complete mode)."""
    return new_users.where(F.col("brokerage_id").isNotNull()).groupBy("brokerage_id") \
                    .agg(F.count("user_id").alias("user_count"))


def start_broker_counts(new_users: DataFrame, out_path: str, checkpoint: str | None = None, available_now: bool = True):
    """T6 to a table: each micro-batch commits all counts as the next version,
    so a reader has the counts of one whole batch, also after a crash."""
    spark = new_users.sparkSession
    versions = Versions(spark, out_path)
    w = (broker_count_stream(new_users).writeStream.outputMode("complete")
         .foreachBatch(lambda df, batch_id: versions.replace({"broker_counts": df}, done=("broker_counts", batch_id)))
         .option("checkpointLocation", _checkpoint(spark, "broker_counts", checkpoint)))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start(), versions


# -- running a job to a table ---------------------------------------------------------


def run_to_table(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None,
                 available_now: bool = True):
    """Start ``df`` into an in-memory table ``name`` (for tests and small drains).

    A memory sink cannot resume, so each run gets a fresh checkpoint folder."""
    spark = df.sparkSession
    w = df.writeStream.format("memory").queryName(name).outputMode(mode) \
          .option("checkpointLocation", checkpoint or _checkpoint(spark, f"{name}-{uuid.uuid4().hex}", None))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def start_to_parquet(df: DataFrame, out_path: str, name: str, checkpoint: str | None = None,
                     available_now: bool = True):
    """Append ``df`` to a parquet folder with exactly-once file commits."""
    spark = df.sparkSession
    w = df.writeStream.format("parquet").option("path", out_path).outputMode("append") \
          .option("checkpointLocation", _checkpoint(spark, name, checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def fixture_streams(spark: SparkSession, folder: str, n_parts: int, max_files_per_trigger: int | None = 64):
    """Order and tick streams over the events files of ``folder``; ``n_parts``: see ``Fixtures``."""
    ev = event_stream(spark, folder, max_files_per_trigger=max_files_per_trigger)
    return Fixtures.orders_from(ev, n_parts), Fixtures.ticks_from(ev, n_parts)
