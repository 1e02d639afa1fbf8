"""Domain tables derived from the driver's synthetic parquet files.

Each function maps raw tables (``lineitem``, ``supplier``, ``events`` ...) to one
of the ledger / market tables the analytical operators take. All of them are
lazy DataFrames: nothing is read until an operator's plan runs, so Catalyst
prunes columns and pushes filters into the parquet scans.

The mapping rules are fixed (they must equal the oracle's view text in
``ledgerline.plans.oracle``); see FIXTURES.md for the reasoning behind them.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.sources.tables import read_table

# Fixed clocks of the fixtures (ledgers end, last trading day).
LEDGER_AS_OF = "2001-12-31"
PRICE_AS_OF = "2001-11-04"


def _ticker(num: Column) -> Column:
    """'T' + the part's key, e.g. 7 -> 'T7': one ticker for every part."""
    return F.concat(F.lit("T"), num.cast("string"))


def _fixed(num: Column, width: int) -> Column:
    return F.lpad(num.cast("string"), width, "0")


def _event_ticker(events: DataFrame, n_parts: int) -> Column:
    """Events name a ticker by their id and their number k, spread over all parts."""
    k = F.get_json_object(events.props, "$.k").cast("bigint")
    return _ticker((events.event_id * 7919 + k) % F.lit(n_parts).cast("bigint"))


def _dec(c: Column, p: int, s: int) -> Column:
    return c.cast(f"decimal({p},{s})")


class Fixtures:
    """Lazily built domain tables over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # -- accounts -----------------------------------------------------------
    @functools.cached_property
    def broker(self) -> DataFrame:
        n = self.raw("nation")
        return n.select(n.n_nationkey.alias("brokerage_id"), n.n_name.alias("name"))

    @functools.cached_property
    def account(self) -> DataFrame:
        s = self.raw("supplier")
        no_broker = ((s.s_suppkey % 11) == 0) | (s.s_nationkey >= 22)
        return s.select(
            s.s_suppkey.alias("user_id"),
            s.s_name.alias("name"),
            F.when(no_broker, F.lit(None).cast("int")).otherwise(s.s_nationkey).alias("brokerage_id"),
            _dec(s.s_acctbal, 15, 2).alias("balance"),
        )

    # -- ledger -------------------------------------------------------------
    @functools.cached_property
    def txn(self) -> DataFrame:
        l = self.raw("lineitem")
        qty = l.l_quantity.cast("int")
        # fixed-width fields: unique like the tuple, ordered like it, and no number to overflow
        tid = F.concat_ws("-", _fixed(l.l_orderkey, 14), _fixed(l.l_linenumber, 2), _fixed(l.l_partkey, 12),
                          _fixed(l.l_suppkey, 12), _fixed(qty, 4))
        return l.select(
            tid.alias("transaction_id"),
            l.l_suppkey.alias("user_id"),
            _ticker(l.l_partkey).alias("stock_ticker"),
            F.when(l.l_returnflag == "R", "SELL").otherwise("BUY").alias("type"),
            qty.alias("quantity"),
            _dec(l.l_extendedprice, 10, 2).alias("price"),
            l.l_shipdate.alias("ts"),
        )

    @functools.cached_property
    def portfolio(self) -> DataFrame:
        """What the ordered replay of the ledger leaves: positions with shares."""
        from ledgerline.operators.positions import position_ledger
        p = position_ledger(self.txn)
        return p.where(p.quantity > 0).select("user_id", "stock_ticker", "quantity", _dec(p.avg_price, 10, 2).alias("avg_price"))

    # -- market -------------------------------------------------------------
    @functools.cached_property
    def stock_prices(self) -> DataFrame:
        t = self.txn
        return t.groupBy(t.stock_ticker.alias("ticker"), t.ts.cast("date").alias("date")).agg(
            F.max_by(t.price, t.transaction_id).alias("price"),
            F.sum(t.quantity).cast("bigint").alias("volume"),
        )

    @functools.cached_property
    def stock(self) -> DataFrame:
        p = self.raw("part")
        listed = p.select(
            _ticker(p.p_partkey).alias("ticker"),
            p.p_name.alias("name"),
            F.when((p.p_partkey % 25) == 24, F.lit(None).cast("decimal(10,2)"))
             .otherwise(_dec(p.p_retailprice * 50, 10, 2)).alias("price"),
        )
        sp = self.stock_prices
        hl = (sp.where((sp.date > F.lit("2000-11-04").cast("date"))
                       & (sp.date <= F.lit(PRICE_AS_OF).cast("date")))
              .groupBy("ticker").agg(F.max("price").alias("high_52"), F.min("price").alias("low_52")))
        return listed.join(hl, "ticker", "left").select("ticker", "name", "price", "high_52", "low_52")

    @functools.cached_property
    def _line_ticker_year(self) -> DataFrame:
        l = self.raw("lineitem")
        return l.select(
            _ticker(l.l_partkey).alias("stock_ticker"),
            l.l_shipdate,
            (_dec(l.l_extendedprice, 12, 2) * _dec(1 - l.l_discount, 3, 2)).alias("_profit"),
            _dec(l.l_extendedprice, 12, 2).alias("_earn"),
        )

    @functools.cached_property
    def yearly_financials(self) -> DataFrame:
        y = (self._line_ticker_year
             .groupBy("stock_ticker", F.year("l_shipdate").alias("year"))
             .agg(F.sum("_profit").alias("profit"), F.sum("_earn").alias("earnings")))
        w = Window.partitionBy("stock_ticker").orderBy("year")
        prev_p, prev_e = F.lag("profit").over(w), F.lag("earnings").over(w)
        return y.select(
            "stock_ticker", "year",
            ((F.col("profit") - prev_p).cast("double") / prev_p.cast("double")).alias("eps_growth"),
            ((F.col("earnings") - prev_e).cast("double") / prev_e.cast("double")).alias("revenue_growth"),
            "profit", "earnings",
        )

    @functools.cached_property
    def quarterly_financials(self) -> DataFrame:
        q = F.concat(F.year("l_shipdate").cast("string"), F.lit("Q"), F.quarter("l_shipdate").cast("string"))
        return (self._line_ticker_year.groupBy("stock_ticker", q.alias("quarter"))
                .agg(F.sum("_profit").alias("profit"), F.sum("_earn").alias("earnings")))

    @functools.cached_property
    def market_analysis(self) -> DataFrame:
        l = self.raw("lineitem")
        v = l.groupBy(_ticker(l.l_partkey).alias("stock_ticker")).agg(
            F.sum(l.l_quantity.cast("int")).cast("bigint").alias("volume"),
            F.sum(_dec(l.l_extendedprice, 12, 2)).alias("amt"),
            (F.sum(_dec(l.l_tax, 4, 2)).cast("double") / F.count(F.lit(1)) * 100).alias("dividend_yield"),
        )
        s = self.stock.select("ticker", "price")
        j = v.join(s, v.stock_ticker == s.ticker, "left")
        return j.select(
            v.stock_ticker,
            (s.price.cast("double") / (v.amt.cast("double") / v.volume.cast("double"))).alias("pe_ratio"),
            v.dividend_yield,
            (s.price * v.volume).cast("double").alias("market_cap"),
            v.volume,
        )

    # -- request / event streams -------------------------------------------
    def _events(self) -> DataFrame:
        return self.raw("events")

    @functools.cached_property
    def n_parts(self) -> int:
        """Number of parts (a row count from the file footers)."""
        return self.raw("part").count()

    @staticmethod
    def ticks_from(events: DataFrame, n_parts: int) -> DataFrame:
        return events.select(
            "event_id",
            _event_ticker(events, n_parts).alias("ticker"),
            _dec(F.col("value"), 10, 2).alias("price"),
            "ts",
        )

    @staticmethod
    def orders_from(events: DataFrame, n_parts: int) -> DataFrame:
        e = events
        return e.select(
            e.event_id.alias("order_id"), "user_id",
            F.when((e.event_id % 53) == 0, F.lit("X999"))
             .otherwise(_event_ticker(e, n_parts)).alias("ticker"),
            F.when(e.event_type.isin("click", "error"), "SELL").otherwise("BUY").alias("type"),
            ((e.event_id % 60) - 3).cast("int").alias("quantity"),
            _dec(e.value, 10, 2).alias("price"),
            "ts",
        )

    @functools.cached_property
    def ticks(self) -> DataFrame:
        return self.ticks_from(self._events(), self.n_parts)

    @functools.cached_property
    def order_requests(self) -> DataFrame:
        return self.orders_from(self._events(), self.n_parts)

    @functools.cached_property
    def deposits(self) -> DataFrame:
        e = self._events()
        return e.where(e.event_type == "signup").select(
            e.event_id.alias("deposit_id"), "user_id",
            (_dec(e.value, 15, 2) - 20).alias("amount"))

    @functools.cached_property
    def signups(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            c.c_custkey.alias("signup_id"),
            F.when((c.c_custkey % 10) == 0,
                   F.concat(F.lit("SUPPLIER#"), F.lpad(c.c_custkey.cast("string"), 9, "0")))
             .otherwise(c.c_name).alias("name"),
            F.when((c.c_custkey % 13) == 0, F.lit(None).cast("int"))
             .otherwise(c.c_nationkey + 3).alias("brokerage_id"),
            _dec(c.c_acctbal, 15, 2).alias("balance"),
        )

    @functools.cached_property
    def snapshots(self) -> DataFrame:
        p = self.raw("part")
        full = F.concat(
            F.lit('{"longName":"'), p.p_name, F.lit('","trailingPE":'), p.p_size.cast("string"),
            F.lit(',"marketCap":'), (p.p_size * 1000000 + p.p_partkey).cast("string"),
            F.lit(',"totalRevenue":'), (p.p_size * 500000 + p.p_partkey).cast("string"), F.lit("}"))
        name_only = F.concat(F.lit('{"longName":"'), p.p_name, F.lit('"}'))
        return p.select(_ticker(p.p_partkey).alias("ticker"),
                        F.when((p.p_partkey % 7) == 0, name_only).otherwise(full).alias("raw"))

    def tables(self) -> dict[str, DataFrame]:
        names = ["broker", "account", "stock", "txn", "yearly_financials", "quarterly_financials",
                 "portfolio", "market_analysis", "stock_prices"]
        return {n: getattr(self, n) for n in names}


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    # a URI goes to Spark as it is; only a relative local path is made absolute
    return Fixtures(spark, sf_dir if ":" in sf_dir else os.path.abspath(sf_dir))
