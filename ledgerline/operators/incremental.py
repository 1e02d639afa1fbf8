"""Holdings and portfolio history kept up to date day by day (Q6, Q8).

Holdings are validity intervals: a position's net quantity from one of its
trading days to the next. What is kept between days is the *open* interval of
every position, split into key buckets, and the intervals that are closed. A
day's trades close the open intervals of the positions they touch and open new
ones: the buckets that hold those positions are rewritten, everything else,
the history above all, is neither read nor written.

Trades without a user or a ticker meet no open interval: each day of theirs
opens one that stays open.

Both tables change in one commit with the day's number, so a reader sees whole
days, and a day that comes again after a failure is known and skipped.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.exprs import signed_qty
from ledgerline.operators.history import daily_position_changes, holdings_by_day, value_history
from ledgerline.operators.positions import POSITION_KEY
from ledgerline.sources.versions import Versions

OPEN, CLOSED, STREAM = "open", "closed", "days"

_SCHEMA = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("stock_ticker", T.StringType()),
                        T.StructField("valid_from", T.DateType()), T.StructField("valid_to", T.DateType()),
                        T.StructField("net_quantity", T.LongType())])


class Holdings:
    """The holdings kept under ``path``; ``buckets``: how finely positions are split."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets, self.versions = spark, buckets, Versions(spark, path)

    def last_day(self) -> dt.date | None:
        """The last day taken in."""
        n = self.versions.done(STREAM)
        return dt.date(1970, 1, 1) + dt.timedelta(days=n) if n >= 0 else None

    def start(self, trades: DataFrame, as_of: dt.date) -> int:
        """Begin with all trades up to ``as_of`` at once."""
        # the open intervals need no order of days: the last day and the sum of all
        known = trades.where(F.col("ts").cast("date") <= F.lit(as_of))
        held = known.groupBy(*POSITION_KEY).agg(F.max(F.col("ts").cast("date")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
                                                F.sum(signed_qty()).cast("bigint").alias("net_quantity"))
        return self.versions.replace({OPEN: held, CLOSED: holdings_by_day(trades, as_of).where("valid_to IS NOT NULL")},
                                     keys={OPEN: POSITION_KEY}, buckets=self.buckets, done=(STREAM, (as_of - dt.date(1970, 1, 1)).days))

    def add_day(self, trades: DataFrame, day: dt.date) -> int:
        """Take in the trades of ``day`` (others are left out); days come in order.

        A day up to the last one taken in changes nothing."""
        changes = daily_position_changes(trades.where(F.col("ts").cast("date") == F.lit(day)), day)
        changes = changes.select(*POSITION_KEY, "net_change").persist()
        number = (day - dt.date(1970, 1, 1)).days
        met: list[DataFrame] = []  # the open intervals of the day's positions, at most as many as there are changes

        def closes(_: DataFrame) -> DataFrame:
            """The open intervals that the day's trades end; one that began on the day itself can't be there."""
            return met[-1].withColumn("valid_to", F.lit(day))

        def opened(rows: DataFrame) -> DataFrame:
            # the day's few changes go to the kept positions, which stay where they are
            met.append(rows.join(changes.select(*POSITION_KEY), POSITION_KEY, "left_semi").persist())
            new = changes.join(met[-1].select(*POSITION_KEY), POSITION_KEY, "left_anti")
            both = rows.join(changes, POSITION_KEY, "left").unionByName(new, allowMissingColumns=True)
            touched = F.col("net_change").isNotNull()
            return both.select(*POSITION_KEY, F.when(touched, F.lit(day)).otherwise(F.col("valid_from")).alias("valid_from"), "valid_to",
                               (F.coalesce("net_quantity", F.lit(0)) + F.coalesce("net_change", F.lit(0))).cast("bigint").alias("net_quantity"))

        try:
            if not self.versions.manifest()["tables"]:
                empty = self.spark.createDataFrame([], _SCHEMA)
                self.versions.replace({OPEN: empty, CLOSED: empty}, keys={OPEN: POSITION_KEY}, buckets=self.buckets)
            return self.versions.rewrite(OPEN, changes, lambda rows, _: opened(rows), append={CLOSED: closes}, done=(STREAM, number))
        finally:
            for df in (*met, changes):
                df.unpersist()

    def intervals(self) -> DataFrame:
        """Q8 as of the last day taken in (batch twin: :func:`ledgerline.operators.history.holdings_by_day`)."""
        return self.versions.read(CLOSED).unionByName(self.versions.read(OPEN)).select(
            "user_id", "stock_ticker", "valid_from", "valid_to", "net_quantity")

    def portfolio_history(self, stock: DataFrame, as_of: dt.date | None = None) -> DataFrame:
        """Q6 at the current prices from the intervals, without the trades (twin: ``history.portfolio_history``)."""
        held = self.intervals().select("user_id", "stock_ticker", F.col("valid_from").alias("date"), F.col("net_quantity").alias("_net"))
        return value_history(held, stock, as_of or self.last_day())
