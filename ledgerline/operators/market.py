"""Market operators for all tickers at once (Q9, Q10, Q15, Q16, Q19-Q28, Q30)
and the batch forms of the price triggers (W5 price audit, W6 running
high/low, market capitalisation).

Tables: ``stock(ticker, name, price, high_52, low_52)``, ``stock_prices(ticker,
date, price, volume)``, ``market_analysis(stock_ticker, pe_ratio,
dividend_yield, market_cap, volume)``, ``yearly_financials``,
``quarterly_financials`` and the ``ticks(event_id, ticker, price, ts)`` stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.exprs import as_double, parse_display_number, pct_change, round2
from ledgerline.operators.scan import bucketed_lag, bucketed_prefix, sliding_range
from ledgerline.sources.tables import parse_snapshot, upsert


def _date(d) -> Column:
    return F.lit(d).cast("date")


def _avg_double(c: Column) -> Column:
    """Mean as ``double(sum) / count``: the sum is exact, one rounding at the end."""
    return F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0)).cast("double")


# -- Q9 -------------------------------------------------------------------------

def moving_averages(stock: DataFrame, stock_prices: DataFrame, as_of, windows: Sequence[int] = (50, 200)) -> DataFrame:
    """Q9 (point form): mean close over the trailing ``n`` days (``date >= as_of - n``)
    for every listed ticker; null when there is no close in the window.

    One pass over the widest window: a single filtered scan and one
    aggregation computes every window with conditional averages.
    """
    widest = max(windows)
    end = _date(as_of)
    sp = stock_prices.where((F.col("date") >= F.date_sub(end, widest)) & (F.col("date") <= end))
    aggs = [round2(_avg_double(F.when(F.col("date") >= F.date_sub(end, n), F.col("price")))).alias(f"moving_avg_{n}")
            for n in windows]
    m = sp.groupBy("ticker").agg(*aggs)
    return stock.select("ticker").join(m, "ticker", "left")


def moving_average_series(stock_prices: DataFrame, n: int = 50) -> DataFrame:
    """Q9 (series form): for each ticker and day, mean close over ``[date - n, date]``.

    One way for every ``n``: a linear-time sliding sum and count
    (:func:`~ledgerline.operators.scan.sliding_range`), whose cost doesn't
    grow with the frame. Closes of one day are peers."""
    sp = stock_prices.select("ticker", "date", "price")
    s = sliding_range(sp, ["ticker"], "date", n, {"_s": ("sum", "price"), "_n": ("count", "price")})
    return s.select("ticker", "date", as_double("price").alias("price"),
                    (F.col("_s").cast("double") / F.nullif(F.col("_n"), F.lit(0)).cast("double"))
                    .alias(f"moving_avg_{n}"))


# -- Q10 ------------------------------------------------------------------------

def top_movers(stock: DataFrame, stock_prices: DataFrame, as_of, n: int = 7, k: int = 5,
               calendar_days: bool = False) -> DataFrame:
    """Q10: change of the current price against the oldest of the last ``n``
    closes up to ``as_of`` (or, with ``calendar_days``, the closes of the last
    ``n`` calendar days, as the vendor's ``7d`` period); ``k`` gainers
    (change > 0, largest first) and ``k`` losers (change <= 0, smallest
    first). Tickers with a null price or fewer than two closes are skipped.
    Ties are broken by ticker.
    """
    sp = stock_prices.where(F.col("date") <= _date(as_of))
    if calendar_days:
        recent = sp.where(F.col("date") > F.date_sub(_date(as_of), n))
    else:
        w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
        recent = sp.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    oldest = recent.groupBy("ticker").agg(F.min_by("price", "date").alias("old_price"), F.count(F.lit(1)).alias("_n"))
    s = stock.where(F.col("price").isNotNull()).select("ticker", "name", "price")
    j = s.join(oldest.where(F.col("_n") >= 2), "ticker")
    j = j.withColumn("percentage_change", round2(pct_change("price", "old_price")))
    j = j.where(F.col("percentage_change").isNotNull())
    side = F.when(F.col("percentage_change") > 0, "gainer").otherwise("loser")
    j = j.withColumn("side", side)
    order = F.when(F.col("side") == "gainer", -F.col("percentage_change")).otherwise(F.col("percentage_change"))
    wr = Window.partitionBy("side").orderBy(order, F.col("ticker"))
    ranked = j.withColumn("rank", F.row_number().over(wr)).where(F.col("rank") <= k)
    return ranked.select("side", F.col("rank").cast("bigint").alias("rank"), "ticker", "name",
                         as_double("price").alias("price"), as_double("old_price").alias("old_price"),
                         "percentage_change")


# -- Q15 / Q16 / Q19 -----------------------------------------------------------

def high_range_stocks(stock: DataFrame, ratio: float = 2.1) -> DataFrame:
    """Q15: stocks whose 52-week high is at least ``ratio`` times the low, highest first."""
    s = stock.where(F.col("high_52") >= F.lit(ratio).cast("decimal(10,4)") * F.col("low_52"))
    return s.select("ticker", "name", as_double("high_52").alias("high_52"), as_double("low_52").alias("low_52")) \
            .orderBy(F.col("high_52").desc_nulls_last(), "ticker")


def low_stocks(stock: DataFrame) -> DataFrame:
    """Q16: stocks with a known 52-week low, lowest first."""
    s = stock.where(F.col("low_52").isNotNull())
    return s.select("ticker", "name", as_double("high_52").alias("high_52"), as_double("low_52").alias("low_52")) \
            .orderBy(F.col("low_52").asc_nulls_last(), "ticker")


def stock_listing(stock: DataFrame) -> DataFrame:
    """Q19: every stock with price and 52-week range, by ticker."""
    return stock.select("ticker", "name", *[as_double(c).alias(c) for c in ("price", "high_52", "low_52")]) \
                .orderBy("ticker")


def sort_by_display(df: DataFrame, text_col: str, ascending: bool = True, missing_value: float = 0.0) -> DataFrame:
    """Order rows by the number shown in a display column (currency signs,
    separators and words stripped); unparseable text sorts as ``missing_value``."""
    key = F.coalesce(parse_display_number(F.col(text_col)), F.lit(missing_value))
    return df.orderBy(key.asc() if ascending else key.desc())


# -- Q20-Q23 --------------------------------------------------------------------

def screen_eps_pe(stock: DataFrame, yearly: DataFrame, market: DataFrame,
                  min_eps: float = 0.0, max_pe: float = 100.0) -> DataFrame:
    """Q20: stocks with EPS growth >= ``min_eps`` and P/E <= ``max_pe``; no year
    filter, so a stock appears once per qualifying year."""
    y = yearly.where(F.col("eps_growth") >= F.lit(min_eps))
    m = market.where(F.col("pe_ratio") <= F.lit(max_pe))
    j = stock.join(y, stock.ticker == y.stock_ticker).join(m, stock.ticker == m.stock_ticker)
    return j.select(stock.ticker, stock.name, y.year, y.eps_growth.alias("eps"), m.pe_ratio.alias("pe"))


def highest_eps_growth(stock: DataFrame, yearly: DataFrame, year: int, k: int = 5) -> DataFrame:
    """Q21: the ``k`` stocks with the highest EPS growth in ``year`` (nulls excluded)."""
    y = yearly.where((F.col("year") == year) & F.col("eps_growth").isNotNull())
    j = stock.join(y, stock.ticker == y.stock_ticker)
    return j.select(stock.ticker, stock.name, y.eps_growth) \
            .orderBy(F.col("eps_growth").desc(), F.col("ticker")).limit(k)


def undervalued_stocks(stock: DataFrame, market: DataFrame, yearly: DataFrame, year: int,
                       max_pe: float = 150.0, min_eps: float = 0.1) -> DataFrame:
    """Q22: P/E below ``max_pe`` and EPS growth above ``min_eps`` in ``year``, by growth."""
    m = market.where(F.col("pe_ratio") < F.lit(max_pe))
    y = yearly.where((F.col("year") == year) & (F.col("eps_growth") > F.lit(min_eps)))
    j = stock.join(m, stock.ticker == m.stock_ticker).join(y, stock.ticker == y.stock_ticker)
    return j.select(stock.ticker, stock.name, m.pe_ratio, y.eps_growth) \
            .orderBy(F.col("eps_growth").desc(), F.col("ticker"))


def most_traded(stock: DataFrame, market: DataFrame, k: int = 10) -> DataFrame:
    """Q23: the ``k`` stocks with the largest volume (ties by ticker)."""
    m = market.where(F.col("volume").isNotNull())
    j = stock.join(m, stock.ticker == m.stock_ticker)
    return j.select(stock.ticker, stock.name, m.volume.alias("total_volume")) \
            .orderBy(F.col("total_volume").desc(), F.col("ticker")).limit(k)


# -- Q24 / Q25 ------------------------------------------------------------------

def latest_per_key(df: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` per ``key`` (``ORDER BY order DESC LIMIT 1``).

    ``max_by`` is a plain aggregate, so it combines map-side: no sort and no
    window, and a hot key is reduced before the shuffle."""
    picked = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in cols])


def stock_profile(stock: DataFrame, yearly: DataFrame, quarterly: DataFrame, market: DataFrame) -> DataFrame:
    """Q24: per stock, its row plus the latest yearly and quarterly figures and
    the market row, each as a nested struct that is null when missing."""
    y = latest_per_key(yearly, "stock_ticker", "year", ["year", "eps_growth", "revenue_growth", "profit", "earnings"])
    q = latest_per_key(quarterly, "stock_ticker", "quarter", ["quarter", "profit", "earnings"])
    y = y.select(F.col("stock_ticker").alias("ticker"), F.struct(
        "year", "eps_growth", "revenue_growth", as_double("profit").alias("profit"),
        as_double("earnings").alias("earnings")).alias("yearly_financials"))
    q = q.select(F.col("stock_ticker").alias("ticker"), F.struct(
        "quarter", as_double("profit").alias("profit"), as_double("earnings").alias("earnings")
    ).alias("quarterly_financials"))
    m = market.select(F.col("stock_ticker").alias("ticker"), F.struct(
        "pe_ratio", "dividend_yield", "market_cap", "volume").alias("market_analysis"))
    s = stock.select("ticker", "name", *[as_double(c).alias(c) for c in ("price", "high_52", "low_52")])
    return s.join(y, "ticker", "left").join(q, "ticker", "left").join(m, "ticker", "left")


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct columns to top-level ``struct_field`` columns."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            cols += [F.col(f"{f.name}.{c.name}").alias(f"{f.name}{sep}{c.name}") for c in f.dataType.fields]
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def price_chart(stock_prices: DataFrame, as_of, months: int = 6, as_arrays: bool = False) -> DataFrame:
    """Q25: closes of the last ``months`` months up to ``as_of`` per ticker, as
    rows, or (``as_arrays``) one row per ticker with date-sorted arrays."""
    end = _date(as_of)
    sp = stock_prices.where((F.col("date") > F.add_months(end, -months)) & (F.col("date") <= end))
    rows = sp.select("ticker", F.date_format("date", "yyyy-MM-dd").alias("date"), as_double("price").alias("price"))
    if not as_arrays:
        return rows
    pts = F.array_sort(F.collect_list(F.struct("date", "price")))
    return rows.groupBy("ticker").agg(pts.alias("_p")).select(
        "ticker", F.col("_p.date").alias("dates"), F.col("_p.price").alias("prices"))


# -- Q26 / Q27 / Q28 ------------------------------------------------------------

def one_snapshot(snapshots: DataFrame, order_col: str | None = None) -> DataFrame:
    """One vendor snapshot per ticker: the last by ``order_col``, or without
    one the largest text, so that a ticker is never refreshed twice."""
    by = F.struct(F.col(order_col), F.col("raw")) if order_col else F.col("raw")
    return snapshots.groupBy("ticker").agg(F.max_by("raw", by).alias("raw"))


def market_refresh(stock: DataFrame, snapshots: DataFrame, stock_prices: DataFrame, as_of, year: int,
                   order_col: str | None = None) -> DataFrame:
    """Q26: refreshed figures for every listed ticker with price history.

    Price and volume come from the last close up to ``as_of``; the rest from
    the ticker's vendor snapshot with the vendor defaults (name 'Unknown',
    numbers 0): dividend yield x100, market cap, profit and revenue in
    millions rounded to cents. A ticker without history is skipped, as is
    one whose snapshot is malformed (reported by :func:`refresh_rejects`).
    """
    last = latest_per_key(stock_prices.where(F.col("date") <= _date(as_of)), "ticker", "date", ["price", "volume"])
    snap = parse_snapshot(one_snapshot(snapshots, order_col))
    j = stock.select("ticker").join(last, "ticker").join(snap, "ticker", "left")
    ok = F.coalesce(F.col("parse_ok"), F.lit(True))
    j = j.where(ok)
    z = F.lit(0.0)
    return j.select(
        "ticker",
        F.coalesce(F.col("long_name"), F.lit("Unknown")).alias("name"),
        as_double("price").alias("price"),
        F.coalesce(F.col("high_52"), z).alias("high_52"),
        F.coalesce(F.col("low_52"), z).alias("low_52"),
        F.coalesce(F.col("trailing_pe"), z).alias("pe_ratio"),
        (F.coalesce(F.col("dividend_yield"), z) * 100).alias("dividend_yield"),
        round2(F.coalesce(F.col("market_cap"), z) / 1e6).alias("market_cap"),
        F.col("volume").cast("bigint").alias("volume"),
        F.coalesce(F.col("eps_growth"), z).alias("eps_growth"),
        F.coalesce(F.col("revenue_growth"), z).alias("revenue_growth"),
        round2(F.coalesce(F.col("net_income"), z) / 1e6).alias("profit"),
        round2(F.coalesce(F.col("total_revenue"), z) / 1e6).alias("earnings"),
        F.lit(year).alias("year"),
    )


def refresh_rejects(stock: DataFrame, snapshots: DataFrame, stock_prices: DataFrame, as_of) -> DataFrame:
    """Listed tickers the refresh skips, with the reason (no history / bad snapshot)."""
    has_hist = stock_prices.where(F.col("date") <= _date(as_of)).select("ticker").distinct() \
                           .withColumn("_h", F.lit(True))
    snap = parse_snapshot(one_snapshot(snapshots)).select("ticker", "parse_ok")
    j = stock.select("ticker").join(has_hist, "ticker", "left").join(snap, "ticker", "left")
    reason = F.when(F.col("_h").isNull(), "no price history") \
              .when(~F.coalesce(F.col("parse_ok"), F.lit(True)), "malformed snapshot")
    return j.select("ticker", reason.alias("reason")).where(F.col("reason").isNotNull())


def apply_refresh(stock: DataFrame, market: DataFrame, yearly: DataFrame,
                  changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Upsert refreshed figures into the three tables (replace on conflict)."""
    c = changes
    new_stock = upsert(stock, c.select("ticker", "name", *[F.col(x).cast("decimal(10,2)").alias(x)
                                                         for x in ("price", "high_52", "low_52")]), ["ticker"])
    new_market = upsert(market, c.select(F.col("ticker").alias("stock_ticker"), "pe_ratio", "dividend_yield",
                                         "market_cap", "volume"), ["stock_ticker"])
    new_yearly = upsert(yearly, c.select(F.col("ticker").alias("stock_ticker"), "year", "eps_growth",
                                         "revenue_growth", "profit", "earnings"), ["stock_ticker", "year"])
    return new_stock, new_market, new_yearly


def market_cap(stock: DataFrame, market: DataFrame) -> DataFrame:
    """Q27: ``price * volume`` per ticker, beside the vendor's market cap (kept
    apart: they differ in unit and source)."""
    j = market.join(stock.select(F.col("ticker").alias("stock_ticker"), "price"), "stock_ticker")
    return j.select("stock_ticker", as_double("price").alias("price"), "volume",
                    as_double(F.col("price") * F.col("volume")).alias("market_cap_pv"),
                    F.col("market_cap").alias("vendor_market_cap"))


def add_or_update_stock(stock: DataFrame, changes: DataFrame,
                        order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Q28: admin upsert of (ticker, name, price). Tickers are upper-cased;
    rows with an empty ticker or name, or a price that is not a number
    (or does not fit NUMERIC(10,2)), are rejected; highs and lows of an
    existing stock are kept. Several changes of one ticker apply in the order
    of ``order_col`` (without one they raise an error). Returns ``(new_stock,
    rejects)``."""
    order = [F.col(order_col).alias("_order")] if order_col else []
    c = changes.select(*order, F.upper(F.trim(F.col("ticker"))).alias("ticker"), F.trim(F.col("name")).alias("name"),
                       F.col("price").alias("_raw_price"),
                       F.col("price").cast("string").try_cast("decimal(10,2)").alias("price"))
    reason = (F.when((F.coalesce(F.col("ticker"), F.lit("")) == "") | (F.coalesce(F.col("name"), F.lit("")) == ""),
                     "ticker and name are required")
               .when(F.col("_raw_price").isNotNull() & F.col("price").isNull(), "price is not a number"))
    c = c.withColumn("reason", reason)
    rejects = c.where(F.col("reason").isNotNull()).drop("_raw_price", "_order")
    ok = c.where(F.col("reason").isNull()).drop("_raw_price", "reason")
    return upsert(stock, ok, ["ticker"], ["name", "price"], "_order" if order_col else None), rejects


# -- Q30 ------------------------------------------------------------------------

def financial_rollup(facts: DataFrame, grain: str = "year") -> DataFrame:
    """Q30: profit and earnings per ticker and year (or quarter, ``YYYYQn``),
    with growth against the previous period of the same ticker.

    ``facts(stock_ticker, ts, profit, earnings)``; sums are exact decimals,
    growth is ``(x - prev) / prev`` in double."""
    if grain == "year":
        period = F.year("ts").alias("year")
        pname = "year"
    else:
        period = F.concat(F.year("ts").cast("string"), F.lit("Q"), F.quarter("ts").cast("string")).alias("quarter")
        pname = "quarter"
    g = facts.groupBy("stock_ticker", period).agg(F.sum("profit").alias("profit"), F.sum("earnings").alias("earnings"))
    w = Window.partitionBy("stock_ticker").orderBy(pname)
    pp, pe = F.lag("profit").over(w), F.lag("earnings").over(w)
    return g.select("stock_ticker", pname,
                    ((F.col("profit") - pp).cast("double") / pp.cast("double")).alias("eps_growth"),
                    ((F.col("earnings") - pe).cast("double") / pe.cast("double")).alias("revenue_growth"),
                    as_double("profit").alias("profit"), as_double("earnings").alias("earnings"))


# -- W5 / W6: batch forms of the price triggers ----------------------------------

def _ticks_with_day(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("_day", F.col("ts").cast("date"))


def price_audit(ticks: DataFrame, stock: DataFrame) -> DataFrame:
    """One audit row per price change. The old price of a tick is the
    previous tick of the ticker (by ts, event_id), and for the first tick the
    stock's stored price. Rows whose price is not distinct from the old one
    (null-safe) are not logged; the percentage is null for a null or zero
    old price. Only listed tickers are audited (the trigger fires on updates
    of existing stock rows).

    The lag runs in day buckets with a carry from the previous day, so a
    ticker with a third of all ticks is still split over many tasks.
    """
    t = _ticks_with_day(ticks.join(stock.select(F.col("ticker"), F.col("price").alias("_seed")), "ticker"))
    t = bucketed_lag(t, ["ticker"], "_day", ["ts", "event_id"], "price", "_prev", has_prev="_has_prev")
    old = F.when(F.col("_has_prev"), F.col("_prev")).otherwise(F.col("_seed"))
    t = t.withColumn("old_price", old)
    t = t.where(~F.col("old_price").eqNullSafe(F.col("price")))
    return t.select("ticker", "event_id", F.col("ts").alias("change_date"),
                    as_double("old_price").alias("old_price"), as_double("price").alias("new_price"),
                    round2(pct_change("price", "old_price")).alias("change_percentage"))


def running_high_low(ticks: DataFrame, stock: DataFrame) -> DataFrame:
    """After each tick, the stock's high and low: the stored values
    moved by every price so far (a higher positive price raises the high, a
    lower price lowers the low; a null price changes nothing). All-time,
    as the original trigger; see :func:`rolling_high_low` for a 52-week frame."""
    t = _ticks_with_day(ticks.join(stock.select("ticker", F.col("high_52").alias("_h0"),
                                                F.col("low_52").alias("_l0")), "ticker"))
    t = t.withColumn("_hp", F.when(F.col("price") > 0, F.col("price")))
    t = bucketed_prefix(t, ["ticker"], "_day", ["ts", "event_id"],
                        {"_hi": ("max", "_hp"), "_lo": ("min", "price")}, include_peers=False)
    return t.select("ticker", "event_id", "ts", as_double("price").alias("price"),
                    as_double(F.greatest("_h0", "_hi")).alias("high_52"),
                    as_double(F.least("_l0", "_lo")).alias("low_52"))


def rolling_high_low(stock_prices: DataFrame, days: int = 364) -> DataFrame:
    """52-week high and low per ticker and day over ``[date - days, date]``
    (linear-time sliding max / min, :func:`~ledgerline.operators.scan.sliding_range`)."""
    s = sliding_range(stock_prices.select("ticker", "date", "price"), ["ticker"], "date", days,
                      {"_hi": ("max", "price"), "_lo": ("min", "price")})
    return s.select("ticker", "date", as_double("_hi").alias("high_52"), as_double("_lo").alias("low_52"))


def latest_tick_prices(ticks: DataFrame) -> DataFrame:
    """Last tick per ticker by (ts, event_id) - the refresh input of T5/T7."""
    g = ticks.groupBy("ticker").agg(F.max_by(F.struct("price", "ts", "event_id"),
                                             F.struct("ts", "event_id")).alias("_r"))
    return g.select("ticker", F.col("_r.price").alias("price"), F.col("_r.ts").alias("ts"),
                    F.col("_r.event_id").alias("event_id"))


def market_cap_live(ticks: DataFrame, stock: DataFrame, market: DataFrame) -> DataFrame:
    """T5 batch twin: market cap ``price * volume`` with the latest tick price
    (stored price when a ticker has no tick)."""
    lt = latest_tick_prices(ticks).select("ticker", F.col("price").alias("_tick"))
    s = stock.select("ticker", "price").join(lt, "ticker", "left") \
             .select(F.col("ticker").alias("stock_ticker"), F.coalesce("_tick", "price").alias("price"))
    j = market.select("stock_ticker", "volume").join(s, "stock_ticker")
    return j.select("stock_ticker", as_double("price").alias("price"), "volume",
                    as_double(F.col("price") * F.col("volume")).alias("market_cap_pv"))


def refresh_from_ticks(stock: DataFrame, ticks: DataFrame) -> DataFrame:
    """T7 batch twin: stock table with each listed ticker's price replaced by its latest tick."""
    lt = latest_tick_prices(ticks).select("ticker", "price")
    listed = lt.join(stock.select("ticker"), "ticker", "left_semi")
    return upsert(stock, listed, ["ticker"], ["price"])


def daily_ohlc(ticks: DataFrame) -> DataFrame:
    """Daily open / high / low / close and tick count per ticker (batch twin of
    :func:`ledgerline.streaming.jobs.ohlc_stream`). Open and close are the
    first and last tick of the day by (ts, event_id); all aggregates combine
    map-side, so a hot ticker is reduced before the shuffle."""
    order = F.struct("ts", "event_id")
    g = ticks.groupBy("ticker", F.col("ts").cast("date").alias("day")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("n_ticks"))
    return g.select("ticker", "day", *[as_double(c).alias(c) for c in ("open", "high", "low", "close")], "n_ticks")
