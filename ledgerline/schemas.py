"""Declared schemas of the ledger and market tables.

Types follow the original DDL: NUMERIC(p,s) -> DecimalType(p,s), TIMESTAMP
without zone -> TimestampNTZ. Keys and constraints are listed beside each
schema; the audits in ``ledgerline.operators.quality`` check them, since
Spark does not enforce them on write.
"""

from __future__ import annotations

from pyspark.sql import types as T

D15_2 = T.DecimalType(15, 2)
D10_2 = T.DecimalType(10, 2)
D5_2 = T.DecimalType(5, 2)

BROKERS = T.StructType([
    T.StructField("brokerage_id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
])

USERS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("brokerage_id", T.IntegerType(), True),
    T.StructField("balance", D15_2, True),
])

STOCK = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("price", D10_2, True),
    T.StructField("high_52", D10_2, True),
    T.StructField("low_52", D10_2, True),
])

TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("stock_ticker", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("quantity", T.IntegerType(), False),
    T.StructField("price", D10_2, False),
    T.StructField("ts", T.TimestampNTZType(), True),
])

PORTFOLIO = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("stock_ticker", T.StringType(), False),
    T.StructField("quantity", T.LongType(), False),
    T.StructField("avg_price", D10_2, True),
])

MARKET_ANALYSIS = T.StructType([
    T.StructField("stock_ticker", T.StringType(), False),
    T.StructField("pe_ratio", T.DoubleType(), True),
    T.StructField("dividend_yield", T.DoubleType(), True),
    T.StructField("market_cap", T.DoubleType(), True),
    T.StructField("volume", T.LongType(), True),
])

STOCK_PRICES = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("price", D10_2, True),
    T.StructField("volume", T.LongType(), True),
])

TICKS = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("ticker", T.StringType(), False),
    T.StructField("price", D10_2, True),
    T.StructField("ts", T.TimestampNTZType(), True),
])

# Raw events file feeding the streaming jobs (driver's ``events`` table).
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("props", T.StringType(), True),
])

# Per-ticker vendor metadata; every field may be missing.
SNAPSHOT_FIELDS = T.StructType([
    T.StructField("longName", T.StringType(), True),
    T.StructField("trailingPE", T.DoubleType(), True),
    T.StructField("dividendYield", T.DoubleType(), True),
    T.StructField("marketCap", T.DoubleType(), True),
    T.StructField("fiftyTwoWeekHigh", T.DoubleType(), True),
    T.StructField("fiftyTwoWeekLow", T.DoubleType(), True),
    T.StructField("earningsGrowth", T.DoubleType(), True),
    T.StructField("revenueGrowth", T.DoubleType(), True),
    T.StructField("netIncomeToCommon", T.DoubleType(), True),
    T.StructField("totalRevenue", T.DoubleType(), True),
])

# Keys and constraints of the declared tables (name -> spec), used by audits.
CONSTRAINTS = {
    "broker": {"pk": ["brokerage_id"], "unique": [["name"]], "not_null": ["name"], "varchar": {"name": 255}},
    "account": {"pk": ["user_id"], "not_null": ["name"],
                "fk": [(["brokerage_id"], "broker", ["brokerage_id"])],
                "numeric": {"balance": (15, 2)}, "varchar": {"name": 255}},
    "stock": {"pk": ["ticker"], "not_null": ["name"],
              "numeric": {"price": (10, 2), "high_52": (10, 2), "low_52": (10, 2)},
              "varchar": {"ticker": 20, "name": 255}},
    "txn": {"pk": ["transaction_id"],
            "fk": [(["user_id"], "account", ["user_id"]), (["stock_ticker"], "stock", ["ticker"])],
            "check": {"type_domain": "type IN ('BUY', 'SELL')", "quantity_positive": "quantity > 0"},
            "numeric": {"price": (10, 2)}, "varchar": {"stock_ticker": 20, "type": 10}},
    "yearly_financials": {"pk": ["stock_ticker", "year"], "not_null": ["stock_ticker"],
                          "fk": [(["stock_ticker"], "stock", ["ticker"])],
                          "numeric": {"eps_growth": (5, 2), "revenue_growth": (5, 2), "profit": (15, 2),
                                      "earnings": (15, 2)}},
    "quarterly_financials": {"pk": ["stock_ticker", "quarter"], "not_null": ["stock_ticker"],
                             "fk": [(["stock_ticker"], "stock", ["ticker"])],
                             "numeric": {"profit": (15, 2), "earnings": (15, 2)},
                             "varchar": {"quarter": 10}},
    "portfolio": {"pk": ["user_id", "stock_ticker"],
                  "fk": [(["user_id"], "account", ["user_id"]), (["stock_ticker"], "stock", ["ticker"])],
                  "check": {"quantity_non_negative": "quantity >= 0"},
                  "numeric": {"avg_price": (10, 2)}},
    "market_analysis": {"pk": ["stock_ticker"], "fk": [(["stock_ticker"], "stock", ["ticker"])],
                        "numeric": {"pe_ratio": (10, 2), "dividend_yield": (5, 2), "market_cap": (15, 2)}},
    "stock_audit": {"pk": ["audit_id"], "fk": [(["ticker"], "stock", ["ticker"])], "not_null": ["ticker"],
                    "numeric": {"new_price": (10, 2)}, "varchar": {"ticker": 20}},
}
