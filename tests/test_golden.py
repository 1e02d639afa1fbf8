"""Hand-sized cases for semantics the fixtures cannot reach or pin down."""

import datetime as dt
from decimal import Decimal as D

import pytest

from ledgerline import schemas
from ledgerline.operators import accounts, history, market, positions, quality
from ledgerline.sources import tables


def ts(day, h=0, m=0):
    return dt.datetime(2001, 1, day, h, m)


def txn_df(spark, rows):
    """rows: (id, user, ticker, type, qty, price, ts)"""
    return spark.createDataFrame([(i, u, t, k, q, D(str(p)), w) for i, u, t, k, q, p, w in rows],
                                 schemas.TRANSACTIONS)


def stock_df(spark, rows):
    def dec(x):
        return None if x is None else D(str(x))
    return spark.createDataFrame([(t, n, dec(p), dec(h), dec(lo)) for t, n, p, h, lo in rows], schemas.STOCK)


# -- Q4 realised P&L ---------------------------------------------------------------

def test_realized_pnl_counts_buys_at_the_same_timestamp(spark):
    t = txn_df(spark, [
        (1, 1, "A", "BUY", 10, 100, ts(1)),
        (2, 1, "A", "SELL", 5, 130, ts(2, 10)),
        (3, 1, "A", "BUY", 10, 200, ts(2, 10)),   # same timestamp as the sell: counts
        (4, 1, "A", "BUY", 10, 900, ts(2, 11)),   # later: does not count
        (5, 2, "B", "SELL", 2, 50, ts(3)),        # no buys at all: mean 0
    ])
    got = {int(r.transaction_id): r for r in history.realized_pnl(t).collect()}
    assert got[2].avg_buy_cost == pytest.approx(150.0)
    assert got[2].realized_pnl == pytest.approx(5 * (130 - 150))
    assert got[5].avg_buy_cost == 0.0 and got[5].realized_pnl == pytest.approx(100.0)


def test_realized_pnl_carries_across_days(spark):
    rows = [(i, 1, "A", "BUY", 1, 10 * i, ts(i)) for i in range(1, 6)]
    rows.append((9, 1, "A", "SELL", 1, 100, ts(6)))
    got = history.realized_pnl(txn_df(spark, rows)).collect()[0]
    assert got.avg_buy_cost == pytest.approx(30.0)


# -- Q12 ledger replay -----------------------------------------------------------

def test_position_ledger_reweights_resets_and_rejects(spark):
    t = txn_df(spark, [
        (1, 1, "A", "BUY", 10, 100, ts(1)),
        (2, 1, "A", "BUY", 10, 200, ts(2)),
        (3, 1, "A", "SELL", 5, 300, ts(3)),
        (4, 1, "A", "SELL", 20, 300, ts(4)),   # oversell: rejected
        (5, 1, "A", "SELL", 15, 100, ts(5)),   # sells out: average resets
        (6, 1, "A", "BUY", 1, 50, ts(6)),
    ])
    steps = {int(r.transaction_id): r for r in positions.ledger_steps(t).collect()}
    assert steps[2].avg_cents_after == 15000 and steps[2].qty_after == 20
    assert steps[3].status == "SOLD" and steps[3].realized_cents == 5 * (30000 - 15000)
    assert steps[4].status == "REJECTED" and steps[4].qty_after == 15
    assert steps[5].qty_after == 0 and steps[5].avg_cents_after == 0
    assert steps[6].avg_cents_after == 5000
    final = positions.position_ledger(t).collect()[0]
    assert (final.quantity, final.avg_price, final.n_trades, final.n_rejected) == (1, 50.0, 6, 1)
    assert final.realized_pnl == pytest.approx(750.0 - 750.0)


def test_position_ledger_rounds_average_half_up_to_the_cent(spark):
    t = txn_df(spark, [(1, 1, "A", "BUY", 1, "1.00", ts(1)), (2, 1, "A", "BUY", 2, "1.01", ts(2)),
                       (3, 1, "A", "BUY", 1, "1.01", ts(3))])
    steps = {int(r.transaction_id): r.avg_cents_after for r in positions.ledger_steps(t).collect()}
    # (100 + 202) / 3 = 100.67 -> 101; (101*3 + 101) / 4 = 101
    assert steps == {1: 100, 2: 101, 3: 101}


def test_trade_step_matches_a_decimal_reference_fold():
    from decimal import ROUND_HALF_UP
    import random
    rnd = random.Random(7)
    qty, avg = 0, 0
    dq, davg = 0, D(0)
    for _ in range(2000):
        kind = rnd.choice(["BUY", "SELL"])
        q, p = rnd.randint(1, 40), rnd.randint(1, 50000)
        qty, avg, status, _ = positions.trade_step(qty, avg, kind, q, p)
        if kind == "BUY":
            davg = ((davg * dq + D(p) * q) / (dq + q)).quantize(D(1), rounding=ROUND_HALF_UP)
            dq += q
        elif q <= dq:
            dq -= q
            davg = davg if dq else D(0)
        assert (qty, avg) == (dq, int(davg))


# -- Q2, Q6, Q10, Q17, Q29 -----------------------------------------------------------

def test_portfolio_totals_zero_for_users_without_positions(spark):
    users = spark.createDataFrame([(1, "a", 1, D("10.00")), (2, "b", 1, D("5.00"))], schemas.USERS)
    pf = spark.createDataFrame([(1, "A", 2, D("10.00"))], schemas.PORTFOLIO)
    st = stock_df(spark, [("A", "Alpha", 15, None, None)])
    got = {r.user_id: r for r in positions.portfolio_totals(users, pf, st).collect()}
    assert got[2].total_investment == 0.0 and got[2].total_pnl_pct == 0.0
    assert got[1].total_pnl == pytest.approx(10.0) and got[1].total_pnl_pct == pytest.approx(50.0)


def test_portfolio_history_dense_calendar_and_running_max(spark):
    t = txn_df(spark, [
        (1, 1, "A", "BUY", 10, 1, ts(1)),
        (2, 1, "A", "SELL", 4, 1, ts(3)),
        (3, 1, "B", "BUY", 1, 1, ts(3)),
    ])
    st = stock_df(spark, [("A", "a", 2, None, None), ("B", "b", 5, None, None)])
    rows = history.portfolio_history(t, st, as_of=dt.date(2001, 1, 5)).orderBy("date").collect()
    assert [r.date.day for r in rows] == [1, 2, 3, 4, 5]
    assert [r.daily_value for r in rows] == [20.0, 20.0, 17.0, 17.0, 17.0]
    assert [r.portfolio_value for r in rows] == [20.0, 20.0, 20.0, 20.0, 20.0]


def test_top_movers_skips_null_price_and_short_history(spark):
    st = stock_df(spark, [("A", "a", 110, None, None), ("B", "b", None, None, None),
                          ("C", "c", 90, None, None), ("D", "d", 100, None, None), ("E", "e", 100, None, None)])
    sp = spark.createDataFrame([(t, dt.date(2001, 1, d), D(p), 1) for t, d, p in [
        ("A", 1, "100"), ("A", 2, "105"), ("B", 1, "1"), ("B", 2, "2"), ("C", 1, "100"), ("C", 2, "95"),
        ("D", 1, "100"), ("D", 2, "100"), ("E", 2, "50")]], schemas.STOCK_PRICES)
    got = {r.ticker: r for r in market.top_movers(st, sp, "2001-01-02").collect()}
    assert set(got) == {"A", "C", "D"}
    assert got["A"].side == "gainer" and got["A"].percentage_change == 10.0
    assert got["D"].side == "loser"           # zero change counts as a loss
    assert got["C"].rank == 1 and got["D"].rank == 2


def test_broker_counts_include_empty_brokers(spark):
    b = spark.createDataFrame([(1, "x"), (2, "y")], schemas.BROKERS)
    u = spark.createDataFrame([(1, "a", 1, D(0)), (2, "b", None, D(0))], schemas.USERS)
    got = {r.brokerage_id: r.user_count for r in accounts.broker_user_counts(b, u).collect()}
    assert got == {1: 1, 2: 0}


def test_register_users_rules_and_batch_duplicates(spark):
    b = spark.createDataFrame([(1, "x")], schemas.BROKERS)
    u = spark.createDataFrame([(1, "Taken", 1, D(0))], schemas.USERS)
    s = spark.createDataFrame([
        (1, "new", 1, D("1000.00")), (2, " NEW ", 1, D("5000.00")), (3, "taken ", 1, D("2000.00")),
        (4, "cheap", 1, D("999.99")), (5, "lost", 9, D("2000.00")), (6, "none", None, D("2000.00")),
        (7, None, 1, D("2000.00")), (8, "  ", 1, D("2000.00")),
    ], "signup_id long, name string, brokerage_id int, balance decimal(15,2)")
    got = {r.signup_id: r.status for r in accounts.register_users(s, u, b).collect()}
    assert got == {1: "accepted", 2: "name_taken", 3: "name_taken", 4: "low_balance",
                   5: "unknown_broker", 6: "broker_required", 7: "name_required", 8: "name_required"}


def test_validate_orders_statuses(spark):
    st = stock_df(spark, [("A", "a", 10, None, None)])
    pf = spark.createDataFrame([(1, "A", 5, D("10.00"))], schemas.PORTFOLIO)
    us = spark.createDataFrame([(1, "u", 1, D("100.00"))], schemas.USERS)
    o = spark.createDataFrame([
        (1, 1, "a", "BUY", 0, D("1")), (2, 1, "Z", "BUY", 1, D("1")), (3, 1, "A", "BUY", 20, D("10")),
        (4, 1, "A", "BUY", 10, D("10")), (5, 2, "A", "SELL", 1, D("1")), (6, 1, "A", "SELL", 6, D("1")),
        (7, 1, "A", "SELL", 5, D("1")), (8, 1, "A", "HOLD", 1, D("1")),
    ], "order_id long, user_id long, ticker string, type string, quantity int, price decimal(10,2)")
    got = {r.order_id: r.status for r in accounts.validate_orders(o, st, pf, us).collect()}
    assert got == {1: "invalid_quantity", 2: "unknown_stock", 3: "insufficient_balance", 4: "accepted",
                   5: "not_held", 6: "insufficient_shares", 7: "accepted", 8: "invalid_type"}


# -- T3 / W5 price audit -----------------------------------------------------------

def test_price_audit_null_and_zero_old_price(spark):
    st = stock_df(spark, [("A", "a", None, None, None), ("B", "b", 0, None, None), ("C", "c", 5, None, None)])
    ticks = spark.createDataFrame([
        (1, "A", D("10"), ts(1)), (2, "A", D("10"), ts(2)), (3, "A", D("12"), ts(3)),
        (4, "B", D("3"), ts(1)), (5, "C", D("5"), ts(1)), (6, "C", D("4"), ts(2))], schemas.TICKS)
    got = {r.event_id: r for r in market.price_audit(ticks, st).collect()}
    assert set(got) == {1, 3, 4, 6}                      # 2 and 5 equal their predecessor
    assert got[1].old_price is None and got[1].change_percentage is None
    assert got[4].old_price == 0.0 and got[4].change_percentage is None
    assert got[3].change_percentage == 20.0 and got[6].change_percentage == -20.0


def test_running_high_low_seeded_from_stock(spark):
    st = stock_df(spark, [("A", "a", 5, 8, 4)])
    ticks = spark.createDataFrame([(1, "A", D("9"), ts(1)), (2, "A", None, ts(2)), (3, "A", D("3"), ts(3))],
                                  schemas.TICKS)
    got = [(r.high_52, r.low_52) for r in market.running_high_low(ticks, st).orderBy("event_id").collect()]
    assert got == [(9.0, 4.0), (9.0, 4.0), (9.0, 3.0)]


# -- S6 / S7 / S10 / S14 -------------------------------------------------------------

def test_upsert_replaces_inserts_and_keeps_other_columns(spark):
    base = stock_df(spark, [("A", "a", 1, 9, 1), ("B", "b", 2, 8, 2)])
    ch = spark.createDataFrame([("A", "a2", None), ("C", "c", D("3"))], "ticker string, name string, price decimal(10,2)")
    got = {r.ticker: r for r in tables.upsert(base, ch, ["ticker"], ["name", "price"]).collect()}
    assert got["A"].name == "a2" and got["A"].price is None and got["A"].high_52 == D("9.00")
    assert got["B"].name == "b" and got["C"].high_52 is None and got["C"].price == D("3.00")


def test_apply_buys_reweights_average(spark):
    pf = spark.createDataFrame([(1, "A", 10, D("100.00"))], schemas.PORTFOLIO)
    buys = spark.createDataFrame([(1, "A", 10, D("200.00")), (2, "B", 1, D("5.00"))],
                                 "user_id long, stock_ticker string, quantity int, price decimal(10,2)")
    got = {(r.user_id, r.stock_ticker): (r.quantity, r.avg_price) for r in tables.apply_buys(pf, buys).collect()}
    assert got == {(1, "A"): (20, D("150.00")), (2, "B"): (1, D("5.00"))}


def test_delete_keys_and_cascade(spark):
    st = stock_df(spark, [("A", "a", 1, None, None), ("B", "b", 1, None, None)])
    pf = spark.createDataFrame([(1, "A", 1, D("1")), (1, "B", 1, D("1"))], schemas.PORTFOLIO)
    keys = spark.createDataFrame([("A",)], "ticker string")
    out = tables.cascade_delete({"stock": st, "portfolio": pf}, "stock", keys, [("portfolio", "stock_ticker")], "ticker")
    assert [r.ticker for r in out["stock"].collect()] == ["B"]
    assert [r.stock_ticker for r in out["portfolio"].collect()] == ["B"]


def test_apply_deposits_rejects_invalid_and_unknown(spark):
    us = spark.createDataFrame([(1, "u", 1, D("10.00"))], schemas.USERS)
    dep = spark.createDataFrame([(1, 1, "5.50"), (2, 1, "-1"), (3, 1, "abc"), (4, 9, "3")],
                                "deposit_id long, user_id long, amount string")
    new_users, rejects = accounts.apply_deposits(us, dep)
    assert new_users.collect()[0].balance == D("15.50")
    assert {r.deposit_id: r.reason for r in rejects.collect()} == {
        2: "Amount must be greater than zero", 3: "Amount must be greater than zero", 4: "User not found"}


def test_parse_snapshot_defaults(spark):
    s = spark.createDataFrame([("A", '{"longName":"x","marketCap":5}'), ("B", "not json"), ("C", "{}")],
                              "ticker string, raw string")
    got = {r.ticker: r for r in tables.parse_snapshot(s).collect()}
    assert got["A"].long_name == "x" and got["A"].market_cap == 5.0 and got["A"].trailing_pe == 0.0
    assert got["C"].long_name == "Unknown"
    assert got["B"].parse_ok is False


# -- K1-K5 audits ---------------------------------------------------------------------

def test_audits_find_each_kind_of_violation(spark):
    st = stock_df(spark, [("A", "a", 1, None, None), ("A", "dup", 1, None, None), ("T" * 21, "long", 1, None, None)])
    acct = spark.createDataFrame([(1, "u", 1, D(0))], schemas.USERS)
    t = txn_df(spark, [(1, 1, "A", "BUY", 1, 1, ts(1)), (2, 2, "Z", "HOLD", 0, 1, ts(1))])
    ma = spark.createDataFrame([("A", 10.0, 1.0, 1e14, 5)], schemas.MARKET_ANALYSIS)
    tabs = {"stock": st, "account": acct, "txn": t, "market_analysis": ma}
    rules = {(r.table, r.rule) for r in quality.audit_tables(tabs).collect()}
    assert ("stock", "primary_key:duplicate") in rules
    assert ("txn", "foreign_key:user_id->account") in rules
    assert ("txn", "foreign_key:stock_ticker->stock") in rules
    assert ("txn", "check:type_domain") in rules and ("txn", "check:quantity_positive") in rules
    assert ("market_analysis", "numeric(15,2):market_cap") in rules
    assert ("stock", "varchar(20):ticker") in rules


def test_accepted_trades_appends_only_accepted(spark, fx, tmp_path):
    judged = accounts.validate_orders(fx.order_requests, fx.stock, fx.portfolio, fx.account)
    trades = accounts.accepted_trades(fx.order_requests, judged)
    n_ok = judged.where("status = 'accepted'").count()
    path = str(tmp_path / "txn")
    tables.append(trades, path)
    tables.append(trades.limit(0), path)
    assert spark.read.parquet(path).count() == n_ok


def test_refresh_rejects_and_admin_upsert_rejects(spark):
    st = stock_df(spark, [("A", "a", 1, None, None), ("B", "b", 1, None, None), ("C", "c", 1, None, None)])
    sp = spark.createDataFrame([("A", dt.date(2001, 1, 1), D("2"), 5), ("C", dt.date(2001, 1, 1), D("3"), 6)],
                               schemas.STOCK_PRICES)
    snaps = spark.createDataFrame([("A", '{"longName":"Alpha"}'), ("C", "{broken")], "ticker string, raw string")
    rej = {r.ticker: r.reason for r in market.refresh_rejects(st, snaps, sp, "2001-01-02").collect()}
    assert rej == {"B": "no price history", "C": "malformed snapshot"}
    ch = market.market_refresh(st, snaps, sp, "2001-01-02", 2024).collect()
    assert [(r.ticker, r.name, r.price, r.volume) for r in ch] == [("A", "Alpha", 2.0, 5)]
    changes = spark.createDataFrame([(" a ", "Alpha2", "9.5"), ("", "x", "1"), ("d", "", "1"), ("e", "Echo", "2"),
                                     ("f", "Fox", "abc")], "ticker string, name string, price string")
    new_stock, rejects = market.add_or_update_stock(st, changes)
    got = {r.ticker: (r.name, r.price) for r in new_stock.collect()}
    assert got["A"] == ("Alpha2", D("9.50")) and got["E"] == ("Echo", D("2.00")) and "D" not in got
    assert rejects.count() == 3 and "F" not in got


def test_accepted_users_get_deterministic_ids(spark):
    b = spark.createDataFrame([(1, "x")], schemas.BROKERS)
    u = spark.createDataFrame([(1, "Taken", 1, D(0))], schemas.USERS)
    s = spark.createDataFrame([(7, "new", 1, D("1000.00")), (8, "taken", 1, D("2000.00"))],
                              "signup_id long, name string, brokerage_id int, balance decimal(15,2)")
    got = accounts.accepted_users(accounts.register_users(s, u, b), id_offset=1000).collect()
    assert [(r.user_id, r.name, r.balance) for r in got] == [(1007, "new", D("1000.00"))]


def test_price_chart_arrays_are_date_sorted(spark):
    sp = spark.createDataFrame([("A", dt.date(2001, 1, d), D(d), 1) for d in (3, 1, 2)], schemas.STOCK_PRICES)
    r = market.price_chart(sp, "2001-01-03", months=6, as_arrays=True).first()
    assert r.dates == ["2001-01-01", "2001-01-02", "2001-01-03"] and r.prices == [1.0, 2.0, 3.0]


def test_top_movers_calendar_window(spark):
    st = stock_df(spark, [("A", "a", 110, None, None)])
    sp = spark.createDataFrame([("A", dt.date(2001, 1, d), D(p), 1) for d, p in [(1, "50"), (5, "100"), (7, "105")]],
                               schemas.STOCK_PRICES)
    got = market.top_movers(st, sp, "2001-01-07", n=7, calendar_days=True).first()
    assert got.old_price == 50.0           # 2001-01-01 is inside the last 7 calendar days
    got = market.top_movers(st, sp, "2001-01-07", n=3, calendar_days=True).first()
    assert got.old_price == 100.0


def test_cli_writes_json_rows(spark, tmp_path):
    from ledgerline.__main__ import main
    out = str(tmp_path / "out")
    assert main(["run", "most_traded", "/root/testdata/sf0.001", out, "--format", "json"]) == 0
    lines = spark.read.text(out).collect()
    assert len(lines) == 10 and lines[0].value.startswith('{"ticker":')


def test_upsert_keeps_last_change_per_key(spark):
    base = stock_df(spark, [("A", "a", 1, None, None)])
    ch = spark.createDataFrame([("A", "first", 1), ("A", "last", 3), ("A", "middle", 2), ("B", "b", 1)],
                               "ticker string, name string, seq int")
    got = {r.ticker: r.name for r in tables.upsert(base, ch, ["ticker"], ["name"], order_col="seq").collect()}
    assert got == {"A": "last", "B": "b"}


def test_cli_stream_high_low_once(spark, tmp_path):
    import os
    from ledgerline.__main__ import main
    events = str(tmp_path / "in")
    os.makedirs(events)
    import shutil
    shutil.copyfile("/root/testdata/sf0.001/events.parquet", os.path.join(events, "events-1.parquet"))
    out = str(tmp_path / "out")
    assert main(["stream", "high-low", events, "/root/testdata/sf0.001", out, "--once",
                 "--checkpoint", str(tmp_path / "ck")]) == 0
    assert spark.read.parquet(out).count() == 1000
