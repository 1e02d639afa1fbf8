"""T1-T4 in event-time order: files in any order, late rows, restarts, cash."""

import datetime as dt
import os
import random
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import market, positions
from ledgerline.sources.fixtures import Fixtures
from ledgerline.streaming import jobs, ordered

from conftest import SF_SMALL

END = dt.datetime(9000, 1, 1)
TRADE = "transaction_id string, user_id long, stock_ticker string, type string, quantity int, price decimal(10,2), ts timestamp_ntz"


def _same(a, b):
    b = b.select(*a.columns)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _deal(spark, folder, n_files):
    """The events in ``n_files`` files, each with rows of all days, read in a random order."""
    os.makedirs(folder)
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    ev.repartition(n_files, F.xxhash64("event_id")).write.mode("append").parquet(folder)
    files = sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))
    random.Random(1).shuffle(files)
    for i, f in enumerate(files):  # the source takes files by their time of change
        os.utime(os.path.join(folder, f), (1_700_000_000 + i, 1_700_000_000 + i))


def _closed(spark, fx, folder, out, steps, max_files, delay="60 days", max_batches=None):
    beats = f"{out}/beats"
    ordered.ensure_folder(spark, beats)

    def build():
        ev = jobs.event_stream(spark, folder, "part-*.parquet", max_files)
        ev = ordered.with_heartbeats(ev, beats)
        return steps(fx.orders_from(ev, fx.n_parts), fx.ticks_from(ev, fx.n_parts))

    sink = ordered.SplitSink(spark, f"{out}/tables")
    ordered.drain(build, sink, f"{out}/ck")
    ordered.beat(spark, beats, END)
    ordered.drain(build, sink, f"{out}/ck")
    return sink


@pytest.mark.parametrize("n_files, max_files", [(3, 1), (200, None)])
def test_streams_equal_their_twins_with_files_in_any_order(spark, fx, tmp_path, n_files, max_files):
    folder = str(tmp_path / "in")
    _deal(spark, folder, n_files)
    judged = lambda orders, _: ordered.order_steps(orders, fx.account, fx.portfolio, fx.stock, "60 days")
    sink = _closed(spark, fx, folder, str(tmp_path / "orders"), judged, max_files)
    twin = positions.process_orders(fx.order_requests, fx.account, fx.portfolio, fx.stock)
    _same(twin, sink.steps())
    assert sink.late().count() == 0
    if max_files:  # the others differ in what they fold only
        return
    trades = lambda orders, _: ordered.position_steps(jobs.trades_from_orders(orders), "60 days")
    sink = _closed(spark, fx, folder, str(tmp_path / "positions"), trades, max_files)
    _same(positions.ledger_steps(jobs.trades_from_orders(fx.order_requests)), sink.steps())
    prices = lambda _, ticks: ordered.price_steps(ticks, fx.stock, "60 days")
    sink = _closed(spark, fx, folder, str(tmp_path / "prices"), prices, max_files)
    _same(jobs.audit_rows(sink.steps()), market.price_audit(fx.ticks, fx.stock))
    _same(jobs.high_low_rows(sink.steps()), market.running_high_low(fx.ticks, fx.stock))


def _trade_files(spark, folder, files):
    """Files of (id, hour, type, quantity, price) trades of one position, one micro-batch each."""
    for i, rows in enumerate(files):
        at = [(f"{n:04d}", 7, "A", kind, q, None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), p) for n, h, kind, q, p in rows]
        df = spark.createDataFrame([(*r[:5], r[6], r[7]) for r in at],
                                   "transaction_id string, user_id long, stock_ticker string, type string, quantity int, ts timestamp_ntz, p int")
        df = df.withColumn("price", F.col("p").cast("decimal(10,2)")).drop("p").select(*[c.split(" ")[0] for c in TRADE.split(", ")])
        df.coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            at = os.path.join(folder, f)
            if f.endswith(".parquet") and os.path.getmtime(at) > 1_600_000_000:
                os.utime(at, (1_500_000_000 + i, 1_500_000_000 + i))


def _trades(spark, folder):
    return spark.readStream.schema(TRADE).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_rows_come_out_once_and_change_nothing(spark, tmp_path):
    folder = str(tmp_path / "in")
    files = [[(1, 0, "BUY", 10, 5)], [(2, 30, "BUY", 10, 7)], [(3, 1, "SELL", 10, 9), (4, 29, "SELL", 5, 9)], [(5, 90, "BUY", 1, 1)],
             [(6, 2, "BUY", 99, 1), (7, 89, "SELL", 1, 2)], [(8, 500, "BUY", 1, 1)]]
    _trade_files(spark, folder, files)
    sink = ordered.SplitSink(spark, str(tmp_path / "out"))
    ordered.drain(lambda: ordered.position_steps(_trades(spark, folder), "2 hours"), sink, str(tmp_path / "ck"))
    late = {r["transaction_id"] for r in sink.late().collect()}
    assert late == {"0003", "0006"}  # both came after a row more than two hours newer
    got = {r["transaction_id"]: (r["status"], r["qty_after"], r["step"]) for r in sink.steps().collect()}
    assert got == {"0001": ("BOUGHT", 10, 1), "0004": ("SOLD", 5, 2), "0002": ("BOUGHT", 15, 3), "0007": ("SOLD", 14, 4),
                   "0005": ("BOUGHT", 15, 5)}  # the newest trade still waits for earlier ones
    assert all(r["status"] is None and r["qty_after"] is None for r in sink.late().collect())


@pytest.mark.parametrize("step", ["data", "publish"])
def test_restart_in_mid_stream_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, step):
    folder, rng = str(tmp_path / "in"), random.Random(4)
    rows = [(n, n * 3 + rng.randrange(-8, 8), rng.choice(["BUY", "BUY", "SELL"]), rng.randint(1, 9), rng.randint(1, 50)) for n in range(40)]
    _trade_files(spark, folder, [rows[i:i + 8] for i in range(0, 40, 8)])
    sink = ordered.SplitSink(spark, str(tmp_path / "out"))
    ck, build = str(tmp_path / "ck"), lambda: ordered.position_steps(_trades(spark, folder), "6 hours")
    calls, real, publish = [], sink.versions.append, sink.versions.folder.publish

    def dies_before(tables, done):
        calls.append(done)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(tables, done=done)

    def dies_after(name, text):  # the version is there, but the stream never hears of it
        calls.append(name)
        done = publish(name, text)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return done

    if step == "data":
        monkeypatch.setattr(sink.versions, "append", dies_before)
    else:
        monkeypatch.setattr(sink.versions.folder, "publish", dies_after)
    with pytest.raises(Exception):
        ordered.drain(build, sink, ck)
    monkeypatch.undo()
    ordered.drain(build, sink, ck)
    whole = ordered.SplitSink(spark, str(tmp_path / "whole"))
    ordered.drain(build, whole, str(tmp_path / "ck2"))
    for a, b in ((sink.steps(), whole.steps()), (sink.late(), whole.late())):
        assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))
    seen = [r["transaction_id"] for t in (sink.steps(), sink.late()) for r in t.collect()]
    waiting = [f"{n:04d}" for n, h, *_ in rows if h > max(r[1] for r in rows) - 6]
    assert len(seen) == len(set(seen)) and sorted(seen + waiting) == [f"{n:04d}" for n in range(40)]


def test_replayed_events_are_dropped_within_the_watermark(spark, fx, tmp_path):
    """At-least-once delivery: a file arrives twice, its events count once."""
    d, out = str(tmp_path / "events"), str(tmp_path / "out")
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    for part in (ev.where(F.col("ts") < cut), ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)):
        part.coalesce(1).write.mode("append").parquet(d)
    once = spark.readStream.schema(ev.schema).parquet(d).withColumn("event_time", F.col("ts").cast("timestamp")) \
        .withWatermark("event_time", "60 days").dropDuplicatesWithinWatermark(["event_id"]).drop("event_time")
    q = once.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-ck") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(out).count() == ev.count()


def test_rows_without_a_time_are_late_and_nulls_are_kept(spark, tmp_path):
    folder = str(tmp_path / "in")
    t = dt.datetime(2024, 1, 1)
    rows = [("a", 7, "A", "BUY", 1, None, None), (None, 7, "A", "BUY", 2, None, t), ("b", None, None, "BUY", 3, None, t),
            ("c", 7, "A", "BUY", 1, None, t), ("d", 7, "A", "BUY", 1, None, t + dt.timedelta(days=9)), ("x", 7, "A", "HOLD", 1, None, t)]
    spark.createDataFrame(rows, TRADE).coalesce(1).write.parquet(folder)
    sink = ordered.SplitSink(spark, str(tmp_path / "out"))
    ordered.drain(lambda: ordered.position_steps(_trades(spark, folder), "1 hour"), sink, str(tmp_path / "ck"))
    assert [r["transaction_id"] for r in sink.late().collect()] == ["a"]
    got = sorted((str(r["user_id"]), str(r["transaction_id"]), r["status"]) for r in sink.steps().collect())
    assert got == [("7", "None", "INVALID"), ("7", "c", "INVALID"), ("None", "b", "INVALID")]


def test_empty_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([], TRADE).write.parquet(folder)
    sink = ordered.SplitSink(spark, str(tmp_path / "out"))
    ordered.drain(lambda: ordered.position_steps(_trades(spark, folder), "1 hour"), sink, str(tmp_path / "ck"))
    assert sink.versions.versions() == [] or sink.steps().collect() == []


ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", sys.argv[2] + "/kept").getOrCreate())
from ledgerline.session import apply_required_conf, ship_package
from ledgerline.streaming import ordered
apply_required_conf(spark)
ship_package(spark)
key, _ = ordered.STATE_STORE
before = spark.conf.get(key)
trades = spark.sql("SELECT * FROM VALUES ('a', 7L, 'A', 'BUY', 4, CAST(2 AS DECIMAL(10,2)), TIMESTAMP_NTZ'2024-01-01 10:00:00'),"
                   "('b', 7L, 'A', 'SELL', 5, CAST(2 AS DECIMAL(10,2)), TIMESTAMP_NTZ'2024-01-01 11:00:00'),"
                   "('c', 7L, 'A', 'BUY', 1, CAST(2 AS DECIMAL(10,2)), TIMESTAMP_NTZ'2024-01-09 11:00:00')"
                   "AS t(transaction_id, user_id, stock_ticker, type, quantity, price, ts)")
trades.coalesce(1).write.parquet(sys.argv[2] + "/in")
sink = ordered.SplitSink(spark, sys.argv[2] + "/out")
stream = spark.readStream.schema(trades.schema).parquet(sys.argv[2] + "/in")
ordered.drain(lambda: ordered.position_steps(stream, "1 hour"), sink, sys.argv[2] + "/ck")
got = sorted((r["transaction_id"], r["status"], r["qty_after"]) for r in sink.steps().collect())
assert got == [("a", "BOUGHT", 4), ("b", "REJECTED", 4)], got
assert spark.conf.get(key) == before
"""


def test_streams_run_in_a_plain_session_started_in_another_folder(tmp_path):
    """No state store is chosen, and Spark's own Python workers don't find the package by the working folder."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", ELSEWHERE, repo, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]


class _Calls:
    """Counts the calls to it, and keeps what a value, list and map state of one key hold."""

    def __init__(self):
        self.n, self.value, self.rows, self.by_key = 0, None, [], {}

    def __getattribute__(self, name):
        if name not in ("n", "value", "rows", "by_key"):
            self.n += 1
        return object.__getattribute__(self, name)

    def getListState(self, *_):
        return _List(self)

    def getValueState(self, *_):
        return _Value(self)

    def getMapState(self, *_):
        return self

    def registerTimer(self, _):
        pass

    deleteTimer = registerTimer

    def containsKey(self, key):
        return key in self.by_key

    def getValue(self, key):
        return self.by_key[key]

    def updateValue(self, key, value):
        self.by_key[key] = value


class _List:
    def __init__(self, calls):
        self.calls = calls

    def appendList(self, rows):
        self.put(self.calls.rows + rows)

    def put(self, rows):
        self.calls.n += 1
        self.calls.rows = rows

    def get(self):
        self.calls.n += 1
        return iter(self.calls.rows)

    def clear(self):
        self.put([])


class _Value:
    def __init__(self, calls):
        self.calls = calls

    def get(self):
        self.calls.n += 1
        return self.calls.value

    def update(self, value):
        self.calls.n += 1
        self.calls.value = value

    def clear(self):
        self.update(None)


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_users_positions_share_one_key():
    """Trades in 200 tickers: one call or two a position, not a key's worth of calls and two frames for each."""
    names = ["micros", "transaction_id", "stock_ticker", "type", "quantity", "price_cents"]
    rows = [(1_000_000 + n, f"{n:04d}", None if n == 7 else f"T{n % 200}", "BUY" if n < 200 else "SELL", 5 if n < 300 else 9, 100) for n in range(400)]
    p, handle = ordered.Positions("string"), _Calls()
    p.init(handle)
    frame = ordered.pd.DataFrame(random.Random(3).sample(rows, len(rows)), columns=names)
    assert list(p.handleInputRows(("7",), iter([frame]), _Clock(0))) == []
    (out,) = p.handleExpiredTimer(("7",), _Clock(10_000_000), None)
    assert handle.n <= 2 * 201 + 12
    got = {r.transaction_id: (r.stock_ticker, r.step, r.status, r.qty_after, r.late) for r in out.itertuples()}
    assert len(out) == len(got) == 400
    assert got["0006"] == ("T6", 1, "BOUGHT", 5, False) and got["0206"] == ("T6", 2, "SOLD", 0, False)
    assert got["0007"] == (None, 1, "BOUGHT", 5, False) and got["0207"] == ("T7", 1, "REJECTED", 0, False)
    assert got["0350"] == ("T150", 2, "REJECTED", 5, False)


def test_position_steps_of_many_tickers_equal_their_twin(spark, tmp_path):
    """Users and tickers may be missing; a trade without a user isn't taken for a heartbeat."""
    rng = random.Random(9)
    rows = [(f"{n:04d}", rng.choice([1, 2, 2**60 + 1, None]), rng.choice(["A", "B", "C", "D", None]), rng.choice(["BUY", "BUY", "SELL"]), rng.randint(1, 9),
             rng.choice([3, 7, None]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(500))) for n in range(300)]
    schema = TRADE.replace("price decimal(10,2)", "price int")
    trades = spark.createDataFrame(rows, schema).withColumn("price", F.col("price").cast("decimal(10,2)"))
    folder = str(tmp_path / "in")
    trades.repartition(3).write.parquet(folder)
    sink = ordered.SplitSink(spark, str(tmp_path / "out"))
    beats = str(tmp_path / "beats")
    ordered.ensure_folder(spark, beats)

    def build():
        both = _trades(spark, folder).unionByName(spark.readStream.schema("ts timestamp_ntz").parquet(beats), allowMissingColumns=True)
        return ordered.position_steps(both, "1 day")

    ordered.drain(build, sink, str(tmp_path / "ck"))
    ordered.beat(spark, beats, END)
    ordered.drain(build, sink, str(tmp_path / "ck"))
    assert sink.late().count() == 0
    got = sink.steps()
    _same(positions.ledger_steps(trades.where("user_id IS NOT NULL")), got.where("user_id IS NOT NULL"))
    nobody = trades.where("user_id IS NULL").withColumn("user_id", F.lit(0).cast("long"))  # one position a ticker, as for any user
    _same(positions.ledger_steps(nobody).drop("user_id"), got.where("user_id IS NULL").drop("user_id"))


class _Server:
    """Counts the calls to it and holds one key's states, by name."""

    def __init__(self):
        self.n, self.states = 0, {}

    def getMapState(self, name, *_):
        return _Named(self, name)

    getValueState = getMapState

    def registerTimer(self, _):
        self.n += 1

    deleteTimer = registerTimer


class _Named:
    def __init__(self, server, name):
        self.server, self.name = server, name

    def _held(self):
        self.server.n += 1
        return self.server.states.setdefault(self.name, {})

    def getValue(self, key):
        return self._held().get(key)

    def updateValue(self, key, value):
        self._held()[key] = value

    def get(self):
        return self._held().get(())

    def update(self, value):
        self._held()[()] = value

    def clear(self):
        self._held().clear()


def _folded(processor, rows, columns, times):
    """What a bucket's rows come out as when the watermark (ms) takes these times one after another, and the calls made."""
    server = _Server()
    processor.init(server)
    frame = ordered.pd.DataFrame(rows, columns=columns)
    assert list(processor.handleInputRows((3,), iter([frame]), _Clock(0))) == []
    out = [r for ms in times for f in processor.handleExpiredTimer((3,), _Clock(ms), None) for r in f.itertuples()]
    return out, server.n


def test_many_tickers_share_a_buckets_calls():
    """Ticks of 2,000 tickers: some calls a slot, not some a ticker; prices are carried from fold to fold."""
    nan = float("nan")
    rng, columns = random.Random(5), ["slot", "ticker", "micros", "event_id", "price", "seed", "seed_high", "seed_low"]
    rows = []
    for n in range(9000):
        k = rng.randrange(2000)
        seeds = (nan, nan, nan) if k == 7 else (50.0 + k, 60.0, nan) if k == 8 else (50.0 + k, 60.0 + k, 40.0 + k)
        rows.append((k % ordered.SLOTS, None if k == 7 else f"T{k}", 1_000_000 + n // 3, n if n % 11 else ordered.NONE,
                     rng.choice([nan, -1.0, float(k), 55.0 + k, 70.0 + k]), *seeds))
    out, calls = _folded(ordered.Prices(), rows, columns, [1001, 1002, 5000])
    assert len(out) == len(rows) and calls <= 3 * (2 * ordered.SLOTS + 12)
    known = lambda x: None if x != x else x
    held, want = {}, Counter()
    for _, ticker, at, i, price, *seeds in sorted(rows, key=lambda r: (r[2], r[3])):
        old, high, low = held.get(ticker) or map(known, seeds)
        p = known(price)
        if p is not None:
            high = p if p > 0 and (high is None or p > high) else high
            low = p if low is None or p < low else low
        held[ticker] = p, high, low
        want[ticker, at, i, p, old, p != old, high, low, False] += 1
    assert Counter((r.ticker, r.micros, r.event_id, known(r.price), known(r.old_price), r.changed, known(r.high_52), known(r.low_52), r.late)
                   for r in out) == want


def _ticks(spark, folder, rows):
    schema = "event_id long, ticker string, price decimal(10,2), ts timestamp_ntz"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stock_is_computed_once_for_all_micro_batches(spark, tmp_path):
    """Also: late and unlisted ticks, ticks without a ticker, ids beyond 2^53 beside none."""
    from decimal import Decimal
    day, folder, made = dt.datetime(2024, 1, 1), str(tmp_path / "in"), spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            made.add(len(f))
            yield f

    stock = spark.createDataFrame([("A", Decimal(5), Decimal(9), None), ("B", None, None, Decimal(4)), ("C", Decimal(1), None, None)],
                                  "ticker string, price decimal(10,2), high_52 decimal(10,2), low_52 decimal(10,2)").mapInPandas(
        counted, "ticker string, price decimal(10,2), high_52 decimal(10,2), low_52 decimal(10,2)")
    big = 2**60 + 1
    for hours in ((0, 1, 2), (50, 51), (200, 1)):  # a file each; hour 1 comes again when it is late
        rows = [(big + 10 * h + i, t, Decimal(p), day + dt.timedelta(hours=h)) for h in hours
                for i, (t, p) in enumerate((("A", 5 + h), ("B", 7), (None, 1), ("X", 2)))]
        ticks = _ticks(spark, folder, [*rows, (None, "A", None, day + dt.timedelta(hours=hours[0]))])
    sink = ordered.SplitSink(spark, str(tmp_path / "out"))
    with ordered.Kept() as keep:
        steps = ordered.price_steps(ticks, stock, "2 hours", keep)
        ordered.drain(lambda: steps, sink, str(tmp_path / "ck"))
    assert made.value == 3
    got = Counter((r.ticker, r.event_id and r.event_id - big, r.old_price, r.price, r.changed, r.high_52, r.low_52) for r in sink.steps().collect())
    on_a = [(None, 5, None, True, 9, None), (0, None, 5, True, 9, 5), (10, 5, 6, True, 9, 5), (20, 6, 7, True, 9, 5),
            (None, 7, None, True, 9, 5), (500, None, 55, True, 55, 5), (510, 55, 56, True, 56, 5)]
    on_b = [(0, None, 7, True, 7, 4), *[(i, 7, 7, False, 7, 4) for i in (10, 20, 500, 510)]]
    nowhere = [(2, None, 1, True, 1, 1), *[(i + 2, 1, 1, False, 1, 1) for i in (10, 20, 500, 510)]]
    want = [("A", *r) for r in on_a] + [("B", i + 1, *r) for i, *r in on_b] + [(None, *r) for r in nowhere]
    assert got == Counter(want)
    late = Counter((r.ticker, r.event_id - big, r.old_price, r.changed, r.high_52) for r in sink.late().collect())
    assert late == Counter([("A", 10, None, None, None), ("B", 11, None, None, None), (None, 12, None, None, None)])
    assert sink.steps().where("ts IS NULL").count() == 0


def test_many_users_share_a_buckets_calls():
    """Orders of 500 users: some calls a slot, not some a user; cash and shares are carried from fold to fold."""
    rng, none = random.Random(6), ordered.NONE
    columns = ["slot", "owner", "micros", "order_id", "ticker", "type", "quantity", "price_cents", "status", "cash", "shares", "avg"]
    cash = [none if u % 9 == 0 else 500 * u for u in range(500)]
    rows = []
    for n in range(6000):
        u, t = rng.randrange(500), rng.randrange(3)
        status = "invalid_type" if n % 13 == 0 else "unknown_stock" if n % 17 == 0 else None
        rows.append((u % ordered.SLOTS, str(u), 1_000_000 + n // 2, n, None if n % 17 == 0 else f"T{t}", rng.choice(["BUY", "SELL"]),
                     rng.randint(1, 9), rng.randint(1, 5000), status, cash[u], *((u % 7, 100) if u % 3 == t and n % 17 else (none, none))))
    out, calls = _folded(ordered.Orders(), rows, columns, [1001, 5000])
    assert len(out) == len(rows) and calls <= 2 * (2 * ordered.SLOTS + 12)
    wallets, want = {}, {}
    for _, owner, _, i, ticker, kind, q, p, status, *_ in sorted(rows, key=lambda r: (r[2], r[3])):
        u = int(owner)
        if u not in wallets:
            wallets[u] = positions.Wallet()
            wallets[u].cash, wallets[u].held = None if cash[u] == none else cash[u], {f"T{u % 3}": (u % 7, 100)}
        w = wallets[u]
        before = w.held.get(ticker, (0, 0))[1]
        want[i] = status or w.apply(kind, ticker, q, p), none if w.cash is None else w.cash, w.held.get(ticker, (0, 0))[0], before
    assert {r.order_id: (r.outcome, r.cash_after_cents, r.shares_after, r.avg_cents_before) for r in out} == want
    assert len({o for o, *_ in want.values()}) == 6


def test_order_steps_equal_their_twin_where_users_are_missing(spark, tmp_path):
    """Orders, accounts and positions may lack a user; users beyond 2^53 stay apart; an account may come twice."""
    rng, folder = random.Random(8), str(tmp_path / "in")
    users = [1, 2, 3, None]
    far = lambda df: df.withColumns({c: F.col(c) + F.lit(2**60) for c in ("user_id", "order_id") if c in df.columns})
    rows = [(n, rng.choice([*users, 4]), rng.choice([" a", "B", "C", "X", None]), rng.choice(["buy", "BUY", "SELL", "HOLD"]),
             rng.choice([0, 1, 2, 5, None]), rng.choice([3, 7, None]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(500)))
            for n in range(400)]
    money = F.col("price").cast("decimal(10,2)")
    schema = "order_id long, user_id long, ticker string, type string, quantity int, price int, ts timestamp_ntz"
    orders = spark.createDataFrame(rows, schema).withColumn("price", money)
    far(orders).repartition(3).write.parquet(folder)
    accounts = spark.createDataFrame([(u, 40) for u in [*users, 3]], "user_id long, price int").select("user_id", money.alias("balance"))
    held = spark.createDataFrame([(u, t, 3, 2) for u in users for t in "AB"], "user_id long, stock_ticker string, quantity long, price int") \
        .withColumn("avg_price", money).drop("price")
    stock = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    beats, sink = str(tmp_path / "beats"), ordered.SplitSink(spark, str(tmp_path / "out"))
    ordered.ensure_folder(spark, beats)
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream = stream.unionByName(spark.readStream.schema("ts timestamp_ntz").parquet(beats), allowMissingColumns=True)
    with ordered.Kept() as keep:
        steps = ordered.order_steps(stream, far(accounts), far(held), stock, "1 day", keep)
        ordered.drain(lambda: steps, sink, str(tmp_path / "ck"))
        ordered.beat(spark, beats, END)
        ordered.drain(lambda: steps, sink, str(tmp_path / "ck"))
    assert sink.late().count() == 0
    _same(far(positions.process_orders(orders, accounts, held, stock)), sink.steps())
