"""Stateful streams that judge a key's rows in event-time order.

Files may arrive in any order. A row waits in its key's list state until the
watermark has passed it, so that no earlier row can still come on time; an
event-time timer then folds all waiting rows up to the watermark, ordered by
time and id, into the key's state. What comes out doesn't depend on how rows
were dealt into files and micro-batches.

A row at or before the watermark on arrival comes out at once, marked
``late``, and changes nothing. So every row comes out exactly once, on time or
late; :class:`SplitSink` keeps the two apart as tables that each micro-batch
changes in one commit.

The watermark follows the newest row seen, ``delay`` behind. Rows within the
delay of a stream's end wait for more; :func:`close_until` ends a period by a
heartbeat, a row that only carries a time.

A handler holds a micro-batch's rows one Arrow batch at a time; a fold holds
the rows that one key, or one bucket of keys (:class:`InBuckets`), got within
one delay.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

import ledgerline
from ledgerline.functions.exprs import as_double
from ledgerline.operators.positions import Wallet, order_rows, trade_step
from ledgerline.session import scratch_path
from ledgerline.sources.versions import Versions

#: The event type of a heartbeat.
HEARTBEAT = "heartbeat"
#: Added by :func:`timed`: the event time, in microseconds.
MICROS = "micros"
#: The only state store that keeps several states for one processor.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _plain(x):
    """None for a null, which pandas may hand over as NaN or NaT."""
    return None if x is None or x != x else x


def _whole(x):
    return None if x is None or x != x else int(x)


class InTimeOrder(StatefulProcessor):
    """Folds each key's rows in the order of time and id.

    ``row``: the input's columns that wait, with their types; the first is the
    microsecond, the second the id that orders rows of one time. A subclass
    names ``output`` and says how state is loaded, a row applied and state
    stored. Rows come out as ``key, row, *applied, late``."""

    row: Sequence[tuple[str, str]] = ()
    output: Sequence[str] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} {t}" for n, t in self.row))
        self.timer = handle.getValueState("timer", "at long")
        self.open()

    def open(self) -> None:
        """Register the subclass's state."""

    def load(self):
        """The state as a Python value that :meth:`apply` changes."""
        raise NotImplementedError

    def apply(self, key, state, row: tuple) -> tuple:
        """Apply one row to the state; the row's further output columns."""
        raise NotImplementedError

    def store(self, state) -> None:
        raise NotImplementedError

    def beats(self, key, row: tuple) -> bool:
        """Whether a row is a heartbeat: it has neither key nor id."""
        return row[1] is None and all(_plain(k) is None for k in key)

    def _frame(self, key, rows: list[tuple], applied: list[tuple], late: bool) -> pd.DataFrame:
        out = [(*key, *r, *a, late) for r, a in zip(rows, applied)]
        return pd.DataFrame(out, columns=list(self.output), dtype=object)

    def _wake(self, micros: int) -> None:
        """Have the timer fire once the watermark passes this time, if it would fire later."""
        at = -(-micros // 1000)
        before = self.timer.get()
        if before is None or at < before[0]:
            if before is not None:
                self.handle.deleteTimer(before[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for pdf in rows:
            # a column with nulls comes as floats
            found = list(zip(*([(_whole if t == "long" else _plain)(v) for v in pdf[n].tolist()] for n, t in self.row)))
            found = [r for r in found if not self.beats(key, r)]
            # a row without a time can't be put in order: it is late at once
            late = [r for r in found if r[0] is None or r[0] <= passed]
            on_time = [r for r in found if r[0] is not None and r[0] > passed]
            if on_time:
                self.waiting.appendList(on_time)
                self._wake(min(r[0] for r in on_time))
            if late:
                nothing = (None,) * (len(self.output) - len(key) - len(self.row) - 1)
                yield self._frame(key, late, [nothing] * len(late), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in rows if r[0] <= passed), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        rest = [r for r in rows if r[0] > passed]
        self.timer.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(min(r[0] for r in rest))
        else:
            self.waiting.clear()
        if due:
            state = self.load()
            applied = [self.apply(key, state, r) for r in due]
            self.store(state)
            yield self._frame(key, due, applied, False)

    def close(self) -> None:
        pass


def timed(stream: DataFrame, delay: str, time_col: str = "ts") -> DataFrame:
    """The stream under a watermark, its time as ``MICROS`` instead.

    The state operator sees no event-time column, so Spark doesn't drop late
    rows before they can be set apart."""
    at = stream.withColumn("_event_time", F.col(time_col).cast("timestamp")).withWatermark("_event_time", delay)
    return at.withColumn(MICROS, F.unix_micros("_event_time")).drop("_event_time", time_col)


def _schema(columns: Sequence[tuple[str, str]]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in columns))


def _run(stream: DataFrame, keys: Sequence[str], processor: InTimeOrder, columns: Sequence[tuple[str, str]]) -> DataFrame:
    # Spark opens the processor's states in a Python worker of the driver, which
    # knows no shipped Python files: the processor takes its code along
    cloudpickle.register_pickle_by_value(ledgerline)
    try:
        steps = stream.groupBy(*keys).transformWithStateInPandas(processor, _schema(columns), "append", "eventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(ledgerline)
    return steps


def _at(steps: DataFrame) -> DataFrame:
    return steps.withColumn("ts", F.timestamp_micros(MICROS).cast("timestamp_ntz")).drop(MICROS)


# -- T1 / T2: positions -------------------------------------------------------------


class Positions(InTimeOrder):
    """A user's positions by ticker: shares, average cost in cents, trades seen.

    The key is the user alone: most positions have few trades, and what a key
    costs (its calls to the state server, its frames) would be paid for each.
    It is the id as text, empty for none: a long column with a null among a
    batch's rows comes as floats, which the state server takes for nulls."""

    def __init__(self, id_type: str):
        self.row = ((MICROS, "long"), ("transaction_id", id_type), ("stock_ticker", "string"), ("type", "string"),
                    ("quantity", "long"), ("price_cents", "long"))
        self.columns = (("owner", "string"), *self.row, ("step", "long"), ("status", "string"),
                        ("qty_after", "long"), ("avg_cents_after", "long"), ("realized_cents", "long"), ("late", "boolean"))
        self.output = [n for n, _ in self.columns]

    def open(self):
        self.held = self.handle.getMapState("held", "slot string", "qty long, avg long, seq long")

    def load(self):
        return _Held(self.held)

    def apply(self, key, state, row):
        _, _, ticker, kind, q, p = row
        slot = "" if ticker is None else f"={ticker}"  # no ticker is a position of its own
        qty, avg, seq = state.get(slot, (0, 0, 0))
        qty, avg, status, realized = trade_step(qty, avg, kind, q, p)
        state[slot] = qty, avg, seq + 1
        return seq + 1, status, qty, avg, realized

    def store(self, state):
        state.save()

    def beats(self, key, row):
        return row[1] is None and row[2] is None and not key[0]


def position_steps(trades: DataFrame, delay: str) -> DataFrame:
    """Every trade of the stream ``trades`` with its position after it, and ``late``.

    The on-time rows are those of the batch twin
    :func:`ledgerline.operators.positions.ledger_steps` over the on-time trades."""
    t = trades.where((F.col("type").isin("BUY", "SELL") & (F.col("quantity") > 0)) | F.col("transaction_id").isNull())
    t = timed(t, delay).select("transaction_id", "user_id", "stock_ticker", "type", MICROS,
                               F.col("quantity").cast("bigint").alias("quantity"),
                               (F.col("price") * 100).cast("bigint").alias("price_cents"))
    processor = Positions(t.schema["transaction_id"].dataType.simpleString())
    t = t.withColumn("owner", F.coalesce(F.col("user_id").cast("string"), F.lit("")))
    steps = _at(_run(t, ["owner"], processor, processor.columns))
    return steps.select(F.expr("nullif(owner, '')").cast("bigint").alias("user_id"), "stock_ticker", "transaction_id", "type", "quantity", "price_cents", "step", "status",
                        "qty_after", "avg_cents_after", "realized_cents", "late", "ts")


class _Held(dict):
    """Positions read from the map state as they are asked for; only those are written back."""

    def __init__(self, state):
        super().__init__()
        self.state, self.changed = state, set()

    def get(self, ticker, default=None):
        if ticker is None:
            return default
        if ticker not in self:
            super().__setitem__(ticker, tuple(self.state.getValue((ticker,))) if self.state.containsKey((ticker,)) else default)
        return self[ticker]

    def __setitem__(self, ticker, value):
        super().__setitem__(ticker, value)
        self.changed.add(ticker)

    def save(self):
        for ticker in self.changed:
            self.state.updateValue((ticker,), self[ticker])


# -- many keys to a bucket ---------------------------------------------------------------

#: Stands for a missing long: a long column with a null among a batch's rows comes as floats.
NONE = -2**63
#: Buckets of keys, each of so many slots. State written with other numbers can't be resumed.
BUCKETS, SLOTS = 2048, 16
PIECE = 10_000


class InBuckets(InTimeOrder):
    """Folds the rows of many keys at once: what a key costs (its calls to the
    state server, its frames) is paid for a bucket of them.

    The first of ``row`` is the key as text, the second the microsecond, the
    third the id; longs are :data:`NONE` and doubles NaN where they are missing. Rows
    wait as columns, in pieces of at most :data:`PIECE` rows. Keys are kept by slot,
    so that a fold reads and writes the slots of its rows' keys only. A subclass
    folds a bucket's rows in :meth:`fold`. Rows come out as ``row`` without
    ``unseen`` columns, ``added`` and ``late``."""

    unseen: Sequence[str] = ()
    added: Sequence[tuple[str, str]] = ()

    def __init__(self):
        self.names = [n for n, _ in self.row]
        self.shown = [(n, t) for n, t in self.row if n not in self.unseen]

    @property
    def columns(self):
        return (*self.shown, *self.added, ("late", "boolean"))

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "piece int", "rows binary")
        self.pieces = handle.getValueState("pieces", "n int")
        self.timer = handle.getValueState("timer", "at long")
        self.kept = handle.getMapState("kept", "slot int", "keys binary")

    def fold(self, rows: dict[str, np.ndarray], kept: dict[int, dict]) -> dict[str, Sequence]:
        """Apply the rows, in time order, to what is kept of their keys by slot; the ``added`` columns."""
        raise NotImplementedError

    def beats_in(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        """Which rows are heartbeats: they have neither key nor id."""
        return (rows[self.names[2]] == NONE) & pd.isna(rows[self.names[0]])

    def _out(self, rows: dict[str, np.ndarray], added: dict[str, Sequence], late: bool) -> pd.DataFrame:
        return pd.DataFrame({**{n: rows[n] for n, _ in self.shown}, **added, "late": late})

    @staticmethod
    def _pick(rows: dict[str, np.ndarray], which: np.ndarray | slice) -> dict[str, np.ndarray]:
        return {n: v[which] for n, v in rows.items()}

    @staticmethod
    def _array(column: pd.Series, kind: str) -> np.ndarray:
        if kind in ("int", "long", "double"):
            return column.to_numpy(dtype="float64" if kind == "double" else "int64")
        return column.astype(object).where(column.notna(), None).to_numpy()

    def _wait(self, rows: dict[str, np.ndarray], after: int) -> None:
        """Have rows wait, as the pieces that follow the first so many."""
        for start in range(0, len(rows[MICROS]), PIECE):
            self.waiting.updateValue((after,), (pickle.dumps(self._pick(rows, slice(start, start + PIECE)), protocol=5),))
            after += 1
        self.pieces.update((after,))
        self._wake(int(rows[MICROS].min()))

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for pdf in rows:
            found = {n: self._array(pdf[n], t) for n, t in (("slot", "int"), *self.row)}
            late = found[MICROS] <= passed  # a row without a time can't be put in order: it is late at once
            beats = self.beats_in(found)
            on_time = ~(late | beats)
            if on_time.any():
                self._wait(self._pick(found, on_time), (self.pieces.get() or (0,))[0])
            late &= ~beats
            if late.any():
                nothing = {n: NONE if t == "long" else None for n, t in self.added}
                yield self._out(self._pick(found, late), nothing, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        pieces = [pickle.loads(self.waiting.getValue((i,))[0]) for i in range(self.pieces.get()[0])]
        rows = {n: np.concatenate([p[n] for p in pieces]) for n in ("slot", *self.names)}
        due = rows[MICROS] <= passed
        for state in (self.timer, self.waiting, self.pieces):
            state.clear()
        if not due.all():
            self._wait(self._pick(rows, ~due), 0)
        if due.any():
            rows = self._pick(rows, due)
            rows = self._pick(rows, np.lexsort((rows[self.names[2]], rows[MICROS])))
            kept = {s: self._load(s) for s in np.unique(rows["slot"]).tolist()}
            added = self.fold(rows, kept)
            for s, keys in kept.items():
                self.kept.updateValue((s,), (pickle.dumps(keys, protocol=5),))
            yield self._out(rows, added, False)

    def _load(self, slot: int) -> dict:
        found = self.kept.getValue((slot,))
        return pickle.loads(found[0]) if found else {}


def _run_in_buckets(stream: DataFrame, processor: InBuckets) -> DataFrame:
    at = F.pmod(F.xxhash64(processor.names[0]), F.lit(BUCKETS * SLOTS))
    rows = stream.select(F.floor(at / SLOTS).cast("int").alias("bucket"), (at % SLOTS).cast("int").alias("slot"),
                         *[F.coalesce(n, F.lit(NONE)).alias(n) if t == "long" else F.col(n) for n, t in processor.row])
    steps = _run(rows, ["bucket"], processor, processor.columns)
    return _at(steps.select(*[F.nullif(n, F.lit(NONE)).alias(n) if t == "long" else F.col(n) for n, t in processor.columns]))


def _dealt(table: DataFrame, *keys: str) -> DataFrame:
    """A static table dealt and sorted as a stream's join on the keys needs it."""
    return table.repartition(_partitions(table.sparkSession), *keys).sortWithinPartitions(*keys)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Kept:
    """Keeps the static tables that a stream joins, while it is drained: they
    are computed once, not once a micro-batch."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, table: DataFrame) -> DataFrame:
        self.tables.append(table.persist())
        table.count()  # a stream's plan sees how a table is dealt once it is there
        return table

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for t in self.tables:
            t.unpersist()


def _as_is(table: DataFrame) -> DataFrame:
    return table


# -- T1 with cash --------------------------------------------------------------------


class Orders(InBuckets):
    """Users: cash, and every position that an order named, by ticker.

    An order brings what its user had before the stream's first order: cash,
    and shares and average cost of its ticker. The first order of a user, or
    of a position, begins with them."""

    row = (("owner", "string"), (MICROS, "long"), ("order_id", "long"), ("ticker", "string"), ("type", "string"),
           ("quantity", "long"), ("price_cents", "long"), ("status", "string"), ("cash", "long"), ("shares", "long"),
           ("avg", "long"))
    unseen = ("cash", "shares", "avg")
    added = (("outcome", "string"), ("cash_after_cents", "long"), ("shares_after", "long"), ("avg_cents_before", "long"))

    def beats_in(self, rows):
        return (rows["order_id"] == NONE) & (rows["owner"] == "")

    def fold(self, rows, kept):
        out = []
        columns = ("slot", "owner", "ticker", "type", "quantity", "price_cents", "status", *self.unseen)
        for slot, owner, ticker, kind, q, p, status, cash, shares, avg in zip(*(rows[n].tolist() for n in columns)):
            users = kept[slot]
            wallet = Wallet()
            if owner in users:
                wallet.cash, wallet.held = users[owner]
            else:
                wallet.cash = None if cash == NONE else cash
            if ticker is not None and ticker not in wallet.held:
                wallet.held[ticker] = (0, 0) if shares == NONE else (shares, avg)
            before = wallet.held.get(ticker, (0, 0))[1]
            outcome = status or wallet.apply(kind, ticker, q, p)
            users[owner] = wallet.cash, wallet.held
            out.append((outcome, NONE if wallet.cash is None else wallet.cash, wallet.held.get(ticker, (0, 0))[0], before))
        return dict(zip((n for n, _ in self.added), zip(*out)))


def order_steps(orders: DataFrame, users: DataFrame, portfolio: DataFrame, stock: DataFrame, delay: str,
                keep: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """T1 with cash: every order of the stream judged by the cash and shares
    that the user's earlier orders left, and ``late``. ``users`` and
    ``portfolio`` are the state before the stream's first order; the batch
    twin is :func:`ledgerline.operators.positions.process_orders`. ``keep``:
    see :class:`Kept`."""
    listed = keep(_dealt(stock.select("ticker"), "ticker"))
    rows, opening = order_rows(timed(orders, delay, "ts").withColumnRenamed(MICROS, "ts"), users, portfolio, listed)
    owner = F.coalesce(F.col("user_id").cast("string"), F.lit(""))  # nobody is an owner, too
    opening = opening.withColumn("owner", owner)
    # of an account or a position that comes twice the last counts, as when they are put into a wallet one by one
    cash = opening.where(F.col("type") == "CASH").groupBy("owner").agg(F.last("price_cents").alias("cash"))
    held = opening.where((F.col("type") == "OPEN") & F.col("ticker").isNotNull())
    held = held.repartition(_partitions(held.sparkSession), "owner", "ticker")
    held = held.groupBy("owner", "ticker").agg(F.last("quantity").alias("shares"), F.last("price_cents").alias("avg"))
    rows = rows.withColumnRenamed("ts", MICROS).withColumn("owner", owner)
    rows = rows.join(keep(held.sortWithinPartitions("owner", "ticker")), ["owner", "ticker"], "left")
    rows = rows.join(keep(_dealt(cash, "owner")), "owner", "left")
    steps = _run_in_buckets(rows, Orders())
    return steps.withColumn("status", F.coalesce("outcome", "status")).drop("outcome") \
                .select(F.nullif("owner", F.lit("")).cast("bigint").alias("user_id"), "*").drop("owner")


# -- T3 / T4: price audit and running high / low ---------------------------------------


class Prices(InBuckets):
    """Tickers: last price, high and low. The first tick ever compares with the stored price."""

    row = (("ticker", "string"), (MICROS, "long"), ("event_id", "long"), ("price", "double"), ("seed", "double"),
           ("seed_high", "double"), ("seed_low", "double"))
    unseen = ("seed", "seed_high", "seed_low")
    added = (("old_price", "double"), ("changed", "boolean"), ("high_52", "double"), ("low_52", "double"))

    def fold(self, rows, kept):
        codes, tickers = pd.factorize(rows["ticker"], use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")  # ticker by ticker, each in time order
        code, price = codes[order], rows["price"][order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        slots, names = rows["slot"][order][first].tolist(), [None if pd.isna(t) else t for t in tickers.tolist()]
        seeds = zip(*(rows[n][order][first].tolist() for n in self.unseen))
        before = np.array([kept[s].get(t, seed) for s, t, seed in zip(slots, names, seeds)], dtype=float)
        old = np.r_[np.nan, price[:-1]]
        old[first] = before[:, 0]
        changed = ~((price == old) | (np.isnan(price) & np.isnan(old)))
        high, low = np.where(price > 0, price, -np.inf), np.where(np.isnan(price), np.inf, price)
        high[first] = np.fmax(high[first], before[:, 1])
        low[first] = np.fmin(low[first], before[:, 2])
        high, low = pd.Series(high).groupby(code).cummax().to_numpy(), pd.Series(low).groupby(code).cummin().to_numpy()
        high, low = np.where(high == -np.inf, np.nan, high), np.where(low == np.inf, np.nan, low)
        last = np.r_[first[1:], len(code)] - 1
        for s, t, *now in zip(slots, names, price[last].tolist(), high[last].tolist(), low[last].tolist()):
            kept[s][t] = tuple(now)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return {"old_price": old[back], "changed": changed[back], "high_52": high[back], "low_52": low[back]}


def price_steps(ticks: DataFrame, stock: DataFrame, delay: str, keep: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """Per tick of a listed ticker the previous price, whether it
    changed, the running high and low, and ``late``. ``keep``: see :class:`Kept`."""
    seeds = stock.select("ticker", as_double("price").alias("seed"), as_double("high_52").alias("seed_high"),
                         as_double("low_52").alias("seed_low"), F.lit(True).alias("_listed"))
    t = timed(ticks, delay).select("ticker", "event_id", MICROS, as_double("price").alias("price"))
    # the triggers fire on updates of stock rows, so other tickers have no steps; a heartbeat has no ticker
    t = t.join(keep(_dealt(seeds, "ticker")), "ticker", "left")
    t = t.where(F.col("_listed") | F.col("ticker").isNull()).drop("_listed")
    return _run_in_buckets(t, Prices())


# -- closing a period -------------------------------------------------------------------


def with_heartbeats(events: DataFrame, folder: str) -> DataFrame:
    """The event stream joined by the heartbeats of a folder (which must exist)."""
    beats = events.sparkSession.readStream.schema("ts timestamp_ntz").parquet(folder)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("ts", "event_type") else
             (F.col("ts") if f.name == "ts" else F.lit(HEARTBEAT).alias(f.name)) for f in events.schema.fields]
    return events.unionByName(beats.select(*empty))


def beat(spark: SparkSession, folder: str, at: dt.datetime) -> None:
    """Write a heartbeat: time has come to ``at``."""
    spark.createDataFrame([(at,)], "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(folder)


def ensure_folder(spark: SparkSession, folder: str) -> None:
    """Create a heartbeat folder without a heartbeat."""
    spark.createDataFrame([], "ts timestamp_ntz").write.mode("append").parquet(folder)


class SplitSink:
    """On-time and late rows of a stream's steps as two tables, changed
    together: a micro-batch is one commit, which also remembers its number, so
    a batch that runs again after a failure is applied once."""

    def __init__(self, spark: SparkSession, path: str, name: str = "steps"):
        self.versions, self.name = Versions(spark, path), name

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            self.versions.append({self.name: batch.where("NOT late").drop("late"), f"{self.name}_late": batch.where("late").drop("late")},
                                 done=(self.name, batch_id))
        finally:
            batch.unpersist()

    def steps(self) -> DataFrame:
        return self.versions.read(self.name)

    def late(self) -> DataFrame:
        return self.versions.read(f"{self.name}_late")


def start(steps: DataFrame, sink: SplitSink, name: str, checkpoint: str | None = None, available_now: bool = True):
    """Start a stream of steps into a sink; with ``available_now`` it ends with what has arrived."""
    place = checkpoint or scratch_path(steps.sparkSession, f"streams/{name}")
    w = steps.writeStream.outputMode("append").foreachBatch(sink.write).option("checkpointLocation", place)
    w = w.trigger(availableNow=True) if available_now else w
    with _state_store(steps.sparkSession):
        return w.start()


@contextlib.contextmanager
def _state_store(spark: SparkSession):
    """Streams started inside keep their state in :data:`STATE_STORE`, whatever the session's other streams use."""
    key, provider = STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def drain(build: Callable[[], DataFrame], sink: SplitSink, checkpoint: str) -> None:
    """Run the stream that ``build()`` gives over all that has arrived, from where the checkpoint is."""
    start(build(), sink, sink.name, checkpoint).awaitTermination()
