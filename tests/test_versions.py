"""Committed versions: readers, crashes, conflicts, buckets, compaction."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import tables
from ledgerline.sources.versions import ChangeLog, CommitConflict, Versions


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_are_snapshots(spark, scratch):
    v = Versions(spark, scratch)
    assert v.versions() == [] and v.done("s") == -1
    v.replace({"t": spark.range(3)})
    before = v.read("t")
    v.append({"t": spark.range(3, 5)})
    v.replace({"t": spark.range(7, 8)})
    assert v.versions() == [1, 2, 3]
    assert [rows(v.read("t", n)) for n in (1, 2, 3)] == [[(0,), (1,), (2,)], [(i,) for i in range(5)], [(7,)]]
    assert rows(before) == [(0,), (1,), (2,)]


@pytest.mark.parametrize("step", ["data", "publish"])
def test_a_write_that_dies_between_the_steps_leaves_the_old_version(spark, scratch, monkeypatch, step):
    v = Versions(spark, scratch)
    v.replace({"t": spark.range(3), "u": spark.range(1)})

    def dies(*args, **kwargs):
        raise KeyboardInterrupt

    if step == "publish":  # all data is written, the version is not
        monkeypatch.setattr(v.folder, "publish", dies)
        doomed = {"t": spark.range(9), "u": spark.range(9)}
    else:  # the second table's write fails half way
        doomed = {"t": spark.range(9), "u": spark.range(9).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))}
    with pytest.raises(BaseException):
        v.replace(doomed)
    monkeypatch.undo()
    again = Versions(spark, scratch)
    assert again.versions() == [1] and rows(again.read("t")) == [(0,), (1,), (2,)] and rows(again.read("u")) == [(0,)]
    again.replace({"t": spark.range(2)})
    assert rows(again.read("t")) == [(0,), (1,)] and rows(again.read("u")) == [(0,)]


def test_two_writers_of_one_version(spark, scratch, monkeypatch):
    first, second = Versions(spark, scratch), Versions(spark, scratch)
    first.replace({"t": spark.range(1)})
    stale = second.manifest()
    first.append({"t": spark.range(1, 2)})
    real, answers = second.manifest, [stale]
    monkeypatch.setattr(second, "manifest", lambda version=None: answers.pop() if answers else real(version))
    second.append({"t": spark.range(2, 3)})  # its first try finds version 2 taken
    assert rows(first.read("t")) == [(0,), (1,), (2,)] and first.versions() == [1, 2, 3]
    monkeypatch.setattr(second, "manifest", lambda version=None: stale)
    with pytest.raises(CommitConflict):
        second.append({"t": spark.range(9, 10)})


def test_upsert_rewrites_touched_buckets_only(spark, scratch):
    base = spark.range(2000).select(F.concat(F.lit("T"), "id").alias("ticker"), F.col("id").alias("price"), F.lit("n").alias("name"))
    v = Versions(spark, scratch)
    v.replace({"stock": base}, keys={"stock": ["ticker"]}, buckets=64)
    old = {p["folder"] for p in v.manifest()["tables"]["stock"]["parts"]}
    assert len(old) == 64
    changes = spark.createDataFrame([("T5", -5), ("T1999", None), ("new", 1)], "ticker string, price long")
    v.upsert("stock", changes, ["price"])
    new = {p["folder"] for p in v.manifest()["tables"]["stock"]["parts"]}
    assert 61 <= len(old & new) <= 63 and len(new) == 64
    assert rows(v.read("stock")) == rows(tables.upsert(base, changes, ["ticker"], ["price"]).select(*base.columns))
    v.delete("stock", spark.createDataFrame([("T5",), ("T6",), ("nowhere",)], "ticker string"))
    left = {r[0] for r in v.read("stock").select("ticker").collect()}
    assert len(left) == 1999 and not left & {"T5", "T6"}
    count = len(v.versions())
    v.upsert("stock", changes.limit(0), ["price"])
    assert len(v.versions()) == count


def test_keys_hash_as_the_table_types_them(spark, scratch):
    v = Versions(spark, scratch)
    v.replace({"t": spark.range(50).select("id", F.lit(0).alias("x"))}, keys={"t": ["id"]}, buckets=8)
    v.upsert("t", spark.createDataFrame([(7, 1)], "id int, x int"))
    assert sorted(r["id"] for r in v.read("t").where("x = 1").collect()) == [7] and v.read("t").count() == 50


def test_cascade_is_one_commit(spark, scratch):
    v = Versions(spark, scratch)
    v.replace({"stock": spark.createDataFrame([("A",), ("B",)], "ticker string"),
               "txn": spark.createDataFrame([(1, "A"), (2, "B")], "id long, stock_ticker string")})
    now = {n: v.read(n) for n in ("stock", "txn")}
    gone = tables.cascade_delete(now, "stock", spark.createDataFrame([("A",)], "ticker string"), [("txn", "stock_ticker")], "ticker")
    v.replace(gone)
    assert v.versions() == [1, 2] and rows(v.read("stock")) == [("B",)] and rows(v.read("txn")) == [(2, "B")]


def test_a_batch_is_applied_once(spark, scratch):
    v = Versions(spark, scratch)
    for batch in (0, 1, 1, 0, 2):
        v.append({"t": spark.range(batch, batch + 1), "late": spark.range(batch)}, done=("s", batch))
    assert rows(v.read("t")) == [(0,), (1,), (2,)] and rows(v.read("late")) == [(0,), (0,), (1,)] and v.done("s") == 2


def test_vacuum_keeps_what_is_read(spark, scratch):
    v = Versions(spark, scratch)
    for n in range(6):
        v.replace({"t": spark.range(n)})
    assert len(v.vacuum(keep=2)) == 4 and v.versions() == [5, 6]
    assert v.read("t", 5).count() == 4 and v.read("t").count() == 5


def test_change_log_stays_small(spark, scratch):
    schema = spark.createDataFrame([], "ticker string, price long").schema
    log, rng, want = ChangeLog(spark, scratch, schema, ["ticker"], fan=4), random.Random(1), {}
    assert log.latest().collect() == []
    for batch in range(70):
        changed = {f"T{rng.randrange(20)}": rng.randrange(1000) for _ in range(5)}
        want.update(changed)
        log.write(spark.createDataFrame(list(changed.items()), schema).coalesce(1), batch)
        log.write(spark.createDataFrame([("T0", -1)], schema), batch)  # the same batch again
        assert log.runs() <= 3 * 4
    assert dict(map(tuple, log.latest().collect())) == want
    table = log.versions.manifest()["tables"]["changes"]
    assert log.versions._rows(table).count() <= 20 + 3 * 3 * 20


def test_a_reader_never_sees_half_a_merge(spark, scratch, monkeypatch):
    schema = spark.createDataFrame([], "ticker string, price long").schema
    log = ChangeLog(spark, scratch, schema, ["ticker"], fan=2)
    log.write(spark.createDataFrame([("A", 1), ("B", 1)], schema), 0)
    reader = log.latest()

    def dies(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(log.versions.folder, "publish", dies)
    with pytest.raises(RuntimeError):  # its data and the merged run are written, the version is not
        log.write(spark.createDataFrame([("A", 2)], schema), 1)
    assert rows(reader) == rows(log.latest()) == [("A", 1), ("B", 1)]
    monkeypatch.undo()
    log.write(spark.createDataFrame([("A", 2)], schema), 1)
    assert rows(log.latest()) == [("A", 2), ("B", 1)] and rows(reader) == [("A", 1), ("B", 1)] and log.runs() == 1
