"""Tables with committed versions: several tables under one folder, changed together.

Layout::

    data/<commit>/<table>/...         files of one commit, never changed
    versions/00000000000012.json      what version 12 consists of

A version names the data folders of every table. A commit first writes its
data folders with Spark, then publishes the next version's file: the file is
written under another name and renamed, and a rename onto an existing file
fails. So a version is there whole or not at all, readers keep the version
they opened, a crash between the steps leaves only unreferenced folders, and
of two writers of one version one starts again on the other's result.

A table may be split into key buckets. Upserts and deletes then read and
rewrite only the buckets that hold changed keys; the other buckets' folders
are carried over into the next version.

``done`` remembers the last micro-batch of a stream in the same version file,
so a replayed micro-batch is recognised and applied once.

Publishing uses Hadoop's ``FileContext`` for the folder's own file system,
which needs a classic session (no Spark Connect) and a store whose rename
refuses to overwrite (HDFS, local disks).
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.sources.tables import upsert

#: The column that bucketed tables are written by.
BUCKET = "_bucket"
ATTEMPTS = 10


class CommitConflict(RuntimeError):
    """Other writers published first, every time."""


class _Folder:
    """Files of a folder on the store that its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @functools.cached_property
    def files(self):
        return self._at("").getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self.files.listStatus(at)] if self.files.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.files.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Create the file with all of its content, or return False if it is there already."""
        draft = self._at(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self.files.create(draft, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        how[0] = rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf)
        try:
            context.rename(self.files.makeQualified(draft), self.files.makeQualified(self._at(name)), how)
            return True
        except Py4JJavaError as e:
            self.files.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise

    def delete(self, name: str) -> None:
        self.files.delete(self._at(name), True)


def bucket_of(keys: Sequence[str], n: int, schema: T.StructType):
    """The bucket of a row by its keys, which are compared as ``schema`` types them."""
    return F.pmod(F.xxhash64(*[F.col(k).cast(schema[k].dataType) for k in keys]), F.lit(n)).cast("int")


class Versions:
    """The tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), _Folder(spark, path)

    # -- reading -------------------------------------------------------------------

    def versions(self) -> list[int]:
        """The committed versions, in order."""
        return sorted(int(n[:-5]) for n in self.folder.names("versions") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version (default: the latest) consists of; before the first commit: nothing."""
        known = self.versions() if version is None else [version]
        if not known:
            return {"version": 0, "tables": {}, "done": {}}
        return json.loads(self.folder.text(f"versions/{known[-1]:014d}.json"))

    def done(self, stream: str) -> int:
        """The last micro-batch of the stream that was committed; -1: none."""
        return self.manifest()["done"].get(stream, -1)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table as of a version: later commits don't change what is read."""
        return self._rows(self.manifest(version)["tables"][name])

    def _rows(self, table: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        parts = [f"{self.path}/{p['folder']}" for p in table["parts"] if buckets is None or p["bucket"] in buckets]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    # -- writing -------------------------------------------------------------------

    def _update(self, change: Callable[[dict, str], dict | None], done: tuple[str, int] | None = None,
                rows: Sequence[DataFrame] = ()) -> int:
        """Publish what ``change(manifest, folder for its data)`` returns as
        the next version, starting again on newer versions; None: nothing to
        do. The ``rows`` of a micro-batch that is ``done`` already are computed
        all the same, because a stateful stream commits its state that way."""
        for _ in range(ATTEMPTS):
            base = self.manifest()
            if done and base["done"].get(done[0], -1) >= done[1]:
                for df in rows:
                    df.write.format("noop").mode("overwrite").save()
                return base["version"]
            tables = change(base, f"data/{base['version'] + 1:014d}-{uuid.uuid4().hex}")
            if tables is None:
                return base["version"]
            new = {"version": base["version"] + 1, "tables": {**base["tables"], **tables},
                   "done": {**base["done"], **({done[0]: done[1]} if done else {})}}
            if self.folder.publish(f"versions/{new['version']:014d}.json", json.dumps(new)):
                return new["version"]
        raise CommitConflict(f"{self.path}: {ATTEMPTS} other versions came first")

    def _write(self, df: DataFrame, folder: str, keys: Sequence[str], buckets: int, **about) -> list[dict]:
        """Write rows to a data folder; its parts."""
        if not keys:
            df.write.parquet(f"{self.path}/{folder}")
            return [{"folder": folder, "bucket": None, **about}]
        rows = df.withColumn(BUCKET, bucket_of(keys, buckets, df.schema))
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        found = [n for n in self.folder.names(folder) if n.startswith(f"{BUCKET}=")]
        return [{"folder": f"{folder}/{n}", "bucket": int(n.split("=")[1]), **about} for n in sorted(found)]

    @staticmethod
    def _table(df: DataFrame, parts: list[dict], keys: Sequence[str] = (), buckets: int = 1) -> dict:
        return {"schema": df.schema.jsonValue(), "keys": list(keys), "buckets": buckets, "parts": parts}

    def replace(self, tables: dict[str, DataFrame], keys: dict[str, Sequence[str]] | None = None, buckets: int = 1,
                done: tuple[str, int] | None = None) -> int:
        """New contents for all the tables named, in one commit. A table with
        ``keys`` is split into ``buckets`` by them; one that was stays so."""
        def change(base, folder):
            out = {}
            for name, df in tables.items():
                old = base["tables"].get(name) or self._table(df, [])
                names = [f["name"] for f in old["schema"]["fields"]]
                if sorted(names) == sorted(df.columns):  # a table keeps the order of its columns
                    df = df.select(*names)
                by, n = ((keys[name], buckets) if keys and name in keys else (old["keys"], old["buckets"]))
                out[name] = self._table(df, self._write(df, f"{folder}/{name}", by, n), by, n)
            return out
        return self._update(change, done, list(tables.values()))

    def append(self, tables: dict[str, DataFrame], done: tuple[str, int] | None = None) -> int:
        """Rows added to all the tables named, in one commit."""
        def change(base, folder):
            out = {}
            for name, df in tables.items():
                old = base["tables"].get(name) or self._table(df, [])
                df = df.select([F.col(f["name"]) for f in old["schema"]["fields"]])
                out[name] = {**old, "parts": old["parts"] + self._write(df, f"{folder}/{name}", old["keys"], old["buckets"])}
            return out
        return self._update(change, done, list(tables.values()))

    def rewrite(self, name: str, changes: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame],
                append: dict[str, Callable[[DataFrame], DataFrame]] | None = None, done: tuple[str, int] | None = None) -> int:
        """Rewrite the buckets that hold keys of ``changes`` as ``merged(their
        rows, changes)``. ``append`` names tables that get, in the same
        commit, the rows which a function makes of the old rows of these buckets."""
        held = changes.persist()

        def change(base, folder):
            table = base["tables"][name]
            keys, n = table["keys"], table["buckets"]
            if not keys:
                raise ValueError(f"{name} has no keys")
            schema = T.StructType.fromJson(table["schema"])
            touched = {r[0] for r in held.select(bucket_of(keys, n, schema)).distinct().collect()}  # at most ``buckets``
            if not touched and not done:
                return None
            old = self._rows(table, touched)
            rows = merged(old, held).select(*schema.names)
            stay = [p for p in table["parts"] if p["bucket"] not in touched]
            out = {name: {**table, "parts": stay + (self._write(rows, f"{folder}/{name}", keys, n) if touched else [])}}
            for other, made in (append or {}).items():
                to = base["tables"][other]
                more = made(old).select([F.col(f["name"]) for f in to["schema"]["fields"]])
                out[other] = {**to, "parts": to["parts"] + (self._write(more, f"{folder}/{other}", to["keys"], to["buckets"]) if touched else [])}
            return out

        try:
            return self._update(change, done, [held] if done else [])
        finally:
            held.unpersist()

    def upsert(self, name: str, changes: DataFrame, update_cols: Sequence[str] | None = None,
               order_col: str | None = None) -> int:
        """S6 by bucket: see :func:`ledgerline.sources.tables.upsert`."""
        def merged(rows, held):
            return upsert(rows, held, self.manifest()["tables"][name]["keys"], update_cols, order_col)
        return self.rewrite(name, changes, merged)

    def delete(self, name: str, keys_df: DataFrame) -> int:
        """S10 by bucket: rows whose keys are listed go."""
        def merged(rows, held):
            keys = self.manifest()["tables"][name]["keys"]
            return rows.join(held.select(*keys).distinct(), keys, "left_anti")
        return self.rewrite(name, keys_df, merged)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete data folders that none of the last ``keep`` versions uses and
        that no commit under way can use; the versions that named them go too."""
        known = self.versions()
        kept = known[-keep:]
        used = {p["folder"].split("/")[1] for v in kept for t in self.manifest(v)["tables"].values() for p in t["parts"]}
        # a folder is named after the version it was written for, so newer ones may still be published
        gone = [n for n in self.folder.names("data") if n not in used and kept and int(n[:14]) <= kept[-1]]
        for v in known[:-keep]:
            self.folder.delete(f"versions/{v:014d}.json")
        for n in gone:
            self.folder.delete(f"data/{n}")
        return gone


class ChangeLog:
    """The latest row of every key, from batches of changed rows.

    A log-structured merge: a batch becomes a run of level 0; ``fan`` runs of
    one level are merged into one of the next, which keeps each key's last
    row. So at most ``fan - 1`` runs a level are read, the largest of them
    about as long as there are keys, however many batches came. A batch, the
    merges it causes and its number are one commit of :class:`Versions`, so a
    reader sees them all or none, and a batch that comes again does nothing.
    """

    TABLE, STREAM, BATCH = "changes", "changes", "_batch"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], fan: int = 8):
        self.spark, self.schema, self.keys, self.fan = spark, schema, list(keys), fan
        self.versions = Versions(spark, path)

    def _last(self, rows: DataFrame) -> DataFrame:
        values = [F.col(c) for c in rows.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), F.col(self.BATCH)).alias("_r"))
        return last.select(*self.keys, *[F.col(f"_r.{v}").alias(v) for v in rows.columns if v not in self.keys])

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Take in a batch: one row for each key that changed."""
        def change(base, folder):
            rows = batch.select(*self.schema.names).withColumn(self.BATCH, F.lit(batch_id).cast("long"))
            table = base["tables"].get(self.TABLE) or Versions._table(rows, [])
            runs = table["parts"] + self.versions._write(rows, f"{folder}/0", (), 1, level=0)
            level = 0
            while sum(r["level"] == level for r in runs) >= self.fan:
                merged = self._last(self.versions._rows({**table, "parts": [r for r in runs if r["level"] == level]}))
                runs = ([r for r in runs if r["level"] != level]
                        + self.versions._write(merged, f"{folder}/{level + 1}", (), 1, level=level + 1))
                level += 1
            return {self.TABLE: {**table, "parts": runs}}
        self.versions._update(change, (self.STREAM, batch_id), [batch])

    def runs(self) -> int:
        """How many runs a reader merges."""
        return len(self.versions.manifest()["tables"].get(self.TABLE, {"parts": []})["parts"])

    def latest(self) -> DataFrame:
        """The last row of every key; none while nothing was written."""
        table = self.versions.manifest()["tables"].get(self.TABLE)
        if table is None:
            return self.spark.createDataFrame([], self.schema)
        return self._last(self.versions._rows(table)).select(*self.schema.names)
