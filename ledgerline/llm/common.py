"""Helpers shared by the corpus operators.

A *word* is a maximal run of characters other than space and U+0009..U+000D;
on UTF-8 bytes that is exactly what ``bytes.split()`` without arguments cuts.

Rows without an id: operators that compare ids order a null id after all
others (``NO_ID``) and give it back as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import apply_required_conf, ensure_checkpoint_dir, ship_package

NO_ID = (1 << 63) - 1

#: Odd multipliers that mix 64-bit hashes (splitmix64's constants).
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)


def prepare(spark: SparkSession) -> None:
    """What every job needs: settings, the shared folder, the package on the workers."""
    apply_required_conf(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def id_key(column: Column) -> Column:
    """A non-null long that orders like the id, null last."""
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def id_value(column: Column) -> Column:
    """The id back from :func:`id_key`."""
    return F.when(column != NO_ID, column)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text of an Arrow column; a null is the empty text."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads a 64-bit value over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * MIX_C
    return x ^ (x >> np.uint64(31))


def slices_of(batch: pa.RecordBatch, column: str, max_bytes: int):
    """Cut a batch into runs of rows whose texts hold about ``max_bytes``, so
    that what is built from them in a worker stays bounded whatever the batch
    size; a single longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def corpus_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes in the whole text column: what shard and block counts derive from."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


def unused_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
