"""Passages repeated across documents, found by a count-min prefilter.

A *window* is ``WINDOW`` consecutive words of one document. A word is removed
if a window that covers it also starts in a document with a smaller id.

1. Every task sketches its windows; the partition sketches are merged block by
   block with saturating addition. Counted is a window's *signature*: the
   smallest hash among the half-length runs inside it. Equal windows have
   equal signatures and neighbouring windows mostly share theirs, so there are
   about a thirteenth as many signatures as windows, and a signature's count
   is never below that of any of its windows. Only "twice or more" is kept: a
   bit per cell, broadcast. Its size is bounded (``MAX_CELL_BITS``); a fuller
   sketch lets more windows pass, and loses none.
2. Windows estimated as repeated are grouped exactly by 128-bit hashes.
   Windows of one task are compared before the shuffle and of each only those
   of its smallest document go on, so a passage that a third of all documents
   share sends one entry per task, not one per document.
3. The places to remove go back to the documents.

Blocks and buckets are counted from the corpus size, so that what one task
holds of them stays the same at every size. Entries travel packed, as arrays.

Defined results: a null or empty text has no words; rows of one id are one
document in the order of ids (neither is smaller), rows without an id come
after all others; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import (MIX_A, MIX_B, MIX_C, corpus_bytes, id_key, id_value, mix, slices_of,
                                   texts_as_bytes, word_hashes)

WINDOW = 50
#: Cells of a sketch row at most: 2^28, of which 32 MB of bits are broadcast for each of the rows.
MAX_CELL_BITS = 28
BLOCK_BITS = 20
ROWS = 2
#: Cells for each expected signature.
CELLS_EACH = 12
BYTES_PER_WORD = 6
BYTES_PER_BUCKET = 8 << 20
WINDOWS_PER_BLOCK = 1 << 20
#: What a task holds before it packs and sends (signatures or windows).
HELD = 1 << 21


@functools.lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(10, (n - 1).bit_length()))[:n]


def rolling(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of every ``size`` consecutive word hashes, as differences of running sums."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=total[1:])
    return (total[size:] - total[:-size]) * powers(pow(base, -1, 1 << 64), n)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every ``size`` consecutive values."""
    held, out = 1, x
    while held < size:
        step = min(held, size - held)
        out = np.minimum(out[:-step], out[step:])
        held += step
    return out


class Windows:
    """The windows of some texts, word by word in a row."""

    def __init__(self, texts: list[bytes], window: int):
        words = [t.split() for t in texts]
        self.window = window
        self.counts = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(self.counts)
        self.hashes = word_hashes([w for own in words for w in own])
        starts = np.arange(max(0, len(self.hashes) - window + 1))
        self.text = np.repeat(np.arange(len(texts)), self.counts)[:len(starts)]
        #: starts of windows that lie within one text
        self.at = starts[starts + window <= self.ends[self.text]] if len(starts) else starts
        self.text = self.text[self.at]

    def signatures(self) -> np.ndarray:
        """The signature of the window at each of ``at``."""
        run = (self.window + 1) // 2
        return sliding_min(mix(rolling(self.hashes, run, int(MIX_A))), self.window - run + 1)[self.at]

    def identities(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the windows at ``at[chosen]``."""
        at = self.at[chosen]
        return (mix(rolling(self.hashes, self.window, int(MIX_B)))[at],
                mix(rolling(mix(self.hashes ^ MIX_A), self.window, int(MIX_C)))[at])

    def places(self) -> np.ndarray:
        """The first word of the window at each of ``at``, counted in its text."""
        return self.at - (self.ends - self.counts)[self.text]


def cells(signatures: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(signatures + MIX_A * np.uint64(row)) >> np.uint64(64 - bits)).astype(np.int64)


class Sketch:
    """Which cells were counted twice or more."""

    def __init__(self, bits: int, rows: int = ROWS):
        self.bits = bits
        self.twice = np.zeros((rows, max(1, (1 << bits) // 8)), np.uint8)

    def repeated(self, signatures: np.ndarray) -> np.ndarray:
        out = np.ones(len(signatures), bool)
        for row, twice in enumerate(self.twice):
            left = np.flatnonzero(out)
            cell = cells(signatures[left], row, self.bits)
            out[left] = (twice[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def cell_bits(n_bytes: int, window: int = WINDOW) -> int:
    """Bits of a cell number: ``CELLS_EACH`` cells for each signature expected of that much text."""
    signatures = 4 * n_bytes // (BYTES_PER_WORD * (window + 4))
    return min(MAX_CELL_BITS, max(BLOCK_BITS, (CELLS_EACH * signatures).bit_length()))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = id_key(F.col(id_col))
    return docs.select(key.alias("key"), F.xxhash64(key, text).alias("row"), text.alias("text"))


def merged_sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                  n_bytes: int | None = None) -> Sketch:
    """The merged sketch of all partitions."""
    sketch = Sketch(cell_bits(corpus_bytes(docs, text_col) if n_bytes is None else n_bytes, window))
    bits = sketch.bits
    sent = pa.schema([("line", pa.int32()), ("block", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])

    def packed(signatures: list[np.ndarray]):
        every = np.concatenate(signatures)
        for row in range(ROWS):
            cell, count = np.unique(cells(every, row, bits), return_counts=True)
            count = np.minimum(count, 2).astype(np.uint8)
            block = cell >> BLOCK_BITS
            begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(cell) else []
            ends = [*begin[1:], len(cell)]
            inner = (cell & ((1 << BLOCK_BITS) - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(begin), row, np.int32)), pa.array(block[begin].astype(np.int32)),
                pa.array([inner[s:e].tobytes() for s, e in zip(begin, ends)], pa.binary()),
                pa.array([count[s:e].tobytes() for s, e in zip(begin, ends)], pa.binary())], schema=sent)

    def count(batches):
        held, waiting = 0, []
        for batch in batches:
            for part in slices_of(batch, "text", 4 << 20):
                windows = Windows(texts_as_bytes(part.column("text")), window)
                found = windows.signatures()
                # a text counts a signature once for each run of windows that have it
                first = np.ones(len(found), bool)
                first[1:] = (found[1:] != found[:-1]) | (windows.text[1:] != windows.text[:-1])
                waiting.append(found[first])
                held += len(waiting[-1])
                if held > HELD:
                    yield from packed(waiting)
                    held, waiting = 0, []
        if held:
            yield from packed(waiting)

    merged = pa.schema([("line", pa.int32()), ("block", pa.int32()), ("twice", pa.binary())])

    def merge(group):
        total = np.zeros(1 << BLOCK_BITS, np.uint8)
        for cell, n in zip(group.column("cells").to_pylist(), group.column("counts").to_pylist()):
            cell = np.frombuffer(cell, np.uint32)
            total[cell] = np.minimum(total[cell] + np.frombuffer(n, np.uint8), 2)
        return pa.Table.from_arrays([group.column("line").slice(0, 1), group.column("block").slice(0, 1),
                                     pa.array([np.packbits(total > 1).tobytes()], pa.binary())], schema=merged)

    blocks = (_rows(docs, id_col, text_col).mapInArrow(count, "line int, block int, cells binary, counts binary")
              .groupBy("line", "block").applyInArrow(merge, "line int, block int, twice binary"))
    size = (1 << BLOCK_BITS) // 8
    for line, block, twice in blocks.collect():  # ROWS * 2^MAX_CELL_BITS bits at most
        sketch.twice[line, block * size:(block + 1) * size] = np.frombuffer(twice, np.uint8)
    return sketch


def runs(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first place, places in a row) of every run of consecutive places."""
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] > place[:-1] + 1)
    begin = np.flatnonzero(new)
    ends = np.append(begin[1:], len(row))
    return row[begin], place[begin], place[ends - 1] - place[begin] + 1 if len(begin) else place[begin]


def smallest_of_group(h1: np.ndarray, h2: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each entry, the smallest key among the entries with its hashes."""
    out = np.empty_like(key)
    if len(key):
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        least = np.minimum.reduceat(key[order], begin)
        out[order] = np.repeat(least, np.diff(np.append(begin, len(key))))
    return out


def places_to_remove(docs: DataFrame, sketch: Sketch, n_bytes: int, id_col: str = "doc_id", text_col: str = "text",
                     window: int = WINDOW) -> DataFrame:
    """``bucket, rows, starts, lengths``: packed runs of windows to remove, of
    rows (XXH64 of key and text) whose hash modulo the buckets is ``bucket``."""
    n_blocks = max(8, n_bytes // (BYTES_PER_WORD * WINDOWS_PER_BLOCK) + 1)
    n_buckets = buckets(n_bytes)
    sent_sketch = docs.sparkSession.sparkContext.broadcast(sketch)
    # a block >= 0 holds windows to compare; -1 - bucket holds runs that are already settled
    sent = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("h1", "h2", "key", "row", "place"))])
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.uint32)

    def packed(group: np.ndarray, columns: tuple):
        order = np.argsort(group, kind="stable")
        group = group[order]
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        ends = [*begin[1:], len(group)]
        arrays = [np.ascontiguousarray(c[order]) for c in columns]
        return [pa.array(group[begin])] + [pa.array([c[s:e].tobytes() for s, e in zip(begin, ends)], pa.binary())
                                           for c in arrays]

    def send(waiting):
        h1, h2, key, row, place = (np.concatenate(x) for x in zip(*waiting))
        later = key > smallest_of_group(h1, h2, key)
        if later.any():
            r, start, n = runs(row[later], place[later])
            none = np.empty(len(r), np.uint8)[:0]
            bucket, rows, starts, lengths = packed(r % n_buckets, (r, start.astype(np.uint32), n.astype(np.uint32)))
            empty = pa.array([none.tobytes()] * len(bucket), pa.binary())
            settled = pa.array(-1 - bucket.to_numpy())
            yield pa.RecordBatch.from_arrays([settled, lengths, empty, empty, rows, starts], schema=sent)
        left = ~later
        if left.any():
            yield pa.RecordBatch.from_arrays(
                packed((h1[left] % np.uint64(n_blocks)).astype(np.int64),
                       (h1[left], h2[left], key[left], row[left], place[left].astype(np.uint32))), schema=sent)

    def candidates(batches):
        held, waiting = 0, []
        for batch in batches:
            for part in slices_of(batch, "text", 4 << 20):
                windows = Windows(texts_as_bytes(part.column("text")), window)
                chosen = np.flatnonzero(sent_sketch.value.repeated(windows.signatures()))
                if not len(chosen):
                    continue
                text = windows.text[chosen]
                waiting.append((*windows.identities(chosen), part.column("key").to_numpy()[text],
                                part.column("row").to_numpy()[text], windows.places()[chosen]))
                held += len(chosen)
                if held > HELD:
                    yield from send(waiting)
                    held, waiting = 0, []
        if held:
            yield from send(waiting)

    out = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("rows", "starts", "lengths"))])

    def settle(key, group):
        block = key[0].as_py()
        if block < 0:
            return pa.Table.from_arrays([pa.array(np.full(len(group), -1 - block)), group.column("row"),
                                         group.column("place"), group.column("h1")], schema=out)
        h1, h2, doc, row, place = (np.frombuffer(b"".join(group.column(c).to_pylist()), kind)
                                   for c, kind in zip(("h1", "h2", "key", "row", "place"), kinds))
        later = doc > smallest_of_group(h1, h2, doc)
        r, start, n = runs(row[later], place[later].astype(np.int64))
        if not len(r):
            return out.empty_table()
        return pa.Table.from_arrays(packed(r % n_buckets, (r, start.astype(np.uint32), n.astype(np.uint32))), schema=out)

    return (_rows(docs, id_col, text_col)
            .mapInArrow(candidates, "block long, h1 binary, h2 binary, key binary, row binary, place binary")
            .groupBy("block").applyInArrow(settle, "bucket long, rows binary, starts binary, lengths binary"))


def buckets(n_bytes: int) -> int:
    return max(8, n_bytes // BYTES_PER_BUCKET + 1)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id_col, n_words, n_removed, kept_text`` of every row: the words that no
    repeated window covers, joined by one space."""
    n_bytes = corpus_bytes(docs, text_col)
    sketch = merged_sketch(docs, id_col, text_col, window, n_bytes)
    marks = places_to_remove(docs, sketch, n_bytes, id_col, text_col, window)
    out = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def cut(texts, found):
        row, start, length = (np.frombuffer(b"".join(found.column(c).to_pylist()), kind).astype(np.int64)
                              for c, kind in (("rows", np.int64), ("starts", np.uint32), ("lengths", np.uint32)))
        order = np.argsort(row, kind="stable")
        row, start, length = row[order], start[order], length[order]
        own = texts.column("row").to_numpy()
        low, high = np.searchsorted(row, own, "left"), np.searchsorted(row, own, "right")
        n_words, n_removed, kept = [], [], []
        for text, a, b in zip(texts.column("text").to_pylist(), low.tolist(), high.tolist()):
            words = text.encode().split()
            n_words.append(len(words))
            if a < b:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start[a:b], 1)
                np.add.at(edge, start[a:b] + length[a:b] + window - 1, -1)
                left = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                words = [words[i] for i in left]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return pa.Table.from_arrays([texts.column("key"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                     pa.array(kept, pa.string())], schema=out)

    n_buckets = buckets(n_bytes)
    rows = _rows(docs, id_col, text_col).withColumn("bucket", F.pmod("row", F.lit(n_buckets).cast("long")))
    found = (rows.groupBy("bucket").cogroup(marks.groupBy("bucket"))
             .applyInArrow(cut, "key long, n_words long, n_removed long, kept_text string"))
    return found.select(id_value(F.col("key")).alias(id_col), "n_words", "n_removed", "kept_text")
