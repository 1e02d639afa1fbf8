"""Benchmark passages in documents, by SimHash over item-sized windows.

Every window of a document that is as long as a benchmark item gets a SimHash
over its 5-word shingles. A multi-index finds the items of that length whose
fingerprint lies within the radius: the 64 bits are cut into radius + 1
blocks, of which two fingerprints within the radius share at least one
unchanged, so looking up every block misses none. What it finds is verified
by the exact weighted similarity of both shingle multisets (sum of the smaller
over sum of the larger counts).

Windows that share no shingle with any item have similarity 0 to all of them
and are passed over without a fingerprint; which shingles occur in items is
known from the index. Window votes are differences of running sums, so a
window costs the same whatever its length.

Words are lower-cased and lose ASCII punctuation on both sides. An item
shorter than a shingle is one shingle of all its words; a document shorter
than an item is compared whole.

Defined results: a null or empty text or item matches nothing; every row of a
repeated document and every repeated item is reported by itself; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import MIX_A, mix, slices_of, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits of two texts of similarity 0.8 are about 10 on average with a deviation of 3.
RADIUS = 20
BITS = 64
#: Words of benchmark items held by one index; more items go into further
#: indexes, each of which makes a pass over the documents of its own.
WORDS_PER_INDEX = 2_000_000

_PUNCTUATION = string.punctuation.encode()


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(None, _PUNCTUATION).split()


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words (none if there are fewer)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, np.uint64(size))
    for j in range(size):
        total *= MIX_A
        total += hashes[j:j + n]
    return mix(total)


def window_fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles at ``starts``."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    running = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=running[1:])
    votes = running[starts + size] - running[starts]
    return np.packbits((2 * votes > size).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def weighted_similarity(a: Counter, b: Counter) -> float:
    common = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


class BlockIndex:
    """Fingerprints by the value of each of ``radius + 1`` blocks of bits."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        edges = np.linspace(0, BITS, min(BITS, radius + 1) + 1).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges, edges[1:])]
        self.tables: list[dict[int, list[int]]] = []
        for shift, mask in self.blocks:
            table: dict[int, list[int]] = defaultdict(list)
            for i, value in enumerate(((fps >> shift) & mask).tolist()):
                table[value].append(i)
            self.tables.append(dict(table))

    def within(self, fp: np.uint64) -> list[int]:
        """Positions of all fingerprints at most ``radius`` bits away."""
        found = {i for (shift, mask), table in zip(self.blocks, self.tables) for i in table.get(int((fp >> shift) & mask), ())}
        if not found:
            return []
        near = np.fromiter(found, np.int64, len(found))
        return np.sort(near[np.bitwise_count(self.fps[near] ^ fp) <= self.radius]).tolist()


@dataclass
class ItemIndex:
    """The benchmark items of one pass."""

    ids: list
    shingles: list[Counter]  # of every item
    sizes: np.ndarray  # words of an item's shingle
    counts: np.ndarray  # shingles of an item
    known: dict[int, np.ndarray]  # shingle size -> sorted shingles of items
    items_of: dict[tuple[int, int], list[int]]  # (shingle size, shingle) -> items
    by_size: dict[tuple[int, int], tuple[np.ndarray, BlockIndex]] = field(default_factory=dict)
    similarity: float = SIMILARITY
    radius: int = RADIUS

    @classmethod
    def build(cls, items: list[tuple], similarity: float = SIMILARITY, radius: int = RADIUS,
              shingle: int = SHINGLE) -> "ItemIndex":
        ids, counters, sizes, counts, fps = [], [], [], [], []
        items_of: dict[tuple[int, int], list[int]] = defaultdict(list)
        for item_id, text in items:
            words = normal_words(text)
            if not words:
                continue
            size = min(shingle, len(words))
            keys = rolling(word_hashes(words), size)
            for key in set(keys.tolist()):
                items_of[size, key].append(len(ids))
            ids.append(item_id)
            counters.append(Counter(keys.tolist()))
            sizes.append(size)
            counts.append(len(keys))
            fps.append(window_fingerprints(keys, np.array([0]), len(keys))[0])
        sizes, counts, fps = np.array(sizes, int), np.array(counts, int), np.array(fps, np.uint64)
        known = {s: np.sort(np.array([k for z, k in items_of if z == s], np.uint64)) for s in {z for z, _ in items_of}}
        index = cls(ids, counters, sizes, counts, known, dict(items_of), {}, similarity, radius)
        for size, count in set(zip(sizes.tolist(), counts.tolist())):
            own = np.flatnonzero((sizes == size) & (counts == count))
            index.by_size[size, count] = own, BlockIndex(fps[own], radius)
        return index

    def hits(self, hashes: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of many documents' words in a row, the shingles and those positions
        that hold an item's shingle within one document."""
        keys = rolling(hashes, size)
        known = self.known[size]
        cell = np.uint64(BITS - 20)
        maybe = np.zeros(1 << 20, bool)
        maybe[(known >> cell).astype(np.int64)] = True
        at = np.flatnonzero(maybe[(keys >> cell).astype(np.int64)])
        at = at[known[np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)] == keys[at]]
        crossing = ends[np.searchsorted(ends, at, side="right")] < at + size if len(at) else np.empty(0, bool)
        return keys, at[~crossing]

    def match(self, keys: np.ndarray, at: np.ndarray, size: int) -> dict[int, tuple[float, int, int]]:
        """Of one document with shingles ``keys`` and item shingles at ``at``:
        item -> (similarity, first word, words) of its best window."""
        wanted: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for p in at.tolist():
            for n in {int(self.counts[i]) for i in self.items_of[size, int(keys[p])]}:
                held = min(n, len(keys))  # a document shorter than the item is one window
                wanted[n, held].append((max(0, p - held + 1), min(p, len(keys) - held)))
        best: dict[int, tuple[float, int, int]] = {}
        for (n, held), ranges in wanted.items():
            own, index = self.by_size[size, n]
            for start, fp in fingerprinted(keys, covered(ranges), held):
                near = index.within(fp)
                if not near:
                    continue
                counted = Counter(keys[start:start + held].tolist())
                for i in own[near].tolist():
                    s = weighted_similarity(counted, self.shingles[i])
                    if s >= self.similarity and s > best.get(i, (0.0,))[0]:
                        best[i] = s, start, held + size - 1
        return best

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, float, int, int]]:
        """(text's position, item's position, similarity, first word, words) of all matches."""
        words = [normal_words(t) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        hashes = word_hashes([w for ws in words for w in ws])
        found = []
        for size in sorted(self.known):
            keys, at = self.hits(hashes, ends, size)
            owner = np.searchsorted(ends, at, side="right")
            for d in np.unique(owner).tolist():
                begin, end = int(ends[d]) - len(words[d]), int(ends[d])
                own = at[owner == d] - begin
                for i, (s, start, n) in self.match(keys[begin:end - size + 1], own, size).items():
                    found.append((d, i, s, start, n))
        return sorted(found)


def fingerprinted(keys: np.ndarray, starts: np.ndarray, size: int, span: int = 1 << 16):
    """Each start with its window's fingerprint; running sums are held for about ``span`` shingles at a time."""
    while len(starts):
        low = int(starts[0])
        now, starts = np.split(starts, [np.searchsorted(starts, low + span)])
        yield from zip(now.tolist(), window_fingerprints(keys[low:int(now[-1]) + size], now - low, size))


def covered(ranges: list[tuple[int, int]]) -> np.ndarray:
    """All integers inside the inclusive ranges, ascending."""
    parts, reach = [], -1
    for a, b in sorted(ranges):
        a = max(a, reach + 1)
        if a <= b:
            parts.append(np.arange(a, b + 1))
            reach = b
    return np.concatenate(parts)


def item_indexes(items: DataFrame, item_col: str = "item_id", item_text_col: str = "text",
                 similarity: float = SIMILARITY, radius: int = RADIUS,
                 words_per_index: int = WORDS_PER_INDEX):
    """The items' indexes, each over at most about ``words_per_index`` words
    (a bound on what is broadcast), one after the other."""
    rows = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where(F.col("t").isNotNull())
    letters = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    parts = 1 + letters // (6 * words_per_index)
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        yield ItemIndex.build([(r[0], r[1]) for r in own.collect()], similarity, radius)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY,
               radius: int = RADIUS) -> DataFrame:
    """``id_col, item_col, word_start, n_words, similarity``: for every document
    and item found in it, the best window (of equal ones the first). No shuffle."""
    spark = docs.sparkSession
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("word_start", pa.int64()), ("n_words", pa.int64()),
                        ("similarity", pa.float64())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for index in item_indexes(items, item_col, item_text_col, similarity, radius):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                for part in slices_of(batch, "text", 4 << 20):
                    hits = sent.value.scan(part.column("text").to_pylist())
                    ids = part.column("id").to_pylist()
                    yield pa.RecordBatch.from_pylist(
                        [{"id": ids[d], "item": sent.value.ids[i], "word_start": start, "n_words": n, "similarity": s}
                         for d, i, s, start, n in hits], schema=schema)

        one = rows.mapInArrow(run, "id long, item long, word_start long, n_words long, similarity double")
        found = one if found is None else found.union(one)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they were. No shuffle."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for index in item_indexes(items, item_col, item_text_col, similarity, radius):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                named = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string())], names=["text"])
                start = 0
                for part in slices_of(named, "text", 4 << 20):
                    leaked = {hit[0] for hit in sent.value.scan(part.column(0).to_pylist())}
                    yield batch.slice(start, part.num_rows).filter(
                        pa.array([i not in leaked for i in range(part.num_rows)], pa.bool_()))
                    start += part.num_rows

        docs = docs.mapInArrow(run, docs.schema)
    return docs
