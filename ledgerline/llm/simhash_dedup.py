"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most r bits exactly if some value lies within
r/2 bits of both. So every distinct fingerprint emits all values within half
the radius (2,081 for r = 4), values are shuffled, and fingerprints meeting at
a value are verified and linked.

Writing each value as a row would shuffle thousands of rows per fingerprint.
The shuffle key is therefore a *prefix* of the value: a fingerprint goes once
to every prefix that its values have (79 for 12 bits), and the task that owns
a prefix makes the rest of the values and lets them meet there. The prefix
length follows from the number of distinct fingerprints, so a prefix's share
stays about the same size however large the input is if they lie evenly.

Near copies do not: their values crowd in few prefixes, however long these
are. So the values are counted per prefix, and a prefix with over
``VALUES_PER_TASK`` is dealt in parts to several tasks. A value's part is a
linear code (XOR of a fixed number for each of its set bits), which cuts even a
crowd evenly and tells without trying which values of a fingerprint are in a
part. The same parts bound what a task makes at once. A value has one part, so
its fingerprints still meet.

Exact copies have one fingerprint and are folded before. At a value the
members are linked as a star, never pairwise: all are within r of its centre.
Each prefix hands on a spanning forest of what it linked, and
:mod:`components` joins these.

Defined results: a null or empty text has fingerprint 0, linked like any
other; a text with fewer words than a shingle is one shingle; repeated rows
are copies; a row without an id gets a component but is nobody's
``component_id`` unless its whole component has no id (then null); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import MIX_A, id_key, id_value, slices_of, texts_as_bytes, unused_name
from ledgerline.llm.components import connected_components

BITS = 64
#: Values that one prefix's task should make at once, about (8 bytes each).
VALUES_PER_PREFIX = 4_000_000
#: Values of a prefix over which its parts go to several tasks.
VALUES_PER_TASK = 32_000_000
#: The code of each bit of a value; parts are numbered by the lowest bits of the codes' XOR.
CODES = np.random.default_rng(3).integers(1, 1 << 24, BITS, dtype=np.int64)
PART_BITS = 24
#: Shingle hashes whose bits are counted at once (64 bytes each).
VOTES_AT_ONCE = 1 << 18


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> list[int]:
    """XXH64 of every ``size``-word shingle, A-Z lower-cased, words joined by one space."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[:-size]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b - 1], seed) for a, b in zip(starts, ends[size - 1:])]


def majority_bits(hashes: list[list[int]]) -> np.ndarray:
    """One fingerprint per list: a bit is 1 if set in over half of its hashes; an empty list gives 0."""
    counts = np.array([len(h) for h in hashes], np.int64)
    flat = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, int(counts.sum()))
    votes = np.zeros((len(hashes), BITS), np.int64)
    ends = np.cumsum(counts)
    for low in range(0, len(flat), VOTES_AT_ONCE):
        part = flat[low:low + VOTES_AT_ONCE]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(ends, [low, low + len(part) - 1], side="right")
        owner = np.arange(first, last + 1)
        owner = owner[counts[owner] > 0]
        at = np.maximum(ends[owner] - counts[owner] - low, 0)
        votes[owner] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    is_set = (2 * votes > counts[:, None]).astype(np.uint8)
    return np.packbits(is_set, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``key`` (the id, null last), ``content`` (XXH64 of the text) and ``fp`` of every row; no shuffle."""
    out = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in slices_of(batch, "text", 1 << 20):
                fp = majority_bits([shingle_hashes(t, shingle) for t in texts_as_bytes(part.column("text"))])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("content"), pa.array(fp.view(np.int64))], schema=out)

    rows = docs.select(id_key(F.col(id_col)).alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("content"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, content long, fp long")


def masks(bits: int, weight: int) -> np.ndarray:
    """All values of ``bits`` bits of which exactly ``weight`` are set."""
    return np.array([sum(1 << b for b in c) for c in itertools.combinations(range(bits), weight)], np.uint64)


def prefix_bits(n_fingerprints: int, half: int) -> int:
    """Bits of the shuffle key: as many as leave about ``VALUES_PER_PREFIX`` values to a key."""
    values = n_fingerprints * sum(math.comb(BITS, w) for w in range(half + 1))
    return min(32, max(6, math.ceil(math.log2(max(values / VALUES_PER_PREFIX, 1)))))


def merge_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``n`` nodes' component under the links ``a[i] - b[i]``."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def meeting(values: np.ndarray) -> np.ndarray:
    """Positions of values that may occur twice: those that share a cell of a
    hash table with another, tried until hardly any more fall out."""
    left = np.arange(len(values))
    for turn in range(4):
        if len(left) < 2:
            break
        bits = max(10, int(2 * len(left) - 1).bit_length())
        cell = ((values[left] + np.uint64(turn)) * (MIX_A + np.uint64(2 * turn)) >> np.uint64(BITS - bits)).astype(np.int64)
        again = np.bincount(cell, minlength=1 << bits)[cell] > 1
        if again.mean() > 0.9:
            break
        left = left[again]
    return left


def codes(x: np.ndarray) -> np.ndarray:
    """XOR of the codes of the set bits."""
    out = np.zeros(len(x), np.int64)
    for b in range(BITS):
        out ^= (x >> np.uint64(b) & np.uint64(1)).astype(np.int64) * CODES[b]
    return out


def ball_sizes(low_bits: int, half: int) -> np.ndarray:
    """How many values a fingerprint has in a prefix that differs from its own in 0, 1, .. ``half`` bits."""
    return np.array([sum(math.comb(low_bits, w) for w in range(half - off + 1)) for off in range(half + 1)], np.int64)


def halvings(n_values: int, budget: int) -> int:
    """Bits of the part number that leave about ``budget`` values to a part."""
    return min(PART_BITS, max(0, math.ceil(math.log2(max(n_values / budget, 1)))))


def link_prefix(prefix: int, fp: np.ndarray, bits: int, radius: int, part: int = 0, part_bits: int = 0,
                budget: int | None = None) -> np.ndarray:
    """Let the values with this prefix (of this part of it) meet, about ``budget``
    at once; the label of every fingerprint is the position of the first one it
    is linked to."""
    far, near = (radius + 1) // 2, radius // 2
    low_bits = BITS - bits
    off = np.bitwise_count((fp >> np.uint64(low_bits)) ^ np.uint64(prefix)).astype(np.int64)
    rest = fp & np.uint64((1 << low_bits) - 1)
    n_values = int(ball_sizes(low_bits, far)[off[off <= far]].sum())
    cut = max(part_bits, halvings(n_values >> part_bits, 2 * (budget or VALUES_PER_PREFIX)) + part_bits)
    patterns = [masks(low_bits, weight) for weight in range(far + 1)]
    if cut:
        own_code, low = codes(rest), (1 << cut) - 1
        by_code = []
        for pattern in patterns:
            code = codes(pattern) & low
            order = np.argsort(code, kind="stable")
            by_code.append((pattern[order], np.searchsorted(code[order], np.arange(low + 2))))
    label = np.arange(len(fp))
    for this in range(part, 1 << cut, 1 << part_bits):
        values, owner, close = [], [], []
        for weight in range(far + 1):
            own = np.flatnonzero(off <= far - weight)
            if cut:
                pattern, bounds = by_code[weight]
                wanted = (own_code[own] ^ this) & low
                begin, n = bounds[wanted], bounds[wanted + 1] - bounds[wanted]
                at = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
                values.append(np.repeat(rest[own], n) ^ pattern[at])
            else:
                pattern, n = patterns[weight], len(patterns[weight])
                values.append((rest[own][:, None] ^ pattern[None, :]).ravel())
            owner.append(np.repeat(own.astype(np.int32), n))
            close.append(np.repeat(off[own] + weight <= near, n))
        a, b = met(np.concatenate(values), np.concatenate(owner), np.concatenate(close), len(fp))
        verified = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        moved = np.flatnonzero(label != np.arange(len(fp)))
        label = merge_labels(len(fp), np.concatenate([moved, a[verified]]), np.concatenate([label[moved], b[verified]]))
    return label


def met(values: np.ndarray, owner: np.ndarray, close: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each value's centre and the others at it."""
    kept = meeting(values)
    values, owner, close = values[kept], owner[kept], close[kept]
    # in a value's run the centre comes first: a member within the smaller half of the radius
    order = np.lexsort((owner, ~close, values))
    values, owner, close = values[order], owner[order], close[order]
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, int)
    run = np.repeat(start, np.diff(np.concatenate([start, [len(values)]])))
    a, b = owner[run], owner
    link = (a != b) & close[run]
    pairs = np.unique(a[link].astype(np.int64) * n + b[link])
    return pairs // max(1, n), pairs % max(1, n)


def crowded(distinct: DataFrame, bits: int, half: int, per_task: int) -> dict[int, int]:
    """The prefixes with over ``per_task`` values, and the bits of their part
    numbers; at most one such prefix for each ``per_task`` values of all."""
    to_flip = np.concatenate([masks(bits, w) for w in range(half + 1)]).astype(np.int64)
    sizes = ball_sizes(BITS - bits, half)[np.bitwise_count(to_flip)]

    def count(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            own, n = np.unique((fp >> np.uint64(BITS - bits)).astype(np.int64), return_counts=True)
            for at in range(0, len(own), 4096):
                prefix, where = np.unique(own[at:at + 4096, None] ^ to_flip[None, :], return_inverse=True)
                made = np.zeros(len(prefix), np.int64)
                np.add.at(made, where.ravel(), (n[at:at + 4096, None] * sizes[None, :]).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(made)], names=["prefix", "made"])

    made = distinct.select("fp").mapInArrow(count, "prefix long, made long").groupBy("prefix").agg(F.sum("made").alias("made"))
    return {r["prefix"]: halvings(r["made"], per_task) for r in made.where(F.col("made") > per_task).collect()}


def near_links(distinct: DataFrame, radius: int = 4, n_fingerprints: int | None = None) -> DataFrame:
    """``u, v`` (structs of key and fp): links between the rows ``key, fp`` of
    ``distinct`` (one row a fingerprint) whose closure joins all rows within
    ``radius`` bits of one another."""
    half = (radius + 1) // 2
    n_fingerprints = distinct.count() if n_fingerprints is None else n_fingerprints
    bits = prefix_bits(n_fingerprints, half)
    per_task, at_once = VALUES_PER_TASK, VALUES_PER_PREFIX
    all_values = n_fingerprints * int(ball_sizes(BITS, half)[0])
    cuts = crowded(distinct, bits, half, per_task) if all_values > per_task else {}
    sent = pa.schema([("prefix", pa.int64()), ("part", pa.int64()), ("fps", pa.binary()), ("keys", pa.binary())])
    to_flip = np.concatenate([masks(bits, w) for w in range(half + 1)]).astype(np.int64)

    def parts_of(prefix, own, part_bits):
        """Positions in ``own`` and the parts of the prefix in which each has values."""
        low_bits = BITS - bits
        off = np.bitwise_count((own >> np.uint64(low_bits)) ^ np.uint64(prefix)).astype(np.int64)
        code, found = codes(own & np.uint64((1 << low_bits) - 1)), []
        for weight in range(half + 1):
            row = np.flatnonzero(off <= half - weight)
            part = (code[row][:, None] ^ codes(masks(low_bits, weight))[None, :]) & ((1 << part_bits) - 1)
            found.append(np.unique((part * len(own) + row[:, None]).ravel()))
        found = np.unique(np.concatenate(found))
        return found % len(own), found // len(own)

    def spread(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            key = batch.column("key").to_numpy()
            for at in range(0, len(fp), 4096):
                own, own_key = fp[at:at + 4096], key[at:at + 4096]
                prefix = ((own >> np.uint64(BITS - bits)).astype(np.int64)[:, None] ^ to_flip[None, :]).ravel()
                order = np.argsort(prefix, kind="stable")
                prefix, row = prefix[order], order // len(to_flip)
                start = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
                ends = [*start[1:], len(prefix)]
                out = []
                for s, e in zip(start, ends):
                    own_rows, one = row[s:e], int(prefix[s])
                    if one not in cuts:
                        out.append((one, 0, own[own_rows].tobytes(), own_key[own_rows].tobytes()))
                        continue
                    at_row, part = parts_of(one, own[own_rows], cuts[one])
                    for r in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                        rows = own_rows[at_row[r]]
                        out.append((one, int(part[r[0]]), own[rows].tobytes(), own_key[rows].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), sent)], schema=sent)

    found = pa.schema([(c, pa.int64()) for c in ("uk", "uf", "vk", "vf")])

    def meet(key, group):
        fp = np.frombuffer(b"".join(group.column("fps").to_pylist()), np.uint64)
        own = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.int64)
        prefix, part = key[0].as_py(), key[1].as_py()
        label = link_prefix(prefix, fp, bits, radius, part, cuts.get(prefix, 0), at_once)
        moved = np.flatnonzero(label != np.arange(len(fp)))
        to = label[moved]
        return pa.Table.from_arrays([pa.array(x) for x in (own[moved], fp[moved].view(np.int64), own[to],
                                                           fp[to].view(np.int64))], schema=found)

    sent_rows = distinct.select("key", "fp").mapInArrow(spread, "prefix long, part long, fps binary, keys binary")
    links = sent_rows.groupBy("prefix", "part").applyInArrow(meet, "uk long, uf long, vk long, vf long").distinct()
    return links.select(F.struct(F.col("uk").alias("key"), F.col("uf").alias("fp")).alias("u"),
                        F.struct(F.col("vk").alias("key"), F.col("vf").alias("fp")).alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    radius: int = 4) -> DataFrame:
    """``key, content, fp, component, root`` of every row of ``docs``: the
    smallest key reachable over links of ``radius`` or fewer bits, and the
    fingerprint that it stands with."""
    rows = fingerprints(docs, id_col, text_col, shingle).checkpoint()
    distinct = rows.groupBy("fp").agg(F.min("key").alias("key")).checkpoint()
    joined = connected_components(near_links(distinct, radius))
    joined = joined.select(F.col("node.fp").alias("fp"), F.col("root.key").alias("component"), F.col("root.fp").alias("root"))
    of_fp = (distinct.join(joined, "fp", "left")
             .select("fp", F.coalesce("component", "key").alias("component"), F.coalesce("root", "fp").alias("root")).checkpoint())
    return rows.join(of_fp, "fp")


def component_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    radius: int = 4) -> DataFrame:
    """``id_col, fingerprint`` (16 hex digits) and ``component_id`` of every row."""
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    return found.select(id_value(F.col("key")).alias(id_col),
                        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        id_value(F.col("component")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                         radius: int = 4) -> DataFrame:
    """One row of every component, all columns as they were: the one with the
    smallest id (null last), of these the one with the smallest text hash.

    Components are told apart by their smallest id and fingerprint, so near
    copies that all lack an id are one component, and rows without an id that
    are no copies stay apart."""
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    key, content = unused_name(docs, "row_key"), unused_name(docs, "row_content")
    chosen = (found.groupBy("component", "root")
              .agg(F.min(F.struct("key", "content")).alias("m"))
              .select(F.col("m.key").alias(key), F.col("m.content").alias(content)).distinct().checkpoint())
    named = docs.select("*", id_key(F.col(id_col)).alias(key), F.xxhash64(F.col(text_col).cast("string")).alias(content))
    return (named.join(chosen, [key, content], "left_semi")
            .dropDuplicates([key, content]).select(*docs.columns))
