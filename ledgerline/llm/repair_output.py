"""Token ids in grammar-compressed binary shards (Re-Pair), read back at random.

Documents are ordered by id over all partitions, encoded by the tokenizers
library, closed by an end id and cut into shards of about ``SHARD_TOKENS``
ids. In every shard the most frequent id pairs are replaced by new symbols,
again and again, until no pair is frequent or hardly any is left. A pair never
spans two documents.

A shard is one binary image (little-endian):

    magic b"RPZ1", crc32 of all that follows
    n_docs u32, n_rules u32, first rule's symbol u32, bytes per symbol u32, n_symbols u64, n_tokens u64
    rules         n_rules x (left u32, right u32)
    expansion     n_rules x u32     ids that a rule stands for
    doc keys      n_docs x i64      the id; 2^63-1 for none
    doc symbols   (n_docs + 1) x u64  where a document's symbols begin
    doc tokens    (n_docs + 1) x u64  where its ids begin, within the shard
    symbols       n_symbols x bytes per symbol

The expansion lengths find the symbol that covers a position and descend its
rules, so one document or one id is read without decoding the others. Spark
writes the images as the binary column of a Parquet table, whose commit
protocol leaves no half-written shard when an executor is lost, on any store.

Words (cut at ASCII white space, which no token of this vocabulary spans) are
known by 64-bit hashes, encoded once per worker and remembered up to a bound.
A text that spells one of the vocabulary's special tokens is encoded whole by
the library, which makes that token of it.

Defined results: a null or empty text is the end id alone; rows of one id are
ordered by their text's XXH64; a row without an id comes last; an empty table gives
no shard and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import MIX_A, id_key, id_value, mix, slices_of, texts_as_bytes

MAGIC = b"RPZ1"
HEADER = struct.Struct("<IIIIQQ")
#: Ids in a shard, about; a longer document is a shard of its own.
SHARD_TOKENS = 1 << 21
#: A pair is frequent if it occurs this often in a shard.
MIN_COUNT = 16
#: Bits of the hash cells in which pairs are counted roughly.
CELL_BITS = 20
#: Replacing ends with the round that shortens a shard by less than this share.
LEAST_GAIN = 0.02
#: Words remembered by a worker's encoder (about 120 bytes each).
REMEMBERED = 700_000


#: A word that no UTF-8 text holds: stands for a text's end.
END = b"\xff"
#: Stands between words that are encoded together; words that hold it are encoded alone.
BETWEEN = "\x01"


#: How the vocabulary writes bytes: printable Latin-1 as itself, the others as further letters.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTED} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}


def plain_word(word: str) -> str:
    """The word as the vocabulary writes it if it is a single run of lower-case
    Latin letters that normalising leaves alone; else nothing."""
    if not word.isalpha() or word != word.lower():
        return ""
    if word.isascii():
        return word
    if max(word) >= "\u0250" or not unicodedata.is_normalized("NFC", word):
        return ""
    return word.encode().decode("latin-1").translate(_BYTES)


_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
_ALNUM = np.array([bytes([b]).isalnum() for b in range(256)])
#: What a byte counts in a word's hash, and the odd base of its places' powers.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * MIX_A)
_BASE = (0x9E3779B97F4A7C15 & ~7) + 5
#: Longer words are hashed one by one: the powers mix the bytes of very long ones less and less.
PLAIN_BYTES = 64


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first ``n`` powers modulo 2^64, and their inverses."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def hashed_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every word of the text: where it starts and ends, and a 64-bit hash of its bytes."""
    raw = np.frombuffer(text, np.uint8)
    blank = np.concatenate([[True], _BLANK[raw], [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    forward, back = powers(1 << max(20, len(raw).bit_length()))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * forward[:len(raw)], dtype=np.uint64)])
    hashes = mix((upto[end] - upto[start]) * back[start])
    for i in np.flatnonzero(end - start > PLAIN_BYTES).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(text[start[i]:end[i]])
    return start, end, hashes


class WordEncoder:
    """Encodes texts word by word, remembering words. ASCII letters are lower-cased
    first, as the vocabulary's normaliser does with all letters."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        (self.between,) = self.ids_of(BETWEEN)
        # the same merges for words that are one token to split and normalised already
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = self.plain.get_vocab()
        self.closing = np.zeros(1 + max(vocabulary.values()), bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # the library as it is: it alone knows what its special tokens do to a text that spells them
        self.library = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.library.get_added_tokens_decoder().values()]
        self.hashes = hashed_words(END)[2]
        self.places = {int(self.hashes[0]): 0}
        self.start, self.length = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids = np.array([end_id], np.uint32)
        self.uses = np.zeros(1, np.int64)

    def ids_of(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def forget(self) -> None:
        """Keep the more used half of the words, and of these no word used only once."""
        least = max(2, int(np.partition(self.uses, -REMEMBERED // 2)[-REMEMBERED // 2]) + 1)
        kept = self.uses >= least
        kept[0] = True
        self.hashes = self.hashes[kept]
        self.places = {h: i for i, h in enumerate(self.hashes.tolist())}
        self.ids = gather(self.ids, self.start[kept], self.length[kept])
        self.length, self.uses = self.length[kept], self.uses[kept] // 2
        self.start = np.cumsum(self.length) - self.length

    def learn(self, words: list[bytes], at_once: int = 2000) -> None:
        # a full stop or comma after an ASCII letter or digit is a token of its own,
        # so words that differ in it alone are encoded once
        raw, sizes = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        closing = np.cumsum(sizes) - 1
        comma = raw[closing] == ord(",")
        marked = (comma | (raw[closing] == ord("."))) & (sizes > 1) & _ALNUM[raw[closing - 1]]
        cores = words.copy()
        for i in np.flatnonzero(marked).tolist():
            cores[i] = words[i][:-1]
        mark = {b".": self.ids_of("."), b",": self.ids_of(",")}
        distinct = list(dict.fromkeys(cores))
        # words of lower-case ASCII letters alone are plain as they are
        letters, others = [w for w in distinct if w.isalpha() and w.islower()], [w for w in distinct if not (w.isalpha() and w.islower())]
        texts = [w.decode("utf-8", "replace") for w in others]
        simple = [plain_word(t) for t in texts]
        distinct = letters + [w for w, p in zip(others, simple) if p] + [w for w, p in zip(others, simple) if not p]
        texts, simple = [t for t, p in zip(texts, simple) if not p], b" ".join(letters).decode().split() + [p for p in simple if p]
        ids, lengths = [], [np.empty(0, np.int64)]
        for i in range(0, len(simple), at_once):
            found = self.plain.encode_batch_fast([" ".join(simple[i:i + at_once])], add_special_tokens=False)[0].ids
            ids.append(np.array(found, np.uint32))
            lengths.append(np.diff(np.flatnonzero(self.closing[ids[-1]]), prepend=-1))
        for i in range(0, len(texts), at_once):
            part = texts[i:i + at_once]
            joined = self.ids_of(f" {BETWEEN} ".join([*part, ""]))
            ends = np.flatnonzero(joined == self.between)
            if len(ends) == len(part):
                ids.append(np.delete(joined, ends))
                lengths.append(np.diff(ends, prepend=-1) - 1)
            else:
                alone = [self.ids_of(t) for t in part]
                ids += alone
                lengths.append(np.array([len(x) for x in alone], np.int64))
        flat, length = np.concatenate([*ids, mark[b"."], mark[b","]]), np.concatenate(lengths)
        start = np.cumsum(length) - length
        # every word is its core's slice and, where marked, the slice of its mark
        number = dict(zip(distinct, range(len(distinct))))
        core = np.fromiter(map(number.__getitem__, cores), np.int64, len(cores))
        slices = np.column_stack([start[core], len(flat) - 2 + comma]).ravel()
        sizes = np.column_stack([length[core], marked.astype(np.int64)]).ravel()
        self.ids = np.concatenate([self.ids, gather(flat, slices, sizes)])
        self.length = np.concatenate([self.length, length[core] + marked])
        self.start = np.cumsum(self.length) - self.length
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def places_of(self, text: bytes) -> np.ndarray:
        """The place of every word of the (lower-case) text, learning new words."""
        start, end, hashes = hashed_words(text)
        distinct, first, which, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        known = np.fromiter(map(self.places.get, distinct.tolist(), itertools.repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = len(self.hashes) + np.arange(len(new))
            self.hashes = np.concatenate([self.hashes, distinct[new]])
            self.places.update(zip(distinct[new].tolist(), known[new].tolist()))
            self.learn([text[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
        self.uses[known] += times
        return known[which]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, each text's closed by the end id; ids per text."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(self.places) > REMEMBERED:
            self.forget()
        low = [t.lower() for t in texts]
        apart = [i for i, t in enumerate(low) if any(s in t for s in self.special)]
        for i in apart:
            low[i] = b""
        at = self.places_of((b" " + END + b" ").join([*low, b""]))
        length = self.length[at]
        upto = np.cumsum(length)[at == 0]
        ids, counts = gather(self.ids, self.start[at], length), np.diff(upto, prepend=0)
        for i in reversed(apart):
            own = self.library.encode(texts[i].decode("utf-8", "replace"), add_special_tokens=False).ids
            ids = np.insert(ids, upto[i] - 1, np.array(own, np.uint32))
            counts[i] += len(own)
        return ids, counts


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, end_id: int) -> WordEncoder:
    return WordEncoder(path, end_id)


def gather(source: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices ``source[start:start + length]`` in a row."""
    begin = np.cumsum(length) - length
    return source[np.arange(int(length.sum())) + np.repeat(start - begin, length)]


def highest_count(pair: np.ndarray, cell: np.ndarray, held: np.ndarray) -> int:
    """How often the most frequent pair occurs: cells are looked into from the
    fullest on, until none is fuller than the best pair found."""
    best, seen = 0, held.copy()
    while int(seen.max()) > best:
        fullest = int(seen.argmax())
        best = max(best, int(np.unique(pair[cell == fullest], return_counts=True)[1].max()))
        seen[fullest] = 0
    return best


def compress(ids: np.ndarray, last: np.ndarray, first_rule: int, min_count: int = MIN_COUNT,
             least_gain: float = LEAST_GAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace frequent pairs: rules (n x 2), the symbols left, and which of
    them end a document (``last``: which ids do). Every round takes all pairs
    that are frequent by then and not far rarer than the most frequent one;
    where two chosen pairs overlap the left one is replaced."""
    seq, rules, n_rules = ids.astype(np.uint64), [], 0
    gain = 1.0
    while gain >= least_gain and len(seq) > 1:
        pair = (seq[:-1] << np.uint64(32)) | seq[1:]
        # a pair is at most as frequent as the hash cell that it falls into, so
        # only the pairs of frequent cells have to be sorted and counted
        cell = (pair * MIX_A >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        cell[last[:-1]] = 1 << CELL_BITS
        held = np.bincount(cell, minlength=(1 << CELL_BITS) + 1)
        held[1 << CELL_BITS] = 0
        least = max(min_count, highest_count(pair, cell, held) // 64)
        at = np.flatnonzero(held[cell] >= least)
        inside = np.sort(pair[at])
        begin = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]])) if len(inside) else at
        chosen = inside[begin[np.diff(np.append(begin, len(inside))) >= least]]  # sorted
        if not len(chosen):
            break
        place = np.minimum(np.searchsorted(chosen, pair[at]), len(chosen) - 1)
        hit = chosen[place] == pair[at]
        at, place = at[hit], place[hit]
        # of neighbouring hits every other one, from the left
        run = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
        offset = at - np.repeat(at[run], np.diff(np.append(run, len(at))))
        at, place = at[offset % 2 == 0], place[offset % 2 == 0]
        seq[at] = place.astype(np.uint64) + np.uint64(first_rule + n_rules)
        last[at] = last[at + 1]
        kept = np.ones(len(seq), bool)
        kept[at + 1] = False
        gain = len(at) / len(seq)
        seq, last = seq[kept], last[kept]
        rules.append(np.column_stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)]))
        n_rules += len(chosen)
    return (np.concatenate(rules) if rules else np.empty((0, 2), np.uint64)), seq, last


def shard_image(keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, first_rule: int,
                min_count: int = MIN_COUNT) -> bytes:
    """The binary image of documents with these keys and numbers of ids."""
    token_at = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    last = np.zeros(len(ids), bool)
    last[token_at[1:][counts > 0].astype(np.int64) - 1] = True
    rules, symbols, ended = compress(ids, last, first_rule, min_count)
    lengths = expansion_lengths(rules, first_rule)
    # every document has at least its end id, so the n-th end belongs to the n-th document
    symbol_at = np.concatenate([[0], np.flatnonzero(ended) + 1]).astype("<u8")
    width = 4 if first_rule + len(rules) >= 1 << 24 else 3 if first_rule + len(rules) >= 1 << 16 else 2
    packed = symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    body = b"".join([
        HEADER.pack(len(keys), len(rules), first_rule, width, len(symbols), len(ids)),
        rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), keys.astype("<i8").tobytes(),
        symbol_at.tobytes(), token_at.tobytes(), np.ascontiguousarray(packed).tobytes()])
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    lengths: list[int] = []
    for a, b in rules.astype(np.int64).tolist():
        lengths.append(sum(1 if s < first_rule else lengths[s - first_rule] for s in (a, b)))
    return np.array(lengths, np.int64)


class Shard:
    """A shard image opened for reading."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC or struct.unpack_from("<I", image, 4)[0] != zlib.crc32(memoryview(image)[8:]):
            raise ValueError("not a whole shard image")
        n_docs, n_rules, self.first_rule, width, n_symbols, self.n_tokens = HEADER.unpack_from(image, 8)
        at = 8 + HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", n_rules).astype(np.int64)
        self.keys = take("<i8", n_docs)
        self.symbol_at = take("<u8", n_docs + 1).astype(np.int64)
        self.token_at = take("<u8", n_docs + 1).astype(np.int64)
        wide = np.zeros((n_symbols, 4), np.uint8)
        wide[:, :width] = take("u1", n_symbols * width).reshape(-1, width)
        self.symbols = wide.view("<u4").ravel().astype(np.int64)

    @functools.cached_property
    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A flat table of ids, and where in it each symbol's expansion starts and how long it is."""
        plain = self.first_rule
        length = np.concatenate([np.ones(plain, np.int64), self.lengths])
        start = np.cumsum(length) - length
        flat = np.empty(int(length.sum()), np.uint32)
        flat[:plain] = np.arange(plain)
        for i, (a, b) in enumerate(self.rules.tolist()):
            s, n, m = start[plain + i], length[a], length[b]
            flat[s:s + n] = flat[start[a]:start[a] + n]
            flat[s + n:s + n + m] = flat[start[b]:start[b] + m]
        return flat, start, length

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of documents ``first`` to ``last`` (exclusive; default: all)."""
        last = len(self.keys) if last is None else last
        flat, start, length = self.expansions
        own = self.symbols[self.symbol_at[first]:self.symbol_at[last]]
        return gather(flat, start[own], length[own])

    def token(self, position: int) -> int:
        """The id at ``position`` of the shard, by descending the rules."""
        doc = int(np.searchsorted(self.token_at, position, side="right")) - 1
        own = self.symbols[self.symbol_at[doc]:self.symbol_at[doc + 1]]
        size = np.ones(len(own), np.int64)
        size[own >= self.first_rule] = self.lengths[own[own >= self.first_rule] - self.first_rule]
        ends = int(self.token_at[doc]) + np.cumsum(size)
        i = int(np.searchsorted(ends, position, side="right"))
        symbol, rest = int(own[i]), position - int(ends[i] - size[i])
        while symbol >= self.first_rule:
            left, right = self.rules[symbol - self.first_rule].tolist()
            n = 1 if left < self.first_rule else int(self.lengths[left - self.first_rule])
            symbol, rest = (left, rest) if rest < n else (right, rest - n)
        return symbol


def write_shards(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 1, shard_tokens: int = SHARD_TOKENS, min_count: int = MIN_COUNT) -> None:
    """Encode ``docs`` and write their shards to the table at ``path``:
    ``part, before`` (ids of the part in front of the shard), ``first_key,
    last_key, n_docs, n_tokens, image``. Parts ascend with the ids."""
    out = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64()),
                     ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())])

    def run(batches):
        encoder = word_encoder(vocabulary, end_id)
        first_rule = encoder.tokenizer.get_vocab_size()
        part, before, held, waiting = TaskContext.get().partitionId(), 0, 0, []

        def shard():
            keys, counts, ids = (np.concatenate(x) for x in zip(*waiting))
            image = shard_image(keys, counts, ids, first_rule, min_count)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "before": before, "first_key": int(keys[0]), "last_key": int(keys[-1]),
                  "n_docs": len(keys), "n_tokens": len(ids), "image": image}], schema=out)

        for batch in batches:
            for rows in slices_of(batch, "text", 1 << 20):
                ids, counts = encoder.encode(texts_as_bytes(rows.column("text")))
                if held and held + len(ids) > shard_tokens:
                    yield shard()
                    before, held, waiting = before + held, 0, []
                waiting.append((rows.column("key").to_numpy(), counts, ids))
                held += len(ids)
        if waiting:
            yield shard()

    text = F.col(text_col).cast("string")
    # the bounds of the ranges are sampled, so what they are made of is small: the text's hash, not the text
    rows = docs.select(id_key(F.col(id_col)).alias("key"), F.xxhash64(text).alias("content"), text.alias("text"))
    ordered = rows.repartitionByRange("key", "content").sortWithinPartitions("key", "content", "text")
    (ordered.mapInArrow(run, "part int, before long, first_key long, last_key long, n_docs long, n_tokens long, "
                             "image binary").write.parquet(path))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shard table with ``start``: the ids of all shards in front."""
    shards = spark.read.parquet(path)
    # a small row a part (a writing task): one task numbers them, and they are broadcast
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return shards.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def decoded_documents(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` of every document in the shards."""
    out = pa.schema([(c, pa.int64()) for c in ("key", "start", "n_tokens", "ids_crc32")])

    def run(batches):
        for batch in batches:
            for start, image in zip(batch.column("start").to_pylist(), batch.column("image")):
                shard = Shard(image.as_py())
                ids, at = memoryview(shard.decode().astype("<u4")), shard.token_at
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (shard.keys, start + at[:-1], np.diff(at), np.array(crc, np.int64))], schema=out)

    found = shards.select("start", "image").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")
    return found.select(id_value(F.col("key")).alias(id_col), "start", "n_tokens", "ids_crc32")


def document_ids(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of every row with this id: opens only shards that may hold it."""
    rows = spark.read.parquet(path).where((F.col("first_key") <= doc_id) & (F.col("last_key") >= doc_id))
    found = []
    for (image,) in rows.select("image").orderBy("part", "before").toLocalIterator():
        shard = Shard(bytes(image))
        found += [shard.decode(i, i + 1).tolist() for i in np.flatnonzero(shard.keys == doc_id).tolist()]
    return found
