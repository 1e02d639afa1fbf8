"""A bigram language model in a log-frequency Bloom filter.

Training counts every word and word pair of the training documents. A count c
is quantised to the level 1 + floor(log2 c), and the Bloom filter holds the
n-gram once for each level up to its own; probing the levels upwards until
the first miss gives the level back, so a false positive costs one level at
most times its small chance. Scoring smooths what the probes return:

    P(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P(w | u) = (c(u w) + mu P(w)) / (c(u) + mu)

(Dirichlet smoothing; quantised counts stand for their level's mean, so the
probabilities sum to about 1). A text is scored from a boundary to its end.

The filter is a table of segments and nobody holds it whole. Texts are taken
in slices; a slice sends each of its distinct words and pairs, with their
training counts, to the block that owns them. The block sums the counts
exactly, sizes its segment by the n-grams it found, sets all their levels and
answers every slice with the levels of what that slice sent (and the exact
counts of its words), so one exchange trains and looks up. The answers meet
the slice's word list and give the scores. No n-gram is left out, however
large the corpus is; only hashes, counts and levels are shuffled, no text.

Memory is bounded by a slice (about ``HELD`` tokens) and a block (about
``PER_BLOCK`` tokens' distinct n-grams). A text longer than ``PIECE`` is cut
at white space into slices of its own, each led by the last token of the one
before, and its parts' sums are added up.

Words are identified by 64-bit hashes, pairs by their block and 48 further bits of theirs.

Defined results: a null or empty text is its end token alone; a row without
an id belongs to training; repeated rows are scored one by one; without
training documents every probability is that of N = V = 0; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import MIX_A, MIX_C, corpus_bytes, id_key, id_value, mix, slices_of, texts_as_bytes, word_hashes

#: A byte that no UTF-8 text holds: the token at a text's end, and the context of its first word.
END = xxhash.xxh3_64_intdigest(b"\xff")
_BLANK = re.compile(rb"\s")
ADDED = 0.1
#: Strength of the word probabilities against a context's counts.
MU = 500.0

#: Bits of a segment for every level of every n-gram in it.
BITS_PER_ENTRY = 8
PROBES = 4
BYTES_PER_WORD = 6
#: Tokens of the corpus per block, about.
PER_BLOCK = 1 << 22
#: Tokens of a slice, about.
HELD = 1 << 20
#: Text bytes tokenised at once.
PIECE = 1 << 20


def held_out(id_column: Column) -> Column:
    """True for a tenth of the ids: crc32 of the id as text divides by 10."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens in a row (A-Z lower-cased, each text closed by the end token); tokens per text."""
    words = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = word_hashes([w for own in words for w in own])
    return np.insert(flat, np.cumsum(counts), np.uint64(END)), counts + 1


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    """The hash of every token with the one in front; in front of a text's first stands an end."""
    before = np.concatenate([np.array([END], np.uint64), tokens[:-1]])
    return mix(before * MIX_A + tokens)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1].astype(np.int64)


def level_mean(level: np.ndarray) -> np.ndarray:
    """Mean of the counts of a level; 0 for level 0."""
    return np.where(level > 0, (2.0 ** (level - 1) + 2.0 ** level - 1) / 2, 0.0)


def positions(keys: np.ndarray, level: int, segment_bits: int):
    """For each probe, the bit inside the n-gram's segment."""
    g = mix(keys + np.uint64(int(MIX_C) * level % (1 << 64)))
    step = (g >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((g + np.uint64(i) * step) % np.uint64(segment_bits)).astype(np.int64)


class Segment:
    """The filter's bits for the n-grams of one block."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Segment:
        """As large as the n-grams with a count need."""
        keys, level = keys[counts > 0], levels(counts[counts > 0])
        is_set = np.zeros(8 * max(8, -(-BITS_PER_ENTRY * int(level.sum()) // 8)), np.uint8)
        for at in range(1, int(level.max(initial=0)) + 1):
            for p in positions(keys[level >= at], at, len(is_set)):
                is_set[p] = 1
        return cls(np.packbits(is_set, bitorder="little"))

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level of every n-gram: probes upwards until the first miss."""
        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        at = 1
        while len(left) and at <= 64:
            hits = np.ones(len(left), bool)
            for p in positions(keys[left], at, 8 * len(self.bits)):
                hits &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
            left = left[hits]
            out[left] = at
            at += 1
        return out


def mass(n_tokens: int, n_words: int) -> float:
    return n_tokens + ADDED * (n_words + 1)


def narrow(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs: all lowest bytes, then all next ones, which compress well."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers back from :func:`narrow`."""
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.view("<i8").ravel()


def by_block(spread: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams' order by block, and where each block begins and ends in it."""
    block = (spread % np.uint64(n_blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    return order, np.searchsorted(block[order], np.arange(n_blocks + 1))


def in_block(spread: np.ndarray) -> np.ndarray:
    """The six bytes that are sent of an n-gram; its block is known by the others."""
    return (spread >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def from_block(data: bytes) -> np.ndarray:
    """What :func:`in_block` sent, as numbers."""
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def blocks(n_bytes: int) -> int:
    return 1 << max(3, (n_bytes // (BYTES_PER_WORD * PER_BLOCK)).bit_length())


_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(*arrays: bytes) -> bytes:
    """Several arrays as one, compressed."""
    whole = b"".join([np.array([len(arrays), *map(len, arrays)], "<u4").tobytes(), *arrays])
    return len(whole).to_bytes(8, "little") + _ZSTD.compress(whole, asbytes=True)


def unpack(data: bytes) -> list[bytes]:
    """The arrays back from :func:`pack`."""
    whole = _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n = int(np.frombuffer(whole, "<u4", 1)[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(whole, "<u4", n, 4), dtype=np.int64)
    return [whole[a:b] for a, b in zip([4 + 4 * n, *ends.tolist()], ends.tolist())]


def pieces(text: bytes, size: int = PIECE):
    """The text cut at white space into pieces of about ``size`` bytes."""
    at = 0
    while len(text) - at > size:
        cut = _BLANK.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


class Slice:
    """Parts of texts whose tokens follow one another: hashes of all tokens,
    and for each part its row, id, whether that is held out, its number of
    tokens and whether the first of them only leads (it is the last token of
    the part before, in another slice)."""

    def __init__(self, tokens, rows, keys, held, counts, leads):
        self.tokens, self.rows, self.keys, self.held, self.counts, self.leads = tokens, rows, keys, held, counts, leads
        self.begin = np.cumsum(counts) - counts

    @classmethod
    def of(cls, parts: list[tuple]) -> Slice:
        return cls(*(np.concatenate(x) for x in zip(*parts)))

    def own(self) -> np.ndarray:
        """Which tokens are the parts' own."""
        out = np.ones(len(self.tokens), bool)
        out[self.begin[self.leads]] = False
        return out

    def sent(self, n_blocks: int) -> tuple[list[bytes], bytes]:
        """What goes to each block, and what is needed to score the slice when the answers are there."""
        training = np.repeat(~self.held, self.counts) & self.own()
        vocabulary, at, times = np.unique(self.tokens, return_inverse=True, return_counts=True)
        often = np.argsort(-times, kind="stable")  # frequent words get small numbers
        vocabulary, at = vocabulary[often], np.argsort(often)[at]
        distinct, pair_at = np.unique(pair_hashes(self.tokens), return_inverse=True)
        columns = []
        for own, where, spread in ((vocabulary, at, mix(vocabulary)), (distinct, pair_at, distinct)):
            times = np.bincount(where[training], minlength=len(own))
            order, bounds = by_block(spread, n_blocks)
            keys, times = (in_block(own) if own is distinct else own)[order], times[order]
            columns.append([keys[s:e].tobytes() for s, e in zip(bounds, bounds[1:])])
            columns.append([narrow(times[s:e]) for s, e in zip(bounds, bounds[1:])])
        known = pack(self.rows.tobytes(), self.keys.tobytes(), self.held.tobytes(), self.leads.tobytes(), narrow(self.counts),
                     vocabulary.tobytes(), narrow(at))
        return [pack(*own) for own in zip(*columns)], known

    @classmethod
    def known(cls, data: bytes) -> tuple[Slice, np.ndarray, np.ndarray]:
        """The slice back from what :meth:`sent` kept of it, its vocabulary, and each token's place in that."""
        rows, keys, held, leads, counts, vocabulary, at = unpack(data)
        rows, vocabulary = np.frombuffer(rows, np.int64), np.frombuffer(vocabulary, np.uint64)
        counts = widened(counts, len(rows))
        at = widened(at, int(counts.sum()))
        return cls(vocabulary[at], rows, np.frombuffer(keys, np.int64), np.frombuffer(held, bool), counts,
                   np.frombuffer(leads, bool)), vocabulary, at


def slices(docs: DataFrame, held: Column, n_blocks: int, id_col: str, text_col: str) -> DataFrame:
    """``block, slice, data``: a row of every slice for every block, and under
    a negative block one of every slice with what is known of it."""
    schema = pa.schema([("block", pa.int64()), ("slice", pa.int64()), ("data", pa.binary())])

    def rows_of(part: Slice, number: int):
        sent, known = part.sent(n_blocks)
        via = -1 - int(mix(np.array([number], np.uint64))[0] % np.uint64(n_blocks))
        yield pa.RecordBatch.from_arrays([pa.array([*range(n_blocks), via]), pa.array([number] * (n_blocks + 1)),
                                          pa.array([*sent, known], pa.binary())], schema=schema)

    def long_text(text: bytes, row, key, is_held):
        """The parts of a long text, each a slice of its own; the first is led by an end."""
        before, leads = np.array([END], np.uint64), np.ones(1, bool)
        for piece in pieces(text):
            tokens = np.concatenate([before, token_hashes([piece])[0][:-1]])
            if len(tokens) > 1:
                yield tokens, row, key, is_held, np.array([len(tokens)]), leads
                before = tokens[-1:]
        yield np.array([before[0], END], np.uint64), row, key, is_held, np.array([2]), leads

    def read(batches):
        first = TaskContext.get().partitionId() << 40
        number, row, n_held, waiting = TaskContext.get().partitionId() << 32, first, 0, []
        for batch in batches:
            for part in slices_of(batch, "text", PIECE):
                texts, n = texts_as_bytes(part.column("text")), part.num_rows
                rows, keys = np.arange(row, row + n), part.column("key").to_numpy()
                is_held = part.column("held").to_numpy(zero_copy_only=False)
                row += n
                if max(map(len, texts)) > PIECE:
                    parts = [p for i in range(n) for p in long_text(texts[i], rows[i:i + 1], keys[i:i + 1], is_held[i:i + 1])]
                    apart = True
                else:
                    tokens, counts = token_hashes(texts)
                    parts, apart = [(tokens, rows, keys, is_held, counts, np.zeros(n, bool))], False
                for own in parts:
                    if n_held and (apart or n_held > HELD):
                        yield from rows_of(Slice.of(waiting), number)
                        number, n_held, waiting = number + 1, 0, []
                    waiting.append(own)
                    n_held += len(own[0])
                if apart:
                    yield from rows_of(Slice.of(waiting), number)
                    number, n_held, waiting = number + 1, 0, []
        if n_held:
            yield from rows_of(Slice.of(waiting), number)

    rows = docs.select(id_key(F.col(id_col)).alias("key"), held.alias("held"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(read, "block long, slice long, data binary")


class Block:
    """The exact sums of what the slices sent to a block, and its segment."""

    def __init__(self, sent: list[bytes]):
        columns = list(zip(*map(unpack, sent)))
        self.at, self.counts, sums = {}, {}, []
        for name, keys, times in (("word", *columns[:2]), ("pair", *columns[2:])):
            keys = [np.frombuffer(b, np.uint64) if name == "word" else from_block(b) for b in keys]
            times = [widened(b, len(k)) for b, k in zip(times, keys)]
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            self.counts[name] = np.zeros(len(distinct), np.int64)
            np.add.at(self.counts[name], at, np.concatenate(times))
            self.at[name] = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
            sums.append(mix(distinct) >> np.uint64(16) if name == "word" else distinct)
        self.spread = dict(zip(("word", "pair"), sums))
        self.segment = Segment.of(np.concatenate(sums), np.concatenate(list(self.counts.values())))
        self.n, self.total = int((self.counts["word"] > 0).sum()), int(self.counts["word"].sum())

    def answers(self) -> list[bytes]:
        """For every slice the exact counts of its words and the levels of its words and pairs."""
        level = {name: self.segment.level(self.spread[name]).astype(np.uint8) for name in self.spread}
        return [pack(narrow(self.counts["word"][w]), level["word"][w].tobytes(), level["pair"][p].tobytes())
                for w, p in zip(self.at["word"], self.at["pair"])]


def score_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all rows that are not held out and score every row: ``id_col,
    held_out, n_tokens, n_known, train_tokens, base_score`` (exact unigrams)
    and ``score`` (the filter's bigrams)."""
    n_blocks = blocks(corpus_bytes(docs, text_col))
    answers = pa.schema([("slice", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("data", pa.binary())])

    def answer(key, group):
        n = total = 0
        data = group.column("data")
        if key[0].as_py() >= 0:
            block = Block(data.to_pylist())
            n, total, data = block.n, block.total, pa.array(block.answers(), pa.binary())
        rows = group.num_rows
        return pa.Table.from_arrays([group.column("slice"), group.column("block"), pa.array([n] * rows, pa.int64()),
                                     pa.array([total] * rows, pa.int64()), data], schema=answers)

    result = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("held", pa.bool_()), ("tokens", pa.int64()), ("known", pa.int64()),
                        ("train", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def assemble(group):
        group = group.sort_by("block")  # what the slice knows is first
        n_tokens = sum(group.column("total").to_pylist())
        whole = mass(n_tokens, sum(group.column("n").to_pylist()))
        data = group.column("data").to_pylist()
        part, vocabulary, at = Slice.known(data[0])
        distinct, pair_at = np.unique(pair_hashes(part.tokens), return_inverse=True)
        counts_of, word_levels, pair_levels = zip(*map(unpack, data[1:]))
        by_word, bounds = by_block(mix(vocabulary), n_blocks)
        times = np.empty(len(vocabulary), np.int64)
        times[by_word] = np.concatenate([widened(b, e - s) for b, s, e in zip(counts_of, bounds, bounds[1:])])
        mean = []
        for order, found in ((by_word, word_levels), (by_block(distinct, n_blocks)[0], pair_levels)):
            level = np.empty(len(order), np.int64)
            level[order] = np.frombuffer(b"".join(found), np.uint8)
            mean.append(level_mean(level))
        own = mean[0][at]
        # in front of a slice's first token stands an end; in a slice without one the first token only leads
        start = mean[0][vocabulary == np.uint64(END)]
        before = np.concatenate([start if len(start) else [0.0], own[:-1]])
        both = np.minimum(mean[1][pair_at], before)
        score = np.log10((both + MU * (own + ADDED) / whole) / (before + MU))
        counted = part.own()
        base = (np.log10(times + ADDED) - np.log10(whole))[at]

        def summed(x):
            return pa.array(np.add.reduceat(np.where(counted, x, 0), part.begin))

        return pa.Table.from_arrays(
            [pa.array(part.rows), pa.array(part.keys), pa.array(part.held), summed(np.ones(len(at), np.int64)),
             summed((times > 0).astype(np.int64)[at]), pa.array(np.full(len(part.rows), n_tokens, np.int64)), summed(base), summed(score)],
            schema=result)

    sent = slices(docs, held_out(F.col(id_col)), n_blocks, id_col, text_col)
    answered = sent.groupBy("block").applyInArrow(answer, "slice long, block long, n long, total long, data binary")
    parts = answered.groupBy("slice").applyInArrow(
        assemble, "row long, key long, held boolean, tokens long, known long, train long, base double, score double")
    # only the parts of very long texts add up; the others are one each
    whole = parts.groupBy("row", "key", "held", "train").agg(*[F.sum(c).alias(c) for c in ("tokens", "known", "base", "score")])
    return whole.select(id_value(F.col("key")).alias(id_col), F.col("held").alias("held_out"),
                        F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
                        F.col("train").alias("train_tokens"), F.col("base").alias("base_score"), "score")
