"""SentencePiece encoding and decoding by vectorised merge rounds.

The model file's pieces and scores are read through the sentencepiece library;
the merging is done here, on flat numpy arrays that hold the symbols of very
many words at once. The normalised text (every space a ``▁``, one ``▁`` in
front) falls into words at each run of ``▁``, because no piece holds a ``▁``
behind another character, and every distinct word is merged once per worker
and remembered up to a bound. Words fall further into *stretches* at
neighbours that stand side by side in no piece, so the length of a text does
not matter.

One round, for all stretches together: look up every neighbouring pair's
piece, take the best score of each stretch (a segmented minimum of ranks),
merge its pairs of that rank at once, from the left and without overlap, and
close the gaps. Stretches without a pair leave; the rounds end when none is
left.

The library merges one pair at a time. Merging several at once differs from
that only if a merge makes a new pair that ranks as good as the ones merged
with it. Stretches in which that happens (runs of spaces, whose pieces all
share one score) go through an agenda of single merges instead.

Characters that no piece stands for become their UTF-8 bytes' pieces.
Decoding is the library's ``decode``.

Defined results: a null or empty text has no ids and decodes to the empty
text; a literal ``▁`` is a space, as in the library; repeated rows are encoded
one by one; an empty table gives an empty result; extra columns are ignored.
A model that normalises, has no byte pieces, or splits words otherwise than
described is refused with ``ValueError``.
"""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import slices_of, texts_as_bytes

SPACE = "▁"
#: A character without a piece of its own is the symbol CHARACTER + its code point.
CHARACTER = 1 << 24
#: Words remembered by a worker (about 150 bytes each).
REMEMBERED = 600_000
#: Text bytes encoded together.
SLICE_BYTES = 4 << 20
NONE = np.int64(1 << 40)


@functools.lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


class Pieces:
    """The model as lookup tables: characters to symbols, pairs to pieces, pieces to ranks."""

    def __init__(self, path: str):
        sp = processor(path)
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(sp.is_byte(i) for i in self.byte_ids.tolist()) or any(sp.is_unused(i) for i in plain):
            raise ValueError("needs a model with byte pieces and without unused ones")
        if sp.normalize("a ﬁ  b") != f"{SPACE}a{SPACE}ﬁ{SPACE}{SPACE}b":
            raise ValueError("needs a model that only puts a space in front and keeps all others")
        if any(re.search(f"[^{SPACE}]{SPACE}", texts[i]) for i in plain):
            raise ValueError("needs pieces that hold spaces at their front only")
        number = {texts[i]: i for i in plain}
        self.symbols = np.arange(0x110000, dtype=np.int64) + CHARACTER
        for i in plain:
            if len(texts[i]) == 1:
                self.symbols[ord(texts[i])] = i
        scores = np.array([-sp.get_score(i) for i in plain])
        self.rank = np.full(n, NONE)
        self.rank[plain] = np.unique(scores, return_inverse=True)[1]

        def symbol(part: str) -> int | None:
            return number.get(part, CHARACTER + ord(part) if len(part) == 1 else None)

        pairs, near = {}, set()
        for i in plain:
            t = texts[i]
            near.update(symbol(a) << 32 | symbol(b) for a, b in zip(t, t[1:]))
            for k in range(1, len(t)):
                left, right = symbol(t[:k]), symbol(t[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self.near = np.array(sorted(near), np.int64)
        #: A line feed that no longer piece holds begins a word as well.
        self.lines_apart = not any("\n" in texts[i] for i in plain if len(texts[i]) > 1)
        self.word = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*" if self.lines_apart else f"{SPACE}+[^{SPACE}]*")

    def words(self, text: str) -> list[str]:
        """The normalised text's words, each without the first ``▁`` if it starts with one."""
        if not text:
            return []
        if self.lines_apart and "  " not in text and text[0] != " " and SPACE not in text:
            return text.replace("\n", " \n").split(" ")
        found = self.word.findall(SPACE + text.replace(" ", SPACE))
        return [w[1:] if w[0] == SPACE else w for w in found]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that every pair merges to (-1: none) and its rank."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        piece = np.where(self.pairs[at] == keys, self.merged[at], -1)
        return piece, np.where(piece >= 0, self.rank[piece], NONE)

    def glued(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether some piece holds the two characters side by side."""
        keys = left << 32 | right
        return self.near[np.minimum(np.searchsorted(self.near, keys), len(self.near) - 1)] == keys


def one_by_one(pieces: Pieces, symbols: list[int]) -> list[tuple[int, int]]:
    """Single merges by an agenda, best rank first, then from the left:
    ``(place, symbol)`` of what is left."""
    n = len(symbols)
    own, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def look(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in known:
            piece, rank = pieces.pair(np.array([a]), np.array([b]))
            known[a, b] = int(piece[0]), int(rank[0])
        return known[a, b]

    agenda = []

    def propose(i: int) -> None:
        if i >= 0 and after[i] < n:
            piece, rank = look(own[i], own[after[i]])
            if piece >= 0:
                agenda.append((rank, i, own[i], own[after[i]], piece))

    for i in range(n - 1):
        propose(i)
    heapq.heapify(agenda)
    while agenda:
        _, i, a, b, piece = heapq.heappop(agenda)
        j = after[i]
        if own[i] != a or j >= n or own[j] != b:
            continue
        own[i], own[j], after[i] = piece, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n:
                piece, rank = look(own[k], own[after[k]])
                if piece >= 0:
                    heapq.heappush(agenda, (rank, k, own[k], own[after[k]], piece))
    return [(i, s) for i, s in enumerate(own) if s >= 0]


def first_of_runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def merge_rounds(pieces: Pieces, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge all words' symbols (``word``: ascending numbers): the symbols left, and each one's word."""
    if not len(symbols):
        return symbols, word
    place = np.arange(len(symbols))
    joined = (word[1:] == word[:-1]) & pieces.glued(symbols[:-1], symbols[1:])
    stretch = np.cumsum(np.concatenate([[0], ~joined]))
    piece, rank = np.full(len(symbols), -1, np.int64), np.full(len(symbols), NONE)
    at = np.flatnonzero(joined)
    piece[at], rank[at] = pieces.pair(symbols[at], symbols[at + 1])
    done_place, done_symbol = [], []
    source = word
    while len(symbols):
        start = first_of_runs(stretch)
        size = np.diff(np.append(start, len(symbols)))
        best = np.minimum.reduceat(rank, start)
        alive = np.repeat(best < NONE, size)
        done_place.append(place[~alive])
        done_symbol.append(symbols[~alive])
        if not alive.any():
            break
        wanted = np.repeat(best, size)[alive]
        symbols, place, stretch, piece, rank = (x[alive] for x in (symbols, place, stretch, piece, rank))
        # of neighbouring hits every other one, from the left
        hit = np.flatnonzero(rank == wanted)
        run = np.flatnonzero(np.concatenate([[True], np.diff(hit) > 1]))
        at = hit[(hit - np.repeat(hit[run], np.diff(np.append(run, len(hit))))) % 2 == 0]
        left = np.ones(len(symbols), bool)
        left[at + 1] = False
        old = symbols, place, stretch
        symbols = symbols.copy()
        symbols[at] = piece[at]
        # a merged pair's right half handed its own pair on: all pairs beside a merge are looked up again
        symbols, place, stretch, piece, rank, wanted = (x[left] for x in (symbols, place, stretch, piece, rank, wanted))
        new = np.cumsum(left)[at] - 1
        touched = np.zeros(len(symbols), bool)
        touched[new] = True
        touched[new[new > 0] - 1] = True
        beside = np.flatnonzero(touched)
        ends = (beside + 1 >= len(symbols)) | (stretch[np.minimum(beside + 1, len(symbols) - 1)] != stretch[beside])
        piece[beside[ends]], rank[beside[ends]] = -1, NONE
        beside = beside[~ends]
        piece[beside], rank[beside] = pieces.pair(symbols[beside], symbols[beside + 1])
        # merges made at once must not bring up a pair that ranks as good as themselves
        several = old[2][at]
        several = several[1:][several[1:] == several[:-1]]
        early = stretch[beside[rank[beside] <= wanted[beside]]]
        clash = np.intersect1d(several, early)
        for number in clash.tolist():
            a, b = np.searchsorted(old[2], [number, number + 1])
            for i, s in one_by_one(pieces, old[0][a:b].tolist()):
                done_place.append(old[1][a + i:a + i + 1])
                done_symbol.append(np.array([s]))
        if len(clash):
            stays = ~np.isin(stretch, clash)
            symbols, place, stretch, piece, rank = (x[stays] for x in (symbols, place, stretch, piece, rank))
    place, symbols = np.concatenate(done_place), np.concatenate(done_symbol)
    order = np.argsort(place)
    return symbols[order], source[place[order]]


class Places(dict):
    """Numbers words in the order of their first use; ``fresh`` are those not encoded yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.fresh.append(word)
        return place


class Encoder:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.forget()

    def forget(self) -> None:
        self.places = Places()
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, words: list[str]) -> None:
        words = [w if self.pieces.lines_apart and w[:1] == "\n" else SPACE + w for w in words]
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols, word = merge_rounds(self.pieces, self.pieces.symbols[points], np.repeat(np.arange(len(words)), sizes))
        strange = np.flatnonzero(symbols >= CHARACTER)
        if len(strange):
            own = [chr(s - CHARACTER).encode() for s in symbols[strange].tolist()]
            times = np.ones(len(symbols), np.int64)
            times[strange] = [len(b) for b in own]
            word, symbols = np.repeat(word, times), np.repeat(symbols, times)
            symbols[symbols >= CHARACTER] = self.pieces.byte_ids[np.frombuffer(b"".join(own), np.uint8)]
        length = np.bincount(word, minlength=len(words))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, symbols.astype(np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and ids per text."""
        if len(self.places) > REMEMBERED:
            self.forget()
        words, sizes = [], []
        for text in texts:
            own = self.pieces.words(text)
            words += own
            sizes.append(len(own))
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        if self.places.fresh:
            self.learn(self.places.fresh)
            self.places.fresh = []
        length = self.length[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.arange(int(ends[-1])) + np.repeat(self.start[at] - ends[:-1], length)]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` of every row of ``docs``; no shuffle."""
    out = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for part in slices_of(batch, "text", SLICE_BYTES):
                texts = [t.decode("utf-8", "replace") for t in texts_as_bytes(part.column("text"))]
                ids, counts = encoder(path).encode(texts)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, ids, decoded string``: the library's text for every row's ids; a null array: the empty text."""
    out = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        sp = processor(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [sp.decode(ids) if ids else "" for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("ids").cast(out.field("ids").type), pa.array(texts, pa.string())],
                    schema=out)

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode again, and describe both by length and SHA-256."""
    both = decode_documents(encode_documents(docs, path, id_col, text_col), path, id_col)
    return both.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
