"""Byte-level BPE encoding and decoding with a local tiktoken rank file.

Texts are encoded by the tiktoken library without special tokens, each match
of the split pattern by itself. A long text is first cut at *safe boundaries*:
places between a non-space and a space character. No match of the pattern
spans such a place and no look-ahead looks past it, so the pieces' ids joined
are the whole text's ids, while a piece keeps the library's regex and merge
buffers small. A text without such a place is one piece. A very long run of
white space is one match of the pattern, all of it at the text's end and
otherwise all but its last character; the library merges its bytes without
matching it, because its matcher gives up on runs of about a million.

Decoding joins the raw bytes of the ids, so ids that cut a character in two
come back unharmed.

Defined results: a null or empty text has no ids and decodes to no bytes;
repeated rows are encoded one by one; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import slices_of

#: Characters after which a long text is cut at the next safe boundary.
PIECE_CHARS = 1 << 16

_SAFE = regex.compile(r"(?<=\S)(?=\s)")
#: Unicode's white space, as the split pattern's ``\s`` knows it, in runs too long for the pattern's matcher.
_LONG_BLANK = regex.compile("[ \t\n\v\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % PIECE_CHARS)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file; one per worker and file."""
    import tiktoken
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def safe_pieces(text: str, piece_chars: int = PIECE_CHARS):
    """The text cut into pieces of at least ``piece_chars`` characters, each
    ending at a safe boundary (the last: at the end)."""
    at = 0
    while len(text) - at > piece_chars:
        cut = _SAFE.search(text, at + piece_chars)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


def encode_text(text: str | None, path: str, pattern: str, piece_chars: int = PIECE_CHARS) -> np.ndarray:
    enc = encoding(path, pattern)
    if not text:
        return np.empty(0, np.uint32)
    if len(text) <= piece_chars:
        return enc.encode_to_numpy(text, disallowed_special=())
    found, at = [], 0
    for run in _LONG_BLANK.finditer(text):
        found += [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(text[at:run.start()], piece_chars)]
        at = run.end() - (run.end() < len(text))
        found.append(np.array(enc._encode_single_piece(text[run.start():at]), np.uint32))
    found += [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(text[at:], piece_chars)]
    return np.concatenate(found)


def decode_ids(ids, path: str, pattern: str) -> bytes:
    return encoding(path, pattern).decode_bytes(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``id_col, ids array<int>`` of every row of ``docs``; no shuffle."""
    out = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for part in slices_of(batch, "text", 4 << 20):
                ids = [encode_text(t, path, pattern, piece_chars) for t in part.column("text").to_pylist()]
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                values = np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                     ids_col: str = "ids") -> DataFrame:
    """``id_col, ids, decoded binary``: the raw bytes that every row's ids stand for; a null array: no bytes."""
    out = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [enc.decode_bytes(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("ids").cast(out.field("ids").type), pa.array(texts, pa.binary())],
                    schema=out)

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return (rows.mapInArrow(run, "id long, ids array<int>, decoded binary")
            .withColumnRenamed("id", id_col))


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Encode, decode again, and describe both by length and SHA-256."""
    both = decode_documents(encode_documents(docs, path, pattern, id_col, text_col), path, pattern, id_col)
    return both.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
