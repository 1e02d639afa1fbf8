"""Plain, slow versions of what the operators compute, and the rows they are tried on."""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import xxhash
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = (1 << 63) - 1

#: The columns of documents, and extra ones named like the operators' own.
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
    ("n_chars", T.LongType()), ("id", T.StringType()), ("key", T.DoubleType()), ("row", T.BooleanType()),
    ("spans", T.StringType()), ("fp", T.LongType()), ("block", T.ArrayType(T.StringType())), ("kept", T.LongType()))])


def documents(spark, rows):
    """``rows``: (doc_id, text) pairs."""
    return spark.createDataFrame(
        [(i, t, None, "a/test/b.py" if i else None, None, "x", 1.5, True, "s", 7, None, None) for i, t in rows], SCHEMA)


def made_up(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, repeats, ties, near copies, a very long text, odd characters."""
    rng = random.Random(seed)
    base, passage = made_up(rng, 120), made_up(rng, 70)
    near = base.split()
    near[60] = "changed"
    long = made_up(rng, 30_000, 50_000)
    return [
        (None, None), (None, ""), (None, base), (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "one two three"),
        (6, base), (6, base), (7, base), (8, " ".join(near)), (9, base.upper()), (10, passage),
        (11, made_up(rng, 30) + " " + passage + "\n" + made_up(rng, 30)), (12, passage + " " + passage),
        (13, "Ünïcödé \U0001F600   　 é́ 'tis it's 12 345 ,.!?  x"), (14, long), (-15, base + " tail"),
        (16, "same same " * 200), (17, "a" * 5000), (18, "line one\nline one\n\nline one\nother"),
        (19, "mail me@host.example.org or +1 (301) 555-0346, 10.0.0.255 and 10.0.0.256 4111 1111 1111 1111"), (20, base),
    ]


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def fingerprint(text: str | None, size: int = 4) -> int:
    words = WORD.findall(lowered(text))
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius: int = 4) -> list[tuple]:
    """(doc_id, fingerprint, smallest id of its component) of every row."""
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                label[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, LONG), LONG if doc is None else doc)
    return [(doc, f"{fps[i]:016x}", None if least[find(i)] == LONG else least[find(i)]) for i, (doc, _) in enumerate(rows)]


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    words = WORD.findall(text or "")
    times = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if times[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def entities(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) by the contract's plain patterns."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15))
    return sorted((m.start(), rank, m.end(), kind) for rank, (kind, pattern, valid) in enumerate(kinds)
                  for m in re.finditer(pattern, text or "") if valid(m[0]))


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def without_repeats(rows, window: int = 50) -> list[tuple]:
    """(doc_id, words, removed, digest of the kept words)."""
    least: dict[tuple, int] = {}
    words = [WORD.findall(t or "") for _, t in rows]
    ids = [LONG if i is None else i for i, _ in rows]
    for i, w in zip(ids, words):
        for a in range(len(w) - window + 1):
            k = tuple(w[a:a + window])
            least[k] = min(i, least.get(k, i))
    out = []
    for (doc, _), i, w in zip(rows, ids, words):
        gone = set()
        for a in range(len(w) - window + 1):
            if least[tuple(w[a:a + window])] < i:
                gone.update(range(a, a + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def leaks(rows, items, similarity: float = 0.8) -> dict[tuple, float]:
    """(doc_id, item_id) -> best similarity over item-sized windows."""
    bare = str.maketrans("", "", string.punctuation)
    words = lambda t: WORD.findall((t or "").lower().translate(bare))
    found = {}
    for item, text in items:
        own = words(text)
        if not own:
            continue
        size = min(5, len(own))
        shingles = Counter(tuple(own[i:i + size]) for i in range(len(own) - size + 1))
        n = sum(shingles.values())
        for doc, t in rows:
            w = words(t)
            s = [tuple(w[i:i + size]) for i in range(len(w) - size + 1)]
            held = min(n, len(s))
            for a in range(len(s) - held + 1 if s else 0):
                c = Counter(s[a:a + held])
                both = sum((c & shingles).values())
                value = both / (held + n - both)
                if value >= similarity:
                    found[doc, item] = max(value, found.get((doc, item), 0))
    return found


def unigram_rows(rows) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, N, V, tokens' counts)."""
    tokens = [WORD.findall(lowered(t)) + ["\0"] for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(x for t, h in zip(tokens, out) if not h for x in t)
    n = sum(counts.values())
    return [(i, h, len(t), sum(counts[x] > 0 for x in t), n, len(counts), [counts[x] for x in t])
            for (i, _), h, t in zip(rows, out, tokens)]
