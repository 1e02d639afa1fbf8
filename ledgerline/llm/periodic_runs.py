"""Maximal periodic runs of words, found in a Re-Pair grammar.

A *run* is a stretch of consecutive words with smallest period q, at least
``max(24, 3 q)`` words long, that no neighbouring word extends keeping period
q. Texts are taken in slices, and the word ids of a slice become one grammar:
pairs that occur twice or more are replaced by nonterminals, frequent ones
first, until every pair occurs once (a pair never spans two documents). What
is left of each document is folded pairwise into a balanced tree, so every
document is the expansion of one binary tree, and passages that occur again
and again, in one document or in many, share their nonterminals.

Every run lies inside the lowest tree node that covers it and crosses the
boundary between that node's halves. So only boundaries are looked at, each
nonterminal's once however often it is derived, and none of expansions under
24 words. At a boundary m a run of period q repeats, q words on, a piece of 16
words or more that holds word m or word m - q; hashes of 8 words find these,
and comparing words makes the result exact. A nonterminal's runs are its
boundary's and its halves'; they are translated to all its places in the
documents, where overlapping intervals of one period merge and the maximal
ones stay.

Everything about a document is decided in its slice: no shuffle, and a lost
task is simply run again. A slice holds about ``SLICE_BYTES`` of text; a
longer text is a slice of its own.

Defined results: a null, empty or blank text has no words, no runs and the
empty collapsed text; repeated rows are judged one by one; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import MIX_A, MIX_B, mix, slices_of, texts_as_bytes

#: A run's least length in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words in a hash: of 16 that repeat, 8 to one side of any word among them do.
HASHED = 8
SLICE_BYTES = 6 << 20
#: Pairs this much rarer than the most frequent one wait for a later round.
RARER = 16
#: Bits of the hash cells in which pairs are counted roughly.
CELL_BITS = 20
#: Boundaries and periods compared at once.
COMPARED = 1 << 21

Run = tuple[int, int, int]  # start, end, period


class Grammar:
    """Re-Pair over the word ids of many documents.

    ``left, right`` are the rules' symbols and ``place`` where each rule's
    first expansion begins; symbols under ``first_rule`` are word ids.
    ``symbols`` and ``at`` are what is left, and where each symbol's expansion
    begins."""

    def __init__(self, ids: np.ndarray, last: np.ndarray):
        self.first_rule = int(ids.max(initial=-1)) + 1
        seq, last, at = ids.astype(np.int64), last.copy(), np.arange(len(ids))
        once = np.zeros(len(seq), bool)  # pairs known to occur once: they stay so until a half is replaced
        left, right, place = [], [], []
        n_rules = 0
        while len(seq) > 1:
            open_ = np.flatnonzero(~(once[:-1] | last[:-1]))
            if not len(open_):
                break
            pair = seq[open_] << 32 | seq[open_ + 1]
            cell = (pair.view(np.uint64) * MIX_A >> np.uint64(64 - CELL_BITS)).astype(np.int64)
            held = np.bincount(cell, minlength=1 << CELL_BITS)[cell]
            once[open_[held < 2]] = True
            open_, pair = open_[held > 1], pair[held > 1]
            if not len(open_):
                break
            order = np.argsort(pair, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], np.diff(pair[order]) != 0]))
            times = np.diff(np.append(start, len(order)))
            once[open_[order[np.repeat(times, times) < 2]]] = True
            least = max(2, int(times.max()) // RARER)
            chosen = np.flatnonzero(times >= least)
            if int(times.max()) < 2:
                break
            # each hit's rule, in the order of the text; of neighbouring hits every other one, from the left
            rule = np.full(len(times), -1)
            rule[chosen] = np.arange(len(chosen))
            own = np.empty(len(order), np.int64)
            own[order] = np.repeat(rule, times)
            hit, own = open_[own >= 0], own[own >= 0]
            run = np.flatnonzero(np.concatenate([[True], np.diff(hit) > 1]))
            even = (hit - np.repeat(hit[run], np.diff(np.append(run, len(hit))))) % 2 == 0
            hit, own = hit[even], own[even]
            # a pair that only overlaps itself, or whose places were all taken, makes no rule
            used, first, own = np.unique(own, return_index=True, return_inverse=True)
            sample = hit[first]
            left.append(seq[sample])
            right.append(seq[sample + 1])
            place.append(at[sample])
            seq[hit] = own + self.first_rule + n_rules
            n_rules += len(used)
            last[hit] = last[hit + 1]
            once[hit] = False
            once[hit[hit > 0] - 1] = False
            kept = np.ones(len(seq), bool)
            kept[hit + 1] = False
            seq, last, at, once = seq[kept], last[kept], at[kept], once[kept]
        none = [np.empty(0, np.int64)]
        self.left, self.right, self.place = (np.concatenate(x + none) for x in (left, right, place))
        self.symbols, self.at = seq, at
        self.length = expansions(self.left, self.right, self.first_rule)


def expansions(left: np.ndarray, right: np.ndarray, first_rule: int) -> np.ndarray:
    """How many words each rule stands for."""
    length: list[int] = []
    for a, b in zip((left - first_rule).tolist(), (right - first_rule).tolist()):
        length.append((1 if a < 0 else length[a]) + (1 if b < 0 else length[b]))
    return np.array(length, np.int64)


def folded(begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes ``begin, middle, end`` of a balanced tree over each document's symbols."""
    nodes = []
    while len(doc):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        number = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
        pairs = np.flatnonzero((number[1:] % 2 == 1) & (doc[1:] == doc[:-1]))
        if not len(pairs):
            break
        nodes.append((begin[pairs], begin[pairs + 1], end[pairs + 1]))
        end = end.copy()
        end[pairs] = end[pairs + 1]
        kept = number % 2 == 0
        begin, end, doc = begin[kept], end[kept], doc[kept]
    none = np.empty(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in zip(*nodes)) if nodes else (none, none, none)


def window_hashes(ids: np.ndarray) -> np.ndarray:
    """A hash of the ``HASHED`` words from each place on; at the end of fewer."""
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    width = 1
    while width < HASHED:
        after = np.zeros_like(h)
        after[:-width] = h[width:]
        h = mix(h * MIX_A + after * MIX_B)
        width *= 2
    return h


def suspects(hashes: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray):
    """``node, place, period``: boundaries that a run of that period may
    cross, where the word at ``place`` would be that of ``place + period``."""
    top = len(hashes) - 1
    periods = (end - begin) // LEAST_PERIODS
    group = (np.cumsum(periods) - periods) // COMPARED
    for own in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(group)) + 1):
        node = np.repeat(own, periods[own])
        upto = np.cumsum(periods[own])
        period = np.arange(len(node)) - np.repeat(upto - periods[own], periods[own]) + 1
        for back in (False, True):
            place = middle[node] - period if back else middle[node]
            far = place + period
            inside = (place >= begin[node]) & (far < end[node])
            near, far = np.clip(place, HASHED, top), np.clip(far, HASHED, top)
            alike = (hashes[near] == hashes[far]) | (hashes[near - HASHED + 1] == hashes[far - HASHED + 1])
            # the first few places have no whole window in front of them
            alike |= place < HASHED
            hit = np.flatnonzero(inside & alike)
            yield node[hit], place[hit], period[hit]


def alike_from(ids: np.ndarray, a: int, b: int, upto: int) -> int:
    """How many words from ``a`` on equal those from ``b`` on, before ``upto``."""
    n, step = 0, 32
    while b + n < upto:
        step = min(step, upto - b - n)
        same = ids[a + n:a + n + step] == ids[b + n:b + n + step]
        if not same.all():
            return n + int(same.argmin())
        n, step = n + step, step * 4
    return n


def alike_before(ids: np.ndarray, a: int, b: int, down: int) -> int:
    """How many words before ``a`` equal those before ``b``, from ``down`` on."""
    n, step = 0, 32
    while a - n > down:
        step = min(step, a - n - down)
        same = ids[a - n - step:a - n] == ids[b - n - step:b - n]
        if not same.all():
            return n + int(same[::-1].argmin())
        n, step = n + step, step * 4
    return n


def boundary_runs(ids: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> dict[int, list[Run]]:
    """For each node the runs across its boundary, inside its expansion."""
    hashes = window_hashes(ids)
    parts = list(suspects(hashes, begin, middle, end)) if len(begin) else []
    if not parts:
        return {}
    node, place, period = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((place, period, node))
    found: dict[int, list[Run]] = {}
    for n, i, q in zip(node[order].tolist(), place[order].tolist(), period[order].tolist()):
        known = found.get(n, ())
        # inside a run of a period that divides this one there is nothing new
        if any(q % p == 0 and a <= i and i + q < b for a, b, p in known):
            continue
        down, upto = int(begin[n]), int(end[n])
        start = i - alike_before(ids, i, i + q, down)
        stop = i + q + alike_from(ids, i, i + q, upto)
        if stop - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
            found.setdefault(n, []).append((start, stop, q))
    return found


def maximal(runs: list[Run]) -> list[Run]:
    """Runs of one period that share a period's length merge; what another one holds goes."""
    out: list[Run] = []
    for start, stop, q in sorted(runs, key=lambda r: (r[2], r[0], -r[1])):
        if out and out[-1][2] == q and start + q <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]), q)
        else:
            out.append((start, stop, q))
    return out


def runs_of(ids: np.ndarray, sizes: np.ndarray) -> dict[int, list[Run]]:
    """The runs of every document that has one (by its number), ordered by
    start and period, as word numbers; ``sizes``: words per document."""
    if not len(ids):
        return {}
    doc_end = np.cumsum(sizes)
    last = np.zeros(len(ids), bool)
    last[doc_end[sizes > 0] - 1] = True
    g = Grammar(ids, last)
    size = np.ones(len(g.symbols), np.int64)
    ruled = g.symbols >= g.first_rule
    size[ruled] = g.length[g.symbols[ruled] - g.first_rule]
    doc = np.searchsorted(doc_end, g.at, side="right")
    begin, middle, end = folded(g.at, g.at + size, doc)
    big = np.flatnonzero(g.length >= LEAST_WORDS)
    halves = np.where(g.left[big] < g.first_rule, 1, g.length[np.maximum(g.left[big] - g.first_rule, 0)])
    wide = end - begin >= LEAST_WORDS
    begin, middle, end = (np.concatenate([a, b[wide]]) for a, b in (
        (g.place[big], begin), (g.place[big] + halves, middle), (g.place[big] + g.length[big], end)))
    found = boundary_runs(ids, begin, middle, end)
    # a nonterminal's runs, as places in its expansion
    of_rule: dict[int, list[Run]] = {}
    left, right, place = (x[big].tolist() for x in (g.left, g.right, g.place))
    for n, rule in enumerate(big.tolist()):
        own = [(a - place[n], b - place[n], q) for a, b, q in found.get(n, ())]
        first, second = of_rule.get(left[n] - g.first_rule), of_rule.get(right[n] - g.first_rule)
        if own or first or second:
            shift = int(halves[n])
            of_rule[rule] = maximal(own + (first or []) + [(a + shift, b + shift, q) for a, b, q in second or ()])
    runs: dict[int, list[Run]] = {}
    doc_begin = doc_end - sizes

    def put(number: int, own: list[Run], shift: int) -> None:
        runs.setdefault(number, []).extend((a + shift, b + shift, q) for a, b, q in own)

    for n in found:
        if n >= len(big):
            number = int(np.searchsorted(doc_end, begin[n], side="right"))
            put(number, found[n], -int(doc_begin[number]))
    if of_rule:
        for i in np.flatnonzero(np.isin(g.symbols, np.array(list(of_rule)) + g.first_rule)).tolist():
            number = int(doc[i])
            put(number, of_rule[int(g.symbols[i]) - g.first_rule], int(g.at[i] - doc_begin[number]))
    return {number: sorted(maximal(own), key=lambda r: (r[0], r[2])) for number, own in runs.items()}


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    kept = np.ones(len(words), bool)
    for start, stop, q in runs:
        kept[start + q:stop] = False
    return b" ".join(w for w, k in zip(words, kept.tolist()) if k)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``id_col, n_words, runs array<struct<start, length, period>>, collapsed``
    of every row; ``rewrite`` may change a document's words first."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    out = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def judged(part):
        keys = part.column("id").to_pylist()
        texts = [t.split() for t in texts_as_bytes(part.column("text"))]
        if rewrite:
            texts = [rewrite(k, words) for k, words in zip(keys, texts)]
        sizes = np.array([len(words) for words in texts], np.int64)
        flat = [w for words in texts for w in words]
        number: dict[bytes, int] = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        runs = runs_of(np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)), sizes)
        ends = np.concatenate([[0], np.cumsum([len(runs.get(i, ())) for i in range(len(keys))])]).astype(np.int32)
        flat_runs = np.array([(a, b - a, q) for i in sorted(runs) for a, b, q in runs[i]], np.int64).reshape(-1, 3)
        rows = pa.StructArray.from_arrays([pa.array(c) for c in flat_runs.T.copy()], fields=list(run_type))
        texts = [(collapsed(words, runs[i]) if i in runs else b" ".join(words)) for i, words in enumerate(texts)]
        return pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), rows),
             pa.array(texts, pa.binary()).cast(pa.string())], schema=out)

    def run(batches):
        for batch in batches:
            for part in slices_of(batch, "text", SLICE_BYTES):
                yield judged(part)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(run, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
                                 "collapsed string").withColumnRenamed("id", id_col))


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail for every tenth id (by the CRC32 of the id as text); no id: as they are."""
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def strongest(runs: Column) -> Column:
    """The run of the greatest length per period (ties: smallest start, then period); null without runs."""
    def better(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    # the runs come by start and period, so the first of equals stays
    return F.reduce(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def run_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite=planted) -> DataFrame:
    """Per document its number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    found = find_runs(docs, id_col, text_col, rewrite).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        F.col(id_col), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
