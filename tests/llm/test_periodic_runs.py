import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from brute_force import WORD, documents, edge_rows, made_up, sha
from hypothesis import given, settings
from hypothesis import strategies as st

import ledgerline.llm.periodic_runs as pr


def plain_runs(words):
    """Every maximal stretch of equal words q apart, smallest period first."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            x = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - x >= max(24, 3 * q):
                out.setdefault((x, i + q), q)
    return sorted((a, b, q) for (a, b), q in out.items())


def expected(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    dropped = {i for a, b, q in runs for i in range(a + q, b)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2])) if runs else None
    strongest = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *strongest, sha(lines), sha(kept))


def test_table_equals_brute_force(spark):
    rng = random.Random(3)
    repeats = " ".join(["one two three"] * 20 + ["x"] + ["one two"] * 30 + ["y"] * 40)
    tens = [i for i in range(30, 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = ([(i, t if len(t or "") < 50_000 else t[:9000]) for i, t in edge_rows()]
            + [(i, made_up(rng, rng.randint(1, 300))) for i in tens]
            + [(500, repeats), (501, repeats), (502, repeats + " tail " + repeats), (None, repeats)])
    got = sorted(map(repr, map(tuple, pr.run_table(documents(spark, rows)).collect())))
    assert got == sorted(repr(expected(i, t)) for i, t in rows)


def shaped(rng):
    """A text of few or many words, with stretches repeated over what followed them."""
    n, k = rng.choice([0, 1, 10, 30, 80, 200, 400]), rng.choice([1, 2, 3, 5, 40])
    words = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 4 else 0):
        a = rng.randrange(n)
        block = words[a:a + rng.randint(1, max(1, (n - a) // 3))]
        for i in range(rng.randint(1, n - a)):
            words[a + i] = block[i % len(block)]
    return words


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    docs = [shaped(rng) for _ in range(rng.randint(1, 15))]
    docs += [list(rng.choice(docs)) for _ in range(3)] + [rng.choice(docs) + rng.choice(docs) * 2]
    got = pr.runs_of(np.array([w for d in docs for w in d], np.int64), np.array([len(d) for d in docs]))
    assert [got.get(i, []) for i in range(len(docs))] == [plain_runs(d) for d in docs]


def test_grammar_spells_the_texts_and_leaves_no_pair_twice():
    rng = np.random.default_rng(1)
    ids, sizes = rng.integers(0, 6, 3000), np.array([1, 0, 999, 1500, 500])
    last = np.zeros(3000, bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    g = pr.Grammar(ids, last)

    def spelled(s):
        return [s] if s < g.first_rule else spelled(int(g.left[s - g.first_rule])) + spelled(int(g.right[s - g.first_rule]))

    assert [w for s in g.symbols.tolist() for w in spelled(s)] == ids.tolist()
    for i, (place, n) in enumerate(zip(g.place.tolist(), g.length.tolist())):
        assert spelled(g.first_rule + i) == ids[place:place + n].tolist()
    ends = set((np.cumsum(sizes) - 1).tolist())
    pairs = [(a, b) for a, b, at in zip(g.symbols.tolist(), g.symbols.tolist()[1:], g.at.tolist()[1:]) if at - 1 not in ends]
    twice = {p for p in pairs if pairs.count(p) > 1}
    assert all(a == b for a, b in twice)  # such a pair only overlaps itself


def test_run_inside_a_repeated_passage_is_found_everywhere():
    passage = [7, 8, 9] * 10 + list(range(100, 160))
    text = passage + [1] + passage + [2] + passage
    got = pr.runs_of(np.array(text), np.array([len(text)]))
    assert got[0] == [(0, 30, 3), (91, 121, 3), (182, 212, 3)] == plain_runs(text)


@pytest.mark.parametrize("block", [[0], [0, 1, 2, 3, 4, 5, 6], list(range(5000))])
def test_very_long_run(block):
    ids = np.tile(block, -(-200_000 // len(block)))
    assert pr.runs_of(ids, np.array([len(ids)])) == {0: [(0, len(ids), len(block))]}


def test_words_between_runs_and_short_stretches_stay(spark):
    text = " ".join(["a b"] * 11)  # 22 words are too few
    row = pr.find_runs(documents(spark, [(None, text)])).first()
    assert (row["n_words"], row["runs"], row["collapsed"]) == (22, [], text)


def test_empty_table(spark):
    assert pr.run_table(documents(spark, [])).collect() == []
