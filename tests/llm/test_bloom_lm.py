import math
import random
import zlib
from collections import Counter

import numpy as np
from brute_force import documents, edge_rows, lowered, made_up, unigram_rows

import ledgerline.llm.bloom_lm as lm

END = b"\xff"


def checked(spark, rows):
    got = sorted(lm.score_held_out(documents(spark, rows)).collect(), key=repr)
    want = sorted(unigram_rows(rows), key=lambda r: repr((r[0], r[1], r[2])))
    assert len(got) == len(want)
    by = lambda r: (repr(r["doc_id"]), r["n_tokens"], r["base_score"])
    expected = []
    for i, h, n, known, total, distinct, counts in want:
        mass = total + 0.1 * (distinct + 1)
        expected.append((repr(i), n, sum(math.log10((c + 0.1) / mass) for c in counts), h, known, total))
    for r, e in zip(sorted(got, key=by), sorted(expected)):
        assert (repr(r["doc_id"]), r["n_tokens"], r["held_out"], r["n_known"], r["train_tokens"]) == (e[0], e[1], e[3], e[4], e[5])
        assert math.isclose(r["base_score"], e[2], rel_tol=1e-9) and r["score"] < 0
    return got


def test_exact_columns_on_edge_rows(spark):
    checked(spark, edge_rows())


def bigram_scores(rows):
    """(id, tokens, score) by the same smoothing with exact counts instead of levels."""
    train = [lowered(t).encode().split() for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    words, pairs = Counter(), Counter()
    for own in train:
        words.update([*own, END])
        pairs.update(zip([END, *own], [*own, END]))
    whole = sum(words.values()) + 0.1 * (len(words) + 1)
    out = []
    for i, t in rows:
        own = lowered(t).encode().split()
        score = sum(math.log10((pairs[u, w] + lm.MU * (words[w] + 0.1) / whole) / (words[u] + lm.MU))
                    for u, w in zip([END, *own], [*own, END]))
        out.append((repr(i), len(own) + 1, score))
    return sorted(out)


def test_score_is_near_that_of_exact_counts(spark):
    """A count stands for its level's mean, at most a factor of two off, so a
    token's score is at most log10(4) off and far less on the whole."""
    rng = random.Random(4)
    templates = [made_up(rng, 15, 500).split() for _ in range(30)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(0, 8)) for w in rng.choice(templates))) for i in range(300)] + edge_rows()
    got = sorted((repr(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.score_held_out(documents(spark, rows)).collect())
    want = bigram_scores(rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for (_, n, score), (_, _, exact) in zip(got, want):
        assert abs(score - exact) <= n * math.log10(4)
    assert abs(sum(g[2] for g in got) - sum(w[2] for w in want)) < 0.03 * -sum(w[2] for w in want)


def answered(text, n_blocks):
    """What the blocks answer to one slice that holds the text: exact counts and levels in the slice's order."""
    tokens, counts = lm.token_hashes([text.encode()])
    one = np.zeros(1, np.int64)
    part = lm.Slice.of([(tokens, one, one, np.zeros(1, bool), counts, np.zeros(1, bool))])
    sent, known = part.sent(n_blocks)
    blocks = [lm.Block([own]) for own in sent]
    back, vocabulary, at = lm.Slice.known(known)
    assert (back.tokens == tokens).all()
    return tokens, blocks


def test_filter_returns_every_level():
    """No false negatives: a held n-gram's level is never below its own; few are above."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(500)]
    text = " ".join(rng.choice(words, 20_000, p=np.arange(500, 0, -1) / np.arange(501).sum()))
    tokens, blocks = answered(text, 4)
    found = 0
    for block in blocks:
        for name in ("word", "pair"):
            level = block.segment.level(block.spread[name])
            assert (level >= lm.levels(block.counts[name])).all()
            assert (level > lm.levels(block.counts[name])).mean() < 0.05
            found += int(block.counts[name].sum())
        strange = lm.mix(np.arange(1, 5000, dtype=np.uint64)) >> np.uint64(16)
        assert (block.segment.level(strange) > 0).mean() < 0.05
    assert found == 2 * len(tokens)


def test_segments_grow_with_what_is_found():
    small, large = (answered(made_up(random.Random(8), n, 50_000), 1)[1][0] for n in (600, 60_000))
    assert len(large.segment.bits) > 50 * len(small.segment.bits)
    assert (large.segment.level(large.spread["pair"]) >= 1).all()


def test_long_texts_in_parts(spark, monkeypatch):
    """A text cut into slices of its own scores as in one slice."""
    rng = random.Random(11)
    rows = [(i, made_up(rng, rng.randrange(0, 60), 100)) for i in range(40)]
    rows += [(100, made_up(rng, 3000, 100)), (100, " " * 5000), (None, made_up(rng, 2000, 100) + " " * 900), (102, "x" * 4000 + " y"), (103, "")]
    whole = checked(spark, rows)
    monkeypatch.setattr(lm, "PIECE", 700)
    monkeypatch.setattr(lm.pieces, "__defaults__", (700,))
    parts = checked(spark, rows)
    by = lambda r: (repr(r["doc_id"]), r["n_tokens"], r["base_score"])
    for a, b in zip(sorted(whole, key=by), sorted(parts, key=by)):
        assert a["n_tokens"] == b["n_tokens"] and math.isclose(a["score"], b["score"], rel_tol=1e-9)


def test_packing():
    arrays = [b"", b"abc", bytes(1000)]
    assert lm.unpack(lm.pack(*arrays)) == arrays and lm.unpack(lm.pack()) == []
    assert b"".join(lm.pieces(b"aa bb cc" * 50, 7)) == b"aa bb cc" * 50


def test_model_beats_unigrams_on_held_out_text(spark):
    """Sentences from a few templates: word order is worth learning."""
    rng = random.Random(9)
    templates = [made_up(rng, 12, 2000).split() for _ in range(40)]
    rows = [(i, " ".join(w for _ in range(6) for w in rng.choice(templates))) for i in range(300)]
    got = [r for r in checked(spark, rows) if r["held_out"]]
    assert got and sum(r["score"] for r in got) > 0.8 * sum(r["base_score"] for r in got)


def test_without_training_documents_and_empty_table(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = lm.score_held_out(documents(spark, [(i, "a b") for i in held])).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(0, 0, 0.0)] * len(held)
    assert lm.score_held_out(documents(spark, [])).collect() == []


def test_levels():
    assert lm.levels(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]
    assert lm.level_mean(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2.5, 5.5]


def test_scores_do_not_depend_on_slices_and_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, made_up(rng, rng.randrange(0, 90), 200)) for i in range(150)] + edge_rows()
    one = checked(spark, rows)
    monkeypatch.setattr(lm, "HELD", 300)
    monkeypatch.setattr(lm, "BITS_PER_ENTRY", 64)
    monkeypatch.setattr(lm, "blocks", lambda n: 37)
    other = checked(spark, rows)
    by = lambda r: (repr(r["doc_id"]), r["n_tokens"], r["base_score"])
    pairs = list(zip(sorted(one, key=by), sorted(other, key=by)))
    assert sum(abs(a["score"] - b["score"]) for a, b in pairs) < 0.02 * sum(-a["score"] for a, _ in pairs)
