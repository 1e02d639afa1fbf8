import random

import numpy as np
from brute_force import documents, edge_rows, made_up, sha, without_repeats
from pyspark.sql import functions as F

from ledgerline.llm.substring_dedup import Sketch, Windows, drop_repeats, merged_sketch, rolling, sliding_min


def digests(spark, rows, window=50):
    found = drop_repeats(documents(spark, rows), window=window)
    return sorted(repr(tuple(r)) for r in found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect())


def test_edge_rows_match_brute_force(spark):
    rows = edge_rows()
    assert digests(spark, rows) == sorted(map(repr, without_repeats(rows)))


def test_planted_passages_in_many_documents(spark):
    rng = random.Random(5)
    passages = [made_up(rng, n) for n in (49, 50, 51, 130)]
    rows = [(i, f"{made_up(rng, rng.randrange(60), 9999)} {rng.choice(passages)} {made_up(rng, rng.randrange(60), 9999)}")
            for i in range(300)]
    assert digests(spark, rows) == sorted(map(repr, without_repeats(rows)))
    assert digests(spark, rows, 7) == sorted(map(repr, without_repeats(rows, 7)))


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    import ledgerline.llm.substring_dedup as sd
    monkeypatch.setattr(Sketch, "repeated", lambda self, s: np.ones(len(s), bool))
    monkeypatch.setattr(sd, "HELD", 50)
    rows = edge_rows(3)
    assert digests(spark, rows) == sorted(map(repr, without_repeats(rows)))


def test_sketch_never_underestimates(spark):
    rows = [(i, t) for i, t in edge_rows(4)]
    sketch = merged_sketch(documents(spark, rows))
    windows = Windows([(t or "").encode() for _, t in rows], 50)
    passes = sketch.repeated(windows.signatures())
    h1, h2 = windows.identities(np.arange(len(windows.at)))
    docs_of: dict = {}
    for a, b, d in zip(h1.tolist(), h2.tolist(), windows.text.tolist()):
        docs_of.setdefault((a, b), set()).add(d)
    for a, b, p in zip(h1.tolist(), h2.tolist(), passes.tolist()):
        assert p or len(docs_of[a, b]) == 1


def test_empty_table(spark):
    assert drop_repeats(documents(spark, [])).collect() == []
    assert drop_repeats(documents(spark, [(1, None), (None, "")])).select("n_words", "n_removed", "kept_text").distinct().collect() == [(0, 0, "")]


def test_rolling_hash_and_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 1 << 63, 300).astype(np.uint64)
    same = np.concatenate([x, x])
    r = rolling(same, 50, 0x9E3779B97F4A7C15)
    assert (r[:251] == r[300:551]).all() and len(set(r[:300].tolist())) == 300
    assert sliding_min(x, 26).tolist() == [x[i:i + 26].min() for i in range(275)]
    assert sha("a") == sha(b"a")
