import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from brute_force import lowered
from pyspark.sql import types as T

import ledgerline.llm.collocations as co

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("phrase", T.DoubleType()),
    ("n", T.StringType()), ("words", T.LongType()), ("bucket", T.BooleanType()), ("f", T.StringType()))])


def documents(spark, rows):
    """``rows``: (text, lang) pairs, with extra columns named like the operator's own."""
    return spark.createDataFrame([(i, t, lang, 1.5, "n", None, True, "f") for i, (t, lang) in enumerate(rows)], SCHEMA)


def counts(rows):
    out = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                out["und" if lang is None else lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return out


def expected(rows, least, top):
    out = []
    for lang, f in counts(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        own = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [c for q, c in f.items() if len(q) > len(p) and c >= least
                      and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * c >= 80 * a for c in longer):
                own.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, r, n, -score) for i, (score, a, p, left, r) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    hot = ["The", "of", "x"] * 6 + [f"w{i}" for i in range(30)]
    phrases = ["strong coffee", "new York city", "the of x y", "é ü  ñ", "a\tb", "MiXed Case"]
    rows = [(None, "en"), ("", "en"), (" \t ", None), (".;:!?,\n\r", "fr"), ("one", None), (" one two", None)]
    for _ in range(60):
        words = [rng.choice(hot) if rng.random() < 0.7 else rng.choice(phrases) for _ in range(rng.randint(1, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", " ", ". ", ",", "\n", "\x0b", " \t"]) for w in words)
        rows.append((text, rng.choice(["en", "en", "en", "fr", None, "und", ""])))
    return rows + [rows[-1]] * 5 + [(" ".join(["the of x z"] * 3000), "en"), ("same " * 500, "fr")]


@pytest.mark.parametrize("per_bucket, least_buckets", [(8 << 20, 1), (200, 1), (1 << 20, 32)])
def test_equals_brute_force(spark, monkeypatch, per_bucket, least_buckets):
    monkeypatch.setattr(co, "LEAST_BUCKETS", least_buckets)
    rows = made(1)
    got = co.collocations(documents(spark, rows), least=5, top=40, per_bucket=per_bucket).collect()
    assert sorted(map(tuple, got)) == expected(rows, 5, 40)


def test_counts_of_all_phrases(spark):
    rows = made(2)
    got = {(r["lang"], r["phrase"]): r["f"] for r in co.frequent_phrases(documents(spark, rows), least=3, per_bucket=500).collect()}
    f = counts(rows)
    want = {(lang, " ".join(p)): c for lang, own in f.items() for p, c in own.items() if c >= 3}
    want.update({(lang, None): sum(c for p, c in own.items() if len(p) == 1) for lang, own in f.items() if own})
    assert got == want


def test_crowded_prefixes_are_spread(spark, monkeypatch):
    monkeypatch.setattr(co, "LEAST_BUCKETS", 16)
    rng = random.Random(5)
    rows = [(" ".join(f"the of w{rng.randrange(900)} v{rng.randrange(900)}" for _ in range(200)), "en") for _ in range(60)]
    docs = documents(spark, rows)
    split = co.spread_prefixes(docs, 400_000, 16)
    assert 2 <= len(split) <= 24 * 16  # "the" and "the of", which begin a quarter of all rows each
    stripes = co.Stripes.of([t.encode() for t, _ in rows], [lang for _, lang in rows])
    dealt, bucket = stripes.dealt(16, split)
    assert set(dealt.depth.tolist()) >= {1, 3} and max(np.bincount(bucket)) < 3 * len(bucket) / 16
    assert int(dealt.counts.sum()) == sum(len(t.split()) for t, _ in rows)


def test_colliding_keys_only_leave_rows_apart(monkeypatch):
    monkeypatch.setattr(co.Stripes, "prefix_hashes", lambda self: [np.zeros(len(self.counts), np.uint64)] * 4)
    dealt, _ = co.Stripes.of([b"a b a b c a b"], ["en"]).dealt(4, np.empty(0, np.uint64))
    whole = dealt.merged()
    found = {tuple(whole.words[c[i]] for c in whole.columns[1:]): n for i, n in enumerate(whole.counts.tolist())}
    end = co.END
    assert found == {(b"a", b"b", b"a", b"b"): 1, (b"b", b"a", b"b", b"c"): 1, (b"a", b"b", b"c", b"a"): 1, (b"b", b"c", b"a", b"b"): 1,
                     (b"c", b"a", b"b", end): 1, (b"a", b"b", end, end): 1, (b"b", end, end, end): 1}


def test_very_large_counts_stay_exact(spark):
    big = 1 << 60
    rows = [("en", "a b", big), ("en", "a", big + 1), ("en", "b", big + 2), ("en", None, 4 * big)]
    got = co.scored(spark.createDataFrame(rows, "lang string, phrase string, f long")).first()
    assert (got["a"], got["l"], got["r"], got["score"]) == (big, big + 1, big + 2, 2_000_000 * big // (2 * big + 3))


def test_subsumed_at_eighty_in_a_hundred(spark):
    phrases = spark.createDataFrame(
        [("en", "a b", 100), ("en", "a b c", 80), ("en", "b c", 101), ("en", "x a b c", 64), ("en", "b c d", 30)],
        "lang string, phrase string, f long")
    kept = co.without_subsumed(phrases.withColumnRenamed("f", "a"), phrases)
    assert sorted(r["phrase"] for r in kept.collect()) == ["b c", "b c d", "x a b c"]


def test_sql_agrees(spark):
    rows = made(4)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(co.ORACLE_SQL).fetchall())
    assert want == sorted(map(tuple, co.collocations(documents(spark, rows)).collect())) == expected(rows, 30, 2000)


def test_empty_table(spark):
    assert co.collocations(documents(spark, [])).collect() == []
