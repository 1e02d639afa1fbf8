import random

import numpy as np
import pytest
import xxhash
from brute_force import SCHEMA, components, documents, edge_rows, fingerprint, made_up
from pyspark.sql import functions as F

from ledgerline.llm.components import connected_components
from ledgerline.llm.simhash_dedup import (component_table, drop_near_duplicates, link_prefix, majority_bits, near_links,
                                          shingle_hashes)


def test_edge_rows_match_brute_force(spark):
    rows = edge_rows()
    got = component_table(documents(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, components(rows)))


def test_fingerprints_over_several_vote_chunks(monkeypatch):
    import ledgerline.llm.simhash_dedup as sd
    monkeypatch.setattr(sd, "VOTES_AT_ONCE", 7)
    texts = ["", "one two", made_up(random.Random(2), 40), "", made_up(random.Random(3), 9), ""]
    got = majority_bits([shingle_hashes(t.encode(), 4) for t in texts])
    assert got.tolist() == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5])
def test_links_join_exactly_the_fingerprints_within_the_radius(spark, radius):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        x = int(s)
        for _ in range(6):  # a chain of small steps, some beyond the radius
            for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    distinct = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "key long, fp long")
    found = connected_components(near_links(distinct, radius)).select("node.key", F.col("root.key").alias("root")).collect()
    got = {r["key"]: r["root"] for r in found}
    label = list(range(len(fps)))
    for _ in fps:
        for i, x in enumerate(fps):
            for j in range(i):
                if bin(x ^ fps[j]).count("1") <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    assert [got.get(i, i) for i in range(len(fps))] == label


def test_dense_ball_is_linked_without_pairs():
    centre = np.uint64(0x0123456789ABCDEF)
    fps = np.array([centre] + [centre ^ np.uint64(1 << b) for b in range(50)], np.uint64)
    label = link_prefix(int(centre >> np.uint64(58)), fps, 6, 4)
    assert set(label.tolist()) == {0}


def test_one_document_of_each_group_stays(spark):
    rows = edge_rows()
    docs = documents(spark, rows)
    kept = drop_near_duplicates(docs)
    assert kept.schema == SCHEMA
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(set(got))
    groups = {c for _, _, c in components(rows)}
    assert {i for i, _ in got if i is not None} == groups - {None}
    assert (6, rows[8][1]) not in got and (-15, rows[18][1]) in got  # the smallest id of its group stays


def test_empty_table(spark):
    docs = documents(spark, [])
    assert component_table(docs).collect() == [] and drop_near_duplicates(docs).collect() == []


def test_components_of_chains_stars_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3), (301, 300), (300, 301)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 300: 300, 301: 300}


def crowd(n):
    """Fingerprints up to 6 bits from one centre, and strangers."""
    rng = np.random.default_rng(11)
    fps = {0x0123456789ABCDEF} | {int(x) for x in rng.integers(0, 1 << 63, 20, dtype=np.uint64)}
    while len(fps) < n:
        x = 0x0123456789ABCDEF
        for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    return np.array(sorted(fps), np.uint64)


def roots(fps, radius=4):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(fps.tolist()):
            near = np.flatnonzero(np.bitwise_count(fps ^ np.uint64(x)) <= radius)
            low = min(label[j] for j in near)
            changed |= any(label[j] != low for j in near)
            for j in near:
                label[j] = low
    return label


def test_a_crowded_prefix_makes_its_values_in_bounded_parts(monkeypatch):
    import ledgerline.llm.simhash_dedup as sd
    made, real = [], sd.meeting
    monkeypatch.setattr(sd, "VALUES_PER_PREFIX", 2000)
    monkeypatch.setattr(sd, "meeting", lambda values: made.append(len(values)) or real(values))
    centre = np.uint64(0x0123456789ABCDEF)
    fps = np.array([centre] + [centre ^ np.uint64(1 << b) for b in range(50)], np.uint64)
    assert set(sd.link_prefix(int(centre >> np.uint64(58)), fps, 6, 4).tolist()) == {0}
    whole = 51 * (1 + 58 + 58 * 57 // 2)
    assert sum(made) == whole and max(made) < 3 * 2000


def test_crowded_prefixes_are_dealt_to_several_tasks(spark, monkeypatch):
    import ledgerline.llm.simhash_dedup as sd
    monkeypatch.setattr(sd, "VALUES_PER_PREFIX", 3000)
    monkeypatch.setattr(sd, "VALUES_PER_TASK", 20_000)
    fps = crowd(150)
    distinct = spark.createDataFrame([(i, f) for i, f in enumerate(fps.view(np.int64).tolist())], "key long, fp long")
    bits = sd.prefix_bits(len(fps), 2)
    assert max(sd.crowded(distinct, bits, 2, 20_000).values()) >= 2
    found = connected_components(near_links(distinct, 4)).select("node.key", F.col("root.key").alias("root")).collect()
    got = {r["key"]: r["root"] for r in found}
    assert [got.get(i, i) for i in range(len(fps))] == roots(fps)


def test_near_copies_without_ids_are_one_group(spark):
    rng = random.Random(21)
    while True:  # two texts within the radius that are not equal
        words = made_up(rng, 400).split()
        near = words[:-1] + ["changed"]
        a, b = " ".join(words), " ".join(near)
        if 0 < bin(fingerprint(a) ^ fingerprint(b)).count("1") <= 4:
            break
    other, third = made_up(rng, 50), made_up(rng, 60)
    rows = [(None, a), (None, b), (None, a), (None, other), (5, third), (5, made_up(rng, 70))]
    kept = drop_near_duplicates(documents(spark, rows)).collect()
    assert len(kept) == 4 and {r["text"] for r in kept} == {min((a, b), key=lambda t: _content(t)), other, third, rows[-1][1]}


def _content(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h
