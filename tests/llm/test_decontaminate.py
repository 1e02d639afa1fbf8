import random

import numpy as np
from brute_force import SCHEMA, documents, edge_rows, leaks, made_up

import ledgerline.llm.decontaminate as dc


def items_table(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def planted(seed: int = 1):
    """Items of many lengths; documents with exact, altered, cut and cross-document passages."""
    rng = random.Random(seed)
    items = [(i, made_up(rng, rng.randrange(8, 60), 900)) for i in range(40)]
    items += [(100, None), (101, ""), (102, "two words"), (103, items[3][1]), (104, "!!! ..."), (105, "word " * 30)]
    rows = []
    for d in range(120):
        words = made_up(rng, rng.randrange(20, 150), 900).split()
        if d % 3 == 0:
            passage = rng.choice(items[:40])[1].split()
            if d % 2:  # altered: one word changed, or an end cut off
                passage[rng.randrange(len(passage))] = "altered"
            if d % 5 == 0:
                passage = passage[:-1]
            if d % 7 == 0:
                passage = [w.upper() + "," for w in passage]
            at = rng.randrange(len(words))
            words[at:at] = passage
        rows.append((1000 + d, " ".join(words)))
    rows += [(2300, items[0][1]), (2301, " ".join(items[1][1].split()[:-2])), (2302, "two words"), (2303, "a two words b"),
             (2304, "word " * 100), (2305, items[2][1] + "\n" + items[2][1])]
    return rows + edge_rows(8), items


def test_matches_brute_force(spark):
    rows, items = planted()
    got = dc.find_leaks(documents(spark, rows), items_table(spark, items)).collect()
    want = leaks(rows, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want)
    for r in got:
        assert abs(r["similarity"] - want[r["doc_id"], r["item_id"]]) < 1e-12
        text = dc.normal_words(dict(rows)[r["doc_id"]])
        assert 0 <= r["word_start"] and r["word_start"] + r["n_words"] <= len(text)


def test_items_in_several_indexes(spark, monkeypatch):
    rows, items = planted(2)
    monkeypatch.setattr(dc, "WORDS_PER_INDEX", 1)
    indexes = list(dc.item_indexes(items_table(spark, items), words_per_index=100))
    assert len(indexes) > 5
    found = {(rows[h[0]][0], ix.ids[h[1]]) for ix in indexes for h in ix.scan([t for _, t in rows])}
    assert found == set(leaks(rows, items))


def test_documents_with_leaks_go_and_clean_ones_stay(spark):
    rows, items = planted(3)
    docs = documents(spark, rows)
    clean = dc.drop_leaks(docs, items_table(spark, items))
    assert clean.schema == SCHEMA
    dirty = {d for d, _ in leaks(rows, items)}
    assert sorted(repr((r["doc_id"], r["text"])) for r in clean.collect()) == sorted(repr(r) for r in rows if r[0] not in dirty)


def test_block_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    for radius in (0, 3, 20):
        index = dc.BlockIndex(fps, radius)
        for f in fps[:40]:
            for flips in (0, radius, radius + 1):
                x = f
                for b in rng.choice(64, flips, replace=False):
                    x = x ^ np.uint64(1 << int(b))
                assert index.within(x) == np.flatnonzero(np.bitwise_count(fps ^ x) <= radius).tolist()


def test_empty_tables(spark):
    rows, items = planted(4)
    docs, bench = documents(spark, rows), items_table(spark, items)
    assert dc.find_leaks(documents(spark, []), bench).collect() == []
    assert dc.find_leaks(docs, items_table(spark, [])).collect() == []
    assert dc.drop_leaks(docs, items_table(spark, [])).count() == len(rows)
