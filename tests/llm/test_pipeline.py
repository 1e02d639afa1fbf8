"""The stages in their order, each against what it must do to its own input."""

import random

import pytest
from brute_force import components, documents, edge_rows, entities, leaks, made_up, text_counts
from pyspark.sql import functions as F

import corpus_pipeline as cp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small lake: clean documents, junk, copies, near copies, leaks, personal data."""
    rng = random.Random(12)
    path = tmp_path_factory.mktemp("lake")
    items = [(i, made_up(rng, rng.randrange(15, 40), 700)) for i in range(12)]
    rows, labels = [], []
    for i in range(260):
        words = made_up(rng, rng.randrange(60, 120), 3000).split()
        kind = i % 13
        if kind == 0:
            words = [w + "###" for w in words]
        labels.append((i, int(kind != 0), 0))
        if kind == 1:
            words[20:20] = rng.choice(items)[1].split()
        if kind == 2:
            words[30:30] = [f"mail{i}@host.example.org", "+1", "(301)", "555-0346"]
        rows.append((i, " ".join(words)))
    for i in range(300, 330):  # copies and near copies of clean documents
        words = rows[i - 300][1].split()
        rows.append((i, " ".join(words if i % 2 else [*words[:-1], "changed"])))
    rows += [(1000 + i if i is not None else None, t) for i, t in edge_rows(5)]
    documents(spark, rows).select(COLUMNS).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), rows, items


def test_stage_contract():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "decontamination", "personal_data", "byte_bpe"]


def test_stages_one_after_another(spark, folder, tmp_path):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, path).write.parquet(str(tmp_path / name))
        seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "byte_bpe":
            assert seen[name].columns == COLUMNS
        docs = seen[name]
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    kept = pairs(seen["quality_rules"])
    for doc, text in rows:
        if text_counts(text)[0] < 50:
            assert (doc, text) not in kept
    ids = {d for d, _ in kept}
    assert not any(d in ids for d in range(0, 260, 13))
    assert sum(d in ids for d in range(260) if d % 13) >= 0.98 * 240

    one_each = pairs(seen["near_dedup"])
    groups = {}
    for (doc, text), (_, fp, group) in zip(kept, components(kept)):
        groups.setdefault((group, fp if group is None else ""), []).append((doc, text))
    assert len(one_each) == len(groups)
    for (group, _), members in groups.items():
        assert sum(m in members for m in one_each) == 1
        assert group is None or any(d == group for d, _ in one_each)

    clean = pairs(seen["decontamination"])
    dirty = {d for d, _ in leaks(one_each, items)}
    assert dirty and sorted(map(repr, clean)) == sorted(repr(x) for x in one_each if x[0] not in dirty)

    safe = dict(pairs(seen["personal_data"]))
    assert len(safe) == len(dict(clean)) and not any(entities(t) for t in safe.values())
    for doc, text in dict(clean).items():
        assert (safe[doc] == text) == (not entities(text))

    encoded = seen["byte_bpe"].collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in encoded} == safe


def test_run_gives_the_last_stage(spark, folder):
    path, _, _ = folder
    got = cp.run(spark, path)
    assert got.columns == ["doc_id", "ids", "decoded"] and got.count() > 150


def test_empty_documents(spark, tmp_path):
    documents(spark, []).select(COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0
