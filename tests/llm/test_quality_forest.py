import random

import numpy as np
from brute_force import SCHEMA, documents, edge_rows, made_up, text_counts
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm.quality_forest import (COUNTS, IsolationForest, best_threshold, filter_documents, fit_model, judge,
                                           statistics, text_statistics)


def labelled(seed: int, n: int):
    """Documents with labels: clean ones, and two kinds of junk that the hard rules pass."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = made_up(rng, rng.randrange(60, 300), 5000).split()
        kind = i % 10
        if kind == 0:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind > 1)))
    return rows, labels


def test_counts_on_edge_rows(spark):
    rows = edge_rows()
    got = statistics(documents(spark, rows)).select("doc_id", *COUNTS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *text_counts(t))) for i, t in rows)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab# \n\t<é "), max_size=120))
def test_counts_of_any_text(text):
    assert tuple(text_statistics(text.encode())[0]) == text_counts(text)


def test_held_out_accuracy(spark):
    rows, labels = labelled(1, 800)
    model = fit_model(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality long"))
    fresh, truth = labelled(2, 500)
    kept = {r["doc_id"]: r["kept"] for r in judge(statistics(documents(spark, fresh)), model).collect()}
    good = [kept[i] for i, q in truth if q]
    bad = [kept[i] for i, q in truth if not q]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.02


def test_filter_keeps_columns_and_agrees_with_the_verdict(spark):
    rows, labels = labelled(3, 300)
    rows += edge_rows()
    docs = documents(spark, rows)
    model = fit_model(docs, spark.createDataFrame([*labels, (None, 1), (0, None), (3, 7)], "doc_id long, quality long"))
    kept = filter_documents(docs, model)
    assert kept.schema == SCHEMA
    verdict = judge(statistics(docs), model).where("kept").collect()
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(r["doc_id"]) for r in verdict)


def test_without_labels_only_the_hard_rules_decide(spark):
    rows = edge_rows()
    docs = documents(spark, rows)
    model = fit_model(docs, spark.createDataFrame([(6, 1)], "doc_id long, quality long"))
    got = judge(statistics(docs), model).collect()
    assert model.forest is None and all(r["kept"] != r["base_failed"] for r in got)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[16]["base_failed"] and by_id[4]["base_failed"] and not by_id[10]["base_failed"]


def test_empty_tables(spark):
    docs, labels = documents(spark, []), spark.createDataFrame([], "doc_id long, quality long")
    model = fit_model(docs, labels)
    assert judge(statistics(docs), model).collect() == [] and filter_documents(docs, model).collect() == []


def test_forest_isolates_outliers_and_threshold_splits_ties():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    score = IsolationForest.fit(rows, 100, 128).score(rows)
    assert score[500] >= np.percentile(score, 99)
    assert abs(best_threshold(np.array([.1, .2, .3]), np.array([.6, .7])) - 0.45) < 1e-12
