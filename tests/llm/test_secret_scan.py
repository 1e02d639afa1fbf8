import hashlib
import random
import time

import numpy as np
from brute_force import documents, edge_rows, made_up
from pyspark.sql import functions as F

from ledgerline.llm.secret_scan import RandomForest, scan, transitions


def planted(seed: int, n: int = 260):
    """Documents with secrets, and with what only looks like one."""
    rng = random.Random(seed)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))
    rows, secrets = [], set()
    for i in range(n):
        words = "the where with under plain table"
        kind, value = i % 6, None
        if kind == 0:
            value = hexes(40)
            part = f'token = "{value}"'
        elif kind == 1:
            value = mixed(32)
            part = f"password: {value}"
        elif kind == 2:
            part = f"commit {hexes(40)} of the revision"
        elif kind == 3:
            part = "internationalization" + rng.choice(["", "andtransformations"])
        elif kind == 4:
            part = f"order {rng.randrange(10**17, 10**18)} shipped"
        else:
            part = made_up(rng, 3)
        rows.append((i, f"{words} {part} {words}"))
        if value:
            secrets.add((i, hashlib.sha256(value.encode()).hexdigest()))
    return rows, secrets


def found(df):
    return {(r["doc_id"], r["value_sha256"]) for r in df.collect()}


def test_secrets_are_found_and_lookalikes_are_not(spark):
    rows, secrets = planted(1)
    got = found(scan(documents(spark, rows), path_col="lang"))
    assert len(got & secrets) >= 0.97 * len(secrets) and len(got - secrets) <= 0.03 * len(secrets)


def test_places_are_code_points(spark):
    rows, _ = planted(2)
    rows = [(i, "\U0001F600é " + t) for i, t in rows]
    texts = dict(rows)
    for r in scan(documents(spark, rows)).collect():
        value = texts[r["doc_id"]][r["start_at"]:r["end_at"]]
        assert hashlib.sha256(value.encode()).hexdigest() == r["value_sha256"] and len(value) == r["n_chars"]


def test_edge_rows_without_labelled_findings(spark):
    rows = edge_rows()
    got = scan(documents(spark, rows), path_col="source", label=F.lit(None).cast("int")).collect()
    assert {r["doc_id"] for r in got} == {17} and all(r["probability"] == 1 for r in got)
    assert scan(documents(spark, [])).collect() == []


def test_given_labels_train_the_forest(spark):
    """Labels that call commits secret and tokens not turn the answer round."""
    rows, secrets = planted(3)
    got = found(scan(documents(spark, rows), label=(F.col("hash_word") == 1).cast("int")))
    assert got and not got & secrets


def test_forest_held_out_accuracy_and_expression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (1200, 4))
    y = ((x[:, 0] > 0) & (x[:, 1] + x[:, 2] > 0)).astype(int)
    forest = RandomForest.fit(x[:800], y[:800])
    p = np.array([forest.probability(r) for r in x[800:]])
    assert ((p >= 0.5) == y[800:]).mean() > 0.9
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[800:900]], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(forest.expression(("a", "b", "c", "d"))).collect()]
    assert np.allclose(got, p[:100])


def test_transitions(spark):
    words = spark.createDataFrame([("aab", 2), ("ab", 1)], "word string, n long")
    chance = transitions(words)
    assert set(chance) == {"aa", "ab"} and chance["ab"] > chance["aa"]
    assert transitions(words.limit(0)) == {}


def test_no_python_runs_on_the_executors(spark):
    plan = scan(documents(spark, planted(4, 40)[0]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_very_long_runs_take_seconds(spark):
    """A run of a million key characters, such as an embedded image, and a very long line of words."""
    rng = random.Random(12)
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1_000_000))
    start = time.perf_counter()
    found = scan(documents(spark, [(1, "image = " + run), (2, "word " * 200_000)])).collect()
    assert [(r["doc_id"], r["n_chars"]) for r in found] == [(1, 1_000_000)] and time.perf_counter() - start < 60
