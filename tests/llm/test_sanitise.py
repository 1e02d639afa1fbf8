import random
import time

from brute_force import SCHEMA, documents, edge_rows, entities, joined, made_up, sha
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import ledgerline.llm.sanitise as sa
from ledgerline.llm.sanitise import disclosing_terms, entity_contexts, sanitise, span_table

ROWS = [
    (30, "a@b.c_d@e.f.g x.@y.z @no.at a@b a@b..c a.b@c.d-e.f. %+@x.y1@z.w"),
    (31, "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 01.002.0255.4 999999999999.1.1.1 1..2.3.4 a1.2.3.4b"),
    (32, "4111-1111-1111-1111 4111 1111 1111 1112 4111  1111 1111 1111 123456789012 0000000000000 5 6"),
    (33, "+1 (301) 555-0346 +49.30.1234567 +1-2 ++123456789 +12345678901234567 +1 2 3 4 5 6 7 8 9)"),
    (34, "\U0001F600é x@y.zz \U0001F600 10.0.0.1 +4111111111111111"),
    (35, "7" * 20_000 + " " + "x" * 20_000 + "@" + "y.z" * 5000 + " " + "1." * 20_000),
]


def plain(rows):
    out = []
    for i, t in rows:
        spans = entities(t)
        counts = [sum(s[3] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        out.append(repr((i, *counts, sha(joined(spans)))))
    return sorted(out)


def test_entities_match_the_plain_patterns(spark):
    rows = edge_rows() + ROWS
    got = span_table(documents(spark, rows)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == plain(rows)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB1.@_%+- ()9é\U0001F600"), max_size=60), min_size=20, max_size=40))
def test_entities_of_any_text(spark, texts):
    rows = list(enumerate(texts))
    got = span_table(documents(spark, rows)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == plain(rows)


def planted():
    """'kontakt' stands only beside emails, with many different ones; 'copied' only in copies of one document."""
    rng = random.Random(3)
    words = lambda n: "".join(c if c.isalpha() or c == " " else "" for c in made_up(rng, n, 1))
    rows = [(500 + i, f"{words(60)} kontakt person{i}@host.example.org {words(60)}") for i in range(12)]
    rows += [(100 + i, f"{words(90)}") for i in range(200)]
    copy = f"{words(50)} copied same@host.example.org {words(50)}"
    return rows + [(400 + i, copy) for i in range(12)]


def test_terms_that_disclose_are_flagged_and_others_are_not(spark):
    docs = documents(spark, planted())
    found = disclosing_terms(docs, entity_contexts(docs)).collect()
    assert [(r["kind"], r["term"]) for r in found] == [("email", "kontakt")] and found[0]["disclosure"] > 0.99
    spans = {r["doc_id"]: r["spans"] for r in span_table(docs).collect()}
    text = dict(planted())[503]
    at = text.index("kontakt")
    assert f"term:{at}:{at + 7}" in spans[503] and "term" not in spans[400] and spans[150] == ""


def test_sanitised_texts(spark):
    rows = planted() + edge_rows() + ROWS
    docs = documents(spark, rows)
    clean = sanitise(docs)
    assert clean.schema == SCHEMA and clean.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "kontakt" not in texts[503] and "<email>" in texts[503] and "person3" not in texts[503]
    assert texts[150] == dict(planted())[150] and texts[1] is None and texts[2] == ""
    assert texts[19].startswith("mail me<email>"[:5]) and "10.0.0.256" in texts[19] and "10.0.0.255" not in texts[19]
    assert texts[34] == "\U0001F600é <email> \U0001F600 <ip> +<card>" or "<phone>" in texts[34] or "<card>" in texts[34]


def test_entities_left_after_sanitising_are_none(spark):
    docs = documents(spark, planted())
    left = span_table(sanitise(docs)).agg(F.sum("n_email"), F.sum("n_ip"), F.sum("n_card"), F.sum("n_phone")).first()
    assert tuple(left) == (0, 0, 0, 0)


def test_empty_table(spark):
    docs = documents(spark, [])
    assert span_table(docs).collect() == [] and sanitise(docs).collect() == []


def test_no_python_runs_on_the_executors(spark):
    plan = span_table(documents(spark, planted()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_many_entities_in_one_text(spark, monkeypatch):
    """The way for texts with many spans finds what the plain one does, and in time."""
    rng = random.Random(3)
    kinds = ["u{0}@h{0}.example.org", "10.0.{1}.7", "+1 (301) 555-0{2}", "4111 1111 1111 1111", "x" * 300 + "{0}@long.example"]
    words = ["é", "word", "Ünder", "of", "a1b", "\U0001F600", "term-like", ",", "\n"]
    parts = []
    for i in range(300):
        parts.append(rng.choice(kinds if i % 50 == 0 else kinds[:4]).format(i, i % 250, 100 + i % 800))
        parts += rng.choices(words, k=rng.randrange(0, 12))
    df = spark.createDataFrame([(" ".join(parts),)], "text string").select("text", sa.entity_spans(F.col("text")).alias("spans"))
    found = lambda: df.select(sa.nearby_terms(F.col("text"), F.col("spans")).alias("t")).first()["t"]
    plain = found()
    monkeypatch.setattr(sa, "MANY", 0)
    monkeypatch.setattr(sa, "BLOCK", 64)
    monkeypatch.setattr(sa, "CHUNK", 7)
    assert len(plain) > 500 and found() == plain


def test_thousands_of_entities_take_seconds(spark):
    text = " ".join(f"user{i}@host{i % 50}.example.org written by somebody number {i}" for i in range(6_000))
    rows = documents(spark, [(1, text)])
    start = time.perf_counter()
    row = span_table(rows).first()
    assert row["n_email"] == 6_000 and time.perf_counter() - start < 60
    assert sanitise(rows).first()["text"].startswith("<email> written by somebody number 0 <email>")
