import public_tokenizers
import pytest
import sentencepiece
from brute_force import documents, edge_rows, sha
from hypothesis import given, settings
from hypothesis import strategies as st

import ledgerline.llm.piece_bpe as pb

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = pb.Encoder(PATH)


def each(encoder, texts):
    ids, counts = encoder.encode(texts)
    ends = counts.cumsum().tolist()
    return [ids[e - n:e].tolist() for e, n in zip(ends, counts.tolist())]


def test_digests_equal_the_library_on_edge_rows(spark):
    rows = edge_rows()
    got = sorted(repr(tuple(r)) for r in pb.round_trip_digests(documents(spark, rows), PATH).collect())
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "")
        want.append(repr((i, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids) if ids else ""))))
    assert got == sorted(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abehingtr Th .,!\n\t\r ▁é的1<s>\U0001F600\x00"), max_size=80), max_size=8))
def test_ids_equal_the_library(texts):
    assert each(ENCODER, texts) == [LIBRARY.encode(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_character(texts):
    assert each(ENCODER, texts) == [LIBRARY.encode(t) for t in texts]


@pytest.mark.parametrize("text", [" " * 50_000, "x" * 300_000, "theinging" * 30_000, " \n" * 20_000, "\U0001F600é" * 20_000,
                                  "aGVsbG8gd29ybGQ" * 20_000])
def test_very_long_texts(text):
    assert each(ENCODER, [text, "next"]) == [LIBRARY.encode(text), LIBRARY.encode("next")]


def test_equal_scores_merge_from_the_left():
    for n in range(1, 80):
        text = "a" + " " * n + "b"
        assert each(ENCODER, [text]) == [LIBRARY.encode(text)]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(pb, "REMEMBERED", 3)
    encoder = pb.Encoder(PATH)
    for text in ["one two three four", "two five", "six one\nseven"] * 2:
        assert each(encoder, [text]) == [LIBRARY.encode(text)]


def test_null_and_repeated_id_lists(spark):
    ids = LIBRARY.encode("one two")
    df = spark.createDataFrame([(1, ids), (1, ids), (2, None), (3, []), (None, [13])], "doc_id long, ids array<int>")
    got = sorted(((r["doc_id"], r["decoded"]) for r in pb.decode_documents(df, PATH).collect()), key=repr)
    assert got == [(1, "one two"), (1, "one two"), (2, ""), (3, ""), (None, "\n")]


def test_empty_table_and_extra_columns(spark):
    assert pb.round_trip_digests(documents(spark, []), PATH).collect() == []
    df = spark.createDataFrame([(7, "a b", 1, "x")], "doc_id long, text string, id int, ids string")
    assert pb.encode_documents(df, PATH).collect()[0].asDict() == {"doc_id": 7, "ids": LIBRARY.encode("a b")}
