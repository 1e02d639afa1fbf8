import public_tokenizers
import pytest
import tiktoken
from brute_force import documents, edge_rows, sha
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm.bpe import decode_documents, encode_documents, encode_text, read_ranks, round_trip_digests

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LIBRARY = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_digests_equal_the_library_on_edge_rows(spark):
    rows = edge_rows()
    got = sorted(repr(tuple(r)) for r in round_trip_digests(documents(spark, rows), PATH, PATTERN).collect())
    want = []
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append(repr((i, len(ids), sha(" ".join(map(str, ids))), sha(t or ""))))
    assert got == sorted(want)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab1'sré .,!\n\t\r  \U0001F600"), max_size=200), st.integers(1, 9))
def test_cutting_at_safe_boundaries_changes_no_id(text, piece):
    assert encode_text(text, PATH, PATTERN, piece).tolist() == LIBRARY.encode_ordinary(text)


def test_very_long_run_without_a_boundary():
    text = "x" * 200_000 + " end"
    assert encode_text(text, PATH, PATTERN).tolist() == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("blank", [" ", "\n", " \n\t", "\u3000\xa0"])
def test_very_long_runs_of_white_space(blank):
    run = blank * (200_000 // len(blank))
    for text in (run, "a" + run, run + "b", "one two" + run + "three" + run + "\n", run + "é" + run):
        assert encode_text(text, PATH, PATTERN).tolist() == LIBRARY.encode_ordinary(text)


def test_runs_that_the_library_refuses():
    text = "a" + " " * 3_000_000 + "b" + "\n" * 2_000_000
    ids = encode_text(text, PATH, PATTERN)
    assert LIBRARY.decode(ids.tolist()) == text
    space, line = LIBRARY.encode_ordinary(" " * 1000)[0], LIBRARY.encode_ordinary("\n" * 1000)[0]
    assert ids.tolist() == (LIBRARY.encode_ordinary("a") + [space] * 2_999_999 + LIBRARY.encode_ordinary(" b") + [line] * 1_000_000)


def test_special_token_strings_are_ordinary_text():
    assert encode_text("<|endoftext|>", PATH, PATTERN).tolist() == LIBRARY.encode_ordinary("<|endoftext|>")


def test_ids_that_cut_a_character_decode_to_its_bytes(spark):
    ids = LIBRARY.encode_ordinary("\U0001F600")
    assert len(ids) > 1
    df = spark.createDataFrame([(1, ids[:1]), (2, ids[1:]), (3, None), (4, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in decode_documents(df, PATH, PATTERN).collect()}
    assert got[1] + got[2] == "\U0001F600".encode() and got[3] == got[4] == b""


def test_empty_table(spark):
    assert encode_documents(documents(spark, []), PATH, PATTERN).collect() == []
    assert round_trip_digests(documents(spark, []), PATH, PATTERN).collect() == []
