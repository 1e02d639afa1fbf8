import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from brute_force import LONG, documents, edge_rows, made_up
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import ledgerline.llm.repair_output as ro

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = ro.WordEncoder(PATH, 1)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


def ordered(rows):
    def content(text):  # Spark's xxhash64, signed
        h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >> 63 else h
    return sorted(rows, key=lambda r: (LONG if r[0] is None else r[0], content(r[1])))


@pytest.mark.parametrize("shard_tokens", [1, 3000, 1 << 21])
def test_documents_read_back(spark, tmp_path, shard_tokens):
    rows = edge_rows()
    path = str(tmp_path / "shards")
    ro.write_shards(documents(spark, rows), path, PATH, shard_tokens=shard_tokens, min_count=4)
    got = ro.decoded_documents(ro.read_shards(spark, path)).orderBy("start").collect()
    at, want = 0, []
    for i, t in ordered(rows):
        ids = library_ids(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    for i in (14, 6, 1, 999):
        assert sorted(ro.document_ids(spark, path, i)) == sorted(library_ids(t) for d, t in rows if d == i)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    ro.write_shards(documents(spark, []), path, PATH)
    assert ro.decoded_documents(ro.read_shards(spark, path)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB.,!' \n\t1é\x01\U0001F600Σσ "), max_size=40), max_size=6))
def test_word_by_word_ids_equal_the_library(texts):
    ids, counts = ENCODER.encode([t.encode() for t in texts])
    assert counts.tolist() == [len(library_ids(t)) for t in texts]
    assert ids.tolist() == [x for t in texts for x in library_ids(t)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "B", "\n"]),
                         max_size=8).map("".join), max_size=5))
def test_special_tokens_as_the_library(texts):
    ids, counts = ENCODER.encode([t.encode() for t in texts])
    assert ids.tolist() == [x for t in texts for x in library_ids(t)] and counts.tolist() == [len(library_ids(t)) for t in texts]


def test_word_hashes_tell_words_apart():
    rng = random.Random(2)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(20_000)})
    words += ["x" * n for n in range(41, 200)] + ["é" * n for n in range(1, 60)]
    raw = [w.encode() for w in words]
    start, end, hashes = ro.hashed_words(b"  ".join(raw) + b"\n" + b"\t".join(raw))
    assert len(set(hashes.tolist())) == len(words) and hashes.tolist()[:len(words)] == hashes.tolist()[len(words):]
    assert ro.hashed_words(b"")[0].tolist() == ro.hashed_words(b" \n\x0b")[0].tolist() == []


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(ro, "REMEMBERED", 5)
    encoder, rng = ro.WordEncoder(PATH, 1), random.Random(1)
    for _ in range(4):
        text = made_up(rng, 50)
        assert encoder.encode([text.encode()])[0].tolist() == library_ids(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=6))
def test_any_ids_round_trip(texts):
    own = [np.array([*t, 1], np.uint32) for t in texts]
    image = ro.shard_image(np.arange(len(own)), np.array([len(x) for x in own]), np.concatenate(own), 10, 2)
    shard = ro.Shard(image)
    whole = np.concatenate(own).tolist()
    assert shard.decode().tolist() == whole
    assert [shard.token(i) for i in range(len(whole))] == whole
    for i, x in enumerate(own):
        assert shard.decode(i, i + 1).tolist() == x.tolist()


def test_frequent_pairs_are_replaced_and_damage_is_seen():
    ids = np.array([5, 6, 7, 8] * 500 + [1], np.uint32)
    image = ro.shard_image(np.array([1]), np.array([len(ids)]), ids, 10)
    shard = ro.Shard(image)
    assert len(shard.symbols) < 100 and max(shard.lengths) >= 8 and shard.decode().tolist() == ids.tolist()
    with pytest.raises(ValueError):
        ro.Shard(image[:-1] + bytes([image[-1] ^ 1]))
