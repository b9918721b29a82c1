import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from keyloom.llm import registry
from keyloom.llm.bpe import Bpe, decode_ids, encode_decode
from keyloom.llm.packing import pack, piece_lengths

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts_match_the_library(library):
    rnd = random.Random(0)
    bits = [*"abcdefghij  \n\t'sdtréü12!.,-_", "<|endoftext|>", "　", "\x1c", "\x85", "\r\n", "the ", "ing", "中文", "😀"]
    texts = ["".join(rnd.choices(bits, k=rnd.randrange(60))) for _ in range(3000)] + ["", "a" * 4000, "-" * 3000, "".join(rnd.choices("abcde", k=9000))]
    bpe = Bpe(PATH)
    for text, got in zip(texts, bpe.encode_batch(texts), strict=True):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_the_cache_may_overflow(library, monkeypatch):
    monkeypatch.setattr("keyloom.llm.bpe._CACHE", 5)
    bpe = Bpe(PATH)
    for text in ("one two three four five six seven", "two eight nine ten eleven one"):
        assert np.frombuffer(bpe.encode_batch([text])[0], "<u4").tolist() == library.encode(text).ids


def test_op2_matches_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.op2_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op1_covers_every_token_once(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.op1_packing(spark, SF).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(docs)
    for doc, pieces in by.items():
        ids = library.encode(docs[doc], add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.offset, p.doc_tokens) == (at, 0, len(ids)) and p.length <= 2048 and p.length == 1 << p.bucket
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 5000])
def test_piece_lengths(n):
    got = piece_lengths(n, 2048)
    assert sum(got) == n and all(x & x - 1 == 0 and x <= 2048 for x in got) and got == sorted(got, reverse=True)


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    kind = "doc_id long, text string, ids string, start string, id string, decoded string"
    rows = [(1, None, "x", "y", "z", "w"), (None, "a b", None, None, None, None), (1, "", "x", "y", "z", "w"), (2, "a b", "", "", "", ""), (2, "a b", "", "", "", "")]
    df = spark.createDataFrame(rows, kind)
    got = sorted((r.doc_id is None, r.doc_id or 0, len(r.ids), r.decoded) for r in encode_decode(df, PATH).collect())
    assert got == [(False, 1, 0, ""), (False, 1, 0, ""), (False, 2, 2, "a b"), (False, 2, 2, "a b"), (True, 0, 2, "a b")]
    assert sorted((r.doc_id or 0, r.length) for r in pack(df, PATH).collect()) == [(0, 1), (0, 2), (1, 1), (1, 1), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert pack(df, PATH, end_id=None).count() == 3
    empty = df.limit(0)
    assert encode_decode(empty, PATH).count() == 0 and pack(empty, PATH).count() == 0
    assert decode_ids(spark.createDataFrame([([64, 65],), (None,)], "ids array<int>"), PATH).collect()[1].decoded is None
    with pytest.raises(ValueError):
        pack(df, PATH, max_len=1000)


def test_long_words_are_proposed_and_verified_like_short_ones(library, monkeypatch):
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdefgh", k=n)) for n in (47, 48, 49, 300, 5000)] + ["the" * 40, "internationalization" * 9, "=" * 200, "中文字" * 60, "a" * 4000]
    coder_ = Bpe(PATH)
    calls = []
    monkeypatch.setattr(coder_, "_exact_long", lambda ids, f=coder_._exact_long: calls.append(len(ids)) or f(ids))
    got = coder_.encode_batch(words)
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert len(calls) < sum(len(w.encode()) > 48 for w in words)  # some stand as proposed


def test_buckets_hold_pieces_of_one_length(spark, tmp_path):
    from keyloom.llm.packing import write_buckets

    docs = spark.createDataFrame([(i, "some words " * (i * 7)) for i in range(60)], "doc_id long, text string")
    write_buckets(pack(docs, PATH, max_len=64), str(tmp_path / "b"))
    got = spark.read.parquet(str(tmp_path / "b")).collect()
    assert len(got) == pack(docs, PATH, max_len=64).count() and all(1 << r.bucket == r.length == len(r.ids) // 4 for r in got)
