"""Byte-level BPE, token counts and packed ids against the libraries themselves."""

import base64
import hashlib
import random
import tempfile
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from plateworks.llm import bpe, counts, packing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "ab cd  \n\t'sré ü漢字😀.!?12\x1c \x00　İΣ"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(RANKS)


@pytest.fixture(scope="module")
def tik(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=200, most=300, seed=3):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, most))) for _ in range(n)]
    words = ["the", "antion", "heen,", "don't", "x.\ny", "Über", "12", "?!"]
    return made + [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_perfect_hash_is_minimal_and_exact(ranks):
    h = bpe.PerfectHash(ranks)
    assert h.n == len(ranks) and None not in h.keys
    assert all(h.get(k) == v for k, v in ranks.items())
    assert h.get(b"no such entry") == -1
    assert bpe.PerfectHash({}).get(b"") == -1 and bpe.PerfectHash({b"a": 5}).get(b"a") == 5


def test_merges_equal_the_library(tik, ranks):
    rnd = random.Random(1)
    for _ in range(300):
        piece = "".join(rnd.choice("abcdethion") for _ in range(rnd.randint(1, 40)))
        assert bpe.merge_bytes(piece.encode(), lambda b: ranks.get(b, -1)) == tik.encode_ordinary(piece) or piece.encode() in ranks
    assert bpe.merge_bytes(b"ab" * 20_000, lambda b: ranks.get(b, -1)) == tik.encode_ordinary("ab" * 20_000)


def test_encode_and_decode_columns(spark, tik):
    rows = [(i, t, "kept") for i, t in enumerate([None, "", "a", "a", " " * 300, "abc" * 40_000, *texts()])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # ids clashes and is replaced
    both = bpe.decode(bpe.encode(df, path=RANKS, pattern=P.PATTERN), path=RANKS)
    got = {r.doc_id: r for r in both.collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert list(got[i].ids) == tik.encode_ordinary(t or "")
        assert bytes(got[i].decoded) == (t or "").encode()
    once = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in bpe.round_trip(df, path=RANKS, pattern=P.PATTERN).collect()}
    assert once == {i: (list(r.ids), bytes(r.decoded)) for i, r in got.items()}
    assert bpe.encode(df.limit(0), path=RANKS, pattern=P.PATTERN).count() == 0


def test_memo_that_starts_anew_changes_nothing(monkeypatch, tik):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "MEMO", 5)
    monkeypatch.setattr(bpe, "CANDIDATES", 5)
    e = bpe.Encoder(RANKS, P.PATTERN)
    for _ in range(3):
        for part in (texts(40, seed=9), texts(40, seed=10)):
            assert [list(x) for x in e.encode(pa.array(part))] == [tik.encode_ordinary(t) for t in part]


def test_query_digests(spark):
    from plateworks.llm import queries

    sf = "/root/testdata/sf0.001"
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op2_byte_bpe(spark, sf).collect():
        ids = tik.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


WORDS = P.path("word_bpe_49k.json")


@pytest.mark.parametrize(("chunk", "overlap"), [(400, 120), (150, 70), (16_384, 512)])
def test_token_counts_by_overlapping_chunks(spark, chunk, overlap):
    lib = Tokenizer.from_file(WORDS)
    more = [None, "", "a b", "x" * 3000, " " * 5000, "<|endoftext|> ab<|startoftext|>c " * 200, "é" * 50 + " " + "é " * 900, "a" * 500 + " b" * 900]
    rows = [(i if i % 7 else None, t) for i, t in enumerate([*more, *texts(60, 2500), "twice " * 300])]
    rows += [rows[-1], rows[3]]
    got = counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path=WORDS, chunk=chunk, overlap=overlap).collect()
    want = sorted((-1 if k is None else k, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False))) for k, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


def test_token_counts_of_nothing(spark):
    assert counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), path=WORDS).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 7, 16, 17, 31, 32])
def test_pack_and_unpack(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = packing.pack(ids, bits)
        assert len(data) == -(-n // 64) * 8 * bits and (packing.unpack(data, bits, 0, n) == ids).all()
        if n > 70:
            assert (packing.unpack(data, bits, 65, n - 3) == ids[65 : n - 3]).all()
    with pytest.raises(ValueError):
        packing.pack(np.array([1 << min(bits, 31) if bits < 32 else (1 << 32)], np.uint64), bits)


def test_width():
    assert [packing.width(n) for n in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_packed_files_in_order(spark):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [(None, None), (1, ""), (2, "a b"), (2, "a b"), (3, "x" * 3000), (5, "<|endoftext|> ab<|endoftext|>c " * 20), *((i + 10, t) for i, t in enumerate(texts(100)))]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = packing.write_packed(df, "file://" + tempfile.mkdtemp(), path=path, end_id=2, block_ids=2000)
    got = sorted(packing.read_packed(spark, folder).collect(), key=lambda r: r.start)
    at = 0
    for r, (k, t) in zip(got, sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (k, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert [list(r.ids) for r in packing.fetch(spark, folder, 2).collect()] == [lib.encode("a b").ids + [2]] * 2
    empty = packing.write_packed(df.limit(0), "file://" + tempfile.mkdtemp(), path=path, end_id=2)
    assert packing.read_packed(spark, empty).count() == 0


def test_base64_ranks_are_read_whole(ranks):
    with open(RANKS, "rb") as f:
        first = f.readline().split()
    assert ranks[base64.b64decode(first[0])] == int(first[1])
