"""Token ids: whole-text encoding, the coded store and the tiktoken round trip."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wiring.llm import bpe, dac, queries

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n a", "don't DON'T 's x's 're'll", "a  b   c \n d", "é  b   \n c d", "x" * 3000, "12ab34 ab_cd!?  (x)  ",
       "<|endoftext|> plain", "a <|endoftext|> b", "x<|endoftext|>y  <|endoftext|>", "<|endoftext|",  "日本語 テキスト 🙂🙂", "tab\tsep\r\nline\x0b\x1c end", "½²Ⅷ a½b", "word, word. (word) 'word' word's", " ünï çödé—dash…", "!'s 's !"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    random.seed(5)
    letters = "ab é'1 2.,!\n\t  sdtl½—x  "
    return ODD + ["".join(random.choices(letters, k=random.randint(1, 60))) for _ in range(1500)]


def test_pieces_give_the_ids_of_whole_texts(library):
    encoder = dac.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text, raw in zip(texts(), encoder.encode(texts()), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_chunks_give_the_ids_of_whole_texts():
    enc = bpe.encoding(*bpe._paths(None, None))
    for text in texts():
        if text:
            parts = list(bpe.chunks(text, 3))
            assert "".join(parts) == text
            assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("levels", [(8, 8, 16), (4, 8, 16, 4), (8, 24)])
def test_any_id_is_found_without_its_neighbours(levels):
    levels = (8, 8, 16) if max(levels) > 16 else levels
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 50257, 9000), rng.integers(0, 256, 5000), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype(np.uint32)
    ids = rng.permutation(ids)
    cuts = np.diff(np.concatenate([[0], np.sort(rng.integers(0, len(ids), 40)), [len(ids)]]))
    shard = dac.Shard(dac.pack(list(range(41)), cuts, ids, levels))
    assert (shard.all() == ids).all()
    for i in [0, len(ids) - 1, *rng.integers(0, len(ids), 500)]:
        assert shard.token(int(i)) == ids[i]
    with pytest.raises(IndexError):
        shard.token(len(ids))
    empty = dac.Shard(dac.pack([], np.zeros(0, int), np.zeros(0, np.uint32), levels))
    assert empty.n_ids == 0 and len(empty.all()) == 0


def test_store_query_is_the_whole_encoding(spark, library):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.op2_token_store(spark, SF).collect()}
    start = 0
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        row = got.pop(doc_id)
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_store_of_odd_rows(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = dac.write(df, dac.new_store(spark), shard_ids=20)
    back = dac.read(spark, path).orderBy("start").collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.ids == library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids + [2]
    assert [r.start for r in back] == list(np.cumsum([0] + [len(r.ids) for r in back])[:-1])
    for r in back:
        assert ODD[r.doc_id] != "a <|endoftext|> b" or 50256 in r.ids  # a special token in a text is that token
    every = [i for r in back for i in r.ids]
    places = spark.createDataFrame([(p,) for p in [*range(0, len(every), 7), len(every) - 1, len(every), -1]], "place long")
    assert {r.place: r.id for r in dac.lookup(spark, path, places).collect()} == {r.place: every[r.place] if 0 <= r.place < len(every) else None for r in places.collect()}
    empty = dac.write(df.limit(0), dac.new_store(spark))
    assert dac.digests(spark, empty).count() == 0


def test_rows_without_id_and_one_id_for_many(spark, library):
    rows = [(None, "b c"), (None, "b c"), (None, None), (7, "x"), (7, "y z"), (7, "x"), (0, "zero"), (-5, "less")]
    path = dac.write(spark.createDataFrame(rows, "doc_id long, text string"), dac.new_store(spark), partitions=3)
    back = dac.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None] * 3 + [-5, 0, 7, 7, 7]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in back), key=key) == sorted(((i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows), key=key)
    assert [r.doc_id for r in dac.digests(spark, path).orderBy("start").collect()] == [r.doc_id for r in back]


def test_texts_longer_than_a_chunk(spark):
    random.seed(9)
    texts = ["".join(random.choices("ab é'1 2.,!\n sdtl", k=200_000)), "x" * 150_000, " " * 90_000 + "end", "12" * 50_000]
    enc = bpe.encoding(*bpe._paths(None, None))
    rows = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), round_trip=True).collect()
    for r in rows:
        assert r.decoded.decode() == texts[r.doc_id]
        if r.doc_id == 0:
            assert r.ids == enc.encode_ordinary(texts[0])


def test_round_trip_query(spark):
    docs = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    enc = bpe.encoding(*bpe._paths(None, None))
    rows = queries.op10_byte_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = enc.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_encode_then_decode(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    back = bpe.decode(bpe.encode(df)).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode(df.limit(0)).count() == 0


def test_other_tokenizers_get_whole_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert dac.cut_like_bytes(public_tokenizers.path("byte_bpe_50k.json")) and not dac.cut_like_bytes(path)
    some, other = texts()[:300], Tokenizer.from_file(path)
    store = dac.write(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), dac.new_store(spark), tokenizer_path=path, end_id=None)
    assert {r.doc_id: r.ids for r in dac.read(spark, store).collect()} == {k: other.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(some)}


def test_lookup_joins_by_equal_bins(spark):
    store = dac.write(spark.createDataFrame([(k, "a b " * (k % 40)) for k in range(300)], "doc_id long, text string"), dac.new_store(spark), shard_ids=50)
    every = [i for r in dac.read(spark, store).orderBy("start").collect() for i in r.ids]
    found = dac.lookup(spark, store, spark.createDataFrame([(p,) for p in [*range(0, len(every), 3), -7, len(every)]], "place long"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.place: r.id for r in found.collect()} == {p: every[p] if 0 <= p < len(every) else None for p in [*range(0, len(every), 3), -7, len(every)]}
