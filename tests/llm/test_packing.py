import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postalloom.llm import packing
from tests.llm.common_rows import documents, frame

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", " <|endoftext|>\n", "x<|endoftext|>y  <|endoftext|> ", "<|endoftext|", "<|<|endoftext|>|>", "<|ENDOFTEXT|>"]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_special_strings_are_the_library_s_tokens(spark, reference):
    assert reference(SPECIAL[0]) == [64, 220, 50256, 275]
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack(docs, *packing.default_tokenizer()).collect()}
    assert got == {i: [*reference(t), 1] for i, t in enumerate(SPECIAL)}


def test_a_text_longer_than_many_windows(spark, reference):
    long = "many words that go on and on <|endoftext|> " * 30_000
    rows = packing.pack(spark.createDataFrame([(1, long)], "doc_id long, text string"), *packing.default_tokenizer()).collect()
    rows.sort(key=lambda r: r["start"])
    assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in rows]).tolist() == [*reference(long), 1]


def test_words_in_any_order_and_with_a_full_memory_give_the_same_ids(reference, monkeypatch):
    texts = [t or "" for _, t, *_ in documents()] + ["a  b", " \n x", "x\n y", "a \n \n b ", "t <|endoftext|> t", "trailing ", "\x1c \x1f a", *SPECIAL]
    encoder = packing.encoder(*packing.default_tokenizer())
    want = [reference(t) for t in texts]
    for most in (10**6, 20):
        monkeypatch.setattr(encoder.words, "most", most)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_windows(spark, tmp_path, reference):
    frame(spark).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = packing.pack(spark.read.parquet(f"{tmp_path}/documents.parquet"), *packing.default_tokenizer(), window=64).collect()
    ids = {}
    stream = sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in stream:  # gapless, full windows but the last
        assert (r["sequence_id"], r["offset"]) == divmod(at, 64)
        at += r["length"]
        ids.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    want = {}
    for i, t, *_ in documents():
        whole = reference(t or "") + [1]
        want.setdefault((i, len(whole)), []).append(whole)
    assert set(ids) == set(want)
    for key, wholes in want.items():
        assert sum(len(x) for _, x in ids[key]) == sum(map(len, wholes))
        if len(wholes) == 1:
            assert [t for _, x in sorted(ids[key]) for t in x] == wholes[0]


def test_query_digest(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.query(spark, str(tmp_path)).collect()
    assert all(r["offset"] + r["length"] <= 2048 for r in rows)
    empty = next(r for r in rows if r["doc_id"] == 1)
    assert (empty["length"], empty["doc_tokens"], empty["ids_crc32"]) == (1, 1, zlib.crc32(b"\x01\0\0\0"))


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), *packing.default_tokenizer()).select(F.count("*")).first()[0] == 0


def test_ids_beyond_16_bits(spark, reference):
    docs = spark.createDataFrame([(1, "some words here"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack(docs, *packing.default_tokenizer(), end=70_000).collect()}
    assert got == {1: [*reference("some words here"), 70_000], 2: [70_000], 3: [70_000]}
