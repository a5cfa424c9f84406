import base64
import hashlib
import random

import numpy as np
import pytest

from postalloom.llm import bpe
from tests.llm.common_rows import documents, frame

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    path = public.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return (*bpe.encoder(path, public.PATTERN), library)


def test_random_strings_equal_the_library(both):
    vocabulary, words, library = both
    r = random.Random(3)
    letters = " \n\t\x0b\x0c\r\x1c\x1f\x85   　​abcABC123!?'é中文\U0001f600sdtrevm.,²½"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randrange(1, 0xD800), r.randrange(0xE000, 0x11000)])) for _ in range(40)) for _ in range(500)]
    texts += ["abc" * 500, "a" * 300, "é" * 200, "<|endoftext|>", ""]
    for text, packed in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
        assert vocabulary.decode(packed) == text.encode()


def test_trees_alone_and_together_agree(both):
    vocabulary, _, library = both
    r = random.Random(4)
    pieces = [bytes(r.choice(b"abcdefgh etsrin") for _ in range(r.randint(1, 64))) for _ in range(400)]
    together = vocabulary.encode_pieces([p.decode() for p in pieces])
    for piece, packed in zip(pieces, together, strict=True):
        if piece not in vocabulary.ranks:
            assert np.frombuffer(packed, "<u4").tolist() == vocabulary.encode_long(piece)
    assert vocabulary.encode_long(b"x" * 20_000) == library.encode_ordinary("x" * 20_000)


def test_query(spark, tmp_path, both):
    library = both[2]
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(str(tuple(r)) for r in bpe.query(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = []
    for i, t, *_ in documents():
        ids = library.encode_ordinary(t or "")
        want.append(str((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
    assert found == sorted(want)


def test_other_columns_and_empty_tables(spark):
    done = bpe.encode(frame(spark), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    assert {"row", "keep", "ids", "decoded"} <= set(done.columns) and "text" not in done.columns
    assert done.count() == len(documents())
    assert bpe.encode(frame(spark, []), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).count() == 0
