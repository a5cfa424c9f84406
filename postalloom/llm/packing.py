"""Packing by concatenating and cutting.

Pass one tokenises each partition once, keeps the ids in a checkpoint and numbers the tokens within the partition. The
partitions' totals, one row each, give by prefix sums where each partition starts in the stream of all tokens.
Pass two cuts the stream into windows of fixed length; a document that crosses borders leaves one
record per window. Only the last window can be short. No document is shuffled.

Nulls: a null text is empty, a null doc_id is carried. An empty text is its end id alone. A very long text is tokenised whole, in one task,
and leaves as many records as it fills windows. Ties and repeated rows: each row is packed, as often as it comes. Of the
input's other columns none is used, so their names cannot clash. An empty table gives no records.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postalloom.llm.common import cut, give_back, table, to_python
from postalloom.llm.pieces import WordEncoder, in_batches

NAME = "op6_pack_windows"
ORACLE = None

WINDOW = 2048
#: Words whose ids a worker remembers: 50 MB, so that it stays small beside the other stages of a pipeline.
MOST_WORDS = 200_000
END = 1
#: Bytes of ids in one Arrow batch that leaves a worker.
BATCH_BYTES = 4 << 20


class Encoder:
    """Texts to ids as ``tokenizers`` gives them without added ids: a special token's string in a text is that token, and what stands
    between two of them is encoded by itself."""

    def __init__(self, words: WordEncoder, special: dict[str, int]):
        self.words = words
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.found = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian 32-bit integers."""
        split = [self.found.search(x) is not None for x in texts] if self.found else [False] * len(texts)
        if not any(split):
            return self.words.encode(texts)
        pieces = [self.found.split(x) if s else [x] for x, s in zip(texts, split, strict=True)]
        ids = iter(self.words.encode([p for own in pieces for p in own]))
        out = []
        for x, own in zip(texts, pieces, strict=True):
            parts = [next(ids)]
            for token in self.found.findall(x) if len(own) > 1 else ():
                parts += [self.special[token], next(ids)]
            out.append(b"".join(parts))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One tokenizer and its words per worker process.

    The file is one of the ``tokenizers`` library. Where its merges are in the order of their ids, as a byte-level
    vocabulary's are, ``tiktoken`` gives the same ids from the same file in a third of the time; any
    other file is left to ``tokenizers``. Special tokens that strip their surroundings or ask for whole words are an error.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = json.loads(Path(path).read_text(encoding="utf-8"))
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"]):
        raise ValueError("added tokens that strip or ask for whole words are not supported")
    added = {t["content"]: t["id"] for t in model["added_tokens"]}
    byte_of = byte_letters()
    tokens = [b""] * (max(model["model"]["vocab"].values()) + 1)
    for letters, i in model["model"]["vocab"].items():
        tokens[i] = bytes(byte_of[c] for c in letters) if all(c in byte_of for c in letters) else b""
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    special = set(added.values())
    if [model["model"]["vocab"]["".join(m)] for m in merges] == list(range(256, 256 + len(merges))):
        import tiktoken

        fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens) if i not in special}, special_tokens={})
        give_back()  # what the file's JSON took
        return Encoder(WordEncoder(lambda text: np.array(fast.encode_ordinary(text), "<u4"), tokens, MOST_WORDS), added)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return Encoder(WordEncoder(lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4"), tokens, MOST_WORDS), added)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such a file: itself if it is printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def tokenised(docs: DataFrame, path: str, pattern: str, end: int = END) -> DataFrame:
    """(doc_id, part, start, doc_tokens, ids): each document's ids with the id that ends it, 16 bits each or, where one needs more, 32; start counts the tokens before it in its partition."""
    wanted = docs.select("doc_id", F.col("text").alias("_text"))
    schema = T.StructType([wanted.schema["doc_id"], T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, start = encoder(path, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            done = 0
            for texts in in_batches(batch.column("_text").to_pylist()):
                ids, sizes = [], []
                for x in words.encode(texts):
                    tokens = np.frombuffer(x + closing, "<u4")
                    ids.append(tokens.astype("<u2").tobytes() if tokens.max() < 1 << 16 else tokens.tobytes())
                    sizes.append(len(tokens))
                counts = np.array(sizes, np.int64)
                starts = start + np.cumsum(counts) - counts
                start += int(counts.sum())
                columns = [batch.column("doc_id").slice(done, len(ids)), pa.array([part] * len(ids), pa.int32()), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())]
                done += len(ids)
                yield pa.RecordBatch.from_arrays(columns, schema.names)
            give_back()

    return to_python(wanted).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, pattern: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """The records of all windows: doc_id, start, length, ids (packed 32-bit), doc_tokens, sequence_id, offset.

    Null text is empty; an empty document is its end id. Repeated rows are packed as often as they come. An empty
    table gives no records. The order of the stream is that of the partitions and of the rows within.
    """
    staged = cut(tokenised(docs, path, pattern, end))
    totals = staged.groupBy("part").agg(F.max(F.col("start") + F.col("doc_tokens")).alias("total"))
    before = totals.selectExpr("part as _part", "coalesce(sum(total) over (order by part rows between unbounded preceding and 1 preceding), 0) as _before")
    placed = staged.join(F.broadcast(before), F.col("part") == F.col("_part")).select("doc_id", (F.col("_before") + F.col("start")).alias("at"), "doc_tokens", "ids")
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([placed.schema["doc_id"], *longs, T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[int]] = []
            ids: list[bytes] = []
            who: list[int] = []
            size = 0

            def flush() -> pa.RecordBatch:
                table = np.array(rows, np.int64).reshape(-1, len(longs))
                return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(who, pa.int64())), *(pa.array(table[:, i]) for i in range(len(longs))), pa.array(ids, pa.binary())], schema.names)

            for i, (at, n, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "doc_tokens", "ids")), strict=True)):
                tokens = np.frombuffer(packed, f"<u{len(packed) // n}").astype("<u4")
                start = 0
                while start < len(tokens):
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, len(tokens) - start)
                    rows.append([start, length, len(tokens), sequence, offset])
                    ids.append(tokens[start : start + length].tobytes())
                    who.append(i)
                    start, size = start + length, size + 4 * length
                    if size >= BATCH_BYTES:
                        yield flush()
                        rows, ids, who, size = [], [], [], 0
            if rows:
                yield flush()

    return to_python(placed).mapInArrow(run, schema)


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def digest(pieces: DataFrame, *more: str) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as records of windows of 2048 tokens."""
    return digest(pack(table(spark, sf_dir, "documents"), *default_tokenizer()))
