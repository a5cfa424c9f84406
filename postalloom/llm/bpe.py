"""Byte-level BPE encoding and decoding with a segment tree.

A match starts as its bytes' tokens. A segment tree over the byte positions stores, for each range, the lowest
(rank, position) of a pair that starts there, so its root is the leftmost pair of minimum rank. A merge
changes three leaves, the merged token's, its left neighbour's and that of the token that is gone, and each
change climbs to the root: n bytes take O(n log n) steps. Short matches run many trees of one size at once
as numpy rows; long ones run alone.

Nulls: a null text is empty, a null doc_id is carried. An empty text has no tokens. Very long texts are encoded whole. Ties between pairs of
one rank go to the leftmost. Repeated rows are encoded each. Clashing columns are carried as one struct, but for those that are named as
the result's. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postalloom.llm.common import row, table, to_python
from postalloom.llm.pieces import WordEncoder, in_batches

NAME = "op10_byte_bpe"
ORACLE = None

#: Sizes of the trees that run together; a longer match has a tree of its own.
SIZES = (4, 8, 16, 32, 64)
NEVER = 1 << 60


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merged token, NEVER if there is none. A negative id has no pairs."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NEVER)

    def encode_long(self, piece: bytes) -> list[int]:
        """One match with a tree of its own."""
        n = len(piece)
        ids, after, before = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << max(1, (n - 1).bit_length())
        find = self.pairs.get
        top = NEVER << 32
        tree = [top] * (2 * size)
        for i in range(n - 1):
            rank = find(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(at: int, value: int) -> None:
            at += size
            tree[at] = value
            while at > 1:
                low = tree[at] if tree[at] < tree[at ^ 1] else tree[at ^ 1]
                at >>= 1
                if tree[at] == low:
                    break
                tree[at] = low

        def pair(at: int) -> int:
            if at < 0 or after[at] >= n:
                return top
            rank = find(ids[at] << 32 | ids[after[at]])
            return top if rank is None else rank << 32 | at

        while tree[1] < top:
            at, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            gone = after[at]
            ids[at], ids[gone], after[at] = rank, -1, after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, top)
            put(at, pair(at))
            if before[at] >= 0:
                put(before[at], pair(before[at]))
        return [x for x in ids if x >= 0]

    def encode_together(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Matches of at most ``size`` bytes, one tree to a row, one merge in every live row at a time."""
        n = len(pieces)
        flat = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        length = np.array([len(p) for p in pieces], np.int64)
        place = np.arange(size)
        ids = np.where(place < length[:, None], self.byte_ids[flat], -1)
        ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)  # column ``size``: after the end
        after = np.minimum(np.broadcast_to(place + 1, (n, size)), length[:, None])
        after = np.concatenate([np.where(after >= length[:, None], size, after), np.full((n, 1), size)], axis=1)
        before = np.broadcast_to(np.append(place - 1, size), (n, size + 1)).copy()  # -1 before the start
        tree = np.full((n, 2 * size), NEVER << 1, np.int64)
        first = self.rank_of(ids[:, :-2], ids[:, 1:-1])
        tree[:, size : 2 * size - 1] = np.where(first == NEVER, NEVER << 1, first * size + place[:-1])
        for i in range(size - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        while True:
            live = np.flatnonzero(tree[:, 1] < NEVER)
            if not live.size:
                break
            at, rank = tree[live, 1] % size, tree[live, 1] // size
            gone = after[live, at]
            follows = after[live, gone]
            ids[live, at], ids[live, gone], after[live, at] = rank, -1, follows
            before[live, follows] = at
            left = before[live, at]
            own = self.rank_of(ids[live, at], ids[live, follows])
            its = self.rank_of(np.where(left >= 0, ids[live, left], -1), ids[live, at])
            left = np.where(left >= 0, left, gone)
            rows = np.concatenate([live, live, live])
            node = np.concatenate([gone, at, left]) + size
            value = np.concatenate([np.full(len(live), NEVER), own, its])
            tree[rows, node] = np.where(value == NEVER, NEVER << 1, value * size + node - size)
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        ids = ids[:, :size]
        stays = ids >= 0
        packed, ends = ids[stays].astype("<u4").tobytes(), np.cumsum(stays.sum(axis=1) * 4).tolist()
        return [packed[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def encode_pieces(self, strings: list[str]) -> list[bytes]:
        """The packed ids of each match."""
        pieces = [x.encode("utf-8", "surrogatepass") for x in strings]
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > SIZES[-1]:
                out[i] = np.array(self.encode_long(piece), "<u4").tobytes()
            else:
                classes.setdefault(next(s for s in SIZES if s >= len(piece)), []).append(i)
        for size, members in classes.items():
            for i, ids in zip(members, self.encode_together([pieces[i] for i in members], size), strict=True):
                out[i] = ids
        return out

    def encode_matches(self, matches: list[str]) -> np.ndarray:
        """The ids of all matches in order; equal matches are encoded once."""
        distinct = list(set(matches))
        known = dict(zip(distinct, self.encode_pieces(distinct), strict=True))
        return np.frombuffer(b"".join(map(known.__getitem__, matches)), "<u4")

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tuple[Vocabulary, WordEncoder]:
    """One vocabulary and its words per worker process."""
    vocabulary, matches = Vocabulary(path), regex.compile(pattern).findall
    return vocabulary, WordEncoder(lambda text: vocabulary.encode_matches(matches(text)), vocabulary.tokens)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` without ``text`` but with its packed ids (little-endian 32-bit) and the bytes they decode to.

    Null text counts as empty and gives no ids. Columns called ``ids`` or ``decoded`` are replaced. No shuffle.
    """
    wanted = docs.select(row(docs, text, ids, decoded), F.col(text).alias("text"))
    schema = T.StructType([wanted.schema["row"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, words = encoder(path, pattern)
        for batch in batches:
            done = 0
            for texts in in_batches(batch.column("text").to_pylist()):
                packed = words.encode(texts)
                some = batch.slice(done, len(texts))
                done += len(texts)
                columns = [some.column("row"), pa.array(packed, pa.binary()), pa.array([vocabulary.decode(x) for x in packed], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    done = to_python(wanted).mapInArrow(run, schema)
    return done.select("row.*", F.col("ids").alias(ids), F.col("decoded").alias(decoded))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and the SHA-256 of its ids and of what they decode to."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
