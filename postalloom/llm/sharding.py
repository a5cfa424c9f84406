"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame expressions only.

A key's shard depends on the key and the number of shards; there is no ring and no table. When a shard is
appended, each key stays or moves to the new shard. The generator is the paper's 64-bit linear congruential
one. Spark's checked arithmetic has no wrapping multiplication, so the 64-bit state is kept as two
halves of 32 bits whose partial products never leave a long.

Nulls: a null key is key 0, a null text is empty. Empty and very long texts count by their bytes, which are read whole. Ties and repeated rows:
rows of one key share a shard and have slots of their own. Clashing columns are carried as one struct, but for those that are
named as the result's, which are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postalloom.llm.common import row, table

NAME = "op1_jump_shards"
#: DuckDB has no CRC-32: its table of 256 entries is made by its rule, and each text's bytes run through it. Texts of megabytes are slow there.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
                          lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) AS c
    FROM range(256) r(i))),
hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (
  SELECT doc_id, length(h) // 2 + 1 AS size,
         list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b
  FROM hexed),
sized AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS text_crc32
  FROM bytes, crc_table),
keys AS (
  SELECT DISTINCT doc_id, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END AS key FROM documents),
jumps(doc_id, state, j) AS (
  SELECT doc_id, key, 0::BIGINT FROM keys
  UNION ALL
  SELECT doc_id, after, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / (after // 8589934592 + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, j, (state * 2862933555777941757 + 1) % 18446744073709551616 AS after FROM jumps WHERE j < 9)),
placed AS (SELECT doc_id, max(j) FILTER (WHERE j < 8) AS shard, max(j) FILTER (WHERE j < 9) AS grown FROM jumps GROUP BY doc_id),
firsts AS (SELECT doc_id, (key * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM keys),
buckets AS (SELECT doc_id, xor(((s % 4294967296) // 4096)::BIGINT, (s // 4294967296)::BIGINT) & 4095 AS bucket FROM firsts)
SELECT z.doc_id, z.size, z.text_crc32, 'key' AS law, p.shard::INT AS shard,
       row_number() OVER (PARTITION BY p.shard ORDER BY b.bucket, z.doc_id NULLS FIRST, z.size, z.text_crc32) - 1 AS slot, p.grown::INT AS grown_shard
FROM sized z JOIN placed p ON z.doc_id IS NOT DISTINCT FROM p.doc_id JOIN buckets b ON z.doc_id IS NOT DISTINCT FROM b.doc_id
"""

MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF
#: A key of n shards jumps about ln(n) times; 96 jumps are out of reach even for millions of shards.
MOST_JUMPS = 96
#: Slots are numbered in this many independent buckets of each shard.
SLOT_BUCKETS = 4096


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """The next state, (high, low), of state * MULTIPLIER + 1 modulo 2**64."""
    m_high, m_low = _long(MULTIPLIER >> 32), _long(MULTIPLIER & LOW)
    upper = F.shiftright(low, 16) * m_low
    base = low.bitwiseAND(_long(0xFFFF)) * m_low + _long(1) + F.shiftleft(upper.bitwiseAND(_long(0xFFFF)), 16)
    carry = F.shiftright(base, 32) + F.shiftright(upper, 16)
    own = high.bitwiseAND(_long(0xFFFF)) * m_low + F.shiftleft((F.shiftright(high, 16) * m_low).bitwiseAND(_long(0xFFFF)), 16)
    return (own + low * m_high + carry).bitwiseAND(_long(LOW)), base.bitwiseAND(_long(LOW))


def stable_key(df: DataFrame, column: str) -> Column:
    """The 64 bits that stand for a key: an integer itself, the XXH64 of anything else, 0 for null."""
    if isinstance(df.schema[column].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.coalesce(F.col(column).cast("long"), _long(0))
    return F.when(F.col(column).isNull(), _long(0)).otherwise(F.xxhash64(F.col(column)))


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard of ``shards`` and of ``shards + 1``, both from one run of draws."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(_long(LOW)).alias("low"),
        _long(0).alias("shard"), _long(0).alias("grown"), F.lit(False).alias("done"),
    )

    def draw(state: Column, _: Column) -> Column:
        high, low = _step(state["high"], state["low"])
        ratio = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + _long(1)).cast("double")
        landed = F.floor((state["grown"] + _long(1)).cast("double") * ratio)
        within = ~state["done"] & (landed <= _long(shards))
        return F.struct(
            high.alias("high"), low.alias("low"),
            F.when(within & (landed < _long(shards)), landed).otherwise(state["shard"]).alias("shard"),
            F.when(within, landed).otherwise(state["grown"]).alias("grown"),
            (state["done"] | (landed > _long(shards))).alias("done"),
        )

    def finish(state: Column) -> Column:
        whole = F.struct(state["shard"].cast("int").alias("shard"), state["grown"].cast("int").alias("grown"))
        return F.when(state["done"] | F.lit(shards + 1 <= MOST_JUMPS), whole).otherwise(F.raise_error(F.lit("a key needs more jumps than MOST_JUMPS")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards + 1, MOST_JUMPS))), start, draw, finish)


def assign(df: DataFrame, key: str, shards: int, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """``df`` with the row's shard and the shard it would have with one more; no shuffle. Null keys are key 0.

    The two new columns replace columns of those names. Equal keys share a shard, so rows of one key stay
    together; write with ``partitionBy(shard)``.
    """
    placed = df.select(row(df, shard, grown), jump(stable_key(df, key), shards).alias("jump"))
    return placed.select("row.*", F.col("jump.shard").alias(shard), F.col("jump.grown").alias(grown))


def slots(df: DataFrame, key: str, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """``df``'s rows numbered without gaps from 0 within each shard.

    Two passes of prefix sums: rows fall into SLOT_BUCKETS buckets by bits of their key's state, the buckets' sizes
    give each bucket's first slot (at most shards x SLOT_BUCKETS rows), and a window numbers each bucket.
    Rows that are equal in all columns are counted as one before the shuffle and spread out again after it,
    so repeats of one row do not gather in a task. ``order`` (columns of ``df``) orders a bucket.
    """
    high, low = _step(F.shiftrightunsigned(stable_key(df, key), 32), stable_key(df, key).bitwiseAND(_long(LOW)))
    bucket = F.shiftright(low, 12).bitwiseXOR(high).bitwiseAND(_long(SLOT_BUCKETS - 1)).cast("int")
    rows = df.select(row(df, slot), F.col(shard).alias("shard"), bucket.alias("bucket"), F.struct(*order).alias("order"))
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("size"))
    before = "coalesce(sum({}) over (partition by {} order by {} rows between unbounded preceding and 1 preceding), 0)"
    starts = sizes.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.expr(before.format("size", "shard", "bucket")).alias("start"))
    once = rows.groupBy("row", "shard", "bucket", "order").agg(F.count("*").alias("copies"))
    once = once.withColumn("after", F.expr(before.format("copies", "shard, bucket", "order")))
    placed = once.join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
    first = F.col("start") + F.col("after")
    return placed.select("row.*", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias(slot))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under law ``key``.

    size is the UTF-8 length plus 1 (null text: 1); text_crc32 that of the text (null: of the empty text).
    A null doc_id is placed as key 0. Rows with one doc_id share a shard and have slots of their own.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = assign(sized, "doc_id", 8)
    numbered = slots(placed, "doc_id", "shard", ["doc_id", "size", "text_crc32"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
