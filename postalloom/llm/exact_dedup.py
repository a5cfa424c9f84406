"""Exact deduplication by two passes over a Bloom filter, in DataFrame expressions only.

Pass one counts how often each cell of the filter is hit and keeps, as bits, the cells hit twice or more.
Pass two asks the broadcast bits for each row: a row whose cell is hit only once has a text of its own and goes
straight to the result. Only the others, possible repeats, are shuffled and compared by SHA-256. The cells are in
proportion to the rows. More cells than may be broadcast at once are dealt out by digest over several rounds: the rows
are written once by round, without a shuffle, and each round has a filter of bounded size.

Nulls: a null text counts as empty, a null doc_id stays behind all others. Empty texts are one group. Very long texts
are hashed whole. Ties go to the smaller doc_id; of repeats of one row exactly one is kept. Other columns
are not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postalloom.llm.common import SPACES, cut, join_hot, table

NAME = "op8_exact_dedup"
ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

#: Cells for each row: one row in sixteen is compared for nothing.
CELLS_A_ROW = 16
#: Cells of one round's filter at most: 64 MB of bits, which are broadcast as rows of CHUNK words.
MOST_CELLS = 1 << 29
CHUNK = 1024


def without_spaces(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _cell(digest: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(cells).cast("long"))


def repeated_cells(digests: DataFrame, column: str, cells: int) -> DataFrame:
    """(chunk, bits): a bit for each cell, set for those hit twice or more; CHUNK words of 64 cells to a row."""
    hits = digests.select(_cell(F.col(column), cells).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("n >= 2")
    found = hits.select(F.expr("cell div 64").alias("word"), F.expr("shiftleft(1L, cast(cell % 64 as int))").alias("bits"))
    every = digests.sparkSession.range(max(1, cells // 64)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = found.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    chunks = words.groupBy(F.expr(f"word div {CHUNK}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return chunks.select("chunk", F.col("words.bits").alias("bits"))


def marked(digests: DataFrame, column: str, cells: int) -> DataFrame:
    """``digests`` with whether a row's ``column`` may repeat; not shuffled."""
    filter_ = cut(repeated_cells(digests, column, cells))
    at = digests.withColumn("_cell", _cell(F.col(column), cells)).join(F.broadcast(filter_), F.expr(f"_cell div {64 * CHUNK} = chunk"))
    bit = F.expr(f"shiftright(get(bits, cast(_cell div 64 % {CHUNK} as int)), cast(_cell % 64 as int)) & 1L")
    return at.select(*digests.columns, (bit == 1).alias("maybe"))


def split_repeats(digests: DataFrame, column: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows that may repeat, rows that surely don't) by ``column``; neither is shuffled."""
    bits = max(10, (CELLS_A_ROW * rows - 1).bit_length())
    most = MOST_CELLS.bit_length() - 1
    rounds = 1 << max(0, bits - most)
    if rounds == 1:
        found = marked(digests, column, 1 << bits)
    else:
        folder = f"{digests.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
        dealt = F.pmod(F.xxhash64(F.lit(1), F.col(column)), F.lit(rounds)).cast("int")
        digests.withColumn("_round", dealt).write.partitionBy("_round").parquet(folder)
        table = digests.sparkSession.read.schema(digests.withColumn("_round", dealt).schema).parquet(folder)
        parts = [cut(marked(table.where(F.col("_round") == i).select(*digests.columns), column, 1 << most)) for i in range(rounds)]
        found = reduce(DataFrame.unionByName, parts)
    return found.where("maybe").drop("maybe"), found.where("not maybe").drop("maybe")


def group(digests: DataFrame) -> DataFrame:
    """Rows of (doc_id, n_chars, digest) with keep_id, group_size and kept.

    The row with the most code points stays, then that with the smallest doc_id; null ids come last. Of
    repeats of one row (same doc_id and digest) exactly one is kept. No rows in, no rows out.
    """
    digests = cut(digests)
    repeats, alone = split_repeats(digests, "digest", digests.count())
    one = repeats.groupBy("digest", "doc_id", "n_chars").agg(F.count("*").alias("copies"))
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("id")))
    groups = one.groupBy("digest").agg(best.alias("best"), F.sum("copies").alias("group_size"), F.count("*").alias("weight"))
    groups = groups.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.col1")).alias("keep_chars"), "group_size", "weight")
    judged = join_hot(one, groups, ["digest"], "weight", ["doc_id", "n_chars"])
    keeper = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    judged = judged.select("doc_id", "keep_id", "group_size", keeper.alias("keeper"), "n_chars", "digest", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    judged = judged.select("doc_id", "keep_id", "group_size", (F.col("keeper") & (F.col("copy") == 1)).alias("kept"), "n_chars", "digest")
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "n_chars", "digest")
    return judged.unionByName(alone)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars of the whole text and the SHA-256 of the text without white space; null text: empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.char_length(text).alias("n_chars"), F.unhex(F.sha2(without_spaces(F.col("text")), 256)).alias("digest"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that stays of its group of equal texts."""
    found = group(digests(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
