"""Corpus-wide line deduplication, in DataFrame expressions only.

The lines' hashes are range-partitioned and sorted by document and position, so one pass over each range
meets a key's first occurrence before the others. What comes back is a sparse bitmap per row: 64 lines
to a word, words without a dropped line left out. Keys that are very frequent are decided from aggregates and a
small broadcast, so no range is filled by one key. Texts are touched again only where a bitmap is applied: a broadcast
filter on the ids of documents with dropped lines tells which rows have to meet one, and only those are shuffled.

A row's lines are known by doc_id and text hash, so that rows which share a doc_id keep positions of their own.
Nulls: a null text is one empty line; a null doc_id is one document, below every other. Empty texts are one empty line. Very
long texts are split whole, within one task; no line is cut. Ties: lines of the one document that keeps a key all stay. Repeated
rows have equal results each. Clashing columns are carried as they are. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postalloom.llm.common import HOT_KEYS, SPACES, UPPER, cut, row, table

NAME = "op5_line_dedup"
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT a.*, b.keep IS NOT NULL AND a.doc_id <> b.keep AS dropped
  FROM keyed a LEFT JOIN shared b USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(dropped::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

MIN_CHARS = 40
MIN_DOCS = 5
KEY = ["h1", "h2"]
#: A row's identity: its document and a hash of its text.
ROW = ["doc_id", "copy"]
#: Cells of the filter: sixteen for each document with a dropped line, as a power of two, up to this bound, which is a broadcast of
#: MOST_CELLS / 64 rows. Beyond it more texts than necessary meet a bitmap, and the result is the same.
MOST_CELLS = 1 << 27


def copy_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("copy")


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, copy, pos, h1, h2) of each line whose key has at least ``min_chars`` code points."""
    lines = docs.select("doc_id", copy_hash(), F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("pos", "line"))
    bare = lines.select(*ROW, "pos", F.btrim(F.col("line"), F.lit(SPACES)).alias("bare")).where(F.char_length("bare") >= min_chars)
    key = F.translate(F.col("bare"), UPPER, UPPER.lower())
    return bare.select(*ROW, "pos", F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, copy, pos) of the lines to drop: those of a key in ``min_docs`` documents, but for its largest doc_id's."""
    found = cut(occurrences(docs, min_chars))
    counts = found.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    hot = cut(counts.orderBy(F.desc("n"), *KEY).limit(HOT_KEYS).select(*KEY, F.lit(True).alias("hot")))
    split = found.join(F.broadcast(hot), KEY, "left")

    last = F.desc_nulls_last("doc_id")
    few = split.where("hot is null").drop("hot").repartitionByRange(*KEY).sortWithinPartitions(*KEY, last, "copy", "pos")
    stream = Window.partitionBy(*KEY).orderBy(last)  # a document's own repeats share its rank
    ranked = few.withColumn("rank", F.dense_rank().over(stream)).withColumn("docs", F.max("rank").over(Window.partitionBy(*KEY)))
    cold_drops = ranked.where((F.col("rank") > 1) & (F.col("docs") >= min_docs)).select(*ROW, "pos")

    many = split.where("hot").drop("hot")
    firsts = many.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("first"))
    hot_drops = many.join(F.broadcast(firsts), KEY).where((F.col("docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("first"))).select(*ROW, "pos")
    return cold_drops.unionByName(hot_drops)


def bitmaps(drops: DataFrame) -> DataFrame:
    """(doc_id, copy, keep): per row the words that hold a dropped line, as (word, bits), bit set: line stays."""
    words = drops.groupBy(*ROW, F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    return words.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"))


def _cell(cells: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(cells).cast("long"))


def with_drops(docs: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose doc_id may be one of ``keep``'s, rows whose doc_id surely isn't); neither is shuffled."""
    cells = 1 << max(10, min(MOST_CELLS.bit_length() - 1, (16 * keep.count()).bit_length()))
    ids = keep.select(_cell(cells).alias("cell"))
    words = ids.groupBy(F.expr("cell div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 as int))")).alias("_bits"))
    marked = docs.select(row(docs), F.col("doc_id"), F.col("text")).withColumn("_cell", _cell(cells))
    marked = marked.join(F.broadcast(cut(words)), F.expr("_cell div 64 = _word"), "left")
    hit = F.expr("coalesce(shiftright(_bits, cast(_cell % 64 as int)) & 1L, 0L) = 1L")
    return marked.where(hit).select("row.*"), marked.where(~hit).select("row.*")


def apply_bitmaps(docs: DataFrame, keep: DataFrame, counts: bool = True) -> DataFrame:
    """``docs`` with text cut down to the lines that stay; the other columns as they were.

    Null text counts as one empty line. With ``counts``, n_lines and n_dropped are added, in place of columns of
    those names.
    """
    added = ["n_lines", "n_dropped"] if counts else []
    old = [c for c in docs.columns if c not in added]
    whole = F.coalesce(F.col("text"), F.lit("")).alias("whole")
    touched, alone = with_drops(docs, keep)
    rows = touched.select(row(touched, "text", *added), "doc_id", copy_hash(), whole)
    of = keep.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "keep")
    joined = rows.join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left")
    joined = joined.withColumn("lines", F.split("whole", "\n", -1))
    by_word, last = F.map_from_entries("keep"), F.expr("element_at(keep, -1).word")
    joined = joined.withColumn("words", F.when(F.col("keep").isNotNull(), F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(by_word[w], F.lit(-1).cast("long")))))
    stays = F.expr("array_join(filter(lines, (x, i) -> (shiftright(coalesce(get(words, i div 64), -1L), i % 64) & 1L) = 1L), '\\n')")
    gone = F.aggregate("keep", F.lit(0).cast("long"), lambda n, w: n + F.lit(64) - F.bit_count(w["bits"]).cast("long"))
    cut_down = F.when(F.col("keep").isNull(), F.col("whole")).otherwise(stays)

    def shaped(rows: DataFrame, text: Column, gone: Column, lines: Column) -> DataFrame:
        made = {"n_lines": lines.cast("long"), "n_dropped": gone}
        return rows.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in old], *[made[c].alias(c) for c in added])

    none = F.lit(0).cast("long")
    alone = alone.select(row(alone, "text", *added), whole)
    untouched = shaped(alone, F.col("whole"), none, F.size(F.split("whole", "\n", -1)))
    return shaped(joined, cut_down, F.coalesce(gone, none), F.size("lines")).unionByName(untouched)


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """``docs`` without the lines that other documents repeat. Rows sharing a doc_id count as one document, and each keeps lines of its own."""
    keep = cut(bitmaps(dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs)))
    return apply_bitmaps(docs, keep, counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of lines, of dropped lines, and the SHA-256 of what stays."""
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
