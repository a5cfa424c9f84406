"""Readers: projections and filters that reach the scan, whatever the table is stored in."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postalloom.operators.ordering import numbered

ENCODINGS = ("utf-8", "gbk", "gb2312", "utf-8-sig", "latin1")
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def open_table(spark: SparkSession, name: str, url: str | None = None, **options: str) -> DataFrame:
    """A catalog table, or with ``url`` one of a database by JDBC (with partition options, read in parallel)."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load() if url else spark.table(name)


def filled_addresses(table: DataFrame, column: str, limit: int | None = None, keep: tuple[str, ...] = ("id", "offline_geocode")) -> DataFrame:
    """id, original_address and offline_geocode of rows whose address is neither null nor empty; no or a zero limit means all."""
    have = [c for c in keep if c in table.columns]
    rows = table.select(*have, F.col(column).alias("original_address")).where("original_address is not null and original_address <> ''")
    return rows.limit(limit) if limit else rows


def new_addresses(table: DataFrame, column: str, since, at: str = "create_time", limit: int | None = None) -> DataFrame:
    """As ``filled_addresses``, of rows made after ``since``, that instant excluded."""
    return filled_addresses(table.where(F.col(at) > F.lit(since).cast("timestamp")), column, limit, ("id", "offline_geocode", at))


def existing_clusters(table: DataFrame, faithful: bool = False) -> DataFrame:
    """Rows that belong to a group. An empty group_id is none, except in faithful mode."""
    return table.where("group_id is not null" if faithful else "group_id is not null and group_id <> ''")


def representatives(table: DataFrame, faithful: bool = False) -> DataFrame:
    """Each row of a group with the average score and number of rows of its address in the group.

    Clean mode joins on group and address; faithful mode on the group alone, so rows fan out.
    """
    rows = existing_clusters(table, faithful)
    stats = rows.groupBy("group_id", "standardized_address").agg(F.avg(F.col("similarity_score").cast("double")).alias("avg_similarity"), F.count("*").alias("cluster_size"))
    base = rows.select("group_id", "standardized_address", "coordinates", "similarity_score")
    if faithful:
        return base.join(stats.drop("standardized_address"), "group_id")
    return base.join(stats, ["group_id", "standardized_address"]).select(*base.columns, "avg_similarity", "cluster_size")


def distinct_page(table: DataFrame, column: str, limit: int = 20_000, offset: int = 0, flag: str | None = None, excluded: str | None = None, min_bytes: int = 5, order: str = "id") -> DataFrame:
    """A page of distinct addresses, numbered from 1 in their order: (id, address).

    Rows flagged ``excluded`` or with a null flag are left out, as are texts below ``min_bytes`` UTF-8 bytes. Only the page's last row
    bounds the sort, so a page is a top-k and not a full ranking in one task.
    """
    rows = table.where(F.col(column).isNotNull() & (F.octet_length(column) >= min_bytes))
    if flag:
        rows = rows.where(F.col(flag) != excluded)
    once = rows.groupBy(column).agg(F.min(order).alias("_first"))
    page = once.orderBy(column).limit(offset + limit)
    number = F.row_number().over(Window.orderBy(column))
    return page.select(number.cast("long").alias("id"), F.col(column).alias("address"), F.col("_first").alias("source_id")).where((F.col("id") > offset) & (F.col("id") <= offset + limit))


def load_file(spark: SparkSession, path: str, sample: int | None = None, schema=None, seed: int = 42) -> DataFrame:
    """CSV with a header, Parquet, or JSON by the ending of ``path``; optionally exactly ``sample`` rows, the same for a seed."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if ending == "csv":
        df = reader.option("header", True).option("encoding", "utf-8").csv(path)
    elif ending == "parquet":
        df = reader.parquet(path)
    elif ending == "json":
        df = read_json(spark, path, schema)
    elif ending in ("xlsx", "xls"):
        df = _excel(spark, path)
    else:
        raise ValueError(f"no reader for .{ending}")
    return sampled(df, sample, seed) if sample else df


def _excel(spark: SparkSession, path: str) -> DataFrame:
    """One sheet, read on the driver; needs a pandas engine for Excel, and the file where the driver can open it."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path))


def sampled(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, chosen by a seeded hash of the row: a top-n, not a shuffle of everything."""
    whole = F.xxhash64(F.lit(seed), F.to_json(F.struct(*df.columns)))
    return df.withColumn("_rank", whole).orderBy("_rank").limit(n).drop("_rank")


def head_of(spark: SparkSession, path: str, n: int) -> bytes:
    """The first ``n`` bytes of a file, of the first file in a folder, or of the first one that matches a pattern."""
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = paths.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(at) or []:
        inside = files.listStatus(found.getPath()) if found.isDirectory() else [found]
        for one in sorted((x.getPath() for x in inside if x.isFile() and x.getPath().getName()[0] not in "._"), key=str):
            stream = files.open(one)
            try:
                return bytes(stream.readNBytes(n))
            finally:
                stream.close()
    raise FileNotFoundError(path)


def read_csv_any(spark: SparkSession, path: str, probe_bytes: int = 1 << 20, multi_line: bool = True) -> DataFrame:
    """A CSV file in the first of ENCODINGS that decodes its beginning; a character that the probe splits is left off its end.

    Quoted fields may hold line ends, so a file is one task's stream; without ``multi_line`` it is split among tasks.
    """
    head = head_of(spark, path, probe_bytes)
    if head.startswith(BYTE_ORDER_MARK):
        return _decoded_csv(spark, path, "utf-8-sig", multi_line)
    for encoding in ENCODINGS:
        for cut in range(4 if len(head) == probe_bytes else 1):
            try:
                head[: len(head) - cut].decode(encoding)
            except UnicodeDecodeError:
                continue
            return _decoded_csv(spark, path, encoding, multi_line)
    return _decoded_csv(spark, path, "utf-8", multi_line)


def _decoded_csv(spark: SparkSession, path: str, encoding: str, multi_line: bool) -> DataFrame:
    """A CSV file in any of ENCODINGS. Those that Spark's reader doesn't know are read byte by byte as Latin-1, and each field is decoded.

    No byte of a character of theirs is a comma, a quote or a line end; one can be a backslash, so quotes are escaped by quotes.
    """
    known = {"utf-8": "utf-8", "utf-8-sig": "utf-8", "latin1": "iso-8859-1"}
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("encoding", known.get(encoding, "iso-8859-1"))
    raw = reader.csv(path)
    if encoding in known:
        return raw

    @F.pandas_udf(T.StringType())
    def decoded(fields: pd.Series) -> pd.Series:
        return fields.map(lambda x: None if x is None else x.encode("latin1").decode(encoding, "replace"))

    names = [c.encode("latin1").decode(encoding, "replace") for c in raw.columns]
    return raw.toDF(*[f"_{i}" for i in range(len(names))]).select(*[decoded(f"_{i}").alias(c) for i, c in enumerate(names)])


def read_json(spark: SparkSession, path: str, schema=None, probe_bytes: int = 1 << 20) -> DataFrame:
    """Rows of JSON files: one document to a line, or one document or array over several lines.

    The first line tells which: if it is a whole document, or longer than the probe, files are split by lines.
    """
    line, more, _ = head_of(spark, path, probe_bytes).lstrip().partition(b"\n")
    try:
        over_lines = bool(more) and json.loads(line) is None
    except ValueError:
        over_lines = True
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", over_lines).json(path)


def process_csv(spark: SparkSession, path: str, run, schema, batch_rows: int = 10_000) -> DataFrame:
    """``run`` (pandas frame to pandas frame) over a CSV file in batches of at most ``batch_rows``, spread over its partitions."""

    def batches(frames):
        for frame in frames:
            for at in range(0, len(frame), batch_rows):
                yield run(frame.iloc[at : at + batch_rows])

    return spark.read.option("header", True).csv(path).mapInPandas(batches, schema)


def by_index(table: DataFrame, index: int, order: str = "id") -> DataFrame:
    """The row at a position, from 0, in the order of ``order``; none beyond the last."""
    return numbered(table, [order], "_position").where(F.col("_position") == index).drop("_position")


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """A similarity matrix as ``sinks.save_edges`` wrote it: (id1, id2, sim)."""
    return spark.read.parquet(path).select("id1", "id2", "sim")


def newest(spark: SparkSession, pattern: str) -> DataFrame:
    """The CSV output that was written last among those that match ``pattern``."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    path = files.orderBy(F.desc("modificationTime"), F.desc("path")).first()["path"]
    return spark.read.option("header", True).csv(path)


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, modified) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
