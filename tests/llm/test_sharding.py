import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postalloom.llm import sharding
from tests.llm.common_rows import documents, frame


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    key %= 1 << 64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_matches_the_published_algorithm(spark):
    keys = [0, 1, 2, 255, 1 << 40, (1 << 63) - 1, -1, -(1 << 63), *range(1000, 3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 100):
        for r in sharding.assign(df, "k", n).collect():
            assert (r["shard"], r["grown_shard"]) == (jump(r["k"], n), jump(r["k"], n + 1))
            assert r["grown_shard"] in (r["shard"], n)


def test_other_keys_and_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "k string")
    rows = sharding.assign(df, "k", 8).collect()
    assert rows[0]["shard"] == rows[3]["shard"] and rows[2]["shard"] == jump(0, 8)


def test_slots_have_no_gaps_and_keep_repeats(spark):
    df = frame(spark)
    placed = sharding.slots(sharding.assign(df, "doc_id", 8), "doc_id", "shard", ["doc_id", "text"])
    rows = placed.collect()
    assert len(rows) == len(documents()) and {"keep", "row", "label"} <= set(placed.columns)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_hot_repeats_are_counted_before_the_shuffle(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.slots(sharding.assign(df, "doc_id", 8), "doc_id", "shard", ["doc_id"]).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in rows)


def test_query(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sharding.query(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in documents())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {r["law"] for r in rows} == {"key"}
    assert sharding.query(spark, _empty(spark, tmp_path)).count() == 0


def _empty(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    return f"{tmp_path}/none"


def test_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, t) for i, t, *_ in documents() if len(t or "") < 3000] + [(-5, "minus"), (-(1 << 63), "least"), ((1 << 63) - 1, "greatest")]
    rows += [(i * 7919, f"text {i}") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = con.sql(sharding.ORACLE).select(*columns).fetchall()
    found = [tuple(r) for r in sharding.query(spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
