import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from postalloom.llm import exact_dedup
from tests.llm.common_rows import documents, frame


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        t = t or ""
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()].append((-len(t), i is None, i))
    out = []
    for sha, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        first = True
        for m in sorted(members, key=lambda m: (m[0], m[1], m[2] or 0)):
            out.append((m[2], best[2], len(members), m == best and first, sha))
            first = first and m != best
    return sorted(out, key=str)


def test_equals_brute_force(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.query(spark, str(tmp_path)).collect()]
    assert sorted(rows, key=str) == brute([(i, t) for i, t, *_ in documents()])


def test_one_of_each_group_is_kept_even_among_repeated_rows(spark):
    done = exact_dedup.group(exact_dedup.digests(frame(spark)))
    assert done.where("kept").count() == done.select("digest").distinct().count()


def test_empty(spark):
    assert exact_dedup.group(exact_dedup.digests(frame(spark, []))).count() == 0


def test_singles_pass_straight_through(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))).alias("text"))
    digests = exact_dedup.digests(df)
    repeats, alone = exact_dedup.split_repeats(digests, "digest", 5000)
    assert 1667 <= repeats.count() < 2100 and repeats.count() + alone.count() == 5000
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_more_rows_than_cells_go_in_rounds(spark, monkeypatch):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2500).cast("string").alias("text"))
    monkeypatch.setattr(exact_dedup, "MOST_CELLS", 1 << 14)
    done = exact_dedup.group(exact_dedup.digests(df))
    assert done.where("kept").count() == 2500 and done.where("group_size = 2").count() == 3000 and done.count() == 4000
    monkeypatch.setattr(exact_dedup, "CELLS_A_ROW", 1)
    monkeypatch.setattr(exact_dedup, "MOST_CELLS", 1 << 11)
    done = exact_dedup.group(exact_dedup.digests(df))
    assert done.where("kept").count() == 2500 and done.where("group_size = 2").count() == 3000


def test_each_round_passes_its_own_singles(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_CELLS", 1 << 15)
    digests = exact_dedup.cut(exact_dedup.digests(spark.range(9000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))))
    repeats, alone = exact_dedup.split_repeats(digests, "digest", 9000)
    assert repeats.count() < 1200 and repeats.count() + alone.count() == 9000
