import datetime
import gzip
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postalloom.config import EngineConfig
from postalloom.plans import cli, pipeline
from postalloom.sources import sinks, tables
from postalloom.streaming import incremental as stream


def addresses(spark, n=12):
    rows = [(i, f"浙江省杭州市西湖区文三路{i % 3 + 20}号", f'{{"offline_geocode":{{"gcj02":"{120 + (i % 3) / 5},30.25"}}}}', datetime.datetime(2024, 1, 1 + i)) for i in range(n)]
    return spark.createDataFrame([*rows, (100, None, None, None), (101, "", None, None)], "id long, address string, offline_geocode string, create_time timestamp")


def test_sources(spark, tmp_path):
    table = addresses(spark)
    assert tables.filled_addresses(table, "address").count() == 12 and tables.filled_addresses(table, "address", 3).count() == 3 and tables.filled_addresses(table, "address", 0).count() == 12
    assert tables.new_addresses(table, "address", "2024-01-11 00:00:00").count() == 1
    sinks.save(table, f"{tmp_path}/a.csv")
    sinks.save(table, f"{tmp_path}/a.parquet")
    assert tables.load_file(spark, f"{tmp_path}/a.csv").count() == tables.load_file(spark, f"{tmp_path}/a.parquet").count() == 14
    assert tables.load_file(spark, f"{tmp_path}/a.parquet", sample=5).count() == 5
    with pytest.raises(ValueError):
        tables.load_file(spark, "x.txt")
    with pytest.raises(ValueError):
        sinks.save(table, f"{tmp_path}/a.xyz")
    for encoding in ("utf-8", "gbk", "utf-8-sig"):
        Path(f"{tmp_path}/{encoding}.csv").write_text("a,b\n北京,1\n", encoding=encoding)
        row = tables.read_csv_any(spark, f"{tmp_path}/{encoding}.csv").first()
        assert (row[0], row[1]) == ("北京", "1")
    Path(f"{tmp_path}/d.json").write_text('{"a": [1, 2]}', encoding="utf-8")
    assert tables.read_json(spark, f"{tmp_path}/d.json").first()["a"] == [1, 2]
    Path(f"{tmp_path}/e.json").write_text('[{"a": 1},\n {"a": 2}]', encoding="utf-8")
    Path(f"{tmp_path}/f.json").write_text('{\n"a": 3\n}', encoding="utf-8")
    sinks.save(spark.range(7).withColumn("a", F.lit("x")).coalesce(1), f"{tmp_path}/g.json")
    for name, n in (("e", 2), ("f", 1), ("g", 7)):
        assert tables.load_file(spark, f"{tmp_path}/{name}.json").count() == n
    assert tables.load_file(spark, f"{tmp_path}/g.json", schema="id long, b string").where("b is null").count() == 7
    for encoding in ("utf-8", "gbk", "gb2312", "utf-8-sig"):  # quotes, line ends and a character whose second byte is a backslash in GBK
        odd = "乗" if encoding != "gb2312" else "乘"
        Path(f"{tmp_path}/odd_{encoding}.csv").write_text(f'地址,b\n"北京,""{odd}""\n二行",{odd}\n{odd},\n', encoding=encoding)
        rows = tables.read_csv_any(spark, f"{tmp_path}/odd_{encoding}.csv")
        assert rows.columns == ["地址", "b"] and [tuple(r) for r in rows.collect()] == [(f'北京,"{odd}"\n二行', odd), (odd, None)]
    Path(f"{tmp_path}/latin.csv").write_bytes("a,b\ncafé\xff,1\n".encode("latin1"))
    assert tuple(tables.read_csv_any(spark, f"{tmp_path}/latin.csv").first()) == ("café\xff", "1")
    Path(f"{tmp_path}/probe.csv").write_text("a\n" + "北" * 50 + "\n", encoding="utf-8")
    assert all(tables.read_csv_any(spark, f"{tmp_path}/probe.csv", probe).first()["a"] == "北" * 50 for probe in (9, 10, 11))
    with pytest.raises(FileNotFoundError):
        tables.head_of(spark, f"{tmp_path}/none*.csv", 5)
    flags = spark.createDataFrame([(1, "北京", "高校"), (2, "上海", None), (3, "上海市", "x"), (4, "ab", "x"), (5, "上海市", "x"), (6, "广州", "x")], "id long, a string, f string")
    assert [tuple(r)[:2] for r in tables.distinct_page(flags, "a", 10, 0, "f", "高校").orderBy("id").collect()] == [(1, "上海市"), (2, "广州")]
    assert [r["address"] for r in tables.distinct_page(flags, "a", 1, 1, "f", "高校").collect()] == ["广州"]


def test_file_sinks(spark, tmp_path):
    df = spark.range(25).withColumn("t", F.lit("x"))
    sinks.save_parts(df.coalesce(1), f"{tmp_path}/parts", 10)
    assert len(list(Path(f"{tmp_path}/parts").glob("part-*"))) == 3
    sinks.merge_parts(spark, f"{tmp_path}/parts", f"{tmp_path}/one")
    files = list(Path(f"{tmp_path}/one").glob("part-*"))
    assert len(files) == 1 and len(files[0].read_text().split()) == 26
    sinks.compress(spark, str(files[0]), f"{tmp_path}/gz")
    with gzip.open(next(Path(f"{tmp_path}/gz").glob("*.gz")), "rt") as lines:
        assert len(lines.read().split()) == 26
    df.write.parquet(f"{tmp_path}/t")
    sinks.overwrite(spark.read.parquet(f"{tmp_path}/t").where("id < 5"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 5
    assert tables.file_info(spark, str(files[0])).first()["bytes"] > 0


def test_compressed_files_stay_whole(spark, tmp_path):
    """A file that a reader would split, and small ones that it would put together, come back with one header each."""
    rows = spark.range(3000).select("id", F.lit("x" * 40).alias("t"))
    sinks.save_parts(rows.coalesce(1), f"{tmp_path}/parts", 1000)
    sinks.merge_parts(spark, f"{tmp_path}/parts", f"{tmp_path}/one")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for source, files, sizes in (("one", 1, (20_000, 0)), ("parts", 3, (1 << 27, 0))):
        before = [spark.conf.get(name) for name in names]
        for name, size in zip(names, sizes, strict=True):
            spark.conf.set(name, str(size))
        try:
            sinks.compress(spark, f"{tmp_path}/{source}", f"{tmp_path}/{source}-gz")
            sinks.decompress(spark, f"{tmp_path}/{source}-gz", f"{tmp_path}/{source}-plain.csv")
            assert [spark.conf.get(name) for name in names] == [str(x) for x in sizes]
        finally:
            for name, value in zip(names, before, strict=True):
                spark.conf.set(name, value)
        assert len(list(Path(f"{tmp_path}/{source}-plain.csv").glob("part-*"))) == files
        back = tables.load_file(spark, f"{tmp_path}/{source}-plain.csv").selectExpr("cast(id as long) id").collect()
        assert sorted(r["id"] for r in back) == list(range(3000))


def test_representatives_modes(spark):
    rows = spark.createDataFrame([("g", "a", "[1,2]", 0.5), ("g", "a", None, 1.0), ("g", "b", None, 0.1), ("", "c", None, 0.2), (None, "d", None, 0.3)], "group_id string, standardized_address string, coordinates string, similarity_score double")
    clean = {(r["standardized_address"], r["avg_similarity"], r["cluster_size"]) for r in tables.representatives(rows).collect()}
    assert clean == {("a", 0.75, 2), ("b", 0.1, 1)}
    assert tables.representatives(rows, True).where("group_id = 'g'").count() == 6


def test_full_then_incremental(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS postalloom_results")
    sinks.create_result_table(spark, "postalloom_results")
    sinks.create_result_table(spark, "postalloom_results")
    with pytest.raises(ValueError):
        sinks.create_result_table(spark, "x; drop table y")
    config = EngineConfig(minhash_permutations=32)
    table = addresses(spark)
    outcome, rows = pipeline.full_run(table, "address", config)
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["group_id"], set()).add(r["id"] % 3)
    assert sorted(map(sorted, groups.values())) == [[0], [1], [2]]
    sinks.append(rows, "postalloom_results")
    results = spark.table("postalloom_results")
    later = table.where("id < 2").withColumn("id", F.col("id") + 500)
    found = pipeline.incremental_run(later.unionByName(spark.createDataFrame([(600, "广东省广州市天河区天河路1号", None, datetime.datetime(2024, 1, 1))], later.schema)), "address", results, "2023-01-01 00:00:00", "r7", config)
    by = {r["id"]: r["group_id"] for r in found.collect()}
    old = {r["id"]: r["group_id"] for r in results.collect()}
    assert by[500] == old[0] and by[501] == old[1] and by[600] == "new_cluster_r7_1"
    assert pipeline.incremental_run(table, "address", results.where("false"), "2023-01-01 00:00:00", "r", config).count() == 12
    report = outcome.report()
    assert report["summary"].count() == 3 and report["quality"].first()["n_clusters"] == 3
    sinks.results(report, f"{tmp_path}/report")
    spark.sql("DROP TABLE postalloom_results")


def test_file_run(spark, tmp_path):
    df = addresses(spark).where("id < 100").select("address", F.lit("120.1").alias("lon"), F.lit("30.2").alias("lat"))
    sinks.save(df, f"{tmp_path}/in.csv")
    outcome = pipeline.file_run(spark, f"{tmp_path}/in.csv", "address", f"{tmp_path}/out", "lon", "lat", config=EngineConfig(minhash_permutations=32))
    assert outcome.labels.count() == 12 and Path(f"{tmp_path}/out/clusters.csv").is_dir()


def test_streams(spark, tmp_path):
    source = f"{tmp_path}/in"
    frame = spark.createDataFrame([(1, "a road", "p", "c", "d", "s", 30.0, 120.0, datetime.datetime(2024, 1, 1)), (2, "far", "q", "c", "d", "s", 10.0, 10.0, datetime.datetime(2024, 1, 1))], "id long, standardized string, province string, city string, district string, street string, lat double, lon double, create_time timestamp").withColumn("original", F.col("standardized"))
    frame.unionByName(frame).write.parquet(source)
    reps = frame.where("id = 1").select(F.lit("g1").alias("group_id"), F.lit(0).alias("rep_pos"), "standardized", "province", "city", "district", "street", "lat", "lon")
    query = stream.match_stream(spark.readStream.schema(frame.schema).parquet(source), lambda: reps, 0.85, f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination(120)
    rows = {r["id"]: r["group_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert rows[1] == "g1" and rows[2].startswith("new_cluster_") and len(rows) == 2
    plain = stream.process_stream(spark.readStream.schema(frame.schema).parquet(source), lambda b: b.select("id"), f"{tmp_path}/out2", f"{tmp_path}/cp2")
    plain.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out2").count() == 4


def test_cli():
    args = cli.arguments(["--threshold", "0.7", "full", "--source-table", "a", "--result-table", "b"])
    assert cli.settings(args).similarity_threshold == 0.7 and args.mode == "full"
